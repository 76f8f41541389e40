"""Problem 3: records that are one but for white space, letter case, punctuation or the order of the two fields.
Problem 5: the surviving record of each such group.

Method: each batch of rows goes as code points through a skip-and-fold table into polynomial hashes; rows that agree
on the unordered pair of hashes are compared with the group's first row by two skipping pointers. Rows that share
hashes with other letters (a collision) go on under a hash of their own kept letters, so no result hangs on luck.

Survivors are chosen by window ordering: of each group and field the usable value of the latest row, ties going to the
more complete row and then the smaller id. Slices of a group rank their own rows before their best meet.

Defined cases: NULL counts as empty; rows with neither letters nor digits form one group; a repeated id counts as one
row; extra columns are not read; an empty table gives no rows. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, instant
from .fold import letters_and_digits, poly_hashes, same_kept


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = letters_and_digits()
    for b in batches:
        first, second = (poly_hashes(b.column(c).to_pylist(), table) for c in ("first", "second"))
        x, y = np.stack(first[:2], 1), np.stack(second[:2], 1)
        swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
        lo, hi = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
        keys = [pa.array(np.ascontiguousarray(v)) for v in (lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("first"), b.column("second"), *keys], ["id", "first", "second", "k1", "k2", "k3", "k4"])


@F.pandas_udf(T.StringType())
def _split(first: pd.Series, second: pd.Series, rep_first: pd.Series, rep_second: pd.Series) -> pd.Series:
    """'' where the row has the letters of its group's first row, else a digest of its own."""
    table = letters_and_digits()
    out = []
    for a, b, c, d in zip(first, second, rep_first, rep_second, strict=True):
        if (same_kept(a, c, table) and same_kept(b, d, table)) or (same_kept(a, d, table) and same_kept(b, c, table)):
            out.append("")
        else:
            kept = sorted("".join(chr(table[ord(x)]) for x in s or "" if table[ord(x)]) for s in (a, b))
            out.append(hashlib.sha256("\0".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
    return pd.Series(out)


def groups(df: DataFrame, key: str = "book_id", first: str = "title", second: str = "author") -> DataFrame:
    """(id, group_id, copies) of every row that has a copy; group_id is the smallest id of the group."""
    rows = df.select(F.col(key).alias("id"), F.col(first).alias("first"), F.col(second).alias("second")).where(F.col("id").isNotNull())
    hashed = cut(rows.mapInArrow(_hashed, "id string, first string, second string, k1 long, k2 long, k3 long, k4 long"))
    keys = ["k1", "k2", "k3", "k4"]
    # The aggregate combines before the shuffle, so a hot group arrives as one row a task.
    several = hashed.groupBy(*keys).agg(F.min_by(F.struct("id", "first", "second"), "id").alias("rep"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(*keys, "rep")
    met = hashed.join(several, keys)
    named = met.select("id", *keys, _split("first", "second", "rep.first", "rep.second").alias("split"))
    named = cut(named)
    size = named.groupBy(*keys, "split").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("copies")).where("copies > 1")
    return named.join(size, [*keys, "split"]).select("id", "group_id", "copies").distinct()


def pairs(df: DataFrame, **fields: str) -> DataFrame:
    """Every pair of ids of a group, the smaller first."""
    g = groups(df, **fields).select("id", "group_id")
    return g.alias("a").join(g.alias("b"), (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("book_a"), F.col("b.id").alias("book_b"))


def records(df: DataFrame, key: str = "book_id", first: str = "title", second: str = "author") -> DataFrame:
    """One row a group, its smallest id's, with the number of copies; rows without a copy count 1."""
    g = groups(df, key, first, second)
    rows = df.select(F.col(key).alias("id"), F.col(first).alias("first"), F.col(second).alias("second"))
    kept = rows.join(g, "id", "left").where("group_id is null or group_id = id")
    return kept.select(F.col("id").alias(key), F.col("first").alias(first), F.col("second").alias(second), F.coalesce("copies", F.lit(1)).alias("copies"))


#: What people type where a value is missing, without white space and in lower case.
STAND_INS = ("", "-", "--", "—", "——", "/", "?", "？", ".", "n/a", "na", "n.a.", "nil", "null", "none", "nan", "tbd", "tba", "unknown", "undefined", "missing", "placeholder", "xxx", "未知", "不详", "不明", "暂无", "待补", "待定", "无", "没有", "佚名", "空")


def usable_text(c: str) -> F.Column:
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)[\s\p{Cf}]+", "")
    return ~bare.isin(*STAND_INS) & bare.rlike(r"[\p{L}\p{N}]")


def usable_cover(c: str) -> F.Column:
    """A file name that is no stand-in: stand-ins say so in words ('placeholder', 'default', 'no cover', 'missing')."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)[\s\p{Cf}]+", "")
    stem = F.regexp_replace(bare, r"\.(jpe?g|png|gif|webp|bmp|svg)$", "")
    return usable_text(c) & ~stem.isin(*STAND_INS) & ~bare.rlike(r"placeholder|default|no[-_ ]?cover|no[-_ ]?image|missing|blank|dummy|unknown")


def usable_isbn(c: str) -> F.Column:
    """Ten or thirteen characters with a right check digit, after 'ISBN', spaces and hyphens are taken away."""
    bare = F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), r"(?U)^\s*ISBN(-1[03])?[:：]?|[\s\-‐‑–—]+", "")
    digit = lambda i: F.when(F.substring(bare, i, 1) == "X", 10).otherwise(F.try_to_number(F.substring(bare, i, 1), F.lit("9")).cast("int"))
    ten = sum(((11 - i) * digit(i) for i in range(1, 11)), F.lit(0)) % 11 == 0
    thirteen = sum(((1 if i % 2 else 3) * digit(i) for i in range(1, 14)), F.lit(0)) % 10 == 0
    same = bare.rlike(r"^(\d)\1+$")
    return F.when(same, False).when(bare.rlike(r"^\d{9}[\dX]$"), ten).when(bare.rlike(r"^\d{13}$"), thirteen).otherwise(False)


USABLE = {"isbn": usable_isbn, "publisher": usable_text, "cover_file": usable_cover}


#: Slices into which a group's rows fall before its best meet.
SLICES = 64


def _best(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by window ordering. Slices of a key rank their own rows first, so that no task sorts a
    whole hot group: at most SLICES rows a key meet."""
    first = lambda d, *more: d.withColumn("r", F.row_number().over(Window.partitionBy(*keys, *more).orderBy(*order))).where("r = 1").drop("r")
    return first(first(rows.withColumn("slice", F.pmod(F.xxhash64("book_id"), F.lit(SLICES))), "slice")).drop("slice")


def _members(df: DataFrame) -> DataFrame:
    """The rows of groups with their instant, which fields are usable, and how many are."""
    g = groups(df).withColumnsRenamed({"id": "book_id"})
    flags = {f"ok_{f}": F.coalesce(check(f), F.lit(False)) for f, check in USABLE.items()}
    rows = df.select("book_id", "updated_at", *USABLE, *[v.alias(k) for k, v in flags.items()]).dropDuplicates(["book_id"])
    full = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return rows.withColumns({"at": F.coalesce(F.unix_micros(instant(F.col("updated_at"))), F.lit(-(2**62))), "full": full}).join(g, "book_id")


def _choices(members: DataFrame) -> DataFrame:
    """For each group and field the surviving row: the latest, then the more complete, then the smaller id."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"ok_{f}").alias("ok")) for f in USABLE])).alias("x")
    long = members.select("group_id", "book_id", "at", "full", fields).select("group_id", "book_id", "at", "full", "x.*").where("ok").drop("ok")
    return _best(long, ["group_id", "field"], [F.desc("at"), F.desc("full"), F.asc("book_id")]).select("group_id", "field", "book_id", "value")


def found_survivors(df: DataFrame) -> DataFrame:
    return _choices(_members(df)).select(F.col("group_id").alias("group_book_id"), "field", "book_id")


def survivors(df: DataFrame) -> DataFrame:
    """One built record a group: each field's surviving value and the latest updated_at of the group."""
    members = cut(_members(df))
    wide = _choices(members).groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in USABLE])
    head = members.groupBy("group_id").agg(F.max("copies").alias("copies"), F.max_by("updated_at", F.struct("at", "updated_at")).alias("updated_at"))
    return head.join(wide, "group_id", "left").withColumnRenamed("group_id", "group_book_id")


def ranked(df: DataFrame) -> DataFrame:
    """The best whole row of each group, by completeness, then trust, recency and the smaller id.

    A value is trusted by as many rows of its group as hold the same one; a row by the sum over its usable values.
    """
    members = cut(_members(df))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"ok_{f}").alias("ok")) for f in USABLE])).alias("x")
    long = members.select("group_id", "book_id", fields).select("group_id", "book_id", "x.*").where("ok")
    votes = long.groupBy("group_id", "field", "value").agg(F.count(F.lit(1)).alias("votes"))
    trust = long.join(votes, ["group_id", "field", "value"]).groupBy("book_id").agg(F.sum("votes").alias("trust"))
    rows = members.join(trust, "book_id", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    best = _best(rows, ["group_id"], [F.desc("full"), F.desc("trust"), F.desc("at"), F.asc("book_id")])
    return best.select(F.col("group_id").alias("group_book_id"), "book_id", "copies", F.col("full").alias("usable_fields"), "trust")
