"""Row-level changes of immutable tables: each returns the new state of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the greatest by the order columns. An aggregate, so a hot key combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key; a key twice among the new is an error of the caller (use keep_latest)."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti").select(*df.columns)


def change(df: DataFrame, ids: DataFrame, key: str, **values: Column) -> DataFrame:
    """Sets columns of the rows named by ids."""
    hit = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def clean_ids(ids: DataFrame, column: str) -> DataFrame:
    """Valid ids in the order of their first place, without repeats. ids has the columns pos and `column`."""
    v = F.lower(F.trim(F.col(column)))
    good = ids.select("pos", v.alias(column)).where(F.col(column).rlike("^[a-f0-9]{32}$"))
    return good.groupBy(column).agg(F.min("pos").alias("pos"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
