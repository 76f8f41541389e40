"""Problem 4: matching entities across two tables that share no key.

Method: wishes and books reduce to forms (title, number of the part, author's entity). Forms meet in three ways: with
the same author, all of them, however many works the author has; where an author is missing, under the title without
one letter; with different authors, under the same title, where the names share a part or could be spellings of one
(names that share nothing are alike by 0, so such pairs are counted for the fit without being listed). Each pair has a
vector: the title's similarity, falling with the rate of typing errors, and
the author's: 1 for one entity, what the spellings share for two, and for a missing one its chance among the authors of
the title. A regularised mixture of Gaussians is fitted to all vectors without labels: two matched components (equal
titles, mistyped ones) and two unmatched ones (other title, other author). Every expectation step holds a wish's books
to transitivity: of wish, best book and another book, the other pair is no likelier than the two books being one work
and the best pair allow; for this each such pair of books has a vector of its own under the same model. Vectors are
counted by cells of a hundredth, on which all rounds run: on the driver where the cells are few (their number is
checked), else over their table, a row of sums a round. Each pair gets its posterior.

Tags were measured and left out: linked rows share a tag hardly more often (9 %) than unlike ones (6 %).

Defined cases: NULL and empty titles match nothing; a NULL, empty or stand-in author is missing; numbered parts match
only the same number; very long titles are compared whole; repeated rows share a form and each gets its pairs; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names
from .common import cut, release
from .lookalike import ALIKE, normal

#: At most so many rounds; fewer where the parameters stay within TOLERANCE.
ROUNDS, TOLERANCE = 10, 5e-3
#: Added to the variances: no component shrinks to a point.
RIDGE = 0.004
#: Vectors are (title, author). The components begin at corners, alike in spread and share: equal titles and mistyped ones
#: of one author, which are matched; other titles of one author, one title of other authors, which are not. And for each
#: part whether what lies beyond the mean, above (1) or below (-1), is no worse than the mean.
MEANS, SPREADS, SHARES = ((1.0, 1.0), (0.75, 1.0), (0.0, 1.0), (1.0, 0.0)), (0.05,) * 4, (0.25,) * 4
BEYOND = ((1, 1), (0, 1), (-1, 0), (0, -1))
MATCHED = 2
#: Titles less alike are unmatched under any fit, and need not be held to transitivity.
ALIKE_AT_ALL = 0.1
#: Cells of vectors up to which the rounds run on the driver: some 10 MB.
MOST_CELLS = 200_000
_LATIN_OF = {x: g[0] for g in ALIKE if g[0].isascii() and g[0].isalpha() for x in g[1:]}
_QUOTES = re.compile(r"^[\s“”\"'‘’「」『』《》〈〉【】\[\]]+|[\s“”\"「」『』《》〈〉~～!！?？.。…,，]+$")
#: Remarks that people add to a title.
_REMARK = re.compile(
    r"[\s\-–—_]*(?:[\[(（【〔]\s*(?:全本|求书|完结|完本|全集|连载|连载中|精校|精校版|校对版|未删节|未删减|文字版|扫描版|电子版|出版版?|e-?book|epub|txt|pdf|mobi|complete|completed|novel|full|unabridged|ongoing|wanted)\s*[\])）】〕]"
    r"|(?<=[\s\-–—])(?:精校版?|校对版|完结版?|全本|全集|求书|txt|epub|pdf|mobi|e-?book|novel|complete)(?:下载)?|(?<=\W)(?:全本|精校版))\s*$",
    re.I,
)
_ZH_NUMBER = {c: i for i, c in enumerate("零一二三四五六七八九十")}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_PART = [
    re.compile(r"[\s]*[(（]\s*(?P<n>[一二三四五六七八九十]{1,3}|\d{1,3}|[ivxIVX]{1,4})\s*[)）]$"),
    re.compile(r"[\s·:：,，]*第\s*(?P<n>[一二三四五六七八九十]{1,3}|\d{1,3})\s*[部卷季集册]$"),
    re.compile(r"[\s,，:：]*\b(?:book|part|vol|volume|no)\b\.?\s*(?P<n>\d{1,3}|[ivx]{1,4})$", re.I),
    re.compile(r"(?:\s+|(?<=[一-鿿]))(?P<n>\d{1,3})$"),
    re.compile(r"\s+(?P<n>II|III|IV|V|VI|VII|VIII|IX)$", re.I),
]


def _count(n: str) -> int:
    n = n.lower()
    if n.isdigit():
        return int(n)
    if n in _ROMAN:
        return _ROMAN[n]
    if "十" in n:
        a, _, b = n.partition("十")
        return (_ZH_NUMBER[a] if a else 1) * 10 + (_ZH_NUMBER[b] if b else 0)
    return _ZH_NUMBER.get(n[0], 0)


def title_parts(raw: str | None, of_char: dict[str, str] | None = None) -> tuple[str, str, int]:
    """(whole, main, number): folded letters of the title, of the part before a colon, and the number of the part."""
    if not raw:
        return "", "", 0
    v = re.sub(r"\s+", " ", re.sub(r"(?<=[A-Za-z])[._\-]+(?=[A-Za-z])|_", " ", normal(raw))).strip()
    number = 0
    for _ in range(5):
        w = _QUOTES.sub("", v).strip()
        if v[:1] in "【[〔" and v[-1:] in "】]〕" and not _REMARK.fullmatch(v):
            w = _QUOTES.sub("", v[:-1]).strip()
        if w.startswith(("(", "（")) and w.endswith((")", "）")) and not any(p.search(w) for p in _PART):
            w = w[1:-1].strip()
        w = re.sub(r"^[(（\[]+(?=[^)）\]]*$)|(?<=^)[-—]+", "", w)
        w = _REMARK.sub("", w).strip()
        if not number:
            for p in _PART:
                if (m := p.search(w)) and m.start():
                    number, w = _count(m.group("n")), w[: m.start()]
                    break
        if w == v:
            break
        v = w
    han = any("㐀" <= c <= "鿿" for c in v)
    if not han and any(c.isascii() and c.isalpha() for c in v):
        v = "".join(_LATIN_OF.get(c, c) for c in v)
    v = "".join(c for c in unicodedata.normalize("NFD", v.lower()) if not unicodedata.combining(c)) if not han else v.lower()
    v = re.sub(r"^(.*), (the|a|an)$", r"\2 \1", v.strip())
    main = re.split(r"[:：]|(?<=\w)- ", v, maxsplit=1)[0] if re.search(r"\w[^:：]*(?:[:：]|(?<=\w)- ).*\w", v) else v
    fold = lambda x: "".join((of_char or {}).get(c, c) for c in re.sub(r"[\W_]+", "", re.sub(r"^(?:the|a|an) ", "", x.strip())))
    if not han and " " not in v:  # glued words: an article may lead
        v, main = (re.sub(r"^(?:the|a)(?=[a-z]{6})", "", x) if x.startswith("the") else x for x in (v, main))
    return fold(v), fold(main), number


def _like(x: str, y: str) -> float:
    """Falls with the rate of typing errors, steepest at three in ten; each further error weighs more than the one before.

    One error in four letters gives 0.64, two in eight 0.51, two in six 0.25.
    """
    if x == y:
        return 1.0
    n = max(len(x), len(y))
    d = float(n - sum(min(x.count(c), y.count(c)) for c in set(x)))  # at least so many errors
    if d <= n / 2:
        d = float(names.distance(x, y, n))
    if d and len(x) == len(y) and sum(p == q for p, q in zip(x, y, strict=True)) > n / 2:
        differ = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
        if all(not names.simplified(p) or not names.simplified(q) for p, q in differ if not (p.isascii() and q.isascii())) and len(differ) < n / 2 and not x.isascii():
            d = min(d, 1.0)  # characters of another writing
    return 1.0 / (1.0 + (min(d * 1.15 ** min(d - 1.0, 20.0), n) / n / 0.29) ** 4) if d else 1.0


def title_similarity(a: tuple[str, str], b: tuple[str, str]) -> float:
    """1 for equal titles; the main part alone counts, a little less, where one side has no more."""
    whole = _like(a[0], b[0])
    if (a[0] == a[1]) != (b[0] == b[1]) and a[1] and b[1]:
        return max(whole, 0.97 * _like(a[1], b[1]))
    return whole


def author_similarity(a: str, b: str) -> float:
    """What two canonical forms share: how likely one is a spelling of the other, or half of their common parts."""
    if a == b:
        return 1.0
    if a[:2] != b[:2]:
        return 0.0
    x, y = a[3:], b[3:]
    ll = max(names.zh_likelihood(x, y), names.zh_likelihood(y, x)) if a[:2] == "zh" else names.la_likelihood(x, y)
    p, q = (set(x), set(y)) if a[:2] == "zh" else (set(x.split()), set(y.split()))
    return max(math.exp(ll / 4.0) if ll > names._NEVER else 0.0, 0.5 * len(p & q) / max(len(p), len(q), 1))


def _without_one(x: Column) -> Column:
    """A text and, from two letters on, the text without each letter."""
    cut_at = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.when(F.length(x) >= 2, F.array_distinct(F.concat(F.array(x), cut_at))).otherwise(F.array(x))


def _holes(main: str) -> Column:
    """Titles with at most one error share one of these."""
    x = F.col(main)
    return F.when(F.length(x) >= 4, _without_one(x)).otherwise(F.array(x))


def _half_holes(main: str) -> Column:
    """Titles with at most two errors share one of these: two errors leave at most one to a half.

    Lengths differ by two at most, so halves are taken for the title's own half length and one less. A half of a very
    long title is its own key only where it is whole, and is hashed without each letter otherwise.
    """
    x, n = F.col(main), F.length(main)
    halves = [_without_one(F.substring(x, at, h)) for h in (F.floor(n / 2), F.floor(n / 2) - 1) for at in (F.lit(1), n - h + 1)]
    tagged = [F.transform(k, lambda y, t=t: F.concat(F.lit(t), y)) for k, t in zip(halves, ("a", "z", "a", "z"), strict=True)]
    return F.when(n >= 8, F.array_distinct(F.concat(*tagged))).otherwise(_holes(main))


def _forms(rows: DataFrame, of_char: dict[str, str]) -> DataFrame:
    """(id, whole, main, number, author) of (id, title, author)."""
    kind = T.StructType([T.StructField("whole", T.StringType()), T.StructField("main", T.StringType()), T.StructField("number", T.IntegerType())])

    @F.pandas_udf(kind)
    def parts(title: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([title_parts(t, of_char) for t in title], columns=["whole", "main", "number"])

    return rows.select("id", parts("title").alias("p"), "author").select("id", "p.*", "author").where("whole <> ''")


class Mixture:
    """Matched and unmatched Gaussians with full covariances over vectors in [0, 1]**2."""

    def __init__(self) -> None:
        self.share = np.array(SHARES)
        self.mean = np.array(MEANS)
        self.cov = np.stack([np.eye(2) * v for v in SPREADS])

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The components' shares of each vector; rows are vectors."""
        logs = np.empty((len(x), len(BEYOND)))
        for k, sides in enumerate(BEYOND):
            d = x - self.mean[k]
            for j, side in enumerate(sides):
                if side:
                    d[:, j] = np.minimum(d[:, j], 0.0) if side > 0 else np.maximum(d[:, j], 0.0)
            inv = np.linalg.inv(self.cov[k])
            logs[:, k] = np.log(self.share[k] + 1e-9) - 0.5 * (np.einsum("ni,ij,nj->n", d, inv, d) + np.log(np.linalg.det(self.cov[k])))
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x)[:, :MATCHED].sum(1)

    def constrained(self, x: np.ndarray, best: np.ndarray, between: np.ndarray) -> np.ndarray:
        """The posterior of pairs, held to what their wish's best book allows: p(w,b) + p(w,best) <= 1 + p(best,b).

        best: the vectors of the wish and its best book; between: of that book and this one, NaN where it is the best.
        """
        p = self.posterior(x)
        rows = ~np.isnan(between[:, 0])
        if rows.any():
            p[rows] = np.clip(1.0 + self.posterior(between[rows]) - self.posterior(best[rows]), 0.0, p[rows])
        return p

    def sums(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expectation over cells v with counts n: of each component the sums that maximization takes."""
        x, each = v[:, :2], self.shares(v[:, :2])
        p = self.constrained(x, v[:, 2:4], v[:, 4:])
        # Within matched and unmatched the components share what transitivity leaves to each side.
        for ks, w in ((slice(0, MATCHED), p), (slice(MATCHED, len(BEYOND)), 1 - p)):
            each[:, ks] *= (w * n / np.maximum(each[:, ks].sum(1), 1e-300))[:, None]
        return each.T @ np.stack([np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2], 1)

    def refit(self, sums: np.ndarray) -> None:
        """Maximization."""
        for k, (w, a, b, aa, ab, bb) in enumerate(sums):
            self.share[k] = w
            if w > 1:  # an empty component stays where it was
                self.mean[k] = a / w, b / w
                self.cov[k] = np.array([[aa / w - (a / w) ** 2, ab / w - a * b / w**2], [ab / w - a * b / w**2, bb / w - (b / w) ** 2]]) + RIDGE * np.eye(2)
        self.share = np.clip(self.share / max(self.share.sum(), 1), 0.005, 0.99)

    def fit(self, cells: DataFrame, rounds: int) -> None:
        """Rounds over cells of vectors with their counts n: on the driver where there are few, else over the table."""
        got = cells.limit(MOST_CELLS + 1).toPandas()
        few = len(got) <= MOST_CELLS
        v, n = got[_VECTORS].to_numpy(float), got["n"].to_numpy(float)
        cells = cells if few else cut(cells)
        for _ in range(rounds):
            before = np.concatenate([self.mean.ravel(), self.cov.ravel()])
            self.refit(self.sums(v, n) if few else self._sums_of(cells))
            if np.abs(np.concatenate([self.mean.ravel(), self.cov.ravel()]) - before).max() < TOLERANCE:
                break

    def _sums_of(self, cells: DataFrame) -> np.ndarray:
        size = len(BEYOND) * 6

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(BEYOND), 6))
            for b in batches:
                total += self.sums(_matrix(b), b.column("n").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.ravel()], [f"s{i}" for i in range(size)])

        got = cells.mapInArrow(run, ", ".join(f"s{i} double" for i in range(size))).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]).first()
        return np.array([v or 0.0 for v in got]).reshape(-1, 6)


_VECTORS = ["x1", "x2", "t1", "t2", "y1", "y2"]


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in _VECTORS], 1)


def matched(books: DataFrame, wishes: DataFrame, restored: DataFrame | None = None, rounds: int = ROUNDS, transitive: bool = True) -> DataFrame:
    """(wish_id, book_id, confidence) of pairs that are rather one work than not.

    restored: (book_id, restored) of garbled titles. Title and author of a book may have changed places.
    """
    rows = books.select("book_id", "title", F.col("author").alias("raw")).dropDuplicates(["book_id"])
    if restored is not None:
        rows = cut(rows.join(restored, "book_id", "left").select("book_id", F.coalesce("restored", "title").alias("title"), "raw"))
    release(books.sparkSession)
    values, links, of_char = names.linked(books, wishes)
    links = cut(links.select("form", "canonical"))
    release(books.sparkSession)
    entity = cut(values.select("raw", "form").distinct().join(links, "form").select("raw", F.col("canonical").alias("author")))
    known = cut(rows.join(entity, "raw", "left"))  # read three times
    # An author that is no name but has letters is a title: the two fields have changed places.
    swapped = known.where("author is null").where(F.col("raw").rlike(r"\p{L}") & ~_stand_in("raw")).select("book_id", F.col("raw").alias("title"), F.col("title").alias("raw"))
    of_form = links.select("form", F.col("canonical").alias("author"))
    swapped = swapped.withColumn("form", names.form_of(of_char)("raw")).join(of_form, "form").select(F.col("book_id").alias("id"), "title", "author")
    plain = known.select(F.col("book_id").alias("id"), "title", "author").join(swapped.select("id"), "id", "left_anti")
    of_books = cut(_forms(plain.unionByName(swapped), of_char))
    w = wishes.where("library_book_id is null").select("id", "title", F.col("author").alias("raw")).dropDuplicates(["id"]).join(entity, "raw", "left").select("id", "title", "author")
    of_wishes = cut(_forms(w, of_char))
    release(books.sparkSession)

    key = ["whole", "main", "number", "author"]
    a, b = of_wishes.select(*key).distinct(), of_books.select(*key).distinct()
    both = a.unionByName(b).distinct()
    # How many authors a title has, over both tables: what a missing author's chance is.
    authors = cut(both.groupBy("main", "number").agg(F.count_distinct("author").alias("authors")))

    # Forms meet as 64-bit numbers under 64-bit keys; pairs that met fetch their texts and check what they met by.
    numbered = lambda d: cut(d.withColumn("form", F.xxhash64(*key)).join(authors, ["main", "number"]))
    a, b = numbered(a), numbered(b)
    met = _met(a, b)
    side = lambda d, s: d.select(*[F.col(c).alias(f"{s}_{c}") for c in ("form", *key, "authors")])
    met = met.join(side(a, "w"), "w_form").join(side(b, "b"), "b_form").where("w_number = b_number")
    one_title = F.expr("w_main = b_main and w_authors > 1 and w_author is not null and b_author is not null")
    vectors = cut(_vectors(met).select("w_form", "b_form", "x1", "x2", one_title.alias("one_title")))
    release(books.sparkSession)
    return _expanded(_posteriors(vectors, _strangers(a, b, vectors), b, key, rounds, transitive), of_wishes.withColumn("form", F.xxhash64(*key)), of_books.withColumn("form", F.xxhash64(*key)))


def _one_off(x: str) -> set[str]:
    """Texts with at most one error share one of these; of long ones it leaves one half whole, lengths may differ by one."""
    holes = {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))} if len(x) <= 40 else {x}
    return holes | ({y for k in (1, 2, 3) for h in ((len(x) - k) // 2,) for y in (f"a:{x[:h]}", f"z:{x[-h:]}")} if len(x) >= 40 else set())


def author_keys(author: str) -> list[str]:
    """Of any two names that are alike at all (author_similarity above 0) both have one of these."""
    core = author[3:]
    if author[:2] == "zh":  # all spellings keep a character
        return sorted(set(core))
    # Names of several parts have one in common, or a family name with one error; a name in one piece is compared whole.
    parts = core.split()
    whole = {*_one_off("".join(parts)), "".join(sorted(parts)), "".join(t for t in parts if len(t) > 1)}
    return sorted({f"{t} " for x in parts for t in (_one_off(x) if len(x) >= 5 else {x})} | whole)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """(w_form, b_form) of forms that share a key."""
    # The part before a colon, and the whole title: a colon may be lost.
    of = lambda keys: F.array_distinct(F.concat(keys("main"), F.array("whole")))
    keyed = lambda d, tag, keys, *more: d.select("form", F.explode(keys).alias("k"), "number", *more).select("form", F.xxhash64(F.lit(tag), "number", "k", *more).alias("key"))
    pair = lambda x, y: x.alias("a").join(y.alias("b"), F.col("a.key") == F.col("b.key")).select(F.col("a.form").alias("w_form"), F.col("b.form").alias("b_form"))
    # All works of one author, which also shows what unlike works share.
    of_author = lambda d: d.where("author is not null").select("form", F.xxhash64(F.lit("s"), "number", "author").alias("key"))
    same = pair(of_author(a), of_author(b))
    # A missing author: the side without one has one form a title, so no key holds many on both sides.
    title = lambda d: keyed(d, "t", of(_holes))
    bare = pair(title(a.where("author is null")), title(b)).unionByName(pair(title(a.where("author is not null")), title(b.where("author is null"))))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def spellings(author: pd.Series) -> pd.Series:
        return author.map(author_keys)

    # Different authors of one title: what problem 1 left apart may still be one person.
    other = lambda d: keyed(d.where(_SHARED), "o", spellings("author"), "main")
    return same.unionByName(bare).unionByName(pair(other(a), other(b))).distinct()


#: Forms whose title has other authors as well.
_SHARED = "author is not null and authors > 1"


def _strangers(a: DataFrame, b: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cells (x1, n) of pairs of one title and different authors whose names share nothing: those that did not meet."""
    of = lambda d, s: d.where(_SHARED).groupBy("main", "number", F.col("whole").alias(f"{s}_whole")).agg(F.count(F.lit(1)).alias(f"{s}_n"))
    each = of(a, "w").join(of(b, "b"), ["main", "number"])
    each = each.select(_title_similarity("w_whole", "main", "b_whole", "main").alias("x1"), (F.col("w_n") * F.col("b_n")).alias("n"))
    cells = each.unionByName(vectors.where("one_title").select("x1", F.lit(-1).cast("long").alias("n"))).groupBy(F.round("x1", 2).alias("x1"))
    return cells.agg(F.sum("n").alias("n")).where("n > 0")


@F.pandas_udf(T.DoubleType())
def _title_similarity(w_whole: pd.Series, w_main: pd.Series, b_whole: pd.Series, b_main: pd.Series) -> pd.Series:
    return pd.Series([title_similarity((p, q), (r, s)) for p, q, r, s in zip(w_whole, w_main, b_whole, b_main, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _author_similarity(w_author: pd.Series, b_author: pd.Series) -> pd.Series:
    return pd.Series([author_similarity(p, q) if p and q else None for p, q in zip(w_author, b_author, strict=True)], dtype=float)


def _vectors(met: DataFrame, one: str = "w", two: str = "b") -> DataFrame:
    """x1, x2 of pairs with the texts of both sides."""
    c = lambda s, n: F.col(f"{s}_{n}")
    alone = 1.0 / F.greatest(c(one, "authors"), c(two, "authors"), F.lit(1))
    author = F.coalesce(_author_similarity(c(one, "author"), c(two, "author")), 0.95 * alone)
    return met.withColumns({"x1": _title_similarity(c(one, "whole"), c(one, "main"), c(two, "whole"), c(two, "main")), "x2": author})


def _stand_in(c: str):
    return F.regexp_replace(F.lower(F.col(c)), r"(?U)[\s\p{P}]+", "").isin(*sorted({re.sub(r"[\W_]", "", x) for x in names.NO_AUTHOR}))


def _posteriors(vectors: DataFrame, strangers: DataFrame, b: DataFrame, key: list[str], rounds: int, transitive: bool) -> DataFrame:
    """(w_form, b_form, p): expectation-maximization with transitivity among the books of each wish.

    t1, t2 are the vector of the wish's best book by evidence, y1, y2 that of this book and the best one. strangers: cells
    of pairs that are no candidates and count in the fit.
    """
    w = Window.partitionBy("w_form")
    top = F.max(F.struct((F.col("x1") + F.col("x2")).alias("s"), "x1", "x2", F.col("b_form").alias("form"))).over(w)
    pairs = vectors.withColumn("top", top).select("w_form", "b_form", "x1", "x2", F.col("top.x1").alias("t1"), F.col("top.x2").alias("t2"), F.col("top.form").alias("best"))
    # Pairs of books that a wish ties, each once; what is unlike the wish is no work of its own accord.
    side = lambda s: b.select(*[F.col(c).alias(f"{s}_{c}") for c in ("form", *key, "authors")])
    tied = pairs.where(f"best <> b_form and x1 >= {ALIKE_AT_ALL}").select(F.col("best").alias("p_form"), F.col("b_form").alias("q_form")).distinct()
    tied = _vectors(tied.join(side("p"), "p_form").join(side("q"), "q_form"), "p", "q")
    tied = tied.select(F.col("p_form").alias("best"), F.col("q_form").alias("b_form"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    pairs = cut(pairs.join(tied, ["best", "b_form"], "left"))
    release(pairs.sparkSession)
    model = Mixture()
    cells = pairs.groupBy(*[F.round(c, 2).alias(c) for c in _VECTORS]).agg(F.count(F.lit(1)).alias("n"))
    # Unmatched under any fit, strangers tie nothing: each is its wish's best as far as they are concerned.
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    model.fit(cells.unionByName(strangers.select("x1", zero.alias("x2"), F.col("x1").alias("t1"), zero.alias("t2"), none.alias("y1"), none.alias("y2"), "n")), rounds)

    @F.pandas_udf(T.DoubleType())
    def posterior(x1: pd.Series, x2: pd.Series, t1: pd.Series, t2: pd.Series, y1: pd.Series, y2: pd.Series) -> pd.Series:
        v = np.stack([c.to_numpy(float) for c in (x1, x2, t1, t2, y1, y2)], 1)
        return pd.Series(model.constrained(v[:, :2], v[:, 2:4], v[:, 4:]) if transitive else model.posterior(v[:, :2]))

    return pairs.select("w_form", "b_form", posterior(*_VECTORS).alias("p"))


def _expanded(scored: DataFrame, of_wishes: DataFrame, of_books: DataFrame) -> DataFrame:
    good = scored.where("p >= 0.5").select("w_form", "b_form", "p")
    w = of_wishes.select(F.col("id").alias("wish_id"), F.col("form").alias("w_form"))
    b = of_books.select(F.col("id").alias("book_id"), F.col("form").alias("b_form"))
    # A book may stand in both orders of its fields: its better pair counts.
    return good.join(w, "w_form").join(b, "b_form").groupBy("wish_id", "book_id").agg(F.max("p").alias("confidence"))


def best_book(matches: DataFrame) -> DataFrame:
    """Of each wish's books the most probable one."""
    w = Window.partitionBy("wish_id").orderBy(F.desc("confidence"), "book_id")
    return matches.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
