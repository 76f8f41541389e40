"""Problem 7: text that was decoded with a wrong character encoding.

Method: each value's encoding chain is latent. A chain says in which encoding the bytes were and in which they were
read; reading back gives the original. The likelihood of a value under a chain is that of the text read back, under the
corpus's own character frequencies; 'no chain' leaves the value as it is. Expectation-maximization learns how common
each chain is in each source and field, so weak evidence of one value leans on the others of its source; a value is
repaired under its most probable chain. Every reading that makes a value likelier at all takes part. A book's fields
have the site of its sections as source. The shares are a table with one row a source and field, joined to the values
in every round: sources may be as many as books. Only parts of a value that read back as valid text change.

Defined cases: NULL and empty values and NULL lines are no cases; a replacement character in a value always makes it a
case, which cannot be restored in full; very long values are read whole; repeated rows give one case; other columns are
not read; an empty table gives no rows. Text in a foreign language or script has no chain that reads back as valid text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fold import code_points
from .site_lines import row_lines

#: Fixed values: (true encoding, wrong encoding). Two steps of the first chain are a chain of their own.
SINGLE = {"utf-8>cp1252": "cp1252", "utf-8>mac_roman": "mac_roman", "utf-8>cp1251": "cp1251", "utf-8>koi8-r": "koi8-r", "utf-8>cp437": "cp437"}
DOUBLE = {"utf-8>gb18030": "gb18030", "utf-8>cp932": "cp932", "utf-8>big5": "big5"}
BY_GBK = {"gb18030>cp1252": "cp1252", "gb18030>mac_roman": "mac_roman"}
CHAINS = ["", *SINGLE, "utf-8>cp1252>cp1252", *DOUBLE, *BY_GBK, "gb18030>big5", "lost"]
ROUNDS = 4
#: Log-share that every chain has at first, and how many values' worth of its field's shares each source gets.
START, SHRINK = math.log(0.001), 50.0

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
#: Two characters or more, or one of the commonest marks: general punctuation, CJK punctuation, full-width forms.
_UTF8_RUN = re.compile(rb"(?:[\xe2-\xe9][\x80-\xbf]{2}|\xef\xbc[\x80-\xbf]){2,}|\xe2\x80[\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x80-\xbf]")
_LONE = re.compile("(?<=[A-Za-z])[一-龥](?=[a-z ,.;:!?’]|$)")
_IDEOGRAPH = re.compile("[一-龥]")
_PAIRS = re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+")
_ODD = re.compile("[\x80-\xb6\xb8-ſƒˆ˜Ѐ-ӿ‚√‰─-■-�｡-ﾟ]")
_WIDE = re.compile("[^\x00-\x7f]+")
#: Latin letters, marks, symbols, ideographs and full-width forms.
_USUAL = re.compile("[\xa0-ɏ\u2000-⟿\u3000-〿一-龥\uff00-｠]|[㐀-䶿]|.[̀-ͯ]")
_KANA = re.compile("[｡-ﾟ]")


@lru_cache(maxsize=16)
def _byte_of(encoding: str) -> dict[str, int]:
    """Characters of a one-byte encoding by what they were; bytes without a character stand for themselves."""
    out = {}
    for i in range(256):
        try:
            out[bytes([i]).decode(encoding)] = i
        except UnicodeDecodeError:
            out[chr(i)] = i
    if encoding == "cp1252":  # Latin-1 reads 0x80 to 0x9f as controls; both readings lead back
        for i in range(0x80, 0xA0):
            out.setdefault(chr(i), i)
    return out


def _segments(v: str, encoding: str) -> Iterator[tuple[int, int, bytes]]:
    """Runs of characters above ASCII that the encoding has, as its bytes."""
    table = _byte_of(encoding)
    for m in _WIDE.finditer(v):
        i = m.start()
        while i < m.end():
            if v[i] not in table:
                i += 1
                continue
            j = i
            while j < m.end() and v[j] in table:
                j += 1
            yield i, j, bytes(table[x] for x in v[i:j])
            i = j


def _by_single(v: str, encoding: str) -> str:
    out, last = [], 0
    for i, j, data in _segments(v, encoding):
        for m in _UTF8.finditer(data):
            text = m.group().decode("utf-8", "replace")
            if len(text) < 3 and not _USUAL.search(text):
                continue  # two letters of a foreign word can look like one character's bytes
            out += [v[last : i + m.start()], text]
            last = i + m.end()
    return "".join(out) + v[last:] if out else v


def _by_pairs(v: str, encoding: str) -> str:
    """GBK bytes read as a one-byte encoding: pairs may hold an ASCII character as their second byte."""
    out, last = [], 0
    for i, j, data in _segments(v, encoding):
        if i < last or len(data) < 2:
            continue
        if j < len(v) and len(data) % 2 and 0x40 <= ord(v[j]) < 0x7F:
            data, j = data + v[j].encode(), j + 1
        m = _PAIRS.match(data)
        if m:
            out += [v[last:i], m.group().decode("gb18030", "replace")]
            last = i + m.end()
    return "".join(out) + v[last:] if out else v


def _by_double(v: str, encoding: str, log_p: np.ndarray) -> str:
    """UTF-8 bytes read as a two-byte encoding: clusters of valid UTF-8 are read back where that makes likelier text."""
    if not _UTF8_RUN.search(v.encode(encoding, "ignore")):
        return v
    out, last = [], 0
    for m in _WIDE.finditer(v):
        pieces = [x.encode(encoding, "ignore") if x != "�" else b"\x00" for x in m.group()]
        data = b"".join(pieces)
        clusters: list[list[int]] = []
        for h in _UTF8_RUN.finditer(data):
            if clusters and h.start() - clusters[-1][1] <= 8:
                clusters[-1][1] = h.end()
            else:
                clusters.append([h.start(), h.end()])
        if not clusters:
            continue
        ends = np.cumsum([len(x) for x in pieces])
        for lo, hi in clusters:
            first = int(np.searchsorted(ends, lo, "right"))
            after = int(np.searchsorted(ends, hi, "left")) + 1
            i, j = m.start() + first, m.start() + after
            if i < last:
                continue
            tail = data[hi : ends[after - 1]]  # what the last character holds beyond: an ASCII byte is text
            text = re.sub("�+", "�", data[lo:hi].replace(b"\x00", b"\xff").decode("utf-8", "replace")) + (tail.decode("ascii", "ignore") if tail.strip(b"\x00") else "")
            if _ll(log_p, text) > _ll(log_p, v[i:j]):
                out += [v[last:i], text]
                last = j
    for m in _LONE.finditer(v):  # a single wide letter inside a Latin word
        data = m.group().encode(encoding, "ignore")
        if len(data) == 2 and data[0] == 0xC3 and 0x80 <= data[1] <= 0xBF and m.start() >= last:
            out += [v[last : m.start()], data.decode("utf-8")]
            last = m.end()
    return "".join(out) + v[last:] if out else v


@lru_cache(maxsize=1)
def _big5_as_gbk() -> np.ndarray:
    """What every code point reads as, GBK bytes having been read as Big5; -1 where it does not read back."""
    out = np.full(0x110000, -1, np.int32)
    out[:128] = np.arange(128)
    for i in range(128, 0x10000):
        try:
            x = chr(i).encode("big5").decode("gb18030")
        except UnicodeError:
            continue
        if len(x) == 1:
            out[i] = ord(x)
    return out


def _by_big5(v: str, log_p: np.ndarray) -> str:
    """GBK bytes read as Big5: character by character, in the stretch where that makes the text likelier by most."""
    codes = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32)
    read = _big5_as_gbk()[codes]
    step = np.where(read >= 0, log_p[read] - log_p[codes], -6.0)
    total = np.concatenate(([0.0], np.cumsum(step, dtype=float)))
    above = total - np.minimum.accumulate(total)
    hi = int(above.argmax())
    if above[hi] <= 0:
        return v
    lo = hi - 1 - int(total[:hi][::-1].argmin())
    text = "".join(chr(x) if x >= 0 else c for x, c in zip(read[lo:hi].tolist(), v[lo:hi], strict=True))
    return v[:lo] + text + v[hi:] if _IDEOGRAPH.search(text) else v


def _steps(log_p: np.ndarray) -> np.ndarray:
    """What each code point gains where it is read back as GBK read as Big5."""
    read = _big5_as_gbk()
    return np.where(read >= 0, log_p[np.maximum(read, 0)] - log_p, -6.0).astype(np.float32)


def may_be_big5(texts: list[str], steps: np.ndarray) -> np.ndarray:
    """Can any stretch of a text gain by being read back, the choice of the stretch paid for? All texts at once.

    No stretch gains more than the sum of the text's gaining characters, so what is refused here has no such reading.
    """
    codes, at = code_points(texts)
    n = np.diff(at)
    total = np.concatenate(([0.0], np.cumsum(np.maximum(steps[codes], 0.0), dtype=float)))
    return total[at[1:]] - total[at[:-1]] > np.log(np.maximum(n * (n + 1) / 2.0, 1.0)) - 1e-3


def readings(v: str, log_p: np.ndarray, big5: bool = True) -> list[tuple[int, str]]:
    """(number of a chain, the text read back) for the chains that change the value. 'lost': it cannot be read back.

    big5: could the value be GBK read as Big5? Asked for all values of a batch before.
    """
    out = []
    odd = _ODD.search(v)
    if odd:
        for name, encoding in SINGLE.items():
            x = _by_single(v, encoding)
            if x != v:
                out.append((CHAINS.index(name), x))
                if encoding == "cp1252" and (y := _by_single(x, encoding)) != x:
                    out.append((CHAINS.index("utf-8>cp1252>cp1252"), y))
        for name, encoding in BY_GBK.items():
            x = _by_pairs(v, encoding)
            if x != v:
                out.append((CHAINS.index(name), x))
    for name, encoding in DOUBLE.items():
        if encoding == "gb18030" or odd and (encoding != "cp932" or _KANA.search(v)):
            x = _by_double(v, encoding, log_p)
            if x != v:
                out.append((CHAINS.index(name), x))
    if big5 and (x := _by_big5(v, log_p)) != v:
        out.append((CHAINS.index("gb18030>big5"), x))
    if _lost(v):
        out.append((CHAINS.index("lost"), v))
    return out


def _lost(v: str) -> bool:
    """Replacement characters, or what became of them when they were wrongly decoded once more."""
    return "�" in v or "锟斤" in v or "斤拷" in v or "ï¿½" in v


# --- the corpus's character frequencies


def _codes(col: pa.Array) -> Iterator[np.ndarray]:
    """The code points of strings, some thousand strings at once, straight from their common buffer."""
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    for i in range(0, len(col), 20_000):
        part = col.slice(i, 20_000)
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, wide)[part.offset : part.offset + len(part) + 1]
        if at[-1] > at[0]:
            text = memoryview(data)[int(at[0]) : int(at[-1])].tobytes().decode("utf-8", "surrogatepass")
            yield np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for b in batches:
        for column in b.columns:
            col = column.drop_null()
            if pa.types.is_list(col.type):
                col = col.flatten().drop_null()
            for codes in _codes(col):
                n = np.bincount(codes)
                total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])


def frequencies(*tables: DataFrame) -> np.ndarray:
    """Log-probabilities of the code points up to the greatest one met; the last entry stands for all beyond it."""
    got = None
    for t in tables:
        part = t.mapInArrow(_counter, "code int, n long")
        got = part if got is None else got.union(part)
    n = np.zeros(0x110000)
    for r in got.groupBy("code").agg(F.sum("n").alias("n")).coalesce(1).toLocalIterator():  # one job
        n[r["code"]] = r["n"]
    n[0xFFFD] = 0
    total = n.sum() + 1
    top = int(np.flatnonzero(n)[-1]) + 1 if n.any() else 0
    return np.log((n[: top + 1] + 0.1) / total).astype(np.float32)


def _whole(log_p: np.ndarray) -> np.ndarray:
    """An entry for every code point: small tables travel, whole ones are made where they are used."""
    return np.concatenate([log_p, np.full(0x110000 - len(log_p), log_p[-1], np.float32)])


def _ll(log_p: np.ndarray, v: str) -> float:
    codes = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32)
    return float(log_p[codes].sum())


def _trimmed(v: str, x: str) -> tuple[str, str]:
    """What differs of the two, without their common head and tail."""
    n, m = 0, min(len(v), len(x))
    while n < m and v[n] == x[n]:
        n += 1
    k = 0
    while k < m - n and v[len(v) - 1 - k] == x[len(x) - 1 - k]:
        k += 1
    return v[n : len(v) - k], x[n : len(x) - k]


def weighed(v: str, log_p: np.ndarray, big5: bool = True) -> list[tuple[int, float, str]]:
    """(chain, log-likelihood over that of the value as it is, text) of each chain that could be."""
    out = []
    for chain, x in readings(v, log_p, big5):
        if CHAINS[chain] == "lost":
            out.append((chain, 20.0, x))  # no text holds a replacement character by itself
            continue
        a, b = _trimmed(v, x)
        gain = _ll(log_p, b) - _ll(log_p, a)
        if CHAINS[chain] == "gb18030>big5":  # the best of all stretches: each is as likely to be the garbled one
            gain -= math.log(len(v) * (len(v) + 1) / 2)
        if gain > 0:
            out.append((chain, gain + (20.0 if _lost(v) else 0.0), x))
    return out


_OUT = "source string, field string, book_id string, section_idx int, line_no int, value string, chains array<int>, gains array<double>, texts array<string>"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], _NAMES)


def _of_lines(log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(log_p)
        steps = _steps(whole)
        for b in batches:
            row, place, text = row_lines(b)
            out, seen = [], {}
            book, section, site = (b.column(c).to_pylist() for c in ("book_id", "section_idx", "site"))
            once = [v for v in dict.fromkeys(text) if v and not v.isascii()]
            for i in range(0, len(once), 20_000):
                part = once[i : i + 20_000]
                seen |= {v: w for v, big5 in zip(part, may_be_big5(part, steps).tolist(), strict=True) if (w := weighed(v, whole, big5))}
            for r, p, v in zip(row.tolist(), place.tolist(), text, strict=True):
                if w := seen.get(v):
                    out.append((site[r], "lines", book[r], section[r], p, v, *map(list, zip(*w, strict=True))))
            yield _batch(out)

    return run


def _of_fields(log_p: np.ndarray, fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(log_p)
        steps = _steps(whole)
        for b in batches:
            out = []
            for f in fields:
                once = [v for v in dict.fromkeys(b.column(f).to_pylist()) if v and not v.isascii()]
                seen = {v: w for v, big5 in zip(once, may_be_big5(once, steps).tolist(), strict=True) if (w := weighed(v, whole, big5))}
                for site, book, v in zip(*(b.column(c).to_pylist() for c in ("site", "book_id", f)), strict=True):
                    if w := seen.get(v):
                        out.append((site, f, book, -1, -1, v, *map(list, zip(*w, strict=True))))
            yield _batch(out)

    return run


def _posterior(prior: Column, chains: Column, gains: Column) -> Column:
    """Of each chain, the first for none: softmax of log-share and gain."""
    w = F.concat(F.array(prior[0]), F.zip_with(chains, gains, lambda c, g: F.get(prior, c) + g))
    e = F.transform(w, lambda x: F.exp(x - F.array_max(w)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _of_source(c: str = "source") -> Column:
    """A key of a source; NULL is one."""
    return F.coalesce(F.concat(F.lit("s:"), c), F.lit(""))


def _learned(values: DataFrame, sizes: DataFrame, rounds: int) -> DataFrame:
    """(key, field, prior): the log-share of every chain in each source and field, by expectation-maximization.

    Only sums by field and chain come to the driver: as many as there are chains and fields.
    """
    sizes = cut(sizes.groupBy(_of_source().alias("key"), "field").agg(F.sum("n").cast("double").alias("n")))
    field_n = {r["field"]: r["n"] for r in sizes.groupBy("field").agg(F.sum("n").alias("n")).collect()}
    prior = sizes.withColumn("prior", F.lit([0.0, *[START] * (len(CHAINS) - 1)]))
    for _ in range(rounds):
        p = F.slice(_posterior(F.col("prior"), F.col("chains"), F.col("gains")), 2, len(CHAINS))
        each = values.join(prior, ["key", "field"]).select("key", "field", F.explode(F.arrays_zip("chains", p.alias("p"))).alias("x"))
        mass = cut(each.groupBy("key", "field", F.col("x.chains").alias("chain")).agg(F.sum("x.p").alias("p")))
        whole = {f: [0.0] * len(CHAINS) for f in field_n}
        for r in mass.groupBy("field", "chain").agg(F.sum("p").alias("p")).collect():
            whole[r["field"]][r["chain"]] = r["p"]
        # A source's shares shrink to those of its field.
        of_field = F.lit(None).cast("array<double>")
        for f, n in field_n.items():
            of_field = F.when(F.col("field") == f, F.lit([SHRINK * (w + 0.1) / (n + 1) for w in whole[f]])).otherwise(of_field)
        own = mass.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "p"))).alias("own"))
        share = F.transform(of_field, lambda w, i: (w + F.coalesce(F.try_element_at("own", i), F.lit(0.0))) / (F.col("n") + SHRINK))
        rest = F.aggregate(F.slice("share", 2, len(CHAINS)), F.lit(0.0), lambda a, x: a + x)
        prior = sizes.join(own, ["key", "field"], "left").withColumn("share", share)
        prior = prior.withColumn("prior", F.transform(F.concat(F.array(F.greatest(F.lit(1e-6), 1 - rest)), F.slice("share", 2, len(CHAINS))), lambda x: F.log(x))).drop("own", "share")
    return prior.drop("n")


#: The fields of books that may be garbled.
FIELDS = ("title", "description")


def judged(books: DataFrame, sections: DataFrame, lines: bool = True, rounds: int = ROUNDS, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every affected value: its place, the most probable chain, its posterior and the text read back.

    lines=False and fewer fields judge these alone, with the same character frequencies, and as each field has shares of
    its own with the same result.
    """
    own_sections = sections.select("book_id", "section_idx", "site", "lines")
    sites = sections.groupBy("book_id").agg(F.min("site").alias("site"))
    log_p = frequencies(books.select(*FIELDS), own_sections.select("lines"))
    own_books = books.select("book_id", *fields).join(sites, "book_id", "left")
    values = own_books.mapInArrow(_of_fields(log_p, fields), _OUT)
    if lines:
        values = values.unionByName(own_sections.mapInArrow(_of_lines(log_p), _OUT))
    values = cut(values.withColumn("key", _of_source()))
    sizes = own_books.groupBy(F.col("site").alias("source")).agg(*[F.count(f).alias(f) for f in fields]).select("source", F.stack(F.lit(len(fields)), *[x for f in fields for x in (F.lit(f), F.col(f))]).alias("field", "n"))
    if lines:
        sizes = sizes.unionByName(own_sections.groupBy(F.col("site").alias("source")).agg(F.sum(F.greatest(F.size("lines"), F.lit(0)).cast("long")).alias("n")).withColumn("field", F.lit("lines")))
    prior = _learned(values, sizes, rounds)
    p = values.join(prior, ["key", "field"]).withColumn("p", _posterior(F.col("prior"), F.col("chains"), F.col("gains")))
    # Chain 0 leaves the value as it is; of the others the most probable repairs it.
    best = F.array_max(F.transform(F.slice("p", 2, len(CHAINS)), lambda x, i: F.struct(x.alias("p"), (-i).alias("at"))))
    p = p.withColumn("best", best).where(F.element_at("p", 1) < 0.5)
    names = F.array(*[F.lit(c) for c in CHAINS])
    return p.select("field", "book_id", "section_idx", "line_no", "source", "value", F.element_at(names, F.element_at("chains", 1 - F.col("best.at")) + 1).alias("chain"), (1 - F.element_at("p", 1)).alias("posterior"), F.element_at("texts", 1 - F.col("best.at")).alias("restored"))


def found(books: DataFrame, sections: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    return judged(books, sections, rounds=rounds).select("field", "book_id", "section_idx", "line_no").distinct()


def repaired(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Affected values with their original text; `whole` says whether nothing of it was lost."""
    return judged(books, sections).withColumn("whole", ~F.col("restored").contains("�") & (F.col("chain") != "lost")).drop("source").distinct()
