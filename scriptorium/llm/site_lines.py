"""Problem 2: lines repeated across one site's documents.

Method: every line's documents are kept as compressed bitmaps per site. One pass over the text numbers each task's
rows and writes, for each line, a container of the rows that hold it: a sorted list of 16-bit positions, or 8 KB of
bits where that is smaller. Containers of two tasks never overlap, so a line's bitmap is the union of its containers
and its exact cardinality the sum of theirs. Spellings of a line (other case, spaces, punctuation, digits) are united
by a polynomial hash of their letters as the containers are made. Lines over the threshold are looked up in the
containers, whose bits, by way of a directory of each container's rows, name the occurrences to delete. The text is
read once; nothing but hashes and positions is shuffled.

The repeated lines are few by proof: each covers at least `share` of its site's rows, so a site has at most (mean
distinct lines of a row) / share of them.

Defined cases: NULL and empty arrays and NULL lines have no lines but count as rows of the site; a NULL site is a site
of its own; a line twice in one row counts once, and both occurrences are found; lines without letters are never
repeated lines. Very long lines are hashed whole; repeated rows count as rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fold import letters, poly_hashes

CONTAINER = 1 << 16
#: Lines after which a block closes before its rows are full: a block's arrays take some 100 bytes a line.
BLOCK_LINES = 1_000_000
#: Different books that a container names: thresholds above it are refused.
BOOKS = 16
#: Repeated lines are broadcast up to so many; beyond, they meet the containers by a shuffle.
MOST_BROADCAST = 200_000
_SCHEMA = "site string, h1 long, h2 long, container long, n long, books array<long>, bitmap binary, places array<int>, times array<int>, row_book array<string>, row_section array<int>"


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit positions as a container: a list of up to 4,095 of them, else 65,536 bits."""
    if len(low) < 4096:
        return low.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < 8192:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def row_lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    """For each line of the batch: its row, its place in the row, its text."""
    col = batch.column("lines")
    sizes = np.asarray(col.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, col.drop_null().flatten().to_pylist()


def _block(container: int, names: list, held: list[tuple], ids: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The records of one block of at most 65,536 rows: a container a line, then the directory of the rows."""
    h1, h2, site, low, place = (np.concatenate([h[i] for h in held]) for i in range(5))
    order = np.lexsort((place, low, h2, h1, site))
    h1, h2, site, low, place = (x[order] for x in (h1, h2, site, low, place))
    book_of = np.asarray([hash_book(b) for b, _ in ids], np.int64)
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (site[1:] != site[:-1])
    first = new.copy()  # of its row
    first[1:] |= low[1:] != low[:-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(h1))
    bitmaps, counts, books, times = [], [], [], []
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        if b - a == 1:
            bitmaps.append(low[a : a + 1].astype("<u2").tobytes())
            counts.append(1)
            books.append(book_of[low[a : a + 1]])
            times.append(None)
        else:
            own = np.flatnonzero(first[a:b])
            rows = low[a:b][own]
            bitmaps.append(pack(rows))
            counts.append(len(rows))
            books.append(np.unique(book_of[rows])[:BOOKS])
            times.append(None if len(own) == b - a else np.diff(np.append(own, b - a)))
    n = len(at)
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(h1)), pa.int32()), pa.array(place, pa.int32()))
    names_of = pa.DictionaryArray.from_arrays(pa.array(site[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
    ls = pa.list_(pa.string()), pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [names_of, pa.array(h1[at]), pa.array(h2[at]), pa.array(np.full(n, container, np.int64)), pa.array(counts, pa.int64()), pa.array(books, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()), places, pa.array(times, pa.list_(pa.int32())), pa.nulls(n, ls[0]), pa.nulls(n, ls[1])],
        names=[x.split()[0] for x in _SCHEMA.split(", ")],
    )
    none = [pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays(
        [*none, pa.array([container], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.nulls(1, ls[1]), pa.nulls(1, ls[1]), pa.array([[b for b, _ in ids]], ls[0]), pa.array([[s for _, s in ids]], ls[1])],
        names=[x.split()[0] for x in _SCHEMA.split(", ")],
    )


def hash_book(book: str | None) -> int:
    """64 bits that tell books apart: only whether there are three different ones is asked."""
    import xxhash

    return xxhash.xxh3_64_intdigest(book or "") - (1 << 63)


def _fitting(batch: pa.RecordBatch, begin: int, rows: int, lines: int) -> int:
    """How many of a batch's rows from a place on the block still takes: one at least."""
    sizes = np.cumsum(np.asarray(batch.column("lines").slice(begin, rows).value_lengths().fill_null(0)))
    return int(min(len(sizes), max(1, np.searchsorted(sizes, lines) + 1)))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, table = TaskContext.get().partitionId(), letters()
    names: list = []
    index: dict = {}
    held: list[tuple] = []
    ids: list[tuple] = []
    block = lines = 0
    for whole in batches:
        done = 0
        while done < whole.num_rows:
            b = whole.slice(done, _fitting(whole, done, CONTAINER - len(ids), BLOCK_LINES - lines))
            done += b.num_rows
            row, place, text = row_lines(b)
            h1, h2, kept = poly_hashes(text, table)
            sites = b.column("site").to_pylist()
            for s in sites:
                if s not in index:
                    index[s] = len(names)
                    names.append(s)
            site = np.asarray([index[s] for s in sites], np.int64)[row] if len(row) else np.zeros(0, np.int64)
            ok = kept > 0
            held.append((h1[ok], h2[ok], site[ok], row[ok] + len(ids), place[ok]))
            ids += zip(b.column("book_id").to_pylist(), b.column("section_idx").to_pylist(), strict=True)
            lines += len(row)
            if len(ids) == CONTAINER or lines >= BLOCK_LINES:
                yield from _block((part << 24) + block, names, held, ids)
                held, ids, block, lines = [], [], block + 1, 0
    if ids:
        yield from _block((part << 24) + block, names, held, ids)


def line_bitmaps(sections: DataFrame) -> DataFrame:
    """A container for each line of each block of rows, and a directory for each block, written to the shared folder."""
    return cut(sections.select("site", "book_id", "section_idx", "lines").mapInArrow(_containers, _SCHEMA))


def _of_lines(lines: DataFrame, few: DataFrame) -> DataFrame:
    """The containers of a few lines."""
    few = few.select(*[c for c in ("site", "h1", "h2", "n") if c in few.columns]).withColumnsRenamed({"site": "its_site", "h1": "its_h1", "h2": "its_h2", "n": "its_n"})
    few = F.broadcast(few) if few.count() <= MOST_BROADCAST else few
    return lines.join(few, F.col("site").eqNullSafe(F.col("its_site")) & (F.col("h1") == F.col("its_h1")) & (F.col("h2") == F.col("its_h2")))


def repeated_lines(sections: DataFrame, bitmaps: DataFrame, share: float = 0.05, least_rows: int = 5, least_books: int = 3) -> DataFrame:
    """(site, h1, h2, n) of the lines that are repeated within their site."""
    if least_books > BOOKS:
        raise ValueError(f"least_books is at most {BOOKS}")
    rows = sections.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows"))
    lines = bitmaps.where("h1 is not null")
    totals = lines.groupBy("site", "h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows)
    rows = rows.withColumnRenamed("site", "its_site")
    often = totals.join(rows, F.col("site").eqNullSafe(F.col("its_site"))).where(F.col("n") >= share * F.col("site_rows")).select("site", "h1", "h2", "n")
    often = cut(often)
    books = _of_lines(lines, often).select("site", "h1", "h2", F.col("its_n").alias("n"), F.explode("books").alias("book"))
    return books.groupBy("site", "h1", "h2", "n").agg(F.count_distinct("book").alias("books")).where(F.col("books") >= least_books).drop("books")


def _look_up(key: tuple, hits: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
    rows, places = [], []
    for bitmap, place, times in zip(hits["bitmap"], hits["places"], hits["times"], strict=True):
        own = unpack(bitmap)
        rows.append(own if times is None else np.repeat(own, times))
        places.append(np.asarray(place, np.int64))
    if not rows or not len(directory):
        return pd.DataFrame({"book_id": pd.Series([], dtype=object), "section_idx": pd.Series([], dtype="int32"), "line_no": pd.Series([], dtype="int32")})
    at = np.concatenate(rows)
    book, section = np.asarray(directory["row_book"].iloc[0], object), np.asarray(directory["row_section"].iloc[0], object)
    return pd.DataFrame({"book_id": book[at], "section_idx": pd.array(section[at], "Int32"), "line_no": np.concatenate(places).astype(np.int32)})


def occurrences(sections: DataFrame, share: float = 0.05, least_rows: int = 5, least_books: int = 3) -> DataFrame:
    """(book_id, section_idx, line_no) of every occurrence of a repeated line."""
    bitmaps = line_bitmaps(sections)
    rep = cut(repeated_lines(sections, bitmaps, share, least_rows, least_books))
    return _places(bitmaps, rep)


def _places(bitmaps: DataFrame, rep: DataFrame) -> DataFrame:
    """The places of lines, from the bits of their containers and the directories of the blocks."""
    hits = _of_lines(bitmaps.where("h1 is not null"), rep).select("container", "bitmap", "places", "times")
    directory = bitmaps.where("row_book is not null").select(F.col("container").alias("block"), "row_book", "row_section")
    return hits.groupBy("container").cogroup(directory.groupBy("block")).applyInPandas(_look_up, "book_id string, section_idx int, line_no int").distinct()


def cleaned(sections: DataFrame, **thresholds: float) -> DataFrame:
    """Each section with its lines but the repeated ones; NULL lines stay NULL.

    The lines of a section are hashed once more as they are read and looked up among the repeated ones of its site, which
    are few by proof: where they are, they go to every task; else each section fetches those of its own hashes.
    """
    bitmaps = line_bitmaps(sections)
    rep = cut(repeated_lines(sections, bitmaps, **thresholds).select("site", "h1", "h2"))
    schema = "book_id string, section_idx int, site string, lines array<string>, removed int"
    rows = sections.select("book_id", "section_idx", "site", "lines")
    if rep.count() <= MOST_BROADCAST:
        known: dict = {}
        for r in rep.toLocalIterator():
            known.setdefault(r["site"], set()).add((r["h1"], r["h2"]))
        told = sections.sparkSession.sparkContext.broadcast(known)
        return rows.mapInArrow(lambda batches: _cleaned(batches, told.value), schema)
    places = _places(bitmaps, rep).groupBy("book_id", "section_idx").agg(F.collect_set("line_no").alias("gone"))
    places = places.withColumnsRenamed({"book_id": "its_book", "section_idx": "its_section"})
    met = rows.join(places, F.col("book_id").eqNullSafe(F.col("its_book")) & F.col("section_idx").eqNullSafe(F.col("its_section")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    return met.select("book_id", "section_idx", "site", kept.alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


def _cleaned(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[pa.RecordBatch]:
    table = letters()
    for b in batches:
        row, _, text = row_lines(b)
        h1, h2, kept = poly_hashes(text, table)
        sites = b.column("site").to_pylist()
        gone = np.zeros(len(row), bool)
        for site in set(sites) & set(known):
            own = known[site]
            at = np.flatnonzero(np.asarray([s == site for s in sites])[row] & (kept > 0)) if len(row) else []
            pairs = zip(h1[at].tolist(), h2[at].tolist(), strict=True)
            gone[at] = [p in own for p in pairs]
        lines = b.column("lines")
        removed = np.bincount(row[gone], minlength=b.num_rows).astype(np.int32) if len(row) else np.zeros(b.num_rows, np.int32)
        sizes = np.asarray(lines.value_lengths().fill_null(0)) - removed
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = pa.array([t for t, g in zip(text, gone.tolist(), strict=True) if not g], pa.string())
        null = lines.is_null()
        out = pa.ListArray.from_arrays(pa.array(ends), flat, mask=null) if null.true_count else pa.ListArray.from_arrays(pa.array(ends), flat)
        yield pa.RecordBatch.from_arrays([b.column("book_id"), b.column("section_idx").cast(pa.int32()), b.column("site"), out, pa.array(removed)], ["book_id", "section_idx", "site", "lines", "removed"])
