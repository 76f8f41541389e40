"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: each partition runs recursive queries in an embedded SQL engine. A batch's texts are cut into words by the
tokenizer's public pattern; words not met before become (word, pos, id) rows, one a byte. A long word is cut before
where no token that stands in it lies across: nothing can merge there. The recursive query joins
neighbouring rows with the merge table, finds each word's pair of least rank, contracts it from the left, and goes on
to the fixpoint; ordered aggregation gives the words' ids back. All places of the least pair contract in one step,
leftmost first and without overlap: a pair that a merge makes always ranks behind that merge, so the result is that
of one leftmost merge at a time. Decoding joins ids with the vocabulary and aggregates their bytes in order.

Defined cases: NULL and empty texts have the empty list; white space is text as any other; strings that look like
special tokens are ordinary text; repeated rows stay; very long texts and words are encoded whole; lone surrogates
cannot occur in a Spark string. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts text into words before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words given to one recursive query, and words a task remembers: bounds of memory, not of what is encoded.
QUERY_BYTES, REMEMBERED = 400_000, 300_000
#: Steps of one recursive query, which keeps them all: what is not done by then goes on from its last step. And the bytes
#: from which a word is first cut where no token of the vocabulary lies across.
STEPS, LONG = 48, 96

_STEP = """
WITH RECURSIVE t(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM fresh
  UNION ALL
  SELECT step + 1, word, pos, merged FROM (
    SELECT step, word, pos, CASE WHEN hit THEN fused ELSE id END AS merged, coalesce(lag(hit) OVER w, false) AS eaten
    FROM (
      SELECT *, hits AND run % 2 = 1 AS hit FROM (
        SELECT *, row_number() OVER (PARTITION BY word, hits, pos - nth ORDER BY pos) AS run FROM (
          SELECT *, row_number() OVER (PARTITION BY word, hits ORDER BY pos) AS nth FROM (
            SELECT *, fused IS NOT NULL AND fused = best AS hits FROM (
              SELECT p.step, p.word, p.pos, p.id, m.fused, min(m.fused) OVER (PARTITION BY p.word) AS best
              FROM (SELECT step, word, row_number() OVER o AS pos, id, lead(id) OVER o AS next FROM t WINDOW o AS (PARTITION BY word ORDER BY pos)) p
              LEFT JOIN merges m ON m.a = p.id AND m.b = p.next)
            WHERE best IS NOT NULL AND step < {steps}))))
    WINDOW w AS (PARTITION BY word ORDER BY pos))
  WHERE NOT eaten
)
SELECT word, list(id ORDER BY pos) AS ids, any_value(last) = {steps} AS unfinished FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM t) WHERE step = last GROUP BY word
""".replace("{steps}", str(STEPS))


def ranks(folder: str, file: str) -> dict[bytes, int]:
    with open(os.path.join(folder, file), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(vocabulary: dict[bytes, int]) -> pa.Table:
    """(a, b, fused): every way in which two tokens make a third; a fused token's id is its rank."""
    a, b, fused = [], [], []
    for token, rank in vocabulary.items():
        for i in range(1, len(token)):
            x, y = vocabulary.get(token[:i]), vocabulary.get(token[i:])
            if x is not None and y is not None:
                a.append(x)
                b.append(y)
                fused.append(rank)
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "fused": pa.array(fused, pa.int32())})


class Encoder:
    """A task's embedded database with the merge table, and the words met so far."""

    def __init__(self, folder: str = TOKENIZERS, file: str = FILE, memory: str = "300MB") -> None:
        import duckdb
        import regex

        vocabulary = ranks(folder, file)
        self.cut = regex.compile(PATTERN).findall
        self.byte = [vocabulary[bytes([i])] for i in range(256)]
        self.whole = vocabulary
        self.known: dict[str, list[int]] = {}
        self.finder = None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": "false"})
        self.db.register("given", merge_table(vocabulary))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")

    def _pieces(self, data: bytes) -> list[bytes]:
        """A long word in stretches that no token lies across: they are encoded each by itself."""
        if len(data) < LONG:
            return [data]
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for token in self.whole:
                if len(token) > 1:
                    self.finder.add_word(token.decode("latin-1"), len(token))
            self.finder.make_automaton()
        out, begin = [], 0
        # Tokens by where they end: a place is free when no token that ends behind it begins before it.
        low = np.full(len(data) + 1, len(data), np.int64)
        for end, size in self.finder.iter(data.decode("latin-1")):
            low[end + 1] = min(low[end + 1], end + 1 - size)
        first = np.minimum.accumulate(low[::-1])[::-1]  # the earliest begin of a token that ends here or later
        for i in range(1, len(data)):
            if first[i + 1] >= i:
                out.append(data[begin:i])
                begin = i
        return [*out, data[begin:]]

    def _learn(self, words: list[str]) -> None:
        cut = [self._pieces(w.encode("utf-8", "surrogatepass")) for w in words]
        done: dict[bytes, list[int]] = {}
        todo = {x: [self.byte[i] for i in x] for x in dict.fromkeys(x for pieces in cut for x in pieces)}
        while todo:
            names = list(todo)
            word = [i for i, x in enumerate(names) for _ in todo[x]]
            pos = [k for x in names for k in range(1, len(todo[x]) + 1)]
            ids = [y for x in names for y in todo[x]]
            self.db.register("given", pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int64()), "id": pa.array(ids, pa.int32())}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT * FROM given")
            self.db.unregister("given")
            got = self.db.sql(_STEP).to_arrow_table()
            todo = {}
            for i, own, unfinished in zip(*(got.column(k).to_pylist() for k in range(3)), strict=True):
                (todo if unfinished else done)[names[i]] = own
        for w, pieces in zip(words, cut, strict=True):
            self.known[w] = done[pieces[0]] if len(pieces) == 1 else [y for x in pieces for y in done[x]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh, size = [], 0
        for w in dict.fromkeys(w for words in cut for w in words):
            if w not in self.known:
                fresh.append(w)
                size += 4 * len(w)
                if size > QUERY_BYTES:
                    self._learn(fresh)
                    fresh, size = [], 0
        if fresh:
            self._learn(fresh)
        return [[x for w in words for x in self.known[w]] for words in cut]


_ENCODERS: dict = {}


def _encoder(folder: str, file: str) -> Encoder:
    """A worker process keeps its encoder from task to task."""
    if (folder, file) not in _ENCODERS:
        _ENCODERS[folder, file] = Encoder(folder, file)
    return _ENCODERS[folder, file]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, file: str = FILE) -> DataFrame:
    """(key, ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, file)
        for b in batches:
            ids = encoder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, *keep: str, text: str = "text", folder: str = TOKENIZERS, file: str = FILE) -> DataFrame:
    """The columns to keep and n_tokens of each row; the ids themselves never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, file)
        for b in batches:
            n = [len(x) for x in encoder.encode(b.column("text__").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    rows = documents.select(*keep, F.col(text).alias("text__"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long")


_DECODE = """
SELECT g.row, list(v.token ORDER BY g.pos) AS tokens
FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM given) g JOIN vocabulary v ON v.id = g.id GROUP BY g.row
"""


def decoded(tokens: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, file: str = FILE) -> DataFrame:
    """(key, text) of rows with ids; ids outside the vocabulary are dropped, bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        vocabulary = ranks(folder, file)
        db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        db.register("given", pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "token": pa.array(vocabulary.keys(), pa.binary())}))
        db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        for b in batches:
            db.register("given", pa.table({"row": pa.array(range(b.num_rows), pa.int32()), "ids": b.column("ids")}))
            text = [""] * b.num_rows
            got = db.sql(_DECODE).to_arrow_table()
            for row, parts in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                text[row] = b"".join(parts).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(text, pa.string())], ["key", "text"])

    rows = tokens.select(F.col(key).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, restored): does decoding give each text back?"""
    ids = encoded(documents)
    met = ids.join(decoded(ids), "doc_id").join(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("was")), "doc_id")
    return met.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("text") == F.col("was")).alias("restored"))
