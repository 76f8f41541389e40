import re

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import site_lines

SCHEMA = "site string, book_id string, section_idx int, lines array<string>, container int"


def brute(rows, share, least, books):
    key = lambda x: re.sub(r"[\W\d_]", "", x or "").lower()
    out = set()
    for site in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == site]
        for k in {key(x) for r in own for x in r[3] or []} - {""}:
            having = [r for r in own if k in {key(x) for x in r[3] or []}]
            if len(having) >= max(least, share * len(own)) and len({r[1] for r in having}) >= books:
                out |= {(r[1], r[2], i) for r in having for i, x in enumerate(r[3]) if key(x) == k}
    return out


def test_as_brute_force(spark):
    rows = []
    for b in range(6):
        for s in range(4):
            n = b * 4 + s
            rows.append((None if b % 3 == 0 else "s", f"b{b}", s, [f"第{n}页 · 本站", f"story {chr(97 + n)}", "本站 第1页", None, "——", ""] if n % 2 else [f"tale {chr(97 + n)}{chr(98 + n)}"], 1))
    rows += [("s", "e", 0, [], 1), ("s", "e", 1, None, 1), ("s", "l", 0, ["长" * 50_000], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in site_lines.occurrences(df, 0.05, 3, 2).collect()}
    assert got == brute(rows, 0.05, 3, 2) and got
    clean = {(r.book_id, r.section_idx): r.lines for r in site_lines.cleaned(df, share=0.05, least_rows=3, least_books=2).collect()}
    assert clean["b0", 1] == [f"story {chr(98)}", None, "——", ""] and clean["e", 1] is None and len(clean) == len(rows)


def test_no_rows(spark):
    assert site_lines.occurrences(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 65536])
def test_containers(n):
    own = np.sort(np.random.default_rng(n).choice(65536, n, replace=False))
    data = site_lines.pack(own)
    assert (site_lines.unpack(data) == own).all() and len(data) <= 8192


def test_blocks_close_by_lines(spark, monkeypatch):
    rows = [("s", f"b{i % 4}", i, ["same line"] * 3 + [f"own {chr(97 + i)}"], 1) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    batch = pa.RecordBatch.from_pylist([{"site": a, "book_id": b, "section_idx": c, "lines": d} for a, b, c, d, _ in rows])
    assert site_lines._fitting(batch, 0, 100, 9) == 3 and site_lines._fitting(batch, 18, 100, 1) == 1 and site_lines._fitting(batch, 0, 5, 10**6) == 5
    assert {tuple(r) for r in site_lines.occurrences(df).collect()} == brute(rows, 0.05, 5, 3)
    with pytest.raises(ValueError):
        site_lines.occurrences(df, least_books=17)


def test_cleaned_both_ways(spark, monkeypatch):
    rows = [("s" if i % 5 else None, f"b{i % 4}", i, [f"第{i}页 本站", "", None, f"own {chr(97 + i)}", "本站"], 1) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    one = sorted(map(repr, site_lines.cleaned(df).collect()))
    monkeypatch.setattr(site_lines, "MOST_BROADCAST", -1)
    assert one == sorted(map(repr, site_lines.cleaned(df).collect()))
