import os
import random

import pytest

from scriptorium.llm import bpe, mixture

needs = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.FILE)), reason="no tokenizer files")


def water_fill(weights, caps, total):
    """Amounts by clamping in a loop: what water_level must give."""
    got = dict.fromkeys(weights, 0.0)
    free = {s for s, w in weights.items() if w > mixture.LEAST_WEIGHT and caps[s] > 0}
    left = min(total, sum(caps[s] for s in free))
    while free and left > 0:
        scale = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * scale >= caps[s]}
        if not over:
            return got | {s: weights[s] * scale for s in free}
        for s in over:
            got[s] = caps[s]
            left -= caps[s]
        free -= over
    return got


@pytest.mark.parametrize("seed", range(6))
def test_water_level(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{i}", rng.choice([0.0, rng.random()]), float(rng.choice([0, rng.randint(1, 1000)]))) for i in range(40)]
    total = rng.choice([0.0, 500.0, 5000.0, 1e9])
    level = mixture.water_level(spark.createDataFrame(rows, "source string, weight double, cap double"), total)
    want = water_fill({s: w for s, w, _ in rows}, {s: c for s, _, c in rows}, total)
    for s, w, c in rows:
        assert (min(c, w * level) if w > mixture.LEAST_WEIGHT and c > 0 else 0.0) == pytest.approx(want[s], abs=1e-6)


@needs
def test_many_sources(spark):
    t = spark.range(20_000).selectExpr("concat('s', id) as source", "1.0 / 20000 as weight", "2 as max_repeats")
    d = spark.createDataFrame([(1, "some words", "s7"), (2, "other words here", "s8")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.copies) for r in mixture.mixed(d, t).collect()} >= {(1, 1)}
    assert mixture.shares(d, t).count() == 20_000


@needs
def test_mixture(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 7), "big") for i in range(300)]
    docs += [(1000 + i, f"small {i}", "small") for i in range(6)] + [(2000, "small 0", "small"), (2001, None, "small"), (2002, "", "big"), (2003, "x", None), (2004, "y", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as n_tokens")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), (None, 0.3, 1)], "source string, weight double, max_repeats int")
    rows = mixture.mixed(d, t).collect()
    assert all(r.copies <= {"big": 1, "small": 3}[r.source] for r in rows)
    assert 2000 not in {r.doc_id for r in rows}  # its text is used by doc 1000
    s = {r.source: r for r in mixture.shares(d, t).collect()}
    assert s["gone"].tokens == 0 and s["small"].capped and s["small"].epochs == 3.0
    assert sum(r.share for r in s.values()) == pytest.approx(1)
    assert abs(s["big"].tokens - s["big"].wanted_tokens) <= 25
    again = sorted((r.doc_id, r.copies) for r in mixture.mixed(d, t).collect())
    assert again == sorted((r.doc_id, r.copies) for r in rows)
    assert mixture.mixed(d.where("doc_id < 0"), t).count() == 0
