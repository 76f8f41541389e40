import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.FILE)), reason="no tokenizer files")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = bpe.ranks(bpe.TOKENIZERS, bpe.FILE)
    return bpe.Encoder(), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab \n哈", max_size=40)), max_size=5))
def test_as_the_public_library(both, texts):
    own, public = both
    assert own.encode(texts) == [public.encode_ordinary(t) for t in texts]


def test_long_and_special(both):
    own, public = both
    texts = ["a" * 20_000, "哈" * 5_000, "<|endoftext|>", " \t\n ", "‍🏳️‍🌈"]
    assert own.encode(texts) == [public.encode_ordinary(t) for t in texts]
    assert own.encode([None, ""]) == [[], []]


def test_round_trip(spark):
    rows = [(1, "渡口 ferry\r\n"), (2, None), (3, ""), (3, ""), (4, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "'k' as key")
    ids = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert ids[2] == ids[3] == [] and len(ids[1]) > 3
    assert bpe.encoded(df).count() == 5
    assert all(r.restored for r in bpe.round_trip(df).collect())
    assert bpe.encoded(df.where("doc_id > 9")).count() == 0


def test_very_long_words(both):
    import random
    import time

    own, public = both
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000)), "9" * 50_000 + "ab" * 20_000]
    t = time.time()
    assert own.encode(texts) == [public.encode_ordinary(x) for x in texts]
    assert time.time() - t < 120
    pieces = own._pieces(texts[0].encode())
    assert b"".join(pieces) == texts[0].encode() and len(pieces) > 100
