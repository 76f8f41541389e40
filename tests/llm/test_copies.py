import itertools
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import copies
from scriptorium.llm.fold import letters_and_digits, poly_hashes, same_kept


def kept(s):
    out = []
    for c in s or "":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            u = c.upper()
            low = (u if len(u) == 1 else c).lower()
            out.append(low if len(low) == 1 else c)
    return "".join(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text(alphabet="aA bB-1é", max_size=8)), max_size=12))
def test_hashes_and_pointers_as_canonical_strings(values):
    t = letters_and_digits()
    a, b, n = poly_hashes(values, t)
    for i, j in itertools.product(range(len(values)), repeat=2):
        same = kept(values[i]) == kept(values[j])
        assert ((a[i], b[i]) == (a[j], b[j])) == same == same_kept(values[i], values[j], t)
    assert [int(x) for x in n] == [len(kept(v)) for v in values]


def brute(rows):
    key = {i: tuple(sorted((kept(t), kept(a)))) for i, t, a in rows}
    return {(x, y) for x in key for y in key if x < y and key[x] == key[y]}


def test_pairs_as_brute_force(books):
    r = random.Random(5)
    texts = [None, "", "  ", "Ab 1", "a-B1", "（ab）１", "灯 塔", "《灯塔》", "ß", "ab1" * 2000, "AB1" * 2000]
    rows = [(f"{i:03}", r.choice(texts), r.choice(texts)) for i in range(80)]
    df = books(*[{"book_id": i, "title": t, "author": a} for i, t, a in rows]).withColumn("id", F.lit("clash")).withColumn("k1", F.lit(1))
    got = {tuple(x) for x in copies.pairs(df).collect()}
    assert got == brute(rows)
    counted = {x.book_id: x.copies for x in copies.records(df).collect()}
    assert sum(counted.values()) == len(rows)


def test_repeated_rows_and_no_rows(books):
    twice = books({"book_id": "a", "title": "x"}, {"book_id": "a", "title": "x"}, {"book_id": None, "title": "x"})
    assert copies.pairs(twice).count() == 0
    assert copies.pairs(books()).count() == 0 and copies.found_survivors(books()).count() == 0 and copies.survivors(books()).count() == 0


def test_fields_survive_by_instant(books):
    base = {"title": "灯", "author": "人"}
    rows = [
        base | {"book_id": "a", "isbn": "978-0-306-40615-7", "publisher": "未知", "cover_file": "nocover.png", "updated_at": "2024-01-01T00:00:00+00:00"},
        base | {"book_id": "b", "isbn": "9780306406158", "publisher": "某社", "cover_file": "cover_1.jpg", "updated_at": "2024-01-01T05:00:00+08:00"},
        base | {"book_id": "c", "isbn": " ", "publisher": "他社", "cover_file": "placeholder.png", "updated_at": ""},
        {"book_id": "d", "title": "人", "author": "灯", "isbn": "0306406152", "publisher": "n/a", "cover_file": None, "updated_at": "2023-12-31T23:59:59Z"},
    ]
    got = {(r.group_book_id, r.field): r.book_id for r in copies.found_survivors(books(*rows)).collect()}
    assert got == {("a", "isbn"): "a", ("a", "publisher"): "b", ("a", "cover_file"): "b"}
    whole = copies.survivors(books(*rows)).first()
    assert (whole.group_book_id, whole.copies, whole.isbn, whole.publisher, whole.updated_at) == ("a", 4, "978-0-306-40615-7", "某社", "2024-01-01T00:00:00+00:00")
    assert copies.ranked(books(*rows)).first().book_id == "b"


def test_usable_isbn(spark):
    values = {"0306406152": True, "080442957X": True, "9780306406157": True, "ISBN 978 0306406157": True, "9780306406158": False, "12345678901": False, "": False, None: False, "N/A": False, "0000000000": False}
    df = spark.createDataFrame([(v,) for v in values], "isbn string")
    assert {r.isbn: bool(r.ok) for r in df.select("isbn", F.coalesce(copies.usable_isbn("isbn"), F.lit(False)).alias("ok")).collect()} == values
