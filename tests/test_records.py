import json

import pytest
from pyspark.sql import functions as F

from scriptorium import params, rules, themes
from scriptorium.operators import library, records
from scriptorium.schemas import BOOKS, WISHLIST


def wishes(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in WISHLIST.fields) for r in rows], WISHLIST)


def books(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in BOOKS.fields) for r in rows], BOOKS)


def test_new_wishes(spark):
    r = records.new_wishes(wishes(spark, {"id": "1", "title": " 灯 A", "author": " ", "library_book_id": "A" * 32, "rating": 9, "read_status": "odd", "read": True})).first()
    assert (r.title, r.author, r.library_book_id, r.identity_title, r.rating, r.read_status, r.read, r.book_status) == ("灯 A", None, "a" * 32, "灯a", 5, "read", True, "ongoing")


def test_changes_and_merges(spark):
    w = wishes(spark, {"id": "1", "title": "灯", "author": "甲", "updated_at": "1", "read_status": "unread", "read": False}, {"id": "2", "title": "火", "author": "甲", "updated_at": "2", "read_status": "unread", "read": False})
    ch = spark.createDataFrame([("1", "火", "read")], "id string, title string, read_status string")
    new = records.changed_wishes(w, ch)
    r = {x.id: x for x in new.collect()}
    assert (r["1"].identity_title, r["1"].read, r["2"].read) == ("火", True, False)
    assert [x.id for x in records.merged_wishes(new).collect()] == ["2"]
    assert records.refreshed_keys(w).count() == 2


def test_book_rows(spark, tmp_path):
    parsed = spark.createDataFrame([("b", "灯", None), ("c", "", "人")], "book_id string, title string, author string")
    form = spark.createDataFrame([("b", " ", "新")], "book_id string, title string, author string")
    r = {x.book_id: x for x in records.book_rows(parsed, "now", form=form).collect()}
    assert (r["b"].title, r["b"].author, r["c"].title, r["c"].author, r["b"].status, r["b"].language) == ("灯", "新", "未命名", "人", "dirty", "zh-CN")
    (tmp_path / "archive" / "x").mkdir(parents=True)
    (tmp_path / "archive" / "x" / "meta.json").write_text(json.dumps({"book_id": "x", "title": "旧"}))
    old = records.legacy_books(spark, str(tmp_path), books(spark, {"book_id": "b"})).first()
    assert (old.book_id, old.title, old.archived, old.tags) == ("x", "旧", True, [])


def test_states(spark):
    b = books(spark, {"book_id": "a", "status": "dirty", "updated_at": "2", "epub_updated_at": "1"}, {"book_id": "b", "status": "dirty", "updated_at": "2"}, {"book_id": "c", "status": "synced", "updated_at": "1", "epub_updated_at": "1", "theme_template": "x"})
    done = spark.createDataFrame([("a", True), ("b", False)], "book_id string, ok boolean")
    assert {r.book_id: (r.status, r.epub_updated_at) for r in records.synced(b, done, "3").collect()} == {"a": ("synced", "3"), "b": ("failed", None), "c": ("synced", "1")}
    assert sorted(r.book_id for r in records.stale(b).collect()) == ["a", "b"]
    assert [r.book_id for r in records.to_regenerate(b, "theme", "x").collect()] == ["c"] and records.to_regenerate(b, "rule", "default").count() == 3


def test_greedy_links_take_each_once(spark):
    b = books(spark, {"book_id": "1" * 32, "title": "灯", "author": "甲", "updated_at": "2"}, {"book_id": "2" * 32, "title": "灯", "author": "乙", "updated_at": "1"})
    w = wishes(spark, {"id": "w", "title": "灯", "author": None, "updated_at": "", "created_at": ""})
    assert [tuple(r) for r in library.greedy_links(b, w).collect()] == [("1" * 32, "w")]


def test_archive_names(spark):
    b = books(spark, *[{"book_id": str(i), "title": t, "author": a} for i, (t, a) in enumerate([("灯", "甲"), ("灯", "甲"), ("灯", "甲-2"), ("a/b", None)])])
    names = {r.book_id: r.file_name for r in library.archive_names(b).collect()}
    assert len(set(names.values())) == 4 and names["0"] == "灯-甲.epub" and names["3"] == "a_b-unknown.epub"


@pytest.mark.parametrize(("f", "raw", "want"), [(params.library_filter, "IN_LIBRARY", "in"), (params.read_filter, "read", "all"), (params.sort, "created", "created"), (params.per_page, "500", 96), (params.per_page, "x", 24), (params.status_filter, None, "all")])
def test_params(f, raw, want):
    assert f(raw) == want


def test_templates(spark, tmp_path):
    rules.save(tmp_path, rules.Rules(id="b", name="二"))
    (tmp_path / "a.json").write_text("{")
    got = rules.load(tmp_path)
    assert list(got) == ["b"] and rules.pick(got, "none").id == "b"
    assert not rules.delete(tmp_path, "b", {"b"}) and rules.delete(tmp_path, "b", set())
    themes.save(tmp_path, themes.Theme("t", "n", "p{}"))
    assert themes.pick(themes.load(tmp_path), "t").css == "p{}" and themes.pick(themes.load(tmp_path), "?").id == "default"
    with pytest.raises(ValueError, match="CSS"):
        themes.save(tmp_path, themes.Theme("u", "n", "p{"))
    df = spark.createDataFrame([(" a ", None), ("a", "b"), (None, " ")], "x string, y string")
    assert [r[0] for r in df.select(themes.composed(F.col("x"), F.col("y"))).collect()] == ["a", "a\n\nb", ""]


def test_greedy_links_as_one_by_one(spark):
    import random

    r = random.Random(3)
    bs = [(f"{i:032x}", r.choice("灯火海"), r.choice(["", "甲", "乙"]) if i % 2 else r.choice("甲乙"), str(r.randrange(9))) for i in range(60)]
    ws = [(f"w{i:02}", r.choice("灯火海"), r.choice(["", "甲", "乙"]) if i % 3 else "甲", str(r.randrange(9))) for i in range(50)]
    bs = [b for b in bs if b[1] != "海" or b[2]]
    ws = [w for w in ws if w[1] != "海" or w[2]]
    want, free = set(), sorted(ws, key=lambda w: (w[3], w[0]))
    free = sorted(ws, key=lambda w: w[0])
    free.sort(key=lambda w: w[3], reverse=True)
    order = sorted(bs, key=lambda b: b[0])
    order.sort(key=lambda b: b[3], reverse=True)
    for b in order:
        hit = next((w for w in free if w[1] == b[1] and (not b[2] or not w[2] or b[2] == w[2])), None)
        if hit:
            free.remove(hit)
            want.add((b[0], hit[0]))
    got = library.greedy_links(books(spark, *[{"book_id": i, "title": t, "author": a, "updated_at": u} for i, t, a, u in bs]), wishes(spark, *[{"id": i, "title": t, "author": a, "updated_at": u, "created_at": ""} for i, t, a, u in ws]))
    assert {tuple(x) for x in got.collect()} == want
