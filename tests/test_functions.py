import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import python as P
from scriptorium.functions import text as X
from scriptorium.rules import RuleError, Rules, from_json


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


TEXTS = st.lists(st.text(alphabet="aZ9 \t\n　 \x1c\x85\xa0渡口，,-X第3章：", max_size=20), min_size=1, max_size=20)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_strip_and_keys_as_in_python(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "x string").select("x", X.strip("x"), X.id_key("x"), X.isbn_key("x"), X.content_line("x")).collect()
    for x, s, k, i, c in got:
        assert s == x.strip()
        assert k == re.sub(r"[^0-9a-zA-Z一-鿿]+", "", x.lower())
        assert i == re.sub(r"[^0-9Xx]", "", x).upper()
        assert c == x.strip().replace("　", "")


@pytest.mark.parametrize(("raw", "want"), [("2001-2-3年", "2001-2-3"), ("  ", None), ("春天", "春天"), (None, None), ("1999年", "1999")])
def test_dates(spark, raw, want):
    assert one(spark, raw, X.clean_date) == want


@pytest.mark.parametrize(("raw", "want"), [("a，b, a ,A", ["a", "b"]), ("", []), (None, []), (" , ，", [])])
def test_tags(spark, raw, want):
    assert one(spark, raw, lambda c: X.split_tags(c, distinct=True)) == want


@pytest.mark.parametrize(("raw", "want"), [("4", 4), ("9", 5), ("-3", 0), ("x", None), (None, None), (" 2 ", 2), ("3.5", None)])
def test_rating(spark, raw, want):
    assert one(spark, raw, X.rating) == want


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><script>x()</script><p>one</p><p>two</p></body></html>"
    assert one(spark, page, X.html_text) == "A & B one two"
    assert one(spark, page, X.html_title) == "A & B"


@pytest.mark.parametrize(("title", "query", "want"), [("渡口", "渡口", 4), ("渡口夜话", "渡口", 3), ("渡夜口灯", "口渡船", 2), ("海", "山", 0), ("", "山", 0)])
def test_title_score(spark, title, query, want):
    assert spark.createDataFrame([(title, query)], "a string, b string").select(X.title_score("a", "b")).first()[0] == want


@pytest.mark.parametrize(("author", "expected", "want"), [("Ann Lee", "ann lee", 8), ("Lee Ann", "Ann Lee", 7), ("Ann Lee", "Ann", 6), (None, "Ann", -1), ("Bob", "Ann", -4), ("Bob", "", 0), ("Bob / Ann Lee", "Ann Lee", 8)])
def test_author_score(spark, author, expected, want):
    assert spark.createDataFrame([(author, expected)], "a string, b string").select(X.author_score("a", "b")).first()[0] == want


@pytest.mark.parametrize(("name", "title", "author"), [("《夜航》作者：某人（完）", "夜航", "某人"), ("夜航 作者: 某人", "夜航", "某人"), ("夜航[校对]", "夜航", None), ("", None, None)])
def test_names_of_files(spark, name, title, author):
    t, a = X.title_from_name("x")
    assert tuple(spark.createDataFrame([(name,)], "x string").select(t, a).first()) == (title, author)


@pytest.mark.parametrize(("css", "bad"), [("", False), ("a{b:c}", False), ("a{", True), ("a}", True), ("a{content:'x", True), ("/* x", True), ("a{}" * 100_000, True), ("a{content:'}'}", False)])
def test_css(css, bad):
    assert bool(P.css_problem(css)) == bad


def test_decoding():
    assert P.decode("﻿渡口".encode()) == ("utf-8-sig", "渡口")
    assert P.decode("渡口".encode("gb18030")) == ("gb18030", "渡口")
    assert P.decode(b"\xff\xff\xff")[0] == "utf-8"
    assert P.decode(None) == (None, None)


@pytest.mark.parametrize(("name", "media", "probe", "want"), [("a.EPUB", None, b"", "epub"), ("a", "application/epub+zip", b"", "epub"), ("a", None, b"PK\3\4", "epub"), ("a", "text/plain", b"\0", "txt"), ("a", None, b"hello", "txt"), ("a", None, b"\0\1", "unknown"), (None, None, None, "unknown")])
def test_source_type(name, media, probe, want):
    assert P.source_type(name, media, probe) == want


def test_rules_from_json():
    r = from_json('{"id":"a","chapter_patterns":["^x"],"heading_max_len":"12","heading_max_commas":0}')
    assert (r.longest, r.commas, r.chapters) == (12, 1, ("^x",))
    for bad in ("{", "[]", '{"id":"a b"}', '{"id":"a","chapter_patterns":["("]}', '{"id":"a","heading_max_len":"x"}'):
        with pytest.raises(RuleError):
            from_json(bad)
    with pytest.raises(RuleError):
        from_json('{"id":"a"}', "b")
    assert Rules().longest == 40


def test_rules_have_defaults(tmp_path):
    from scriptorium import rules as R

    assert from_json('{"id":"a"}') == Rules("a", "a") and from_json('{"chapter_patterns":[]}', stem="s").id == "s"
    for bad in ('{"id":"_x"}', '{"id":"a","heading_max_len":-5}', '{"id":"a","chapter_patterns":["("]}', '{"id":"a","volume_patterns":"x"}', '{"id":"a","chapter_patterns":["(?P<n>x)"]}'):
        if "P<n>" in bad and not R.SparkSession.getActiveSession():
            continue
        with pytest.raises(RuleError):
            from_json(bad)
    (tmp_path / "own.json").write_text('{"name":"x"}')
    assert R.load(tmp_path)["own"].chapters == R.CHAPTERS


def test_entities(spark):
    import html

    texts = ["a &amp; b", "&amp;lt;", "&eacute;&Eacute;", "&#8364;&#x20AC;", "&lt;p&gt;&nbsp;x", "&", "&&amp;&", "&#39;&quot;&apos;", "&hellip;&mdash;&middot;", "&#x1F600;", "x&#10;y", "plain", "", "&nope;", "&hearts;&Alpha;"]
    df = spark.createDataFrame([(t, [t]) for t in texts] + [(None, None)], "t string, a array<string>")
    got = df.select("t", X.unescape("t").alias("u"), F.transform("a", X.unescape).alias("v")).collect()
    assert {r.t: r.u for r in got} == {t: html.unescape(t) for t in texts} | {None: None}
    assert all(r.v is None or r.v == [r.u] for r in got)


def test_flags_targets_hosts_and_styles(spark):
    from scriptorium import params

    assert [params.flag(v) for v in (True, " Yes ", "1", "no", None, 1, "")] == [True, True, True, False, False, False, False]
    got = [params.local_target(v, "/") for v in ("/a?b=1#c", "/a", "//evil/x", "http://x/y", "a", None, "", "/")]
    assert got == ["/a?b=1", "/a", "/", "/", "/", "/", "/", "/"]
    rows = [("https://www.site.com/x", "a\r\nb ", "a\nb"), ("https://mysite.com/x", "a", "b"), (None, None, " "), ("x", None, "a")]
    df = spark.createDataFrame(rows, "u string, s string, e string").select(X.on_host("u", "site.com").alias("h"), X.style_differs("s", "e").alias("d"))
    assert [tuple(r) for r in df.collect()] == [(True, False), (False, True), (False, False), (False, True)]


def test_whole_files():
    import io
    import zipfile

    from scriptorium.sources.epub import documents_root

    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    assert P.whole_type("a", None, zipped("META-INF/container.xml")) == "epub" and P.whole_type("a", None, zipped("b")) == "unknown"
    assert P.whole_type("a.epub", None, b"x") == "epub" and P.whole_type(None, None, b"hello") == "txt" and P.whole_type(None, None, None) == "unknown"
    assert documents_root(["OEBPS/Text/a.xhtml", "OEBPS/Text/b.xhtml"]) == "OEBPS" and documents_root(["a.xhtml"]) == "" and documents_root(["O/x/a", "O/y/b"]) == "O" and documents_root([]) == ""
