import io
import zipfile

from scriptorium.operators import lookup
from scriptorium.sources import epub, files
from scriptorium.streaming import ingest


def made(**meta):
    m = {"book_id": "b", "title": "灯 & 火", "author": "某人", "language": "zh", "description": "d", "series": "s", "identifier": "urn:x:1", "publisher": "p", "tags": ["甲", "乙"], "published": "2001", "isbn": "9780000000002", "rating": 4} | meta
    parts = [{"title": "卷一", "lines": ["序"], "kind": "volume"}, {"title": "第一章：起", "lines": ["甲 <1>", "", "乙"], "kind": "chapter"}, {"title": "空卷", "lines": [], "kind": "volume"}]
    return epub.write(epub.Book(m, parts, css="p{}", cover=("cover.jpg", b"\xff\xd8jpg")))


def test_round_trip():
    p = epub.Package(made())
    m = p.metadata()
    assert {k: m[k] for k in ("title", "author", "language", "description", "series", "publisher", "tags", "published", "isbn", "rating")} == {"title": "灯 & 火", "author": "某人", "language": "zh", "description": "d", "series": "s", "publisher": "p", "tags": ["甲", "乙"], "published": "2001", "isbn": "9780000000002", "rating": 4}
    s = list(p.sections())
    assert [(x[0], x[1]) for x in s] == [(0, "卷一"), (1, "第一章：起")]
    assert '甲 &lt;1&gt;'.encode() in s[1][3] and b"<p></p>" not in s[1][3] and '<p class="stamp">第一章</p>'.encode() in s[1][3]
    assert p.cover() == ("EPUB/Images/cover.jpg", b"\xff\xd8jpg")
    assert zipfile.ZipFile(io.BytesIO(made())).namelist()[0] == "mimetype"


def test_broken_paths_and_xml():
    src, out = zipfile.ZipFile(io.BytesIO(made())), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            data = src.read(n)
            z.writestr("EPUB/../nav.xhtml" if n.endswith("nav.xhtml") else n, data.replace(b"<metadata", b"<!-- x --><metadata").replace("灯 &amp; 火".encode(), "灯 & 火".encode()))
    p = epub.Package(out.getvalue())
    assert p.metadata()["title"] == "灯 & 火" and len(list(p.sections())) == 2
    assert "nav.xhtml" in zipfile.ZipFile(io.BytesIO(epub.rewrite(out.getvalue(), lambda _, d: d))).namelist()


def test_patches():
    p = epub.Package(epub.with_metadata(made(), {"title": "新", "author": "乙"}))
    assert (p.metadata()["title"], p.metadata()["author"], p.metadata()["publisher"]) == ("新", "乙", "p")
    assert epub.without_webp(made()) == made()
    assert "stylesheet" not in epub.without_styles('<head><link rel="stylesheet" href="x"/><style>p{}</style></head>')
    assert epub.with_style("<head></head>", "a.css") == '<head><link rel="stylesheet" type="text/css" href="a.css"/></head>'
    assert epub.for_reader("<head><script>x</script></head>", "/b/") == '<head><base href="/b/"/></head>'


def test_build_and_read_in_tasks(spark):
    books = spark.createDataFrame([("b1", "题", "人", "zh", None, None, None, None, ["t"], None, None, 3, "p{}")], "book_id string, title string, author string, language string, description string, series string, identifier string, publisher string, tags array<string>, published string, isbn string, rating int, custom_css string")
    parts = spark.createDataFrame([("b1", 1, "chapter", "第二章", ["乙"]), ("b1", 0, "chapter", "第一章", ["甲"])], "book_id string, section_idx int, kind string, title string, lines array<string>")
    made = epub.build(books, parts).withColumnRenamed("epub", "content").selectExpr("*", "'x' as source_name").cache()
    assert [(r.section_idx, r.title) for r in epub.read_sections(made).orderBy("section_idx").collect()] == [(0, "第一章"), (1, "第二章")]
    m = epub.read_metadata(made).first()
    assert (m.title, m.tags, m.rating) == ("题", ["t"], 3)
    bad = spark.createDataFrame([("x", "n", bytearray(b"no zip"))], "book_id string, source_name string, content binary")
    assert epub.read_sections(bad).count() == 0


def test_csv(tmp_path, spark):
    df = spark.createDataFrame([("a,b", None), ('q"', 'x\ny')], "title string, author string")
    assert files.write_csv(df.coalesce(1), tmp_path / "x.csv") == 2
    assert (tmp_path / "x.csv").read_bytes() == b'\xef\xbb\xbftitle,author\r\n"a,b",\r\n"q""","x\ny"\r\n'


def test_stream(spark, tmp_path):
    land, out, check = tmp_path / "land", tmp_path / "out", tmp_path / "check"
    land.mkdir()
    (land / "《灯》作者：某人.txt").write_bytes("第一章\n甲\n".encode("gb18030"))
    (land / "x.bin").write_bytes(b"\0\1\2")
    (land / "bad.epub").write_bytes(b"PK no package")
    (land / "c.epub").write_bytes(made())
    run = lambda: ingest.ingest(spark, str(land), str(out), str(check)).awaitTermination()
    run()
    (land / "b.txt").write_text("书名：海\n\n第一章\n乙")
    run()
    run()
    books = spark.read.parquet(str(out / "books"))
    assert sorted((r.title, r.author) for r in books.collect()) == [("海", None), ("灯", "某人"), ("灯 & 火", "某人")]
    parts = spark.read.parquet(str(out / "sections"))
    assert parts.count() == 4 and ["甲 <1>", "乙"] in [r.lines[-2:] for r in parts.collect()]
    assert sorted(r.status for r in spark.read.parquet(str(out / "jobs")).collect()) == ["failed", "failed", "success", "success", "success"]


def test_progress_stream(spark, tmp_path):
    schema = "book_id string, section int, page int, page_count int, updated_at string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events" / str(n)))
    (tmp_path / "events").mkdir()
    put([("a", 1, 1, 9, "2020"), ("a", 2, 1, 9, "2021")], 0)
    run = lambda: ingest.progress_state(spark, str(tmp_path / "events" / "*"), schema, str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination()
    run()
    put([("a", 1, 5, 9, "2020"), ("b", 3, 1, 9, "2020")], 1)
    run()
    last = sorted((tmp_path / "state").iterdir())[-1]
    assert sorted((r.book_id, r.section) for r in spark.read.parquet(str(last)).collect()) == [("a", 2), ("b", 3)]


def test_pages(spark):
    ld = '<script type="application/ld+json">{"@type":"Book","name":"灯","author":[{"name":"某人"}],"isbn":"9780000000002"}</script>'
    html = ld + '<meta property="og:image" content="//img/x.jpg"><a class="tag">甲</a><a class="tag">乙</a><span class="pl">出版社:</span> 某社<br>'
    r = lookup.page_record(spark.createDataFrame([("u", html), ("v", "<title>海</title>")], "url string, html string")).orderBy("url").collect()
    assert (r[0].title, r[0].author, r[0].isbn, r[0].publisher, r[0].cover_url, r[0].tags) == ("灯", "某人", "9780000000002", "某社", "https://img/x.jpg", ["甲", "乙"])
    assert (r[1].title, r[1].author, r[1].tags) == (None, None, [])


def test_review_pages(spark):
    pages = {
        "criteria": "<script>criteria = '7:小说|7:文学|3:/subject/1/|7:小说';</script>",
        "intro": '<div class="intro"><p>短。</p></div><div class="intro"><p>第一段。</p>\n <p>第二段。<br>换行&amp;继续。</p></div>',
        "cover": '<meta property="og:image" content="https://a/b.jpg"/><a href="https://c/d.jpg" class="x nbg">c</a>',
        "text": "<span>出版社:</span> 某社 <span>出版年:</span> 2001-2 <span>ISBN:</span> 9780000000002",
        "list": '<script type="application/ld+json">[{"@type":"Thing"},{"@type":["Book","X"],"name":"灯","author":["甲",{"name":"乙"}],"image":[{"url":"bad"},{"url":"//i/x.png"}],"description":{"text":"说"},"inLanguage":"zh","keywords":"a, b"}]</script>',
    }
    got = {r.url: r for r in lookup.page_record(spark.createDataFrame(list(pages.items()), "url string, html string")).collect()}
    assert got["criteria"].tags == ["小说", "文学"] and got["intro"].description == "第一段。\n\n第二段。\n换行&继续。"
    assert got["cover"].cover_url == "https://c/d.jpg"
    assert (got["text"].publisher, got["text"].published, got["text"].isbn) == ("某社", "2001-2", "9780000000002")
    r = got["list"]
    assert (r.title, r.author, r.cover_url, r.description, r.language, r.tags) == ("灯", "甲, 乙", "https://i/x.png", "说", "zh", ["a", "b"])


def test_shop_pages(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Dune","author":{"name":"A B"},"brand":{"name":"Ace"},"isbn":"9780441172719","keywords":"x, y"}</script>'
    page = """<meta name="title" content="Amazon.com: Past Noon: 9780679824251: Osborne: Books"/><div id="bylineInfo"><a>Mary O</a><a>Sal M</a><a>Mary O</a></div>
<div id="bookDescription_feature_div"><span class="a-expander-partial-collapse-content">Jack and Annie are in deep trouble, as so often before.</span></div>
<div id="rpi-attribute-book_details-publisher"><div class="rpi-attribute-value"><span>Random &amp; Co</span></div></div>
<div id="rpi-attribute-book_details-language"><div class="rpi-attribute-value"><span>English</span></div></div>
<div id="rpi-attribute-book_details-isbn13"><div class="rpi-attribute-value"><span>978-0679824251</span></div></div>"""
    points = '<div id="feature-bullets"><span class="a-list-item">One thing to know</span><span class="a-list-item">short</span><span class="a-list-item">ONE thing to know</span></div>'
    got = {r.url: r for r in lookup.product_record(spark.createDataFrame([("ld", ld), ("page", page), ("points", points), ("none", None)], "url string, html string")).collect()}
    assert (got["ld"].title, got["ld"].author, got["ld"].publisher, got["ld"].isbn, got["ld"].tags) == ("Dune", "A B", "Ace", "9780441172719", ["x", "y"])
    r = got["page"]
    assert (r.title, r.author, r.publisher, r.language, r.isbn) == ("Past Noon", "Mary O, Sal M", "Random & Co", "English", "978-0679824251")
    assert r.description.startswith("Jack and Annie") and got["points"].description == "- One thing to know" and got["none"].title is None


def test_suggestions(spark):
    q = spark.createDataFrame([("1", "灯塔", "某人"), ("2", "灯塔", "别人")], "id string, query string, expected string")
    s = spark.createDataFrame([("1", 0, "灯塔", "旁人"), ("1", 1, "灯塔记", "某人"), ("2", 0, "灯塔", "旁人")], "id string, pos int, title string, author string")
    assert [(r.id, r.pos) for r in lookup.best_suggestion(q, s).collect()] == [("1", 1)]


def test_cover_and_style():
    data = epub.with_cover_and_style(made(), ("new.png", b"\x89PNG1"), "h2{}")
    p = epub.Package(data)
    assert p.cover() == ("EPUB/Images/new.png", b"\x89PNG1") and p.read("EPUB/Styles/overlay.css") == b"h2{}"
    assert b'href="../Styles/overlay.css"' in next(p.sections())[3] and b"Styles/style.css" in next(p.sections())[3]
    again = epub.Package(epub.with_cover_and_style(data, css="", plain=True))
    assert not any(m.endswith(".css") for m in again.members) and b"stylesheet" not in next(again.sections())[3]
    assert epub.cover_ending("x", b"GIF89") == ".gif" and epub.cover_ending("x.PNG", b"") == ".png"


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a.epub", bytearray(b"1")), ("b.epub", bytearray(b"2"))], "file_name string, epub binary")
    assert epub.bundle(df, str(tmp_path / "x.zip")) == 2
    assert sorted(zipfile.ZipFile(tmp_path / "x.zip").namelist()) == ["a.epub", "b.epub"]


def test_whole_metadata(spark):
    from datetime import UTC, datetime

    meta = {"book_id": "u1", "title": "新", "author": "人", "description": "简", "publisher": "社", "tags": ["甲", ""], "published": "2025-01-01", "isbn": "9780000000002", "identifier": "x7", "series": "套", "rating": 5}
    data = epub.with_metadata(made(), meta, datetime(2025, 1, 2, 3, 4, 5, 6, tzinfo=UTC))
    got = epub.Package(data).metadata("f")
    assert {k: got[k] for k in ("title", "author", "description", "publisher", "published", "isbn", "series", "rating", "tags")} == {"title": "新", "author": "人", "description": "简", "publisher": "社", "published": "2025-01-01", "isbn": "9780000000002", "series": "套", "rating": 5, "tags": ["甲"]}
    opf = epub.Package(data).read(epub.Package(data).opf).decode()
    assert opf.count("dcterms:modified") == 1 and "2025-01-02T03:04:05Z" in opf and "urn:uuid:x7" in opf
    less = epub.with_metadata(data, {"isbn": None, "series": None, "rating": None, "title": ""})
    got = epub.Package(less).metadata("f")
    assert (got["title"], got["isbn"], got["series"], got["rating"], got["author"]) == ("新", None, None, None, "人")


def test_a_page_is_no_cover():
    data = epub.with_cover_and_style(made(), ("new.png", b"\x89PNG1"), "")
    page = next(i for i in epub.Package(data).items if i.media == "application/xhtml+xml")
    wrong = epub.rewrite(data, lambda p, raw: raw.replace(b"</metadata>", f'<meta name="cover" content="{page.id}"/></metadata>'.encode()) if p.endswith(".opf") else raw)
    assert epub.Package(wrong).cover()[1] == b"\x89PNG1"


def test_archive_names(spark):
    from scriptorium.operators import library

    rows = [("1", "灯", "人"), ("2", "灯", "人"), ("3", "灯", "人-2"), ("4", "灯", "人"), ("5", "海", None), ("6", "海", None), ("7", "灯", "人-2")]
    got = library.archive_names(spark.createDataFrame(rows, "book_id string, title string, author string"))
    names = {r.book_id: r.file_name for r in got.collect()}
    assert [names[k] for k in "1234"] == ["灯-人.epub", "灯-人-2.epub", "灯-人-2-2.epub", "灯-人-3.epub"] and names["7"] == "灯-人-2-3.epub"
    assert names["5"][:-5] + "-2.epub" == names["6"] and len(set(names.values())) == 7
