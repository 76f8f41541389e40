import numpy as np
import pytest

from scriptorium.llm import mojibake as m

CLEAN = ["“这条路我走过，夜里不能点灯。”摆渡人低声说道。", "第三次钟响过后，守门人在潮湿的地窖里把剑横在膝上。", "The café on the corner stayed dark, and “nobody” rang.", "Commande expédiée à l’aube."] * 30
COUNT = np.zeros(0x110000)
for _v in CLEAN:
    for _c in _v:
        COUNT[ord(_c)] += 1
LOG_P = np.log((COUNT + 0.1) / (COUNT.sum() + 1)).astype(np.float32)


def best(v):
    w = m.weighed(v, LOG_P)
    return max(w, key=lambda x: x[1])[2] if w else v


def sloppy(b):
    return "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in b)


@pytest.mark.parametrize("text", CLEAN[:3])
@pytest.mark.parametrize("wrong", ["latin-1", "sloppy", "mac_roman", "twice"])
def test_chains_read_back(text, wrong):
    raw = text.encode()
    bad = {"sloppy": lambda: sloppy(raw), "twice": lambda: sloppy(sloppy(raw).encode())}.get(wrong, lambda: raw.decode(wrong))()
    assert best(bad) == text


@pytest.mark.parametrize("text", CLEAN[:2])
def test_chinese_encodings_read_back(text):
    assert best(text.encode("gbk").decode("latin-1")) == text
    lossy = text.encode().decode("gb18030", "replace")
    assert m.weighed(lossy, LOG_P) and "夜里" in best(CLEAN[0].encode().decode("gb18030", "replace"))
    assert best(text[:10] + text[10:].encode().decode("latin-1")) == text


@pytest.mark.parametrize("v", ["Вода поднялась", "霧の港で鐘が鳴った。", "№ 7", "café", "", "守门人", "naïve — “x”"])
def test_foreign_text_stays(v):
    assert not [w for w in m.weighed(v, LOG_P) if w[1] > 7]


def test_rows(spark, books):
    bad = CLEAN[0].encode().decode("latin-1")
    rows = [("b", i, "s", [x]) for i, x in enumerate(CLEAN)] + [("c", 0, None, [None, bad, "x�y"]), ("c", 1, "s", None), ("c", 2, "s", []), ("c", 3, "s", [CLEAN[1] * 3000])]
    s = spark.createDataFrame(rows, "book_id string, section_idx int, site string, lines array<string>").selectExpr("*", "'z' as value", "'z' as field")
    b = books({"book_id": "t", "title": bad, "description": None}, {"book_id": "u", "title": "", "description": CLEAN[2]}, {"book_id": "t", "title": bad})
    got = {tuple(r) for r in m.found(b, s).collect()}
    assert got == {("lines", "c", 0, 1), ("lines", "c", 0, 2), ("title", "t", -1, -1)}
    fixed = {(r.book_id, r.line_no): (r.restored, r.whole) for r in m.repaired(b, s).collect()}
    assert fixed["c", 1] == (CLEAN[0], True) and fixed["c", 2] == ("x�y", False)
    assert m.found(books(), s.where("book_id = 'none'")).count() == 0


def test_common_garbled_characters_are_still_found(spark, books):
    # A tenth of the text is GBK read as Big5: none of its characters is rare.
    bad = "".join(x.encode("gbk").decode("big5", "ignore") or x for x in CLEAN[1])
    rows = [("b", i, "s", [CLEAN[i % 2]]) for i in range(90)] + [("c", i, "s", [bad]) for i in range(10)]
    s = spark.createDataFrame(rows, "book_id string, section_idx int, site string, lines array<string>")
    assert {tuple(r) for r in m.found(books(), s).collect()} == {("lines", "c", i, 0) for i in range(10)}


def test_weak_evidence_is_kept_for_its_source():
    log_p = np.full(0x110000, -10.0, np.float32)
    log_p[[ord("Ã"), ord("©")]] = -6.5
    assert ("utf-8>cp1252", 3.0, "café") in [(m.CHAINS[c], round(g, 3), x) for c, g, x in m.weighed("cafÃ©", log_p)]


def test_expectation_maximization_decides(spark, books):
    """Weak values are found where their own site is often garbled, and only there; without rounds nowhere."""
    strong = CLEAN[2].encode().decode("latin-1")
    weak = "The café rang."
    bad = weak.encode().decode("latin-1")
    filler = [("f", i, "other", [CLEAN[0], CLEAN[1], "Zürich Ã© rang " * 40]) for i in range(60)]
    rows = filler + [("g", i, "garbled", [strong]) for i in range(100)] + [("g", 200, "garbled", [bad]), ("h", 0, "clean", [bad])] + [("h", i, "clean", [CLEAN[i % 4]] * 20) for i in range(1, 200)]
    s = spark.createDataFrame(rows, "book_id string, section_idx int, site string, lines array<string>")
    with_em = {tuple(r) for r in m.found(books(), s).where("book_id <> 'f'").collect()}
    without = {tuple(r) for r in m.found(books(), s, rounds=0).where("book_id <> 'f'").collect()}
    assert ("lines", "g", 200, 0) in with_em - without
    assert ("lines", "h", 0, 0) not in with_em | without


def test_many_sources(spark, books):
    bad = CLEAN[0].encode().decode("latin-1")
    s = spark.range(200_000).selectExpr("concat('b', id) as book_id", "0 as section_idx", "concat('s', id) as site").selectExpr("*", f"if(book_id = 'b7', array('{bad}'), array('x')) as lines")
    assert [tuple(r) for r in m.found(books(), s).collect()] == [("lines", "b7", 0, 0)]


def test_a_books_fields_have_its_site(spark, books):
    bad = CLEAN[0].encode().decode("latin-1")
    s = spark.createDataFrame([("t", 0, "s", ["x"]), ("t", 1, None, None)], "book_id string, section_idx int, site string, lines array<string>")
    got = m.judged(books({"book_id": "t", "title": bad}, {"book_id": "u", "title": bad}), s).collect()
    assert {(r.book_id, r.source) for r in got} == {("t", "s"), ("u", None)}


def test_code_points_of_buffers():
    import pyarrow as pa

    texts = ["守门人", None, "", "café 😅", "x" * 30_000, None]
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(texts * 3, kind).slice(2, 9).drop_null()
        got = np.concatenate(list(m._codes(col)))
        assert got.tolist() == [ord(c) for t in (texts * 3)[2:11] if t for c in t]
    assert not list(m._codes(pa.array([], pa.string())))
