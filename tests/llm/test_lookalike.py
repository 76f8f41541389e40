import pytest

from scriptorium.llm import lookalike as k

MODEL = k.Model(k.pair_counts(iter(["The Unsent Lantern Harbor", "Burning Garden", "Throne of Salt", "Тихий маяк", "Соляная дорога"] * 20)))


@pytest.mark.parametrize(
    ("value", "want"),
    [("Тhе Unsent Lаntern", "The Unsent Lantern"), ("Νinth Наrbor", "Ninth Harbor"), ("Ｔｈｅ Salt３", "The Salt3"), ("étoile", "étoile"), ("隐形图书​⁠馆", "隐形图书馆"), ("⽆名", "无名"), ("梨花", "梨花"), ("a b　c", "a b c"), ("空­心", "空心")],
)
def test_cases(value, want):
    assert k.consistent(value, MODEL) == want


@pytest.mark.parametrize("value", ["", "Тихий маяк", "Renée Zoë", "夢與樓", "a\n\tb", "《灯》：！，（二）", "№ 7 ①²", "“x”—…·～", "カタカナ ひらがな", "x" * 50_000])
def test_no_cases(value):
    assert k.consistent(value, MODEL) == value


def test_rows(books, wishes, spark):
    b = books({"book_id": "a", "title": "Sаlt", "author": None}, {"book_id": "a", "title": "Sаlt"}, {"book_id": "b", "title": "", "author": "x​y"})
    w = wishes({"id": "w", "title": "灯 "}, {"id": "v", "title": None})
    none = spark.createDataFrame([], "field string, book_id string")
    assert {tuple(r) for r in k.found(b, w, none).collect()} == {("books", "a", "title"), ("books", "b", "author"), ("wishlist", "w", "title")}
    gone = spark.createDataFrame([("title", "a")], "field string, book_id string")
    assert ("books", "a", "title") not in {tuple(r) for r in k.found(b, w, gone).collect()}
    assert k.normalized(b, w).count() == 8
    assert k.found(books(), wishes(), none).count() == 0


def test_ideographic_space_alone(books, wishes, spark):
    b = books({"book_id": "a", "title": "The　Burning Lantern"}, {"book_id": "b", "title": "盐园，《灯》", "author": "陈　桂"})
    w = wishes({"id": "w", "title": "Salt Orchard　"})
    none = spark.createDataFrame([], "field string, book_id string")
    assert {tuple(r) for r in k.found(b, w, none).collect()} == {("books", "a", "title"), ("books", "b", "author"), ("wishlist", "w", "title")}
    assert {r.record_id: r.consistent for r in k.normalized(b, w).where("field = 'title'").collect()} == {"a": "The Burning Lantern", "b": "盐园，《灯》", "w": "Salt Orchard "}


#: Tokens whose letters are mostly of the wrong script, numerals and digits for letters, syllables for ideographs.
HARD = [("Тhе Lаntern", "The Lantern"), ("Нarbоr", "Harbor"), ("ꓧarbor", "Harbor"), ("ⅼantern", "lantern"), ("Sa1t", "Salt"), ("港ロ", "港口"), ("力ーテン", "カーテン")]


def test_the_lattice_decides():
    """A mapping to the script of most letters gets hard tokens wrong that the likeliest path gets right."""
    model = k.Model(k.pair_counts(iter(["The Unsent Lantern Harbor Salt", "Burning Garden", "港口 出口 入口", "カーテン タワー ラーメン", "Тихий маяк", "Соляная дорога"] * 20)))
    want = [(v, w) for v, w in HARD if w]
    assert [k.consistent(v, model) for v, _ in want] == [w for _, w in want]
    assert sum(k.majority(v) != w for v, w in want) >= 4
    flat = k.Model({})
    assert sum(k.consistent(v, flat) != w for v, w in want) >= 1


def test_plain_words_are_no_lattices():
    for v in ["Тихий маяк", "сосо", "R2D2", "A1", "1st 10th", "東京タワー", "Ωmega", "八一", "Ⅱ"]:
        assert k.consistent(v, MODEL) == v


def test_long_tokens_take_linear_time():
    assert k.consistent("Lаntern" * 20_000, MODEL) == "Lantern" * 20_000
