import pytest

from scriptorium.llm import pii


def got(text):
    return [(k, text[a:b]) for a, b, k in pii.pieces(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("邮箱 a.b+c@mail.test ，看到必回", [("email", "a.b+c@mail.test")]),
        ("write to x [at] post [dot] example [dot] org.", [("email", "x [at] post [dot] example [dot] org")]),
        ("到zan＠post.example.org。", [("email", "zan＠post.example.org")]),
        ("电话(0960) 5550 0005，晚上", [("phone", "(0960) 5550 0005")]),
        ("电话１６９２４９２０４３２，", [("phone", "１６９２４９２０４３２")]),
        ("My number is 1-212-555-0199 ext. 28, ask", [("phone", "1-212-555-0199 ext. 28")]),
        ("Appelez le +33 1 99 00 88 77 après", [("phone", "+33 1 99 00 88 77")]),
        ("身份证：48000320030724759X，作者", [("id_number", "48000320030724759X")]),
        ("SSN, QQ 36 94 60 C.", [("id_number", "QQ 36 94 60 C")]),
        ("样书请寄到冰芊省伞枫市霓蓼镇馨藤巷7号院内7号楼。", [("address", "冰芊省伞枫市霓蓼镇馨藤巷7号院内7号楼")]),
        ("Return address: Flat 9, 9 Millrace Avenue, Sifimi 12345", [("address", "Flat 9, 9 Millrace Avenue, Sifimi 12345")]),
        ("Envoyez au 9 rue de la Marée, 44575 Kizoji.", [("address", "9 rue de la Marée, 44575 Kizoji")]),
        ("联系人：上官弦长。", [("name", "上官弦长")]),
        ("此稿由陈桂洛录入，谢梭核对。", [("name", "陈桂洛"), ("name", "谢梭")]),
        ("Thanks go to Nonellel, Stephanie for the map.", [("name", "Nonellel, Stephanie")]),
        ("Ms. Ada Zimevi-Sun from the desk replied.", [("name", "Ada Zimevi-Sun")]),
    ],
)
def test_found(text, want):
    assert got(text) == want


@pytest.mark.parametrize("text", ["", None, "订单号 205905619212684952，已发货。", "ISBN 9797481117596 的那一版", "楼主@渡口闲人 说得对。", "As @lampstairs_fan said", "https://scan.example/book/9?page=2", "墨渡街的书摊", "The shop on Lantern Row", "管账先生低声说道。", "流水号97826454712953979作废。"])
def test_not_found(text):
    assert pii.pieces(text) == []


def test_skip_edges_find_bare_names():
    text = "联系人：陈桂洛。" + "雨停了。" * 5000 + "听说陈桂洛已搬走。"
    assert [x for x in got(text) if x[0] == "name"] == [("name", "陈桂洛")] * 2
    assert got("听说陈桂洛已搬走。") == []


def test_rows(spark):
    rows = [(1, "邮箱 a@b.test ，邮箱 a@b.test ，"), (1, "邮箱 a@b.test ，"), (2, None), (3, ""), (4, "x" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as kind")
    assert [tuple(r) for r in pii.found(d).collect()] == [(1, "email", "a@b.test")]
    assert sorted(r.pieces for r in pii.redacted(d).collect()) == [0, 0, 0, 1, 2]
    assert pii.redact("邮箱 a@b.test ，") == "邮箱 [EMAIL] ，"
    assert pii.found(d.where("doc_id > 9")).count() == 0


@pytest.mark.parametrize("name", ["曾志强", "肖红", "温小海", "凌云", "仝志强", "买买提江"])
def test_names_without_a_common_family_name(name):
    assert got(f"联系人：{name}。") == [("name", name)]
    assert name not in pii.redact(f"我叫{name}，写书的。")
    assert got("联系人：不详。") == []


@pytest.mark.parametrize("address", ["黑龙江省哈尔滨市南岗区解放北路12号", "石家庄市长安区中山路12号", "呼和浩特市新城大街5号", "沙路3号"])
@pytest.mark.parametrize("before", ["", "样书请寄到", "我住在", "收件地址：", "他走过"])
def test_addresses_with_parts_of_any_length(before, address):
    assert got(f"{before}{address}。") == [("address", address)]


#: What no cue names: other case, a missing or misspelt part, a reordered one, a number's other spelling.
HARD = [
    ("Reviewed by Maria Garcia Lopez. Later Maria Lopez found two more pages.", ["Maria Lopez"]),
    ("Thanks to Emily Watson for the map.\nEMILY WATSON keeps the originals.", ["EMILY WATSON"]),
    ("Contact: Winifred Tebimenker\nAsk Winifrid Tebimenker for the rest.", ["Winifrid Tebimenker"]),
    ("My name is Theodore Zenbenfe. Letters for Zenbenfe, Theodore go to the desk.", ["Zenbenfe, Theodore"]),
    ("联系人：陈桂洛。听说陈桂洛已搬走。", ["陈桂洛"]),
]


def test_the_field_decides(capsys):
    """Without messages the hard pieces are lost: they are found by skip edges alone."""
    on = off = 0
    for text, want in HARD:
        with_field = [text[a:b] for a, b, _ in pii.pieces(text)]
        without = [text[a:b] for a, b, _ in pii.pieces(text, rounds=0)]
        on += sum(with_field.count(w) > without.count(w) for w in want)
        off += sum(w in without for w in want if without.count(w) == with_field.count(w))
    assert (on, off) == (len(HARD), 0)


def test_a_garden_is_no_relative():
    assert [x for _, x in got("Thanks to Rose Walker for the map. The Rose Garden was closed.")] == ["Rose Walker"]


def test_weights_are_learned(spark):
    """A word that no list holds stands before names that a cue names elsewhere: it is learned as a cue."""
    names = ["陈桂洛", "李苍礁", "韦莱", "沈深海", "孔桃凰", "郎朵琼", "许冰朵", "鲍雪香"]
    rows = [(f"联系人：{n}。" + "雨停了。" * 20 + f"接洽者：{n}，有事写信。") for n in names for _ in range(4)] + [f"人物：{n}，写得好。" for n in ["白狼王", "黄风怪"]] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, "接洽者：马石伞，有事写信。"])], "doc_id long, text string")
    field = pii.trained(docs)
    hard = "接洽者：马石伞，有事写信。"
    assert pii.pieces(hard) == [] and [hard[a:b] for a, b, _ in pii.pieces(hard, field)] == ["马石伞"]
    assert pii.pieces("人物：白狼王，写得好。", field) == []
    assert (len(rows), "name", "马石伞") in {tuple(r) for r in pii.found(docs).collect()}


def test_long_texts_take_linear_time():
    import time

    t = time.time()
    text = "联系人：陈桂洛。" + "陈桂洛来了，电话 13912345678。Dear Ada Zimevi, " * 20_000
    assert len(pii.pieces(text)) > 20_000 and time.time() - t < 60
