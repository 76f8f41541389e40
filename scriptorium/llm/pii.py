"""Problem 10: personal information inside free text.

Method: a skip-chain conditional random field over each document's candidate pieces. A node is a stretch of tokens that
could be personal data; its labels are 'none' and the five kinds, and a stretch of digits may be of several kinds. Its
potentials come from shape and cue words (fixed log-odds) and from the words around it (learned weights); chain edges
join neighbours, skip edges join nodes of the same or similar tokens at any distance. Loopy message passing gives each
node's marginals; a piece is found where another label than 'none' wins.

Some nodes only the field can decide: whatever shares its tokens with a name that a cue names for sure, wherever it
stands (in other case, without a middle name, with one typing error), numbers without a cue, names behind words that no
list holds. Their own odds are against them; a skip edge to a sure mention or the learned weights carry them.

Training: the weights of the words around a node and the chain potentials are fitted to the nodes of SAMPLE documents
(those of the least hashed ids), labelled by what is sure: a strong cue or check digit, or the string being sure
elsewhere in the sample. Weights shrink to zero and are held within LIMIT, so that a few chance contexts decide nothing.

Places to look at are found by their digits, signs and cue words; the patterns run there only, over whole texts.

Defined cases: NULL and empty texts have no pieces; a piece twice in a text is one row; very long texts are read whole
and messages pass only along edges, of which a node has one to the previous and one to the first node of its tokens;
repeated documents give one row a piece; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("none", "email", "phone", "id_number", "address", "name")
ROUNDS = 6
#: Documents that the weights are fitted to, the least count of a context, and how far a node's weights may carry it.
SAMPLE, LEAST, LIMIT = 4_000, 5, 2.5
#: Own log-odds of nodes that no cue names: in a sure name's other mentions, of one token only, behind an unknown word.
MENTION, SINGLE, UNCUED = -0.7, -3.9, -1.5

#: Full-width digits, letters and signs read as the ordinary ones; one character for one, so places stay.
_FULL = re.compile("[０-９Ａ-Ｚａ-ｚ＠＋－（）．＃]")

_AT = r"(?: ?[@] ?| ?(?:\[at\]|\(at\)|\{at\}) ?)"
_DOT = r"(?:\.| ?(?:\[dot\]|\(dot\)|\{dot\}) ?)"
_LOCAL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"{_LOCAL}{_AT}(?:{_LABEL}{_DOT})+[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
#: Spelt out: 'name at site dot org'.
EMAIL_WORDS = re.compile(rf"{_LOCAL} at (?:{_LABEL} dot )+[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_EXT = r"(?:(?: ?转 ?| ?(?:[,，] ?)?(?:ext|extension|poste|x)\.? ?#?)\d{1,6}|-\d{1,4}(?![\d-]))?"
PHONE = re.compile(
    r"(?<![\d.\-A-Za-z+(/=])(?:"
    r"(?:(?:\+|00)86[ \-]?)?1[3-9]\d(?:\d{8}|([ \-])\d{4}\1\d{4})"  # mobile numbers
    r"|(?:(?:\+|00)86[ \-]?)?\(?0?\d{2,3}\)?[ \-]\d{4}[ \-]?\d{4}|\(0\d{2,3}\) ?\d{4}[ \-]?\d{4}|\(0\d{2,3}\) ?\d{3}[ \-]?\d{4}|0\d{2,3}[ \-]\d{7,8}"  # with an area code
    r"|(?:(?:\+|00)?1[ \-.])?\(?[2-9]\d{2}\)?[ \-.]\d{3}[ \-.]\d{4}"  # three, three, four
    r"|\+44[ \-]?\(?0?\)?\d{2,4}[ \-]?\d{3,4}[ \-]?\d{3,4}|0\d{4}[ \-]\d{6}|020[ \-]\d{4}[ \-]\d{4}"
    r"|(?:(?:\+|00)33[ \-.]?(?:\(0\))?|0)[1-9](?:([ \-.]?)\d{2}(?:\2\d{2}){3})"
    r"|\+\d{1,3}(?:[ \-.]?\(?\d{1,4}\)?){2,5}"
    rf"){_EXT}(?![\d]|[A-Za-z])"
)
ID_NUMBER = re.compile(
    r"(?<![\dA-Za-z\-.+@/])(?:"
    r"\d{6}([ \-]?)(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\1\d{3}[\dXx]"
    r"|\d{3}([ \-])\d{2}\2\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|[A-Z]{1,2}\d{7,8}"
    r"|[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?"
    r")(?![\dA-Za-z])"
)
_NUM = r"[0-9一二三四五六七八九十百]+"
ZH_ROAD = re.compile(rf"(?<=[一-龥])(?:大道|大街|路|街|巷|弄|胡同){_NUM}(?:-{_NUM})?号(?:院内|院)?(?:{_NUM}(?:号楼|栋|幢|座|单元|楼|层|室|号|户))*(?:[A-Z0-9]+室)?")
#: Ideographs of the names of places and roads before a road's kind; words like 'at', 'to' and 'I' end them.
_ZH_RUN = re.compile(r"(?:(?![的了着过我你他她它们这那是说在到寄住往至位于])[一-龥])+$")
_ZH_LABEL = re.compile(r".*(?:地址|住址|地点)")
_ZH_PLACES = "省市县区镇乡村州"
_W = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ’'\-]+"
_STREET = "Street|Avenue|Road|Lane|Row|Close|Drive|Court|Place|Square|Terrace|Way|Walk|Hill|Mews|Gate|Wharf|Green|Gardens|Parade|Rise|Grove|Yard|Alley|Crescent|Boulevard|St\\.|Ave\\.|Rd\\."
EN_ADDRESS = re.compile(rf"(?:(?:Flat|Apt|Apartment|Unit|Suite) [0-9A-Z]+, ?)?(?<![\d])\d{{1,5}}[A-Z]? (?:{_W} ){{1,3}}(?:{_STREET})(?![a-z])(?:,? (?:Flat|Apt|Apartment|Unit|Suite)\.? [0-9A-Z]+)?(?:, {_W}(?: {_W})?(?: \d{{5}}(?:-\d{{4}})?)?)?")
FR_ADDRESS = re.compile(rf"(?<!\d)\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|avenue|impasse|quai|place|boulevard|allée|chemin|cours|passage) (?:(?:de la|de l’|des|du|de|d’|de l')[ ]?)?{_W}(?:[ \-]{_W})*(?:, (?:appt?\.? ?\d+, )?\d{{5}} {_W}(?:[ \-]{_W})*)?")

#: Common family names.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉钮龚程嵇邢裴陆荣翁荀羊惠甄曲家封芮储靳段富巫乌焦巴弓牧山谷车侯全班秋仲伊宫宁仇栾甘厉戎祖武符刘景詹束龙叶幸司韶黎薄印宿白怀蒲从鄂索赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍桑桂牛寿通边扈燕冀浦尚农温别庄晏柴瞿阎连习艾鱼容向古易慎戈廖庾终居衡步都耿满弘匡国文寇广东欧沃利蔚越师巩聂晁勾敖融冷辛阚那简饶曾沙养鞠丰关相查后荆红游权盖益桓公肖"
COMPOUND = "欧阳|上官|司马|诸葛|慕容|司徒|东方|南宫|皇甫|尉迟|公孙|令狐|长孙|宇文|轩辕|夏侯|端木|百里|独孤|西门"
_ZH_NAME = rf"(?:(?:{COMPOUND})[一-龥]{{1,2}}|[{SURNAMES}][一-龥]{{1,2}})"


def _literals(cue: str) -> tuple[str, ...]:
    """Words of a cue of which every match holds one: the text is searched for these first."""
    inner = re.match(r"\(\?:((?:[^()]|\([^()]*\))*)\)|(.*)", cue, re.S)
    words = []
    for branch in (inner.group(1) or inner.group(2)).split("|"):
        runs = re.findall(r"[一-龥]+|[a-zà-ÿ]{2,}|—", re.sub(r"\[[^\]]*\]|\(\?:[^)]*\)|\\.", " ", branch))
        words.append(max(runs, key=len, default=""))
    return tuple(words)


#: Cues, before and after, that name a Chinese person; the text between must have the shape of a name.
ZH_CUES = [
    (r"(?:联系人|责任编辑|责编|编辑|校对|录入|扫描|整理|收件人|寄件人|签约人|作者本名|经手人|负责人|姓名)\s?[：:]\s?", r"(?=[\s。，,；;、（(先女老]|$)"),
    (r"(?:本人|我叫|我是|我的名字叫|名叫)", r"(?=[，,。；]|$)"),
    (r"(?:有问题|有事|请)找", r"(?=就行|就好|即可|，|。)"),
    (r"(?:转给|交给|寄给|付给|感谢|谢谢|鸣谢)", r"(?=[，,。！]|$)"),
    (r"整理者", r"(?=留|[，。])"),
    (r"此稿由", r"(?=录入|整理|扫描|校对)"),
    (r"(?:录入|整理|扫描)，", r"(?=核对|校对|录入)"),
    (r"(?:写的是|署名是|署名为|收件人是)", r"(?=[，,。]|$)"),
    (r"(?:签约人|联系人|编辑|作者|收件人)[（(]", r"(?=[）)])"),
    (r"(?:——|—— )", r"(?=\s*(?:\n|$|\r))"),
]
_ZH_CUES = [(re.compile(f"(?:{a})(?P<n>{_ZH_NAME}){b}", re.M), _literals(a)) for a, b in ZH_CUES]
_NO_ZH_NAME = {"不详", "未知", "未详", "佚名", "匿名", "无名", "无名氏", "保密", "同上", "本站", "本人", "客服", "管理员", "编辑部"}
#: Behind a label or words that only a name follows, two to four ideographs are one even without a listed family name.
_ZH_SURE = [(re.compile(f"(?:{a})(?P<n>[一-龥]{{2,4}}){b}", re.M), _literals(a)) for a, b in (ZH_CUES[0], (r"(?:我叫|我的名字叫|名叫)", ZH_CUES[1][1]), *ZH_CUES[5:6], *ZH_CUES[7:9])]
#: A person's role right before a name with a form of address; a name behind any word and a colon, or in a line of its own.
_ROLED = re.compile(rf"(?:编辑|责编|校对|录入|扫描|整理|译者|作者|联系人|收件人|负责人|审稿|审校|主编)(?P<n>{_ZH_NAME})(?=先生|女士|小姐|老师|同志)")
_ZH_UNCUED = re.compile(rf"(?:[：:]\s?|^\s*)(?P<n>{_ZH_NAME})(?=[\s，,。；;、)）]|$)", re.M)
_TITLED = re.compile(rf"(?<![一-龥])(?P<n>{_ZH_NAME})(?:先生|女士|小姐|老师|同学|编辑|同志)(?![一-龥]{{0,2}}(?:想起|吹|在|把|却|这))")
_CAP = r"(?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][A-Za-zÀ-ÿ]*[a-zà-ÿA-ZÀ-Þ](?:[’'\-][A-ZÀ-Þ][A-Za-zÀ-ÿ]+)*)"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Monsieur|Madame)\.? )?"
_LATIN = rf"{_TITLE}(?P<n>{_CAP}(?:,? ?{_CAP}){{1,3}})"
EN_CUES = [
    (r"[Mm]y name is ", r""), (r"[Tt]hanks (?:go )?to ", r"(?= for| from|[.,!]|$)"), (r"[Tt]yped in by ", r"(?= and)"), (r"[Cc]hecked by ", r"(?=[.,]|\s|$)"), (r"[Pp]lease credit ", r"(?= for)"),
    (r"[Ss]igned for by ", r""), (r"Contact ?: ", r""), (r"(?:[Yy]ours|[Ss]incerely|[Rr]egards|[Bb]est|[Cc]heers|[Ww]ishes)(?: truly| sincerely| faithfully)?,\s{1,3}", r"(?=\s|$|\.)"), (r"— ?", r"(?=\s*(?:\n|\r|$))"),
    (r"(?:[Ee]dited|[Ss]canned|[Pp]roofread|[Uu]ploaded|[Tt]ranscribed|[Ss]igned|[Rr]eviewed|[Tt]ranslated|[Cc]ompiled) by ", r""), (r"(?:Editor|Proofreader|Attn|Name|Dear) ?[:.]? ", r""),
    (r"[Jj]e m[’']appelle ", r""), (r"(?:[Rr]elu|[Cc]orrigé|[Nn]umérisé|[Ss]aisi) par ", r""), (r"[Mm]erci à ", r"(?= pour|[.,!]|$)"), (r"Contact : ", r""),
]
_EN_CUES = [(re.compile(f"(?:{a}){_LATIN}(?![A-Za-zÀ-ÿ]){b}", re.M), _literals(f"(?:{a})")) for a, b in EN_CUES]
_CAPITALS = re.compile(rf"(?<![A-Za-zÀ-ÿ]){_CAP}(?:,? {_CAP}){{0,3}}(?![A-Za-zÀ-ÿ])")
_REPLIED = re.compile(rf"{_LATIN} (?:from the desk|replied|from the office)")
_NOT_PHONE = re.compile(r"(?:订单号?|流水号|单号|编号|批号|书号|ISBN|Order(?: no)?|Commande|order|invoice|No|no|版本|校验值|checksum|scan_v|QQ群?|tracking|Ref|运单号?)[.:：#]? ?$")
_ID_CUE = re.compile(r"(?:身份证|证件|证号|SSN|Passport|passport|护照|ID no|[Ii]dentity|ID number|pièce|sécurité|NIR|National|ID)[^\n。]{0,22}$")
_ID_AFTER = re.compile(r"^\s?(?:这串)?身份证|^\s?已核验")
_PHONE_CUE = re.compile(r"(?:电话|手机|联系方式|热线|致电|拨打|微信|Phone|phone|Call|call|number is|Tel|tel|left|Appelez|Téléphone|Mobile|fax|Fax|传真)[^\n。]{0,12}$")
#: Words that begin with a capital letter and are no part of a person's name.
_NO_NAME = {"The", "A", "An", "In", "On", "At", "It", "Chapter", "Volume", "Book", "Lantern", "Please", "Thanks", "Dear", "Contact", "Yours", "Phone", "Passport", "Return", "Order", "ISBN", "File", "Build", "Table", "See", "I", "If", "By", "My", "We", "As", "There", "No", "TEXT", "STARTS", "Send", "Write", "Call", "Our", "Duplicate", "Merci", "Relu", "Courriel", "Typed", "QQ", "SSN", "ID"}


def _cn_check(v: str) -> bool:
    d = re.sub(r"[^0-9Xx]", "", v)
    if len(d) != 18:
        return False
    s = sum(int(x) * (1 << (17 - i)) for i, x in enumerate(d[:17])) % 11
    return "10X98765432"[s] == d[17].upper()


class Node:
    """A stretch of text with the log-odds of each kind by shape and cue, and the tokens that skip edges go by."""

    __slots__ = ("end", "keys", "log", "start", "text")

    def __init__(self, text: str, start: int, end: int, label: str, odds: float, keys: tuple[str, ...]) -> None:
        self.text, self.start, self.end, self.keys = text, start, end, keys
        self.log = np.full(len(LABELS), -6.0)
        self.log[0] = 0.0
        self.log[LABELS.index(label)] = odds

    def own(self) -> float:
        return float(self.log[1:].max())


def _name_keys(name: str) -> tuple[str, ...]:
    """The whole name whatever its order, then, of a Latin one, its tokens of three letters or more."""
    tokens = re.findall(r"\w+", name.lower())
    return (" ".join(sorted(tokens)), *[f"~{t}" for t in tokens if len(t) > 2 and t[0] < "\u2000"])


def _trim(t: str, a: int, b: int) -> tuple[int, int, list[str]]:
    """A run of capitals without the sentence that begins behind it."""
    words = re.findall(r"[^\s,]+", t[a:b])
    while words and words[-1].rstrip(".") in _NO_NAME:
        b = a + t[a:b].rfind(words.pop())
        b = a + len(t[a:b].rstrip(" ,."))
    return a, b, words


_FORMS = ("先生", "女士", "小姐", "老师", "同学", "编辑", "同志")
#: (pattern, cue words of which a match holds one, log-odds).
_PATTERNS = [(p, w, 4.0) for p, w in _ZH_CUES] + [(p, w, 1.0) for p, w in _ZH_SURE] + [(_ROLED, _FORMS, 3.0), (_TITLED, _FORMS, -0.5)]
_LATIN_PATTERNS = [*_EN_CUES, (_REPLIED, ("from the", "replied"))]


def _finder():
    """All cue words at once: each with the patterns that ask for it."""
    of: dict[str, set[int]] = {}
    for i, (_, words, *_) in enumerate([*_PATTERNS, *_LATIN_PATTERNS]):
        for w in words:
            of.setdefault(w, set()).add(i)
    a = ahocorasick.Automaton()
    for w, which in of.items():
        a.add_word(w, frozenset(which))
    a.make_automaton()
    return a


_CUE_WORDS = _finder()


def _name_spans(t: str) -> Iterator[tuple[int, int, float]]:
    asked: set[int] = set()
    for _, which in _CUE_WORDS.iter(t):
        asked |= which
    for i in sorted(asked):
        if i < len(_PATTERNS):
            cue, _, odds = _PATTERNS[i]
            for m in cue.finditer(t):
                if odds != 1.0 or m.group("n") not in _NO_ZH_NAME:
                    yield *m.span("n"), odds
        else:
            for m in _LATIN_PATTERNS[i - len(_PATTERNS)][0].finditer(t):
                a, b, words = _trim(t, *m.span("n"))
                if len(words) >= 2 and words[0] not in _NO_NAME:
                    yield a, b, 4.0
    for m in _ZH_UNCUED.finditer(t):
        if m.group("n") not in _NO_ZH_NAME:
            yield *m.span("n"), UNCUED


def _like(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Names of the same tokens, or all of one in the other, or with one typing error."""
    if a[0] == b[0]:
        return True
    x, y = set(a[1:]), set(b[1:])
    if x and y and (x <= y or y <= x):
        return True
    # One token differs, in one letter.
    p, q = x - y, y - x
    return bool(len(p) == len(q) == 1 and x & y and _near(p.pop(), q.pop()))


def _near(a: str, b: str) -> bool:
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def _mentions(t: str, named: list[Node]) -> Iterator[Node]:
    """Other places of the names that a cue names for sure: in any case, and whatever runs of capitals are like them."""
    sure = {n.text: n for n in named if n.log[LABELS.index("name")] >= 3}
    if not sure:
        return
    low = t.lower()
    folded = len(low) == len(t)
    for s, n in sure.items():
        latin = s[0].isascii()
        where, what = (low, s.lower()) if latin and folded else (t, s)
        at = where.find(what)
        while at >= 0:
            ends = at + len(s)
            if not (latin and (where[at - 1 : at].isalnum() or where[ends : ends + 1].isalnum())):
                yield Node(t[at:ends], at, ends, "name", MENTION, n.keys)
            at = where.find(what, ends)
    by_token: dict[str, list[Node]] = {}
    for n in sure.values():
        for k in n.keys[1:]:
            by_token.setdefault(k, []).append(n)
    if by_token:
        for m in _CAPITALS.finditer(t):
            # Of a run of capitals, from its first to its last token of sure names: a sentence may begin with another.
            words = [(w.start() + m.start(), w.end() + m.start()) for w in re.finditer(r"[^\s,]+", m.group())]
            tokens = [_name_keys(t[i:j])[1:] for i, j in words]
            known = [k for k, x in enumerate(tokens) if any(y in by_token for y in x)]
            if not known:
                continue
            lo, hi = known[0], known[-1]
            for lo, hi in {(lo, hi), (max(0, lo - 1), hi), (lo, min(hi + 1, len(words) - 1)), (0, len(words) - 1)}:
                a, b = words[lo][0], words[hi][1]
                keys = _name_keys(t[a:b])
                others = {id(n): n for k in keys[1:] for n in by_token.get(k, ())}
                if any(_like(keys, n.keys) for n in others.values()):
                    yield Node(t[a:b], a, b, "name", MENTION if hi > lo else SINGLE, keys)


def _zh_start(t: str, road: int) -> int:
    """Where an address begins whose road's kind stands at a place: parts of one to six ideographs, walked back."""
    run = _ZH_RUN.search(t, max(0, road - 60), road)
    if not run:
        return road
    least = run.start()
    if label := _ZH_LABEL.match(t, least, road):
        least = label.end()
    a = end = road
    while a > least:
        # The part reaches back to the place before it, if one is near, or to where the run begins.
        a = next((i for i in range(end - 1, max(least, end - 7), -1) if t[i - 1] in _ZH_PLACES and i - 1 > least), 0)
        if not a:
            return least if end - least <= 6 else end - 2
        end = a - 1
    return a


_DIGITS = re.compile(r"[0-9]+")
_LOCAL_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_AT_SIGNS = re.compile(r"@|[\[({]at[\])}]", re.I)
_FLAT = re.compile(r"(?:Flat|Apt|Apartment|Unit|Suite) [0-9A-Z]+, ?$")


def _emails(t: str) -> Iterator[Node]:
    if "@" in t or "at]" in t or "at)" in t or "at}" in t or "AT" in t:
        done = 0
        for sign in _AT_SIGNS.finditer(t):
            i = sign.start() - (t[sign.start() - 1 : sign.start()] == " ")
            while i > done and t[i - 1] in _LOCAL_LETTERS:
                i -= 1
            if m := EMAIL.search(t, i, sign.end() + 320):
                if m.start() < sign.start():
                    done = m.end()
                    yield Node(m.group(), *m.span(), "email", 5.0, (m.group().lower(),))
    if " dot " in t:
        for m in EMAIL_WORDS.finditer(t):
            yield Node(m.group(), *m.span(), "email", 4.0, (m.group().lower(),))


def _numeric_windows(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches with six digits or more that few signs part, with room for what stands around a number."""
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 4:
            j += 1
            n += runs[j][1] - runs[j][0]
        if n >= 6:
            # Never into the next stretch, never out of the last: a number lies in one of them.
            lo = max(runs[i - 1][1] if i else 0, runs[i][0] - 8)
            hi = min(runs[j + 1][0] if j + 1 < len(runs) else len(t), runs[j][1] + 24)
            ext = j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 24
            yield lo, runs[j + 1][1] if ext else hi
        i = j + 1


def _numbers(t: str, runs: list[tuple[int, int]]) -> Iterator[Node]:
    for lo, hi in _numeric_windows(t, runs):
        for m in ID_NUMBER.finditer(t, lo, hi):
            if t[m.end() : m.end() + 1].isalnum() and t[m.end()].isascii():
                continue
            before, odds = t[max(0, m.start() - 40) : m.start()], -1.5
            shape = re.sub(r"\d", "9", m.group())
            if _ID_CUE.search(before) or _ID_AFTER.search(t[m.end() : m.end() + 8]):
                odds = 5.0
            elif _NOT_PHONE.search(before):
                odds = -5.0
            elif _cn_check(m.group()):
                odds = 2.5
            elif shape.startswith(("QQ 99", "QQ99")):
                odds = 2.0
            yield Node(m.group(), *m.span(), "id_number", odds, (re.sub(r"\W", "", m.group()).lower(),))
        for m in PHONE.finditer(t, lo, hi):
            if t[m.end() : m.end() + 1].isalnum() and t[m.end()].isascii():
                continue
            before, odds = t[max(0, m.start() - 24) : m.start()], 1.0
            digits = re.sub(r"\D", "", m.group())
            if not 7 <= len(re.sub(r"(?:转|ext|x|poste).*", "", digits)) <= 17:
                continue
            if _NOT_PHONE.search(before):
                odds = -5.0
            elif _PHONE_CUE.search(before):
                odds = 5.0
            yield Node(m.group(), *m.span(), "phone", odds, (digits,))


def _addresses(t: str, runs: list[tuple[int, int]]) -> Iterator[Node]:
    if "号" in t:
        for m in ZH_ROAD.finditer(t):
            a = _zh_start(t, m.start())
            if a < m.start():
                yield Node(t[a : m.end()], a, m.end(), "address", 4.0, (t[a : m.end()],))
    for i, j in runs:
        if j - i > 5 or t[j : j + 1] not in (" ", ",") and t[j + 1 : j + 2] != " ":
            continue
        if m := EN_ADDRESS.match(t, i):
            a = i - (len(f.group()) if (f := _FLAT.search(t, max(0, i - 40), i)) else 0)
            yield Node(t[a : m.end()], a, m.end(), "address", 3.5, (t[a : m.end()].lower(),))
        elif m := FR_ADDRESS.match(t, i):
            yield Node(m.group(), *m.span(), "address", 3.5, (m.group().lower(),))


def candidates(text: str) -> list[Node]:
    """The nodes of a text, in order; of overlapping spans the likelier, then the longer one. Two kinds of the same
    span are one node with the odds of both."""
    t = _FULL.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)
    runs = [m.span() for m in _DIGITS.finditer(t)]
    nodes = [*_emails(t), *_numbers(t, runs), *_addresses(t, runs)]
    named = [Node(t[a:b], a, b, "name", odds, _name_keys(t[a:b])) for a, b, odds in _name_spans(t)]
    nodes += [*named, *_mentions(t, named)]
    at: dict[tuple[int, int], Node] = {}
    for n in nodes:
        if (x := at.get((n.start, n.end))) is None:
            at[n.start, n.end] = n
        else:
            np.maximum(x.log, n.log, out=x.log)
    return _apart(sorted(at.values(), key=lambda n: (-n.own(), n.start - n.end, n.start)))


def _apart(nodes: list[Node]) -> list[Node]:
    """Keeps, in the given order, the spans that overlap none kept before; gives them by place."""
    starts: list[int] = []
    kept: list[Node] = []
    for n in nodes:
        i = bisect.bisect(starts, n.start)
        if (i and kept[i - 1].end > n.start) or (i < len(kept) and kept[i].start < n.end):
            continue
        starts.insert(i, n.start)
        kept.insert(i, n)
    return kept


# --- what is learned


def contexts(t: str, n: Node) -> tuple[str, ...]:
    """The words around a node, digits alike: two characters and a word before, the same behind."""
    before, behind = t[max(0, n.start - 14) : n.start], t[n.end : n.end + 14]
    before, behind = re.sub(r"[0-9]", "9", before).lower(), re.sub(r"[0-9]", "9", behind).lower()
    out = {f"B{before[-2:]}", f"A{behind[:2]}", f"B{before[-4:]}"}
    if m := re.search(r"([a-zà-ÿ]+)\W{1,3}$", before):
        out.add(f"W{m.group(1)}")
    if m := re.match(r"\W{1,3}([a-zà-ÿ]+)", behind):
        out.add(f"V{m.group(1)}")
    return tuple(out)


class Field:
    """Learned potentials: of a context with each label, and of a chain edge."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, chain: np.ndarray | None = None) -> None:
        self.weights = weights or {}
        self.chain = _CHAIN if chain is None else chain

    def potentials(self, t: str, nodes: list[Node]) -> np.ndarray:
        log = np.stack([n.log for n in nodes])
        if self.weights:
            for i, n in enumerate(nodes):
                got = [w for c in contexts(t, n) if (w := self.weights.get(c)) is not None]
                if got:
                    log[i] += np.where(log[i] > -6.0, np.clip(np.sum(got, 0), -LIMIT, LIMIT), 0.0)
        return log


def _teacher(text: str | None) -> list[tuple[str, int, list[str], int]]:
    """(string, label or -1 where nothing is sure, own potentials, contexts, label of the node before or -1) of a text's nodes."""
    if not text:
        return []
    nodes, out, before = candidates(text), [], -1
    for i, n in enumerate(nodes):
        best = int(n.log.argmax())
        label = best if best and n.own() >= 2.5 else 0 if n.own() <= -4 else -1
        near = i and n.start - nodes[i - 1].end < 40
        out.append((n.keys[0], label, n.log.tolist(), list(contexts(text, n)), before if near else -1))
        before = label
    return out


def fit(nodes: list[tuple[str, int, list[float], list[str], int]]) -> Field:
    """Weights of contexts and chain potentials from labelled nodes; a string that is sure somewhere is so everywhere."""
    sure: dict[str, Counter] = {}
    for key, label, *_ in nodes:
        if label > 0:
            sure.setdefault(key, Counter())[label] += 1
    of = np.zeros(len(LABELS))
    seen: dict[str, np.ndarray] = {}
    pairs = np.zeros((len(LABELS), len(LABELS)))
    for key, label, own, around, before in nodes:
        if before > 0 and label > 0:
            pairs[before, label] += 1
        if label < 0 and key in sure:  # what its string is elsewhere
            label = sure[key].most_common(1)[0][0]
        if label < 0:  # an unsure node counts for each label as its own odds say
            share = np.exp(np.asarray(own) - max(own))
            share /= share.sum()
        else:
            share = np.eye(len(LABELS))[label]
        of += share
        for c in around:
            seen[c] = seen.get(c, 0.0) + share
    base = (of + 1) / (of.sum() + len(LABELS))
    weights = {}
    for c, n in seen.items():
        if n.sum() < LEAST:
            continue
        # Against what the labels' shares would give: ten nodes' worth of those are added to each context.
        w = np.log((n + 10 * base) / ((n.sum() + 10) * base))
        weights[c] = np.clip(w - w[0], -LIMIT, LIMIT) / 2
    row, col, all_of = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True), pairs.sum()
    chain = _CHAIN + np.clip(np.log((pairs + 5) * (all_of + 180) / ((row + 30) * (col + 30))), -0.3, 0.3) * (_CHAIN > 0)
    return Field(weights, chain)


def trained(documents: DataFrame) -> Field:
    """The field of a corpus, from the nodes of SAMPLE documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for t in b.column("text").to_pylist() for x in _teacher(t)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "label", "own", "around", "before"])

    # A threshold on the hash leaves about twice the sample before the least are ordered: no task meets all rows.
    least = F.xxhash64("doc_id", "text")
    share = min(1.0, 2.0 * SAMPLE / max(documents.count(), 1))
    rows = documents.where("text <> ''").where(F.shiftrightunsigned(least, 32) < int(share * 2**32))
    sample = rows.select("doc_id", "text").orderBy(least).limit(SAMPLE)
    nodes = sample.select("text").repartition(8).mapInArrow(run, "key string, label int, own array<double>, around array<string>, before int")
    return fit(sorted(tuple(r) for r in nodes.collect()))


#: Log-potentials of a chain edge (neighbours within a line share a block of contacts) and of a skip edge.
_CHAIN = np.zeros((len(LABELS), len(LABELS)))
_CHAIN[1:, 1:] = 0.2
_SKIP = np.full((len(LABELS), len(LABELS)), -1.5)
np.fill_diagonal(_SKIP, 2.0)


def marginals(nodes: list[Node], log: np.ndarray | None = None, chain: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Sum-product messages along chain and skip edges: exact without loops, loopy with them."""
    n = len(nodes)
    log = np.stack([x.log for x in nodes]) if log is None else log
    chain = _CHAIN if chain is None else chain
    edges: list[tuple[int, int, np.ndarray]] = [(i, i + 1, chain) for i in range(n - 1) if nodes[i + 1].start - nodes[i].end < 40]
    if n > 1:
        met: set[tuple[int, int]] = set()
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for i, x in enumerate(nodes):
            for k in x.keys:
                for j in {first.get(k, i), last.get(k, i)} - {i}:
                    if (j, i) not in met and (k == x.keys[0] == nodes[j].keys[0] or _like(x.keys, nodes[j].keys)):
                        met.add((j, i))
                        edges.append((j, i, _SKIP))
                first.setdefault(k, i)
                last[k] = i
    if not edges or not rounds:
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a = np.array([e[0] for e in edges])
    b = np.array([e[1] for e in edges])
    pot = np.stack([e[2] for e in edges])
    to_b, to_a = np.zeros((len(edges), len(LABELS))), np.zeros((len(edges), len(LABELS)))

    def belief() -> np.ndarray:
        out = log.copy()
        np.add.at(out, b, to_b)
        np.add.at(out, a, to_a)
        return out

    for _ in range(rounds):
        now = belief()
        new_b = np.logaddexp.reduce((now[a] - to_a)[:, :, None] + pot, axis=1)
        new_a = np.logaddexp.reduce((now[b] - to_b)[:, None, :] + pot, axis=2)
        to_b, to_a = new_b - new_b.max(1, keepdims=True), new_a - new_a.max(1, keepdims=True)
    now = belief()
    p = np.exp(now - now.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def pieces(text: str | None, field: Field | None = None, rounds: int = ROUNDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data of a text, in order."""
    if not text:
        return []
    nodes = candidates(text)
    if not nodes:
        return []
    field = field or Field()
    best = marginals(nodes, field.potentials(text, nodes), field.chain, rounds).argmax(1)
    return [(n.start, n.end, LABELS[k]) for n, k in zip(nodes, best, strict=True) if k]


def redact(text: str | None, own: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with typed placeholders for its pieces."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in pieces(text) if own is None else own:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def found(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    field = trained(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += dict.fromkeys((doc, kind, text[i:j]) for i, j, kind in pieces(text, field, rounds))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "kind", "found_text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, kind string, found_text string").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text, pieces): every text with typed placeholders and how many pieces they stand for."""
    field = trained(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [pieces(t, field) for t in texts]
            plain = [redact(t, own) for t, own in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(plain, pa.string()), pa.array(list(map(len, found)), pa.int32())], ["doc_id", "text", "pieces"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, pieces int")
