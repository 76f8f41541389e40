"""Problem 1: variant spellings of names that people typed.

Method: noisy-channel attribution. Stored values reduce to forms (what is left of a name without decoration, titles
and typing noise). Frequent forms are the candidate canonical ones. A form goes to the candidate of the greatest
posterior: the prior is the candidate's frequency, the likelihood that of the typing errors, abbreviations, reordered
parts, nicknames or transcriptions that would turn the candidate into the form, and that both stand beside the same
title. Candidates are met by keys (a name without one letter in any rotation, its first letters, its surname with an
initial, its transcription), never by comparing all with all. A form without a likely enough candidate is canonical.

What letters of another writing stand for is learned from the data: a character outside the simplified set from forms
that differ in it alone, a character's Latin syllable from forms beside the same title.

Defined cases: NULL, blank and stand-in values are no names; a value that stands more often as a title than as an
author is none; values without letters are none; very long values are compared whole; repeated rows add to frequency;
other columns are not read; an empty table gives no rows. A form met by two canonical ones of like probability stays by
itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .copies import STAND_INS
from .lookalike import ALIKE, normal

#: What stands where an author is unknown.
NO_AUTHOR = {*STAND_INS, "佚名", "未知", "匿名", "无名氏", "不详", "anonymous", "unknown", "unknown author", "anon", "various", "n/a", "none", "null", "author unknown", "作者不详", "未知作者", "unknownauthor", "无名", "未署名", "noauthor", "tba", "author", "作者"}
#: Forms of address and pen-name endings; short forms take the last two.
_ZH_TAIL = re.compile(r"(?:先生|女士|居士|主人|公子|老师|大大|散人|山人|大人|同学|君|客|大)$")
_ZH_ORG = re.compile(r"(?:网络文学有限公司|网络文学|文学有限公司|文化有限公司|有限公司|文化工作室|工作室|出版集团|出版社|出版|书社|文艺社|文学社|社)$")
_ZH_ROLE = re.compile(r"(?:\(著\)|/文|/著|\(编\)|\(译\)| 著| 编| 译|作品)$")
_ZH_BEFORE = re.compile(r"^(?:作者[:：]?|\(([^()]*(?:社|工作室|公司|出版))\)|\[?著\]?[:：])")
_LATIN_ROLE = re.compile(r"(?:,? *\(?\b(?:ed|eds|editor|trans|translator|author|jr|sr|phd|md)\b\.?\)?)+$", re.I)
_LATIN_TITLE = re.compile(r"^(?:(?:dr|mr|mrs|ms|prof|sir|by)\b\.? *)+", re.I)
_LATIN_ORG = re.compile(r"\b(?:publ|hse|pr|coll|writers['’]?s?|press|collective|company|co|studio|studios|publishing|publishers|editions|books|house|group|society|guild|ltd|inc|workshop)\b|&", re.I)
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_BLANKS, _NO_WORD, _NO_WORDS, _SOME = re.compile(r"[\s_]+"), re.compile(r"[^\w]"), re.compile(r"[^\w]+"), re.compile(r"\s+")
_EDGES = re.compile(r"^[\s“”\"'‘’「」『』《》〈〉【】\[\]()—\-~～!！?？.。…,，:：;；·]+(?!社\)|出版社\)|书社\)|工作室\))|[\s“”\"「」『』《》〈〉【】\[\]~～!！?？。…,，:：;；·\-—]+$")
_DOTS, _EDITED = re.compile(r"(?<=[^A-Z])\.+$|(?<=\w\w)\.+$"), re.compile(r"\bed\.$")
#: Short forms of given names.
NICKNAMES = {"bill": "william", "will": "william", "bob": "robert", "rob": "robert", "dick": "richard", "rick": "richard", "ted": "theodore edward", "ned": "edward", "ed": "edward", "jim": "james", "jack": "john jonathan", "jon": "jonathan john", "steven": "stephen", "catherine": "katherine", "kathryn": "katherine catherine", "ann": "anne", "sara": "sarah", "elisabeth": "elizabeth", "jeffrey": "geoffrey", "eric": "erik", "marc": "mark", "johnny": "john", "dot": "dorothy", "dottie": "dorothy", "lucy": "lucinda lucille", "peg": "margaret", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "kate": "katherine catherine", "kathy": "katherine catherine", "cathy": "catherine", "kit": "christopher katherine", "chris": "christopher", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bess": "elizabeth", "lizzie": "elizabeth", "vicky": "victoria", "tori": "victoria", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "win": "winifred", "winnie": "winifred", "fred": "frederick", "freddie": "frederick", "greg": "gregory", "geoff": "geoffrey", "jeff": "geoffrey jeffrey", "larry": "lawrence", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "charlie": "charles", "chuck": "charles", "hal": "henry", "harry": "henry harold", "hank": "henry", "nick": "nicholas", "nate": "nathaniel", "nat": "nathaniel", "dan": "daniel", "danny": "daniel", "ben": "benjamin", "benny": "benjamin", "becky": "rebecca", "becca": "rebecca", "barb": "barbara", "babs": "barbara", "steph": "stephanie", "steffi": "stephanie", "flo": "florence", "flossie": "florence", "fran": "francesca frances", "frankie": "francesca francis", "hattie": "harriet", "nell": "eleanor helen", "ellie": "eleanor", "nora": "eleanor", "jo": "josephine", "josie": "josephine", "pip": "philippa", "pippa": "philippa", "penny": "penelope", "nelly": "penelope eleanor", "ronnie": "veronica", "vera": "veronica", "gabe": "gabriel", "sandy": "alexander", "alex": "alexander", "al": "albert alexander", "andy": "andrew andre", "drew": "andrew", "vince": "vincent", "vin": "vincent", "jake": "jacob", "sam": "samuel samantha", "mike": "michael", "mick": "michael", "oli": "oliver", "ollie": "oliver", "sue": "susannah susan", "susie": "susannah susan", "tilly": "matilda", "mattie": "matilda", "ursa": "ursula", "matt": "matthew", "tony": "anthony", "joe": "joseph", "zack": "zachary", "abby": "abigail", "debbie": "deborah", "gunni": "gunter", "ren": "renee", "matyi": "matyas", "ulla": "ursula", "iggy": "ignatius", "len": "leonard", "lenny": "leonard", "nes": "ines", "tina": "celestine christina", "debs": "deborah", "steve": "steven stephen", "dave": "david", "phil": "philip", "ray": "raymond", "ron": "ronald", "don": "donald", "ken": "kenneth", "jerry": "gerald jeremy", "terry": "terence theresa", "cindy": "cynthia lucinda", "mandy": "amanda", "jenny": "jennifer", "katie": "katherine catherine", "molly": "mary", "polly": "mary", "nancy": "ann anne", "sally": "sarah", "toby": "tobias", "max": "maximilian", "gus": "augustus", "archie": "archibald", "bert": "albert herbert robert", "bella": "isabella", "izzy": "isabella isidore", "lottie": "charlotte", "millie": "mildred amelia", "trudy": "gertrude"}
#: Parts of family names that are no initials, though as short.
PARTICLES = frozenset({"le", "la", "de", "du", "di", "da", "el", "al", "st", "af", "zu"})
_PINYIN = re.compile(r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ui|ao|ou|iu|ie|ue|ve|er|an|en|in|un|ia|ua|uo|a|o|e|i|u|v)")
#: Where each initial of the Latin transcription begins among the characters that the national character
#: set orders by sound, as that set's codes.
_INITIALS = [("a", 0xB0A1), ("b", 0xB0C5), ("c", 0xB2C1), ("d", 0xB4EE), ("e", 0xB6EA), ("f", 0xB7A2), ("g", 0xB8C1), ("h", 0xB9FE), ("j", 0xBBF7), ("k", 0xBFA6), ("l", 0xC0AC), ("m", 0xC2E8), ("n", 0xC4C3), ("o", 0xC5B6), ("p", 0xC5BE), ("q", 0xC6DA), ("r", 0xC8BB), ("s", 0xC8F6), ("t", 0xCBFA), ("w", 0xCDDA), ("x", 0xCEF4), ("y", 0xD1B9), ("z", 0xD4D1), ("", 0xD7FA)]


#: How many places apart characters of one syllable may stand in the order of sounds.
SAME_SOUND = 12


@lru_cache(maxsize=65536)
def sound(c: str) -> str:
    """The initial of a character's transcription, or '' where the character set does not order it by sound."""
    try:
        code = int.from_bytes(c.encode("gb2312"), "big")
    except UnicodeEncodeError:
        return ""
    last = ""
    for letter, begin in _INITIALS:
        if code < begin:
            return last
        last = letter
    return ""


def place(c: str) -> int:
    """A character's number in the part of the national set that is ordered by sound; -1 outside it."""
    try:
        hi, lo = c.encode("gb2312")
    except (UnicodeEncodeError, ValueError):
        return -1
    return (hi - 0xB0) * 94 + lo - 0xA1 if 0xB0 <= hi < 0xD8 else -1


def sounds_like(a: str, b: str) -> bool:
    """Characters of one initial that stand close together in the order of sounds: typed by the same keys."""
    x, y = place(a), place(b)
    return x >= 0 and y >= 0 and abs(x - y) <= SAME_SOUND and sound(a) == sound(b)


@lru_cache(maxsize=65536)
def simplified(c: str) -> bool:
    try:
        c.encode("gb2312")
        return True
    except UnicodeEncodeError:
        return False


_LATIN_OF = {x: g[0] for g in ALIKE if g[0].isascii() and g[0].isalpha() for x in g[1:]}


def bare(raw: str) -> str:
    """Normal form without decoration: quotes, brackets around all of it, trailing marks, doubled blanks."""
    v = normal(raw)
    v = _BLANKS.sub(" ", v.replace("（", "(").replace("）", ")").replace("／", "/")).strip()
    if any(x.isascii() and x.isalpha() for x in v) and not _HAN.search(v):
        v = "".join(_LATIN_OF.get(x, x) for x in v)
    for _ in range(4):
        w = _EDGES.sub("", v) if not v.startswith("(") or v.endswith(")") else v.rstrip(" ~～!！?？.。…,，")
        if w.endswith(".") and not _EDITED.search(w):
            w = _DOTS.sub("", w)
        if w == v:
            break
        v = w
    return v.strip()


@lru_cache(maxsize=1 << 15)
def parse(raw: str | None) -> dict | None:
    """kind ('zh' or 'la') and core; None for no name."""
    if not raw:
        return None
    v = bare(raw)
    low = re.sub(r"\s+", " ", v.lower())
    if not any(c.isalpha() for c in v) or low in NO_AUTHOR or re.sub(r"\W", "", low) in NO_AUTHOR:
        return None
    if _HAN.search(v):
        m = re.match(r"^[\s“”\"「《【\[]*\(([^()]*)\)\s*(.+)$", v)
        if m and _ZH_ORG.search(re.sub(r"\W", "", m.group(1))):
            v = m.group(2)
        v = _ZH_ROLE.sub("", v)
        v = re.sub(r"^作者[:：]?\s*", "", v)
        v = re.sub(r"^[^\w]*(?:网络文学有限公司|文化工作室|工作室|出版社|书社)(?=[^\w]*\w{3,})", "", v)
        flat = _NO_WORD.sub("", v)
        if (m := _ZH_ORG.search(flat)) and len(flat) - len(m.group()) >= 2:
            flat = flat[: m.start()]
        elif (m := _ZH_TAIL.search(flat)) and len(_HAN.findall(flat)) - len(m.group()) >= 2:
            flat = flat[: m.start()]
            if (m := _ZH_TAIL.search(flat)) and len(flat) - len(m.group()) >= 4:
                flat = flat[: m.start()]
        if not _HAN.search(flat) and len(latin := re.sub(r"[^A-Za-z]", "", unicodedata.normalize("NFD", v))) >= 4:
            return {"kind": "la", "core": latin.lower()}
        core = "".join(_HAN.findall(flat))
        if not core:
            return None
        return {"kind": "zh", "core": core}
    v = _LATIN_ROLE.sub("", v)
    v = _LATIN_TITLE.sub("", v)
    org = bool(_LATIN_ORG.search(v))
    comma = "," in v
    plain = "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c))
    plain = re.sub(r"(?<=[a-z])(?=[A-Z][a-z.]|[A-Z]\b)|(?<=[A-Z]\.)(?=[A-Z])", " ", plain) if " " not in plain.strip() else plain
    tokens = [t for t in re.split(r"[^A-Za-zĀ-ʯͰ-ԯ]+", plain) if t]
    if org:  # what tells organisations apart are not the words for their kind
        kept = [t.lower() for t in tokens if not _LATIN_ORG.fullmatch(t) and t.lower() not in ("the", "of", "and", "s", "writers", "for")]
        return {"kind": "la", "core": "".join(kept)} if kept else None
    if not tokens:
        return None
    caps = [t for t in tokens if len(t) == 2 and t.isupper()]
    out: list[str] = []
    for t in tokens:
        out += list(t.lower()) if t in caps and len(tokens) > 1 else [t.lower()]
    if comma and len(out) > 1:
        out = out[1:] + out[:1]
    return {"kind": "la", "core": " ".join(out)}


def rotation(s: str) -> str:
    """The least of a text's rotations: they begin with its least character."""
    if len(s) < 2:
        return s
    first = min(s)
    if s.count(first) == 1:
        i = s.index(first)
        return s[i:] + s[:i]
    return min(s[i:] + s[:i] for i, c in enumerate(s) if c == first)


def zh_keys(core: str) -> list[str]:
    keys = [f"z:{rotation(core)}"]
    n = len(core)
    odd = [i for i, x in enumerate(core) if not simplified(x)]
    if n >= 4:
        if n <= 13:
            keys += [f"d:{rotation(core[:i] + core[i + 1 :])}" for i in range(n)]
        if n >= 12:
            keys += _part_keys("d", core, 2, (n - 1, n, n + 1))
        keys += [f"d:{rotation(core)}"]
        keys += sorted({f"p:{(core[i:] + core[:i])[:3]}" for i in (0, 2, 3)})
        keys += [f"wp:{core[:2]}:2"]  # met by short forms only, as plain keys by those of another writing
        if n >= 5:  # two characters of another writing leave two neighbours whole, in whatever rotation
            pairs = [core[i - 1] + core[i] for i in range(n) if not odd or (i not in odd and (i - 1) % n not in odd)]
            if not odd:
                keys += [f"wp:{x}:{n}" for x in pairs]
            elif len(odd) == 2:
                keys += [f"wo:{min(pairs)}:{n}"]
    else:
        keys += [f"p:{core}"] + ([f"wo:{core}:2"] if n == 2 else [])
        if n >= 2:  # one character of the same sound, the others and their places as they are
            keys += [f"s:{core[:i]}_{core[i + 1 :]}:{x}" for i in range(n) if (x := sound(core[i]))]
    return keys


def _part_keys(tag: str, core: str, parts: int, sizes: tuple[int, ...]) -> list[str]:
    """The parts of a long name by which names of these lengths share one: an error fewer than parts leaves one whole."""
    out = set()
    for n in sizes:
        cuts = [round(n * k / parts) for k in range(parts + 1)]
        for k in range(parts):
            lo, hi = cuts[k], cuts[k + 1]
            out.add(f"{tag}{k}:{core[lo:hi] if k + 1 < parts else core[len(core) - (hi - lo) :]}:{n}")
    return sorted(out)


def la_keys(core: str) -> list[str]:
    tokens = core.split()
    joined = "".join(tokens)
    keys = {f"j:{''.join(tokens)}", f"j:{''.join(t for t in tokens if len(t) > 1)}", f"j:{''.join(sorted(tokens))}"}
    if len(joined) > 40:  # one error leaves one half whole; lengths may differ by one
        keys |= {f"h:{x}" for h in {(len(joined) - k) // 2 for k in (1, 2, 3)} for x in (f"a{joined[:h]}", f"z{joined[-h:]}")}
    if len(tokens) == 1:
        keys |= {f"j:{core[:i] + core[i + 1 :]}" for i in range(len(core))} if len(core) <= 40 else set()
        return sorted(keys)
    for t in (t for t in tokens if len(t) >= 2):
        rest = {x[0] for x in tokens if x is not t} | {y[0] for x in tokens if x is not t for y in NICKNAMES.get(x, "").split()}
        for c in rest:
            keys.add(f"f:{t}:{c}")
            if len(t) >= 5:  # errors in shorter parts make another name
                keys |= {f"f:{t[:i] + t[i + 1 :]}:{c}" for i in range(len(t))}
    return sorted(keys)


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits with neighbouring letters changing places, up to most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, j, k = 0, len(a), len(b)
    while i < j and i < k and a[i] == b[i]:
        i += 1
    while j > i and k > i and a[j - 1] == b[k - 1]:
        j, k = j - 1, k - 1
    a, b = a[i:j], b[i:k]  # a common head and tail cost nothing
    if max(len(a), len(b)) <= 1:
        return max(len(a), len(b))
    if most == 1:
        return 1 if len(a) == len(b) == 2 and a == b[::-1] else 2
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


_NEVER = -60.0


def zh_likelihood(form: str, name: str) -> float:
    """log P(form | name): rotations, one wrong or misplaced character, the first characters alone."""
    if rotation(form) == rotation(name):
        return -0.7
    n = len(name)
    if len(form) == n and 2 <= n <= 3:
        # Real names are as short: one character may be another of the same sound. Of another writing, it is learned.
        differ = [(x, y) for x, y in zip(form, name, strict=True) if x != y]
        return (-5.0 if n == 3 else -6.5) if len(differ) == 1 and sounds_like(*differ[0]) else _NEVER
    if len(form) <= 3:
        if n < 4 or len(form) < 2:
            return _NEVER
        # The first characters, or those of the name with its two parts in the other order.
        return -2.5 if name.startswith(form) else -4.0 if any((name[i:] + name[:i]).startswith(form) for i in (2, 3)) and len(form) == 3 else _NEVER
    if n < 4:
        return _NEVER
    # One typing error leaves all but one character in common, in whatever rotation.
    shared = sum(min(form.count(c), name.count(c)) for c in set(form))
    if max(n, len(form)) - shared > 1 and all(map(simplified, form)) and all(map(simplified, name)):
        return _NEVER
    best = _NEVER
    for i in range(len(name)):
        spun = name[i:] + name[:i]
        cost = -0.7 if i else 0.0
        d = distance(form, spun, 1)
        if d <= 1:
            best = max(best, cost - 3.5)
        elif len(form) == n and d > 1:
            differ = [(x, y) for x, y in zip(form, spun, strict=True) if x != y]
            wild = sum(not simplified(x) or not simplified(y) for x, y in differ)
            if wild == len(differ) and n - len(differ) >= 2:
                best = max(best, cost - 2.0 - 1.5 * len(differ))
            elif len(differ) - wild <= 1 and n - len(differ) >= 3 and wild:
                best = max(best, cost - 5.0)
    return best


def _token_like(x: str, y: str, family: bool) -> float:
    if x == y:
        return 0.0
    if not family and (y in NICKNAMES.get(x, "").split() or x in NICKNAMES.get(y, "").split()):
        return -1.5
    if not family and min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
        return -2.0
    least = 5 if family or len(x) == len(y) else 4  # of four letters only a lost one is no other name
    return -3.5 if min(len(x), len(y)) >= least and distance(x, y, 1) <= 1 else _NEVER


def la_likelihood(form: str, name: str) -> float:
    """log P(form | name): parts in another order, nicknames, initials, a missing middle name, one typing error.

    Relatives stay apart: of two names with two full parts each, both parts must agree.
    """
    a, b = form.split(), name.split()
    if len(a) == 1 or len(b) == 1:
        x, y = "".join(a), "".join(b)
        z = "".join(t for t in (b if len(a) == 1 else a) if len(t) > 1)
        if x == y or (x if len(a) == 1 else y) == z or "".join(sorted(a)) == "".join(sorted(b)):
            return -1.0
        return -4.0 if min(len(x), len(y)) >= 7 and distance(x, y, 1) <= 1 else _NEVER
    if sorted(a) == sorted(b):
        return -0.5
    long_a, long_b = ([t for t in x if len(t) > 2] for x in (a, b))
    small_a, small_b = ([t[0] for t in x if len(t) <= 2 and t not in PARTICLES] for x in (a, b))
    if not long_a or not long_b:
        return _NEVER
    if len(long_a) >= 2 and len(long_b) >= 2:
        if len(long_a) != len(long_b):  # middle names in full on one side only, and all else equal
            less, more = sorted((long_a, long_b), key=len)
            return -3.0 if (less[0], less[-1]) == (more[0], more[-1]) and not _minus(less, more) and _within(small_a, small_b) else _NEVER
        # All parts but one must be equal, in whatever order: what is left of each side is compared.
        left_a, left_b = _minus(long_a, long_b), _minus(long_b, long_a)
        if len(left_a) > 1 or not _within(small_a, small_b):
            return _NEVER
        best = _token_like(left_a[0], left_b[0], False) if left_a else 0.0
        if best <= _NEVER:
            return _NEVER
        kept = [left_a[0] if left_a and t == left_b[0] else t for t in long_b]
        return best - (0.5 if kept != long_a else 0.0) - 0.7 * (small_a != small_b)
    if len(long_a) == 1 and len(long_b) == 1:
        if not small_a or not small_b or small_a[0] != small_b[0] or (len(small_a) > 1 and len(small_b) > 1 and small_a[1:] != small_b[1:]):
            return _NEVER
        return _token_like(long_a[0], long_b[0], True) - 0.7 * (small_a != small_b)
    # One of the two has its given names as initials.
    (family,), initials, full, middle = (long_a, small_a, long_b, small_b) if len(long_a) == 1 else (long_b, small_b, long_a, small_a)
    best = _NEVER
    for i, y in enumerate(full):
        rest = full[:i] + full[i + 1 :]
        like = _token_like(family, y, True)
        given = {rest[0][0], *(n[0] for n in NICKNAMES.get(rest[0], "").split())} if len(rest) == 1 else set()
        if like > _NEVER and initials and initials[0] in given and (len(initials) < 2 or not middle or initials[1:] == middle):
            best = max(best, like - 1.5 - 0.7 * (initials[1:] != middle))
    return best


def _within(a: list[str], b: list[str]) -> bool:
    """Are the initials of one in the other, in order? No initials are in any."""
    a, b = sorted((a, b), key=len)
    rest = iter(b)
    return all(x in rest for x in a)


def _minus(a: list[str], b: list[str]) -> list[str]:
    """What of a is not in b, counted."""
    rest = list(b)
    out = []
    for t in a:
        if t in rest:
            rest.remove(t)
        else:
            out.append(t)
    return out


def _steps(text: str) -> list[list[int]]:
    """For each place of a Latin text, where a syllable of the transcription that begins there may end."""
    return [[at + size for size in range(1, 7) if at + size <= len(text) and _PINYIN.fullmatch(text, at, at + size)] for at in range(len(text))]


def initials(text: str, n: int, whole: bool = True) -> set[str]:
    """The first letters of n syllables, for all ways to cut the whole text, or its beginning, into them."""
    steps = _steps(text)
    now = {(0, "")}
    for _ in range(n):
        now = {(end, got + text[at]) for at, got in now if at < len(text) for end in steps[at]}
    return {got for at, got in now if not whole or at == len(text)}


def counts(text: str) -> list[int]:
    """Into how many syllables the text can be cut."""
    ways = [0] * (len(text) + 1)  # bit k: into k syllables
    ways[0] = 1
    for at, ends in enumerate(_steps(text)):
        if ways[at]:
            for end in ends:
                ways[end] |= ways[at] << 1
    return [k for k in range(1, len(text) + 1) if ways[-1] >> k & 1]


#: Names of up to so many characters have all initials in their transcription key, longer ones the first of them.
_WHOLE = 6


def align(han: str, roman: str, cost) -> tuple[float, list[str]]:
    """The cheapest way to cut Latin text into one syllable a character, and these; cost(character, syllable) or None."""
    steps = _steps(roman)
    best: dict[int, tuple[float, list[str]]] = {0: (0.0, [])}
    for x in han:
        now: dict[int, tuple[float, list[str]]] = {}
        for at, (c, path) in best.items():
            for end in steps[at] if at < len(roman) else ():
                if (k := cost(x, roman[at:end])) is not None and (end not in now or c + k < now[end][0]):
                    now[end] = (c + k, [*path, roman[at:end]])
        best = now
        if not best:
            break
    return best.get(len(roman), (-_NEVER, []))


_PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("core", T.StringType())])


@F.pandas_udf(_PARSED)
def _parse(raw: pd.Series) -> pd.DataFrame:
    got = [parse(v) for v in raw]
    return pd.DataFrame({"kind": [g and g["kind"] for g in got], "core": [g and g["core"] for g in got]}, dtype=object)


def form_of(of_char: dict[str, str]):
    """A function of stored values: the kind and the core, characters of another writing replaced; NULL for no name."""

    @F.pandas_udf(T.StringType())
    def form(raw: pd.Series) -> pd.Series:
        got = [parse(v) for v in raw]
        return pd.Series([g and f"{g['kind']}:" + ("".join(of_char.get(x, x) for x in g["core"]) if g["kind"] == "zh" else g["core"]) for g in got], dtype=object)

    return form


@lru_cache(maxsize=1 << 15)
def _letters(raw: str | None) -> str:
    return re.sub(r"[\W_]+", "", normal(raw).lower()) if raw else ""


@F.pandas_udf(T.StringType())
def _title_key(raw: pd.Series) -> pd.Series:
    return raw.map(_letters)


def values_of(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """(raw, kind, core, title_key, n) of values that are names."""
    rows = books.select(F.col("author").alias("raw"), "title").unionByName(wishes.select(F.col("author").alias("raw"), "title")).where("raw is not null")
    counted = rows.groupBy("raw", "title").agg(F.count(F.lit(1)).alias("n"))
    parsed = counted.select("raw", "n", _title_key("title").alias("title_key"), _title_key("raw").alias("own_key"), _parse("raw").alias("p")).select("raw", "n", "title_key", "own_key", "p.*")
    parsed = cut(parsed.where("core is not null"))
    # Titles in the author column: their letters stand more often as a title.
    as_title = parsed.where("title_key <> ''").groupBy(F.col("title_key").alias("k")).agg(F.sum("n").alias("as_title"))
    as_author = parsed.groupBy(F.col("own_key").alias("k")).agg(F.sum("n").alias("as_author"))
    titles = as_author.join(as_title, "k").where("as_title >= as_author and as_title > 0").select(F.col("k").alias("own_key"))
    return parsed.join(titles, "own_key", "left_anti").select("raw", "kind", "core", "title_key", "n")


@F.pandas_udf(T.BooleanType())
def _is_simple(c: pd.Series) -> pd.Series:
    return c.map(simplified)


#: Characters on either side of an odd one that must agree.
AROUND = 8


def _learn_characters(forms: DataFrame) -> dict[str, str]:
    """Characters outside the simplified set and what they stand for: the set bounds the table.

    Names and titles that differ in one character share what is left without it. Holes are only cut where an odd
    character stands and into texts that could fill them: texts without odd ones.
    """
    rows = forms.where(F.length("core") >= 3).where(F.col("core").rlike(r"^[\x{3400}-\x{9fff}]+$")).select("core").distinct()
    odd_at = rows.withColumn("simple", _all_simple("core"))
    # The hole's neighbours up to AROUND characters away stand for the text: a long text costs no more a character.
    around = lambda: F.concat(F.expr(f"substring(core, greatest(1, i - {AROUND}), i - greatest(1, i - {AROUND}))"), F.lit("*"), F.expr(f"substring(core, i + 1, {AROUND})"), F.when(F.expr(f"i > {AROUND} + 1"), "<").otherwise(""), F.when(F.expr(f"i + {AROUND} < length(core)"), ">").otherwise(""))
    hole = lambda i: F.struct(around().alias("hole"), F.expr("substring(core, i, 1)").alias("c"))  # noqa: E731, ARG005
    cut_at = odd_at.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("core")))).select("simple", hole("i").alias("h")).select("simple", "h.*")
    odd = cut_at.where("not simple").where(~_is_simple("c")).select("hole", F.col("c").alias("odd"))
    plain = cut_at.where("simple").select("hole", "c")
    # An odd text with several odd characters keeps the others in its hole, so only what was learned from one counts.
    pairs = odd.join(plain, "hole").groupBy("odd", "c").agg(F.count(F.lit(1)).alias("k"))
    return {r["odd"]: r["b"]["c"] for r in pairs.groupBy("odd").agg(F.max(F.struct("k", "c")).alias("b")).collect()}


@F.pandas_udf(T.BooleanType())
def _all_simple(core: pd.Series) -> pd.Series:
    return core.map(lambda c: all(map(simplified, c)))


def _learn_sounds(forms: DataFrame, beside: DataFrame) -> dict[str, str]:
    """Each character's syllable, from transcribed forms and forms in characters beside the same title."""
    roman = beside.where("kind = 'la'").select("title_key", F.regexp_replace("core", " ", "").alias("roman")).distinct()
    han = beside.where("kind = 'zh'").select("title_key", "core").where(F.length("core") >= 2).distinct()

    def fits(x: str, y: str) -> float | None:
        return None if sound(x) not in ("", y[0]) else 0.0

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def aligned(roman: pd.Series, core: pd.Series) -> pd.Series:
        out = []
        for r, c in zip(roman, core, strict=True):
            got: set[str] = set()
            if len(c) <= len(r) <= 6 * len(c) and sum(sound(x) != "" for x in c) >= 2 and len(c) in counts(r):
                for spun in {c[i:] + c[:i] for i in range(len(c))}:
                    _, path = align(spun, r, fits)
                    got |= {f"{x} {y}" for x, y in zip(spun, path, strict=False)}
            out.append(sorted(got))
        return pd.Series(out)

    pairs = roman.join(han, "title_key").select(F.explode(aligned("roman", "core")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    both = F.split("x", " ")
    return {r["c"]: r["b"]["y"] for r in pairs.select(both[0].alias("c"), both[1].alias("y"), "k").groupBy("c").agg(F.max(F.struct("k", "y")).alias("b")).collect()}


def linked(books: DataFrame, wishes: DataFrame, margin: float = 0.8, floor: float = -9.0) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The values (raw, form), each form's canonical form (form, canonical, posterior), and what characters of another
    writing stand for."""
    values = cut(values_of(books, wishes))
    forms0 = values.groupBy("kind", "core").agg(F.sum("n").alias("n"))
    of_char = _learn_characters(forms0.select("kind", "core").unionByName(values.select(F.lit("zh").alias("kind"), F.col("title_key").alias("core"))))
    core = F.when(F.col("kind") == "zh", F.translate("core", "".join(of_char), "".join(of_char.values()))).otherwise(F.col("core"))
    values = values.select("raw", "n", "title_key", "kind", F.concat("kind", F.lit(":"), core).alias("form"))
    forms = values.groupBy("form").agg(F.sum("n").alias("n"))
    beside = values.where("title_key <> ''").select("kind", F.substring("form", 4, 1 << 20).alias("core"), "title_key", "form").distinct()
    sounds = _learn_sounds(forms, beside)

    def initial(c: str) -> str:
        return sounds[c][0] if c in sounds else sound(c)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(form: pd.Series) -> pd.Series:
        out = []
        for f in form:
            kind, core = f[:2], f[3:]
            if kind == "zh":
                k = zh_keys(core)
                spun = {core[i:] + core[:i] for i in range(len(core))}
                if len(core) >= 4 and all(initial(x) for x in core):
                    k += [f"i{'+' if len(core) > _WHOLE else ''}:{''.join(initial(x) for x in y[:_WHOLE])}" for y in spun]
                if len(core) >= 2 and all(x in sounds for x in core):
                    k += ["y:" + "".join(sounds[x] for x in y) for y in spun]
            else:
                k = la_keys(core)
                joined = core.replace(" ", "")
                if n := counts(joined):
                    k += [f"y:{joined}"] + [f"i:{y}" for m in n if 4 <= m <= _WHOLE for y in initials(joined, m)]
                    if n[-1] > _WHOLE:
                        k += [f"i+:{y}" for y in initials(joined[: 6 * _WHOLE], _WHOLE, False)]
            out.append(sorted(set(k)))
        return pd.Series(out)

    def transcribed(han: str, roman: str) -> float:
        """How well the Latin text transcribes the characters, in any rotation; unknown syllables count by initials."""
        if len(han) not in counts(roman):
            return _NEVER
        cost = lambda x, y: (0.0 if sounds[x] == y else None) if x in sounds else 1.0 if initial(x) == y[0] else None
        best = _NEVER
        for i in range(len(han)):
            price, _ = align(han[i:] + han[:i], roman, cost)
            if price < -_NEVER:
                best = max(best, -2.0 - price - (0.7 if i else 0.0))
        return best

    @F.pandas_udf(T.DoubleType())
    def likelihood(form: pd.Series, name: pd.Series) -> pd.Series:
        out = []
        for f, c in zip(form, name, strict=True):
            if f[:2] == c[:2]:
                out.append((zh_likelihood if f[:2] == "zh" else la_likelihood)(f[3:], c[3:]))
                continue
            han, roman = (f[3:], c[3:]) if f[:2] == "zh" else (c[3:], f[3:])
            out.append(transcribed(han, roman.replace(" ", "")))
        return pd.Series(out)

    def full(form: str) -> F.Column:
        """Is a form whole: four characters, two parts of three letters, or one part alone?"""
        own = F.substring(form, 4, 1 << 30)
        parts = F.size(F.filter(F.split(own, " "), lambda t: F.length(t) > 2)) >= 2
        return F.when(F.col(form).startswith("zh"), F.length(own) >= 4).otherwise(parts | ~own.contains(" "))

    keyed = forms.select("form", "n", F.explode(keys("form")).alias("key"))
    # A pair is met under any of its keys; of a pair, the full form before a short one and then the more frequent one is
    # the candidate. Keys of two characters of another writing join only those to plain ones.
    # Keys travel as 64 bits: a chance meeting is refused by its likelihood.
    keyed = keyed.withColumns({"wild": F.when(F.col("key").startswith("wo:"), 2).when(F.col("key").startswith("wp:"), 1).otherwise(0), "key": F.xxhash64(F.regexp_replace("key", "^w[op]:", "w:"))})
    keyed = cut(keyed.select("key", "wild", F.struct(full("form").alias("full"), "n", F.length("form").alias("size"), "form").alias("x")))
    either = (F.col("a.wild") == 0) | (F.col("a.wild") + F.col("b.wild") > 2)
    met = keyed.alias("a").join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.x") < F.col("b.x")) & either).select(F.col("a.x.form").alias("form"), F.col("b.x.form").alias("name"), F.col("b.x.n").alias("n")).distinct()
    scored = cut(met.withColumn("ll", likelihood("form", "name")).where(F.col("ll") > _NEVER))
    t = beside.select("form", "title_key")
    shared = scored.select("form", "name").join(t, "form").join(t.select(F.col("form").alias("name"), "title_key"), ["name", "title_key"]).groupBy("form", "name").agg(F.count(F.lit(1)).alias("titles"))
    scored = scored.join(shared, ["form", "name"], "left").withColumn("score", F.col("ll") + F.log(F.col("n")) + 3.0 * F.log1p(F.coalesce("titles", F.lit(0))))
    w = Window.partitionBy("form")
    best = scored.withColumn("top", F.max("score").over(w)).withColumn("z", F.sum(F.exp(F.col("score") - F.col("top"))).over(w))
    # Candidates of one form are often forms of one entity: a tie between them is none, so ties go to the first, below.
    best = best.groupBy("form").agg(F.max(F.struct("score", "n", "name", "ll", F.exp(F.col("score") - F.col("top")).alias("p"), F.col("z"))).alias("b"))
    links = best.select("form", F.col("b.name").alias("canonical"), (F.lit(1.0) / F.col("b.z")).alias("posterior"), F.col("b.ll").alias("ll"))
    return values, _rooted(forms, links, scored, margin, floor), of_char


def _rooted(forms: DataFrame, links: DataFrame, scored: DataFrame, margin: float, floor: float) -> DataFrame:
    """Follows each form's link to a form without one, four times as far each round: links go one way, so it ends."""
    now = cut(forms.select("form").join(links.where(F.col("ll") > floor), "form", "left").select("form", F.coalesce("canonical", "form").alias("canonical"), F.coalesce("posterior", F.lit(1.0)).alias("posterior")))
    while True:
        up = now.select(F.col("form").alias("canonical"), F.col("canonical").alias("next"))
        far = up.join(now.select(F.col("form").alias("next"), F.col("canonical").alias("after")), "next")
        nxt = cut(now.join(far, "canonical").select("form", F.col("after").alias("canonical"), "posterior", (F.col("after") != F.col("canonical")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        now = nxt.drop("moved")
        if not moved:
            break
    # A link is sure where the candidates of its form that lead to the same root hold most of the probability.
    roots = now.select(F.col("form").alias("name"), F.col("canonical").alias("root"))
    w = Window.partitionBy("form")
    sums = scored.select("form", "name", "score").join(roots, "name").withColumn("top", F.max("score").over(w)).withColumn("p", F.exp(F.col("score") - F.col("top")))
    mass = sums.groupBy("form", "root").agg(F.sum("p").alias("p")).withColumn("share", F.col("p") / F.sum("p").over(w))
    judged = now.join(mass.select("form", F.col("root").alias("canonical"), "share"), ["form", "canonical"], "left")
    sure = (F.col("share") >= margin) | (F.col("form") == F.col("canonical"))
    return judged.select("form", F.when(sure, F.col("canonical")).otherwise(F.col("form")).alias("canonical"), F.coalesce("share", F.lit(1.0)).alias("posterior"))


def entities(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """(name, canonical, posterior): each stored value with its entity's canonical form."""
    values, links, _ = linked(books, wishes)
    return values.select("raw", "form").distinct().join(links, "form").select(F.col("raw").alias("name"), "canonical", "posterior")


def pairs(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """All pairs of stored values of one entity, the smaller first."""
    e = cut(entities(books, wishes).select("name", "canonical"))
    return e.alias("a").join(e.alias("b"), (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()
