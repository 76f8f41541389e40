"""Problem 6: text that looks the same but has other characters.

Method: a value is brought to compatibility normal form (full-width letters and digits, composed accents, radicals and
compatibility ideographs), spaces become the ordinary one and ignorable characters go. Every token that holds letters of
several scripts, letter-like numerals or a digit among Latin letters is a lattice: each character or one of its
look-alikes. Viterbi finds the likeliest path under character bigrams of tokens that keep to one script, counted over
all values, where a change of script inside a token and every replacement have a price; the token stays where its own
path is the best. In the bigrams of ideographs and kana all characters without a look-alike are one class a script, so
the table is as small as the alphabets. Punctuation is left as it is.

Defined cases: NULL and empty values have no consistent form and are no cases; tokens wholly in one script stay, in
whatever script; line feeds and tabs stay; very long values are taken whole; repeated rows give one case; other columns
are not read; an empty table gives no rows. Values of problem 7 are no cases.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the same look. Each group lists Latin, then Cyrillic, Greek and other letters like it.
ALIKE = (
    "aаαɑ", "bЬ", "cсϲ", "dԁ", "eеҽ", "gɡ", "hһ", "iіι", "jјϳ", "kκ", "lӏ", "mм", "nո", "oоοօσ", "pрρ", "qԛ", "rг", "sѕ", "tт", "uυս", "vνѵ", "wԝѡ", "xхχ", "yуγү", "zᴢ",
    "AАΑ", "BВΒ", "CСϹ", "DᎠ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "LᏞ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "RᎡ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YҮΥУ", "ZΖ",
    "ёë", "їï", "ќḱ", "ЁË", "ЇÏ", "口ロ", "力カ", "二ニ", "工エ", "卜ト", "夕タ", "八ハ", "一ー",
)
#: Capitals of two more writings and the Latin ones of their look.
LISU, LISU_LATIN = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
CHEROKEE, CHEROKEE_LATIN = "ᎪᏴᏟᎬᏀᎻᎫᏦᎷᏢᏚᎢᏙᎳᎩᏃ", "ABCEGHJKMPSTVWYZ"
OTHERS = {c: [x for x in g if x != c] for g in ALIKE for c in g}
for _x, _y in zip(LISU + CHEROKEE, LISU_LATIN + CHEROKEE_LATIN, strict=True):
    OTHERS.setdefault(_x, []).append(_y)
for _i in range(0x2160, 0x2180):  # numerals of one letter look like it
    if len(_x := unicodedata.normalize("NFKC", chr(_i))) == 1:
        OTHERS.setdefault(chr(_i), []).append(_x)
#: Digits that stand for a letter where Latin letters are on both sides.
DIGITS = {"0": ["o", "O"], "1": ["l", "I"]}
_SCRIPT = [("Latn", regex.compile(r"\p{Latin}")), ("Cyrl", regex.compile(r"\p{Cyrillic}")), ("Grek", regex.compile(r"\p{Greek}")), ("Armn", regex.compile(r"\p{Armenian}")), ("Cher", regex.compile(r"\p{Cherokee}")), ("Lisu", regex.compile(r"\p{Lisu}")), ("Han", regex.compile(r"\p{Han}")), ("Kata", regex.compile(r"\p{Katakana}|ー")), ("Hira", regex.compile(r"\p{Hiragana}"))]
#: What becomes ordinary: compatibility letters, digits, marks and spaces, and characters without a look of their own.
_PLAIN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Zs}\p{So}]")
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nl}]+(?:(?<=\p{Latin})[01](?=\p{Latin})[\p{L}\p{M}\p{Nl}]+)*")
_DIGIT_INSIDE = regex.compile(r"\p{Latin}[01]\p{Latin}")
#: Han and Latin stand side by side in one run of letters: each stretch is a lattice of its own.
_STRETCH = regex.compile(r"[\p{Han}\p{Katakana}ー]+|[^\p{Han}\p{Katakana}ー]+")
_SUSPECT = regex.compile(r"[^\x00-\x7f一-鿿、-〃〈-】…—“”‘’·！（），：；？～]|[A-Za-z][01][A-Za-z]")
_CONTROL = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ALPHABETS = {"Latn", "Cyrl", "Grek", "Armn", "Cher", "Lisu"}
_SWITCH, _REPLACE = -6.0, -3.0


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    for name, of in _SCRIPT:
        if of.match(c):
            return name
    return "Zyyy" if not unicodedata.category(c).startswith("L") else "Zzzz"


@lru_cache(maxsize=65536)
def _one(c: str) -> str:
    """A character's ordinary form; punctuation and symbols that are no letters keep theirs."""
    if unicodedata.category(c) == "Zs":
        return " "
    if _IGNORABLE.match(c):
        return ""
    if not _PLAIN.match(c):
        return c
    x = unicodedata.normalize("NFKC", c)
    if x == c or not all(unicodedata.category(y)[0] in "LNM" for y in x):
        return c
    if unicodedata.category(c) in ("No", "So") and not 0x2E80 <= ord(c) <= 0x2FDF:
        return c  # superscripts, circled and other numbers look unlike digits
    if unicodedata.decomposition(c).startswith(("<super", "<sub", "<fraction", "<square", "<compat") ) and not 0x2E80 <= ord(c) <= 0x2FDF and not 0xFB00 <= ord(c) <= 0xFB06:
        return c
    return x


def normal(v: str) -> str:
    """Compatibility normal form of letters, digits, marks and spaces, without ignorable characters."""
    if not _SUSPECT.search(v) and not _CONTROL.search(v):
        return v  # nothing but plain letters, ideographs and punctuation
    return unicodedata.normalize("NFC", "".join(c if c < "\x7f" and (c >= " " or c in "\t\n\r") else _one(c) for c in v))


def _symbols(token: str) -> list[str]:
    """A token's characters as the bigrams know them: ideographs and kana without a look-alike by their script alone."""
    return [c if c in OTHERS else "<Han>" if script(c) == "Han" else "<Kata>" if script(c) == "Kata" else c for c in token]


def pair_counts(values: Iterator[str]) -> dict[tuple[str, str], int]:
    """Bigrams of stretches that keep to one script; '^' begins a stretch, '$' ends it."""
    n: dict[tuple[str, str], int] = {}
    for v in values:
        for t in _TOKEN.findall(v):
            for part in _STRETCH.findall(t) if not t.isascii() else (t,):
                scripts = {script(c) for c in part} - {"Zyyy"}
                if len(scripts) == 1 and scripts <= _ALPHABETS | {"Han", "Kata"}:
                    x = _symbols(part) if scripts <= {"Han", "Kata"} else list(part)
                    for p in zip(["^", *x], [*x, "$"], strict=True):
                        n[p] = n.get(p, 0) + 1
    return n


class Model:
    """Log-probabilities of bigrams; behind a rare character those of single ones count more."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.pair = counts
        self.first: dict[str, int] = {}
        self.single: dict[str, int] = {}
        for (a, b), n in counts.items():
            self.first[a] = self.first.get(a, 0) + n
            self.single[b] = self.single.get(b, 0) + n
        self.total = sum(counts.values())

    def log_p(self, a: str, b: str) -> float:
        alone = (self.single.get(b, 0) + 0.02) / (self.total + 2.0)
        return math.log((self.pair.get((a, b), 0) + 2.0 * alone) / (self.first.get(a, 0) + 2.0))

    def viterbi(self, token: str) -> str:
        """The likeliest spelling of a stretch among its characters' look-alikes."""
        wide = script(token[0]) in ("Han", "Kata")
        best: dict[str, float] = {"^": 0.0}
        sym: dict[str, str] = {"^": "^"}
        back: list[dict[str, str]] = []
        for i, c in enumerate(token):
            options = [c, *OTHERS.get(c, ())]
            if c in DIGITS and 0 < i < len(token) - 1:
                options += DIGITS[c]
            now: dict[str, float] = {}
            came: dict[str, str] = {}
            of = {x: _symbols(x)[0] if wide else x for x in options}
            for x in options:
                price = _REPLACE if x != c else 0.0
                for y, p in best.items():
                    q = p + self.log_p(sym[y], of[x]) + price
                    if y != "^" and "Zyyy" not in (script(x), script(y)) and script(x) != script(y):
                        q += _SWITCH
                    if x not in now or q > now[x]:
                        now[x], came[x] = q, y
            best, sym = now, of
            back.append(came)
        x = max(best, key=lambda y: (best[y] + self.log_p(sym[y], "$"), y))
        out = []
        for came in reversed(back):
            out.append(x)
            x = came[x]
        return "".join(reversed(out))


def uncertain(part: str) -> bool:
    """Is a stretch no plain word of one script? Such a stretch is a lattice; a word wholly in one script stays."""
    if not any(c in OTHERS for c in part):
        return False
    scripts = {script(c) for c in part} - {"Zyyy"}
    return len(scripts) > 1 and not (scripts & {"Hira"}) or bool(_DIGIT_INSIDE.search(part)) or any(unicodedata.category(c) == "Nl" for c in part if script(c) != "Han")


def majority(v: str) -> str:
    """What a rule without a model gives: every stretch in the script of most of its letters. For comparison only."""

    def one(m) -> str:
        part = m.group()
        if not uncertain(part):
            return part
        n: dict[str, int] = {}
        for c in part:
            if script(c) != "Zyyy":
                n[script(c)] = n.get(script(c), 0) + 1
        most = max(n, key=lambda s: (n[s], s))
        return "".join(c if script(c) == most else next((x for x in OTHERS.get(c, ()) if script(x) == most), c) for c in part)

    return _TOKEN.sub(lambda m: _STRETCH.sub(one, m.group()), normal(v))


def consistent(v: str, model: Model) -> str:
    token = lambda m: _STRETCH.sub(lambda p: model.viterbi(p.group()) if uncertain(p.group()) else p.group(), m.group())
    return _TOKEN.sub(token, normal(v))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, str], int] = {}
    for b in batches:
        for k, n in pair_counts(normal(v) for v in b.column("value").to_pylist() if v).items():
            total[k] = total.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["a", "b", "n"])


def fitted(values: DataFrame) -> Model:
    """Bigrams over all values: the alphabets bound the table, not the data."""
    sums = values.select("value").mapInArrow(_counter, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return Model({(r["a"], r["b"]): r["n"] for r in sums.coalesce(1).toLocalIterator()})


def values_of(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """(table_name, record_id, field, value) of every value."""
    fields = [(books, "books", "book_id", "title"), (books, "books", "book_id", "author"), (wishes, "wishlist", "id", "title")]
    parts = [t.select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.lit(f).alias("field"), F.col(f).alias("value")) for t, name, key, f in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def normalized(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """Every value with its one consistent form."""
    values = values_of(books, wishes)
    model = fitted(values)

    @F.pandas_udf(T.StringType())
    def form(value: pd.Series) -> pd.Series:
        done: dict = {}
        out = []
        for v in value:
            if v is None:
                out.append(None)
            elif not _SUSPECT.search(v):
                out.append(_IGNORABLE.sub("", v))
            else:
                if v not in done:
                    done[v] = consistent(v, model)
                out.append(done[v])
        return pd.Series(out, dtype=object)

    return values.withColumn("consistent", form("value"))


def found(books: DataFrame, wishes: DataFrame, garbled: DataFrame) -> DataFrame:
    """garbled: (field, book_id) of problem 7's values; those and values that were garbled elsewhere are no cases."""
    cases = normalized(books, wishes).where("value is not null and consistent <> value")
    gone = garbled.select(F.lit("books").alias("table_name"), F.col("book_id").alias("record_id"), "field").distinct()
    return cases.join(gone, ["table_name", "record_id", "field"], "left_anti").select("table_name", "record_id", "field").distinct()
