"""Arrow-batched Python functions: what column expressions cannot say."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings of source files in the order of trial.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
LONGEST_CSS = 200_000


def decode(data: bytes | None) -> tuple[str | None, str | None]:
    """(encoding, text): the first encoding that reads all bytes, else UTF-8 with replacements."""
    if data is None:
        return None, None
    data = bytes(data)
    for e in ENCODINGS:
        try:
            return e, data.decode(e)
        except UnicodeDecodeError:
            continue
    return "utf-8", data.decode("utf-8", "replace")


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(c) for c in content], columns=["encoding", "text"])


#: The messages.
def css_problem(raw: str | None) -> str | None:
    """What is wrong with a style sheet, or None: its length, NUL, open comments and strings, braces."""
    if not raw or not raw.strip():
        return None
    if len(raw) > LONGEST_CSS:
        return f"CSS 过长（超过 {LONGEST_CSS} 字符）"
    if "\0" in raw:
        return "CSS 包含非法字符"
    depth = 0
    token = re.compile(r"""/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|/\*|["'{}]""", re.S)
    for m in token.finditer(raw):
        t = m.group()
        if t == "/*":
            return "CSS 注释未闭合"
        if t in "\"'":
            return "CSS 字符串未闭合"
        depth += {"{": 1, "}": -1}.get(t, 0)
        if depth < 0:
            return "CSS 花括号不匹配"
    return "CSS 花括号不匹配" if depth else None


@F.pandas_udf(T.StringType())
def css_problems(raw: pd.Series) -> pd.Series:
    return raw.map(css_problem)


def looks_like_text(probe: bytes) -> bool:
    """No NUL and under two of a hundred control bytes in the first 4,096."""
    sample = bytes(probe[:4096])
    if not sample or b"\0" in sample:
        return False
    return sum(b < 9 or 13 < b < 32 for b in sample) / len(sample) < 0.02


def source_type(name: str | None, media: str | None, probe: bytes | None) -> str:
    """'epub', 'txt' or 'unknown' by ending, media type, magic bytes, and the look of the bytes."""
    low, media, probe = (name or "").lower(), media or "", bytes(probe or b"")
    if low.endswith(".epub"):
        return "epub"
    if low.endswith(".txt"):
        return "txt"
    if media == "application/epub+zip" or probe.startswith(b"PK"):
        return "epub"
    return "txt" if media.startswith("text/") or looks_like_text(probe) else "unknown"


def is_package(data: bytes | None) -> bool:
    """A readable archive with the mimetype of packaged books or a container's description: asks for the whole file."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
            names = set(z.namelist())
            return "META-INF/container.xml" in names or ("mimetype" in names and z.read("mimetype").strip() == b"application/epub+zip")
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError):
        return False


def whole_type(name: str | None, media: str | None, data: bytes | None) -> str:
    """The type of a whole file: magic bytes alone make no package."""
    kind = source_type(name, media, data)
    named = (name or "").lower().endswith(".epub") or media == "application/epub+zip"
    if kind != "epub" or named or is_package(data):
        return kind
    return source_type(None, media, b"x" + bytes(data or b"")[1:]) if looks_like_text(bytes(data or b"")) else "unknown"


@F.pandas_udf(T.StringType())
def source_types(name: pd.Series, media: pd.Series, probe: pd.Series) -> pd.Series:
    return pd.Series([source_type(*x) for x in zip(name, media, probe, strict=True)])
