"""Request parameters brought to the closed sets that the engine's functions take."""

from __future__ import annotations

import os
import re
from pathlib import Path
from urllib.parse import urlsplit


def choice(value: str | None, allowed: tuple[str, ...], other: str, aliases: dict[str, str] | None = None) -> str:
    v = (value or "").strip().lower()
    v = (aliases or {}).get(v, v)
    return v if v in allowed else other


def read_filter(v: str | None, tracker: bool = False) -> str:
    return choice(v, ("unread", "reading", "read") if tracker else ("unread",), "all")


def library_filter(v: str | None) -> str:
    return choice(v, ("in", "out"), "all", {"in_library": "in", "not_in_library": "out"})


def status_filter(v: str | None) -> str:
    return choice(v, ("ongoing", "hiatus", "completed"), "all")


def sort(v: str | None) -> str:
    return choice(v, ("created",), "updated")


def whole(v: object, lo: int, hi: int, other: int) -> int:
    try:
        return max(lo, min(hi, int(str(v).strip())))
    except ValueError:
        return other


def per_page(v: object) -> int:
    return whole(v, 4, 96, 24)


def last_page(total: int, size: int) -> int:
    return max(1, -(-total // max(1, size)))


def setting(name: str, other: str | None = None) -> str | None:
    """An environment variable, or the text of the file that NAME_FILE names."""
    if v := os.environ.get(name):
        return v
    path = os.environ.get(f"{name}_FILE")
    if path and Path(path).is_file():
        return Path(path).read_text(encoding="utf-8").strip() or other
    return other


#: The words of a form's flag that mean yes.
YES = frozenset({"1", "true", "yes", "on"})


def flag(v: object) -> bool:
    """A form's flag: one of the words for yes, or true itself."""
    return v is True or (isinstance(v, str) and v.strip().lower() in YES)


def local_target(v: object, other: str) -> str:
    """Where to go on: a path of this site with its query, else the other target."""
    url = urlsplit(v.strip()) if isinstance(v, str) else urlsplit("")
    ours = not url.scheme and not url.netloc and re.match(r"/(?!/)", url.path)
    return f"{url.path}?{url.query}" if ours and url.query else url.path if ours else other
