"""Style themes: files, the default, and a book's whole style sheet."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as X
from .functions.python import css_problem


@dataclass(frozen=True)
class Theme:
    id: str
    name: str
    css: str = ""
    description: str = ""
    version: str = "1"


DEFAULT = Theme("default", "默认")


def load(folder: str | Path) -> dict[str, Theme]:
    """Theme files in name order; unreadable ones are left out; the default is always there."""
    out = {}
    for p in sorted(Path(folder).glob("*.json")):
        try:
            d = json.loads(p.read_text(encoding="utf-8"))
            t = Theme(str(d["id"]), str(d.get("name") or d["id"]), str(d.get("css") or ""), str(d.get("description") or ""), str(d.get("version") or "1"))
        except (OSError, ValueError, KeyError, TypeError):
            continue
        out[t.id] = t
    return out if "default" in out else {"default": DEFAULT} | out


def pick(themes: dict[str, Theme], theme_id: str | None) -> Theme:
    return themes.get(theme_id or "") or themes["default"]


def save(folder: str | Path, theme: Theme) -> Path:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", theme.id):
        raise ValueError("bad id")
    if problem := css_problem(theme.css):
        raise ValueError(problem)
    path = Path(folder) / f"{theme.id}.json"
    path.write_text(json.dumps(asdict(theme), ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def delete(folder: str | Path, theme_id: str, used: set[str]) -> bool:
    path = Path(folder) / f"{theme_id}.json"
    if theme_id == "default" or theme_id in used or not path.exists():
        return False
    path.unlink()
    return True


def composed(theme_css: Column, own: Column) -> Column:
    """A theme's style and a book's own: parts that are not blank, an empty line between."""
    return F.array_join(F.filter(F.array(*[X.strip(F.coalesce(c, F.lit(""))) for c in (theme_css, own)]), lambda x: x != ""), "\n\n")
