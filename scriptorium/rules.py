"""Heading rules: their defaults, files and validation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession

#: The default patterns, headings and limits.
CHAPTERS = (
    r"^第\s*[0-9一二三四五六七八九十百千万两零〇]+\s*章.*$",
    r"^第\s*[0-9一二三四五六七八九十百千万两零〇]+\s*节.*$",
    r"^第\s*[0-9一二三四五六七八九十百千万两零〇]+\s*回.*$",
    r"(?i)^Chapter\s+\d+.*$",
)
VOLUMES = (
    r"^第\s*[0-9一二三四五六七八九十百千万两零〇]+\s*卷.*$",
    r"^卷\s*[0-9一二三四五六七八九十百千万两零〇]+.*$",
    r"^第\s*[0-9一二三四五六七八九十百千万两零〇]+\s*部.*$",
)
SPECIAL = ("序章", "序", "楔子", "引子", "前言", "前序", "后记", "后序", "尾声", "结语", "终章", "终卷", "终篇", "番外", "番外篇", "作者的话", "完结感言")
SKIPPED = r"(http|www|QQ群|群|公众号|微信|下载|txt|整理|校对|打包|本书|电子书)"


class RuleError(ValueError):
    """A rule file that cannot be used."""


@dataclass(frozen=True)
class Rules:
    id: str = "default"
    name: str = "默认"
    chapters: tuple[str, ...] = CHAPTERS
    volumes: tuple[str, ...] = VOLUMES
    special: tuple[str, ...] = SPECIAL
    longest: int = 40
    commas: int = 1
    skipped: str = SKIPPED
    extra: dict = field(default_factory=dict, compare=False)


def compiles(pattern: str) -> None:
    """Refuses a pattern that Python or, where a session runs, the engine's regular expressions cannot read."""
    try:
        re.compile(pattern)
        if spark := SparkSession.getActiveSession():
            spark._jvm.java.util.regex.Pattern.compile(f"^(?Us)(?:{pattern})")
    except (re.error, Py4JJavaError, CapturedException) as e:
        raise RuleError(f"bad pattern {pattern}") from e


def from_json(raw: str, expected_id: str | None = None, stem: str | None = None) -> Rules:
    """Rules of a JSON text; patterns must compile, numbers may be text, unknown keys are kept, 0 means the default.

    Lists that are missing or empty are the default ones; a missing id is the expected one or the file's stem.
    """
    try:
        data = json.loads(raw)
    except ValueError as e:
        raise RuleError(f"not JSON: {e}") from e
    if not isinstance(data, dict):
        raise RuleError("not an object")
    rule_id = str(data.get("id") or expected_id or stem or "").strip()
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", rule_id):
        raise RuleError("bad id")
    if expected_id is not None and rule_id != expected_id:
        raise RuleError("another id")
    lists = {}
    for key, name, default in (("chapter_patterns", "chapters", CHAPTERS), ("volume_patterns", "volumes", VOLUMES), ("special_headings", "special", SPECIAL)):
        v = data.get(key)
        if v is not None and (not isinstance(v, list) or not all(isinstance(x, str) for x in v)):
            raise RuleError(f"{key} is no list of texts")
        lists[name] = tuple(v) if v else default
    for p in (*lists["chapters"], *lists["volumes"], data.get("skip_candidate_re") or SKIPPED):
        compiles(str(p))
    numbers = {}
    for key, name, default in (("heading_max_len", "longest", 40), ("heading_max_commas", "commas", 1)):
        try:
            numbers[name] = int(data.get(key) or default)
        except (TypeError, ValueError) as e:
            raise RuleError(f"{key} is no number") from e
        if numbers[name] < 0:
            raise RuleError(f"{key} is below 0")
    known = {"id", "name", "chapter_patterns", "volume_patterns", "special_headings", "heading_max_len", "heading_max_commas", "skip_candidate_re"}
    return Rules(rule_id, str(data.get("name") or rule_id), skipped=data.get("skip_candidate_re") or SKIPPED, extra={k: v for k, v in data.items() if k not in known}, **lists, **numbers)


def load(folder: str | Path) -> dict[str, Rules]:
    """The rule files of a folder in name order; unreadable ones are left out; never empty."""
    out = {}
    for p in sorted(Path(folder).glob("*.json")):
        try:
            r = from_json(p.read_text(encoding="utf-8"), stem=p.stem)
        except (OSError, RuleError):
            continue
        out[r.id] = r
    return out or {"default": Rules()}


def pick(rules: dict[str, Rules], rule_id: str | None) -> Rules:
    """The rules of an id, else the first."""
    return rules.get(rule_id or "") or next(iter(rules.values()))


def save(folder: str | Path, rules: Rules) -> Path:
    path = Path(folder) / f"{rules.id}.json"
    data = {"id": rules.id, "name": rules.name, "chapter_patterns": list(rules.chapters), "volume_patterns": list(rules.volumes), "special_headings": list(rules.special), "heading_max_len": rules.longest, "heading_max_commas": rules.commas, "skip_candidate_re": rules.skipped, **rules.extra}
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


def delete(folder: str | Path, rule_id: str, used: set[str]) -> bool:
    """Deletes a rule file; the default and rules in use stay."""
    path = Path(folder) / f"{rule_id}.json"
    if rule_id == "default" or rule_id in used or not path.exists():
        return False
    path.unlink()
    return True


__all__ = ["CHAPTERS", "SKIPPED", "SPECIAL", "VOLUMES", "RuleError", "Rules", "delete", "from_json", "load", "pick", "replace", "save"]
