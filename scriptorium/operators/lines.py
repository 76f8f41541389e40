"""Texts as lines, lines in their context, headings, sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules import Rules


def split_file(text: Column | str) -> Column:
    """Lines of a file: any line end counts; an end at the very end opens no line."""
    parts = F.split(X.col(text), "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_memory(text: Column | str) -> Column:
    """Lines of a text in memory: a lone carriage return breaks no line but is taken from its end."""
    parts = F.split(X.col(text), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "[\r\n]+$", ""))


def lines_of(docs: DataFrame, key: str, text: str, in_memory: bool = False) -> DataFrame:
    """(key, line_no, line), counted from 0; NULL texts have no lines."""
    cut = split_memory(text) if in_memory else split_file(text)
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(cut).alias("line_no", "line"))


def has_content(text: Column | str) -> Column:
    return F.coalesce(F.exists(split_file(text), lambda x: X.strip(x) != ""), F.lit(False))


def with_context(lines: DataFrame, key: str) -> DataFrame:
    """Each line with the one before and the one behind; `bare` is the line stripped, once for all that asks for it."""
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("bare", X.strip("line")).withColumns({"prev": F.lag("bare").over(w), "next": F.lead("bare").over(w)})


def likely_heading(rules: Rules) -> Column:
    """Beside a blank line anything may be a heading; else it must be short, have few commas and end no sentence."""
    s = F.col("bare")
    alone = (F.coalesce("prev", F.lit("")) == "") | (F.coalesce("next", F.lit("")) == "")
    commas = F.length(s) - F.length(F.translate(s, "，,", ""))
    fits = ~s.rlike("[。！？]$") & (F.length(s) <= rules.longest) & (commas <= rules.commas)
    return (s != "") & (alone | fits)


def _java(pattern: str) -> str:
    """A pattern with Unicode classes and a dot as elsewhere, held at the line's beginning."""
    return f"^(?Us)(?:{pattern})"


def heading_kind(rules: Rules) -> Column:
    """'chapter', 'volume' or NULL: the first rule that matches decides, also where the line then is no heading."""
    s = F.col("bare")
    any_of = lambda ps: F.lit(False) if not ps else s.rlike("|".join(ps))
    words = [rf"^(?:{'|'.join(re.escape(w) for w in rules.special)})(?:$|[ ：:])"] if rules.special else []
    kind = F.when(any_of([*map(_java, rules.chapters), *words]), "chapter").when(any_of([*map(_java, rules.volumes)]), "volume")
    return F.when(likely_heading(rules), kind)


def headings(lines: DataFrame, key: str, rules: Rules | None = None) -> DataFrame:
    return with_context(lines, key).withColumn("kind", heading_kind(rules or Rules()))


def sections(lines: DataFrame, key: str, rules: Rules | None = None) -> DataFrame:
    """(key, section_idx, kind, volume_title, title, lines) of (key, line_no, line).

    One shuffle by key serves the context, the running section number and the collection of lines. Text before any
    heading opens the chapter 正文; a volume without own lines is no section; an empty chapter is one.
    """
    rows = headings(lines, key, rules)
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumns({"part": F.count("kind").over(w), "content": F.replace("bare", F.lit("　"), F.lit(""))})
    rows = rows.withColumn("volume", F.last(F.when(F.col("kind") == "volume", F.col("bare")), ignorenulls=True).over(w))
    own = F.when(F.col("kind").isNull() & (F.col("content") != ""), F.struct("line_no", "content"))
    parts = rows.groupBy(key, "part").agg(F.max("kind").alias("kind"), F.max(F.when(F.col("kind").isNotNull(), F.col("bare"))).alias("title"), F.min_by("volume", "line_no").alias("volume"), F.transform(F.sort_array(F.collect_list(own)), lambda x: x["content"]).alias("lines"))
    parts = parts.withColumns({"title": F.coalesce("title", F.lit("正文")), "kind": F.coalesce("kind", F.lit("chapter")), "first": F.col("kind").isNull()})
    kept = parts.where((F.size("lines") > 0) | ((F.col("kind") == "chapter") & ~F.col("first")))
    n = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return kept.select(key, n.alias("section_idx"), "kind", F.when(F.col("kind") == "chapter", F.col("volume")).alias("volume_title"), "title", "lines")


def volumes(lines: DataFrame, key: str, rules: Rules | None = None) -> DataFrame:
    """Every volume heading in order, with or without lines of its own."""
    rows = headings(lines, key, rules).where("kind = 'volume'")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1).alias("volume_idx"), F.col("bare").alias("title"))


def section_counts(parts: DataFrame, key: str, titles: int = 10) -> DataFrame:
    """Volumes, chapters, lines and the first titles of each text."""
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("section_idx", "title"))), 1, titles), lambda x: x["title"])
    return parts.groupBy(key).agg(F.count_if(F.col("kind") == "volume").alias("volumes"), F.count_if(F.col("kind") == "chapter").alias("chapters"), F.sum(F.coalesce(F.size("lines"), F.lit(0))).cast("long").alias("n_lines"), first.alias("first_titles"))


def numbered(parts: DataFrame) -> DataFrame:
    """Names of the sections' files in a packaged book, and their neighbours."""
    w = Window.partitionBy("book_id").orderBy("section_idx")
    n = F.row_number().over(w)
    return parts.select("book_id", "section_idx", "title", F.format_string("section_%04d.xhtml", n).alias("file_name"), X.chapter_stamp("title", "kind").alias("stamp"), X.chapter_main("title", "kind").alias("main_title"), F.lag("section_idx").over(w).alias("prev_idx"), F.lead("section_idx").over(w).alias("next_idx"))


# --- the nested form of a book


def book_tree(parts: DataFrame) -> DataFrame:
    """(book_id, tree): a book's sections as JSON in reading order."""
    item = F.struct("section_idx", "kind", "volume_title", "title", "lines")
    return parts.groupBy("book_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("spine"))).alias("tree"))


def from_tree(trees: DataFrame) -> DataFrame:
    shape = "struct<spine:array<struct<section_idx:int,kind:string,volume_title:string,title:string,lines:array<string>>>>"
    return trees.select("book_id", F.explode(F.from_json("tree", shape)["spine"]).alias("x")).select("book_id", "x.*")
