"""Full-text scan of sections: hits with snippets, in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def section_text(sections: DataFrame) -> DataFrame:
    """(book_id, section_idx, title, text): white space joined, empty texts left out."""
    joined = X.one_space(F.array_join(F.coalesce("lines", F.array().cast("array<string>")), " "))
    rows = sections.where(F.exists("lines", lambda x: X.strip(x) != ""))  # cheaper to ask than the joined text
    return rows.select("book_id", "section_idx", "title", joined.alias("text"))


def document_text(documents: DataFrame) -> DataFrame:
    """The same of HTML section documents (book_id, section_idx, title, media_type, html)."""
    html = documents.where(F.lower("media_type").contains("html"))
    return html.select("book_id", "section_idx", "title", X.html_text("html").alias("text")).where("text <> ''")


def hits(texts: DataFrame, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """The first match of each section that has one: `limit` of them a book after `offset`, with 30 letters before and 70 behind."""
    q = " ".join(query.split())
    size = len(q)
    at = F.locate(q.lower(), F.lower("text")) - 1
    begin = F.greatest(F.lit(0), F.col("at") - 30)
    end = F.least(F.col("size"), F.col("at") + size + 70)
    snippet = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring("text", begin + 1, end - begin), F.when(end < F.col("size"), "...").otherwise(""))
    # The snippet is cut before the shuffle: whole texts do not travel.
    found = texts.withColumns({"at": at, "size": F.length("text")}).where((F.col("at") >= 0) & F.lit(bool(q)))
    found = found.select("book_id", "section_idx", "title", F.col("at").alias("offset"), snippet.alias("snippet"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("section_idx"))
    return found.withColumn("n", n).where((F.col("n") > offset) & (F.col("n") <= offset + limit)).drop("n")


def summary(texts: DataFrame, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Per book: sections with text, matches, whether more follow the page, and where the next page begins."""
    q = " ".join(query.split()).lower()
    match = (F.locate(q, F.lower("text")) > 0) & F.lit(bool(q))
    rows = texts.groupBy("book_id").agg(F.count(F.lit(1)).alias("indexed_sections"), F.count_if(match).alias("matches"))
    shown = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("matches") - offset))
    return rows.select("book_id", "indexed_sections", "matches", (F.col("matches") > offset + limit).alias("has_more"), (F.lit(offset) + shown).cast("long").alias("next_offset"))
