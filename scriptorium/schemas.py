"""Schemas of the library's tables, their defaults, and readers that fill what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_TAGS = T.ArrayType(_S)

BOOKS = T.StructType([T.StructField(n, t) for n, t in [("book_id", _S), ("title", _S), ("author", _S), ("language", _S), ("description", _S), ("source_type", _S), ("series", _S), ("identifier", _S), ("publisher", _S), ("tags", _TAGS), ("published", _S), ("isbn", _S), ("rating", _I), ("status", _S), ("epub_updated_at", _S), ("archived", _B), ("read", _B), ("read_updated_at", _S), ("cover_file", _S), ("rule_template", _S), ("theme_template", _S), ("custom_css", _S), ("created_at", _S), ("updated_at", _S)]])
WISHLIST = T.StructType([T.StructField(n, t) for n, t in [("id", _S), ("title", _S), ("library_book_id", _S), ("author", _S), ("identity_title", _S), ("identity_author", _S), ("rating", _I), ("read", _B), ("read_status", _S), ("tags", _TAGS), ("comment", _S), ("book_status", _S), ("created_at", _S), ("updated_at", _S)]])
JOBS = T.StructType([T.StructField(n, _S) for n in ("id", "book_id", "action", "status", "stage", "message", "log", "rule_template", "created_at", "updated_at")])
PROGRESS = T.StructType([T.StructField("book_id", _S), T.StructField("section", _I), T.StructField("page", _I), T.StructField("page_count", _I), T.StructField("updated_at", _S)])
SECTIONS = T.StructType([T.StructField("book_id", _S), T.StructField("section_idx", _I), T.StructField("kind", _S), T.StructField("volume_title", _S), T.StructField("title", _S), T.StructField("lines", T.ArrayType(_S)), T.StructField("site", _S)])

#: What a missing value of a column is read as.
DEFAULTS = {"language": "zh-CN", "source_type": "txt", "status": "synced", "archived": False, "read": False, "title": "", "created_at": "", "updated_at": "", "identity_title": "", "identity_author": "", "read_status": "unread", "book_status": "ongoing"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones and NULLs get the default, tags an empty list; others are dropped."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        elif f.name == "tags":
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
