"""Source files: bytes, their encoding, their text; and exports as single files."""

from __future__ import annotations

import csv
import io
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import decoded, source_types


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, source_name, content, source_type) of a folder's files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    probe = F.substring("content", 1, 4096)
    return raw.select("path", name.alias("source_name"), "content", source_types(F.element_at(F.split("path", "/"), -1), F.lit(None).cast("string"), probe).alias("source_type"))


def texts(source: DataFrame) -> DataFrame:
    """(book_id, path, source_name, encoding, text) of text files; the id is the path's digest."""
    rows = source.where("source_type = 'txt'").select("path", "source_name", decoded("content").alias("d"))
    return rows.select(F.md5("path").alias("book_id"), "path", "source_name", F.col("d.encoding"), F.col("d.text").alias("text"))


def write_csv(rows: DataFrame, path: str | Path) -> int:
    """One CSV file with a byte order mark and CRLF line ends, rows as they come, NULL as ''. Returns the rows written.

    Rows are fetched one partition after another, so the driver never holds more than one.
    """
    n = 0
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def csv_bytes(header: list[str], rows: list[list]) -> bytes:
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(header)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue().encode("utf-8-sig")
