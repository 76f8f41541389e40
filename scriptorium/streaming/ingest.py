"""Incremental ingest: new texts and packaged books of a landing folder become books and sections, exactly once.

The file source remembers what it has read in its checkpoint; each micro-batch is written under its own number, so a
batch that runs twice after a failure writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..functions.python import source_types
from ..operators import header, lookup
from ..operators.tables import keep_latest
from ..rules import Rules
from ..sources import epub, files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """The stream of files; per_batch is the queue's capacity, 1 to 2048: a full queue waits instead of failing."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max(1, min(2048, per_batch))).option("recursiveFileLookup", "true").load(folder)


def _of_texts(typed: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, title, author, intro, path) and sections of text files."""
    text = files.texts(typed)
    head, parts = header.parsed(text, "book_id", "text", "source_name", rules)
    return head.join(text.select("book_id", "path"), "book_id"), parts


def _of_packages(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of packaged books: their own metadata, and the lines of each document of their reading order."""
    packed = typed.where("source_type = 'epub'").withColumn("book_id", F.md5("path"))
    meta = epub.read_metadata(packed)
    named = F.coalesce(X.stripped_or_null("title"), F.lit("未命名"))
    head = meta.select("book_id", named.alias("title"), X.stripped_or_null("author").alias("author"), X.stripped_or_null("description").alias("intro")).join(packed.select("book_id", "path"), "book_id")
    lines = F.filter(F.split(F.coalesce(lookup.paragraphs(F.col("html")), F.lit("")), r"\s*\n\s*"), lambda x: x != "")
    parts = epub.read_sections(packed).select("book_id", "section_idx", F.lit("chapter").alias("kind"), F.lit(None).cast("string").alias("volume_title"), "title", lines.alias("lines"))
    return head, parts


def _batch(rows: DataFrame, out: str, rules: Rules, known: DataFrame | None, batch: int) -> None:
    name = F.element_at(F.split("path", "/"), -1)
    typed = rows.withColumns({"source_name": F.regexp_replace(name, r"\.[^.]+$", ""), "source_type": source_types(name, F.lit(None).cast("string"), F.substring("content", 1, 4096))}).persist()
    try:
        (head, parts), (e_head, e_parts) = _of_texts(typed, rules), _of_packages(typed)
        head, parts = head.unionByName(e_head), parts.unionByName(e_parts)
        taken = head.select("book_id").withColumn("_read", F.lit(True))
        if known is not None:  # a text that the library has by title and author adds no book
            k = known.select(X.id_key("title").alias("_t"), X.id_key("author").alias("_a")).distinct()
            head = head.withColumns({"_t": X.id_key("title"), "_a": X.id_key("author")}).join(k, ["_t", "_a"], "left_anti").drop("_t", "_a")
            parts = parts.join(head.select("book_id"), "book_id", "left_semi")
        jobs = typed.select(F.md5("path").alias("book_id"), F.lit("ingest").alias("action"), F.col("source_type").alias("stage")).join(taken, "book_id", "left")
        jobs = jobs.select(F.col("book_id").alias("id"), "book_id", "action", F.when(F.col("_read"), "success").otherwise("failed").alias("status"), "stage")
        for table, df in (("books", head), ("sections", parts), ("jobs", jobs)):
            df.write.mode("overwrite").parquet(f"{out}/{table}/batch={batch}")
    finally:
        typed.unpersist()


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Rules | None = None, known: DataFrame | None = None, per_batch: int = 64) -> StreamingQuery:
    """Reads what is there and ends; run again, it takes only what is new."""
    rules = rules or Rules()
    stream = landing(spark, folder, per_batch)
    return stream.writeStream.foreachBatch(lambda df, n: _batch(df, out, rules, known, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_state(spark: SparkSession, events: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reading positions as they arrive, the last of each book kept: versions of the state, the newest is whole."""

    def step(df: DataFrame, n: int) -> None:
        both = df if not n else spark.read.parquet(f"{out}/version={n - 1}").unionByName(df)
        keep_latest(both, ["book_id"], ["updated_at", "section", "page", "page_count"]).write.mode("overwrite").parquet(f"{out}/version={n}")
        if n > 1:  # the version before the last is needed by no batch that may run again
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version={n - 2}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(events)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
