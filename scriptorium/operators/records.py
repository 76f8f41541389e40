"""Records on their way into the tables: from forms, parsed texts, packages, legacy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import BOOKS, conform


def new_wishes(rows: DataFrame) -> DataFrame:
    """Tracker rows as stored: link in its one form, texts stripped, keys of title and author, one read status."""
    status = X.read_status("read_status", "read")
    title, author = X.strip(F.coalesce("title", F.lit(""))), X.stripped_or_null("author")
    return rows.select("id", title.alias("title"), X.book_link("library_book_id").alias("library_book_id"), author.alias("author"), X.id_key(title).alias("identity_title"), X.id_key(author).alias("identity_author"), X.clamp("rating", 0, 5).alias("rating"), (status == "read").alias("read"), status.alias("read_status"), X.book_status("book_status").alias("book_status"), X.stripped_or_null("comment").alias("comment"))


def refreshed_keys(wishes: DataFrame) -> DataFrame:
    """Rows whose stored keys are not those of their title and author."""
    t, a = X.id_key("title"), X.id_key("author")
    return wishes.where((F.coalesce("identity_title", F.lit("")) != t) | (F.coalesce("identity_author", F.lit("")) != a)).select("id", t.alias("identity_title"), a.alias("identity_author"))


def changed_wishes(wishes: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates: (id, any columns); NULL leaves a column. Keys follow title and author, the flag the status."""
    given = [c for c in changes.columns if c != "id" and c in wishes.columns]
    met = wishes.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in given]), "id", "left")
    out = {c: F.coalesce(f"_{c}", c) for c in given}
    rows = met.select(*[out.get(c, F.col(c)).alias(c) for c in wishes.columns])
    rows = rows.withColumns({"identity_title": X.id_key("title"), "identity_author": X.id_key("author")})
    return rows.withColumn("read", F.col("read_status") == "read") if "read_status" in given and "read" not in given else rows


def merged_wishes(wishes: DataFrame) -> DataFrame:
    """Unlinked rows that have become one by title and author merge into the latest."""
    from .tables import ranked

    manual = wishes.where(X.book_link("library_book_id").isNull() & (X.id_key("title") != ""))
    keyed = manual.withColumns({"_t": X.id_key("title"), "_a": X.id_key("author")})
    kept = ranked(keyed, ["_t", "_a"], [F.desc("updated_at"), F.desc("created_at"), F.desc("id")]).drop("_t", "_a")
    rest = wishes.where(~(X.book_link("library_book_id").isNull() & (X.id_key("title") != "")))
    return rest.unionByName(kept)


def first_of(*values: Column | str) -> Column:
    """A form's value, else the parsed one, else the default: blank counts as none."""
    return F.coalesce(*[X.stripped_or_null(v) for v in values])


def book_rows(parsed: DataFrame, now: str, source: str = "txt", form: DataFrame | None = None) -> DataFrame:
    """Catalogue rows of parsed books (book_id, title, author, description ...), a form's fields over them."""
    fields = ("title", "author", "language", "description", "series", "identifier", "publisher", "published", "isbn")
    have = [c for c in fields if c in parsed.columns]
    rows = parsed
    if form is not None:
        rows = rows.join(form.select("book_id", *[F.col(c).alias(f"_{c}") for c in fields if c in form.columns]), "book_id", "left")
    pick = lambda c: first_of(*([f"_{c}"] if f"_{c}" in rows.columns else []), *([c] if c in have else []), *([F.lit({"title": "未命名", "language": "zh-CN"}.get(c))] if c in ("title", "language") else [F.lit(None).cast("string")]))
    out = rows.select("book_id", *[pick(c).alias(c) for c in fields], F.lit(source).alias("source_type"), F.lit("dirty").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), *([F.col("tags")] if "tags" in rows.columns else []))
    return conform(out, BOOKS)


def legacy_books(spark: SparkSession, folder: str, books: DataFrame) -> DataFrame:
    """Books of old metadata files that the table lacks; those below an archive folder are archived."""
    raw = spark.read.schema(BOOKS).option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder, recursiveFileLookup=True, pathGlobFilter="meta.json")
    rows = raw.withColumn("archived", F.coalesce("archived", F.lit(False)) | F.input_file_name().contains("/archive/"))
    return conform(rows.where("book_id is not null"), BOOKS).join(books.select("book_id"), "book_id", "left_anti")


def synced(books: DataFrame, done: DataFrame, at: str) -> DataFrame:
    """The state after a write-back: (book_id, ok) of the books tried."""
    met = books.join(done.select("book_id", F.col("ok").alias("_ok")), "book_id", "left")
    status = F.when(F.col("_ok"), "synced").when(~F.col("_ok"), "failed").otherwise(F.col("status"))
    return met.select(*[status.alias(c) if c == "status" else F.when(F.col("_ok"), F.lit(at)).otherwise(F.col(c)).alias(c) if c == "epub_updated_at" else F.col(c) for c in books.columns])


def existing(books: DataFrame, folders: DataFrame) -> DataFrame:
    """Books whose folder is there: (book_id) of a listing."""
    return books.join(folders.select("book_id").distinct(), "book_id", "left_semi")


def stale(books: DataFrame) -> DataFrame:
    """Books whose package is older than their record."""
    return books.where((F.col("status") != "failed") & ((F.coalesce("epub_updated_at", F.lit("")) == "") | (F.col("epub_updated_at") < F.col("updated_at"))))


def to_regenerate(books: DataFrame, scope: str, template: str) -> DataFrame:
    """Live books to build anew when a rule or a theme has changed."""
    from .library import effective_theme, live

    rows = live(books)
    if scope == "rule":
        return rows.where((F.coalesce("source_type", F.lit("txt")) != "epub") & (F.coalesce(X.present("rule_template"), F.lit("default")) == template))
    return rows.where(effective_theme().eqNullSafe(F.lit(template)))
