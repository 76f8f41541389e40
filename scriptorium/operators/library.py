"""The catalogue, the reading tracker and the job list as relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..params import last_page



def effective_updated() -> Column:
    return F.coalesce(X.present("updated_at"), F.col("created_at"))


def live(books: DataFrame) -> DataFrame:
    return books.where("archived is null or archived = false")  # a form that reaches the scan


def archived(books: DataFrame) -> DataFrame:
    return books.where("archived = true")


def all_books(books: DataFrame) -> DataFrame:
    """Live ones, then archived ones."""
    return live(books).unionByName(archived(books))


def page_bounds(page: int, per_page: int) -> tuple[int, int]:
    per_page = max(1, per_page)
    return (max(1, page) - 1) * per_page, per_page


def _matching(books: DataFrame, wishes: DataFrame, query: str, read_filter: str) -> DataFrame:
    """Live books beside their tracker row, filtered. A query's % and _ are wildcards."""
    w = wishes.where("library_book_id is not null").select("library_book_id", F.col("read_status").alias("tracker_status"), F.col("rating").alias("tracker_rating"))
    out = live(books).join(w, F.col("book_id") == F.col("library_book_id"), "left").drop("library_book_id")
    if q := query.strip().lower():
        out = out.where(F.lower("title").like(f"%{q}%") | F.lower(F.coalesce("author", F.lit(""))).like(f"%{q}%"))
    if read_filter == "unread":
        out = out.where(F.coalesce("tracker_status", F.lit("unread")) != "read")
    return out


def library_page(books: DataFrame, wishes: DataFrame, query: str = "", read_filter: str = "all", sort: str = "updated", page: int = 1, per_page: int = 24) -> DataFrame:
    """A page of live books with the tracker's state; ids settle ties."""
    skip, size = page_bounds(page, per_page)
    key = F.col("created_at") if sort == "created" else effective_updated()
    rows = _matching(books, wishes, query, read_filter)
    return rows.orderBy(key.desc_nulls_last(), "book_id").offset(skip).limit(size).select("book_id", "title", "author", "tracker_status", "tracker_rating", "created_at", "updated_at")


def library_page_within(books: DataFrame, wishes: DataFrame, query: str = "", read_filter: str = "all", sort: str = "updated", page: int = 1, per_page: int = 24) -> DataFrame:
    """The same, the page held to those there are: one beyond the last is the last."""
    total = library_count(books, wishes, query, read_filter).first()["total"] if page > 1 else 0
    return library_page(books, wishes, query, read_filter, sort, min(page, last_page(total, per_page)) if page > 1 else 1, per_page)


def library_count(books: DataFrame, wishes: DataFrame, query: str = "", read_filter: str = "all") -> DataFrame:
    return _matching(books, wishes, query, read_filter).agg(F.count(F.lit(1)).alias("total"))


def archived_page(books: DataFrame) -> DataFrame:
    return archived(books).orderBy(effective_updated().desc(), "book_id")


def status_view() -> Column:
    synced = (F.coalesce("epub_updated_at", F.lit("")) != "") & (F.coalesce("updated_at", F.lit("")) != "") & (F.col("epub_updated_at") >= F.col("updated_at"))
    return F.when(F.col("status") == "failed", "failed").when(F.col("status") == "dirty", "pending").when(synced, "ok").otherwise("pending")


def effective_theme() -> Column:
    own = X.strip(F.coalesce("theme_template", F.lit("")))
    return F.when((F.col("source_type") == "epub") & (own == "__book__"), F.lit(None).cast("string")).when(own != "", own).otherwise("default")


def book_view(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """What a book's page shows: the tracker's state goes before the book's own."""
    w = wishes.where("library_book_id is not null").select("library_book_id", F.col("read_status").alias("w_status"), F.col("rating").alias("w_rating"), F.lit(True).alias("tracked"))
    met = books.join(w, F.col("book_id") == F.col("library_book_id"), "left")
    read = F.when(F.col("tracked"), F.col("w_status") == "read").otherwise(F.coalesce("read", F.lit(False)))
    return met.select("book_id", "title", "author", read.alias("is_read"), F.when(F.col("tracked"), F.col("w_rating")).otherwise(F.col("rating")).alias("shown_rating"), status_view().alias("state"), effective_theme().alias("theme"), (F.coalesce("cover_file", F.lit("")) != "").alias("has_cover"))


def tracker_state(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """Books whose stored read flag or rating the tracker overrides, with the new values."""
    w = wishes.where("library_book_id is not null").select(F.col("library_book_id").alias("book_id"), (F.col("read_status") == "read").alias("new_read"), F.col("rating").alias("new_rating"))
    met = books.select("book_id", "read", "rating").join(w, "book_id")
    changed = ~F.col("read").eqNullSafe(F.col("new_read")) | ~F.col("rating").eqNullSafe(F.col("new_rating"))
    return met.where(changed).select("book_id", "new_read", "new_rating", (~F.col("read").eqNullSafe(F.col("new_read"))).alias("stamp_read_time"))


# --- the tracker


def wish_rows(wishes: DataFrame) -> DataFrame:
    """Stored rows as the tracker reads them."""
    return wishes.withColumns({"read_status": X.read_status("read_status", "read"), "book_status": F.coalesce(X.present("book_status"), F.lit("ongoing")), "link": X.book_link("library_book_id")})


def missing_wishes(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """A new tracker row for each book without one, archived books included; ids come from the book's."""
    linked = wishes.where("library_book_id is not null").select(F.col("library_book_id").alias("book_id"))
    b = books.join(linked, "book_id", "left_anti")
    read = F.coalesce("read", F.lit(False))
    created = F.coalesce(X.present("created_at"), X.present("updated_at"), F.lit(""))
    updated = F.coalesce(X.present("updated_at"), X.present("created_at"), F.lit(""))
    return b.select(F.md5("book_id").alias("id"), "title", F.col("book_id").alias("library_book_id"), "author", F.lit("").alias("identity_title"), F.lit("").alias("identity_author"), "rating", read.alias("read"), F.when(read, "read").otherwise("unread").alias("read_status"), F.lit("ongoing").alias("book_status"), created.alias("created_at"), updated.alias("updated_at"))


def identity_index(books: DataFrame) -> DataFrame:
    """Live books with keys and their place in the library's order."""
    return live(books).select("book_id", X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"), F.struct(effective_updated().alias("at"), F.col("book_id").alias("id")).alias("_o"))


def _first_by(index: DataFrame, *keys: str) -> DataFrame:
    """The first book of each key: the latest, of like ones the smallest id. Two aggregates, so hot keys combine early."""
    latest = index.groupBy(*keys, "_o.at").agg(F.min("book_id").alias("book_id"))
    return latest.groupBy(*keys).agg(F.max_by("book_id", "at").alias("book_id"))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], can: Column) -> DataFrame:
    """A left join for the rows that can have a partner only: the others, often most, do not meet in one task."""
    rest = rows.where(~F.coalesce(can, F.lit(False)))
    return rows.where(can).join(table, keys, "left").unionByName(rest, allowMissingColumns=True)


def library_match(wishes: DataFrame, books: DataFrame) -> DataFrame:
    """(id, match_id): the book a tracker row stands for: its link, else title and author, else title where it names no author."""
    index = identity_index(books)
    titled = index.where("title_key <> ''")
    by_title = _first_by(titled, "title_key").withColumnRenamed("book_id", "t_id")
    by_both = _first_by(titled.where("author_key <> ''"), "title_key", "author_key").withColumnRenamed("book_id", "ta_id")
    w = wishes.select("id", X.book_link("library_book_id").alias("link"), X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"))
    met = _looked_up(w, index.select(F.col("book_id").alias("link"), F.col("book_id").alias("d_id")), ["link"], F.col("link").isNotNull())
    met = _looked_up(met, by_title, ["title_key"], F.col("title_key") != "")
    met = _looked_up(met, by_both, ["title_key", "author_key"], (F.col("title_key") != "") & (F.col("author_key") != ""))
    by_key = F.when(F.col("t_id").isNull(), None).when(F.col("author_key") == "", F.col("t_id")).otherwise(F.col("ta_id"))
    return met.select("id", F.coalesce("d_id", by_key).alias("match_id"))


def tracker_stats(wishes: DataFrame, books: DataFrame) -> DataFrame:
    rows = wish_rows(wishes).select("id", "read_status").join(library_match(wishes, books), "id", "left")
    n = lambda c: F.count_if(c)
    inside = n(F.col("match_id").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("total"), n(F.col("read_status") == "read").alias("read"), n(F.col("read_status") == "reading").alias("reading"), n(~F.col("read_status").isin("read", "reading")).alias("unread"), inside.alias("in_library"), F.greatest(F.lit(0), F.count(F.lit(1)) - inside).alias("out_of_library"))


def tracker_rows(wishes: DataFrame, books: DataFrame, query: str = "", read_filter: str = "all", library_filter: str = "all", status_filter: str = "all") -> DataFrame:
    """Filtered tracker rows as they are shown."""
    rows = wish_rows(wishes).join(library_match(wishes, books), "id", "left")
    if q := query.strip().lower():
        tags = F.array_join(F.transform(F.filter("tags", lambda t: X.strip(t) != ""), F.lower), " ")
        rows = rows.where(F.lower("title").contains(q) | F.lower(F.coalesce("author", F.lit(""))).contains(q) | F.coalesce(tags, F.lit("")).contains(q))
    if read_filter != "all":
        rows = rows.where(F.col("read_status") == read_filter)
    if library_filter != "all":
        rows = rows.where(F.col("match_id").isNotNull() if library_filter == "in" else F.col("match_id").isNull())
    if status_filter != "all":
        rows = rows.where(X.book_status("book_status") == status_filter)
    status = X.book_status("book_status")
    return rows.select("id", "title", "author", "rating", "read_status", X.labelled(F.col("read_status"), X.READ_STATUS_LABELS, F.lit("未读")).alias("read_label"), status.alias("book_status"), X.labelled(status, X.BOOK_STATUS_LABELS, F.lit("更新中")).alias("book_label"), X.tag_text("tags").alias("tag_text"), "comment", "match_id", F.col("match_id").isNotNull().alias("in_library"), "updated_at", "created_at")


def tracker_page(wishes: DataFrame, books: DataFrame, page: int = 1, per_page: int = 20, **filters: str) -> DataFrame:
    skip, size = page_bounds(page, per_page)
    return tracker_rows(wishes, books, **filters).orderBy(F.desc("updated_at"), F.desc("created_at"), "id").offset(skip).limit(size)


def export_rows(wishes: DataFrame, books: DataFrame, **filters: str) -> DataFrame:
    """The rows of the tracker's CSV: empty text for what is missing."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return tracker_rows(wishes, books, **filters).select("id", blank("title").alias("title"), blank("author").alias("author"), blank("rating").alias("rating"), blank("comment").alias("comment"), X.displayed_instant("updated_at").alias("date"))


def duplicate_check(wishes: DataFrame, title: str, author: str | None = None, exclude_id: str = "", limit: int = 5) -> DataFrame:
    """Tracker rows of one title; those that block a new row first."""
    keys = wishes.sparkSession.range(1).select(X.id_key(F.lit(title)).alias("t"), X.id_key(F.lit(author or "")).alias("a")).first()
    rows = wishes.where((X.id_key("title") == keys["t"]) & (F.lit(keys["t"]) != "") & (F.col("id") != exclude_id))
    exact = F.lit(bool(keys["a"])) & (X.id_key("author") == keys["a"])
    shown = rows.select("id", "title", F.coalesce("author", F.lit("")).alias("author"), X.book_link("library_book_id").isNotNull().alias("in_library"), exact.alias("exact_author"), (exact if keys["a"] else F.lit(True)).alias("blocking"))
    return shown.orderBy(F.desc("blocking"), F.desc("in_library"), "title", "author", "id").limit(max(1, min(20, limit)))


def title_suggestions(wishes: DataFrame, title: str, author: str | None = None, limit: int = 8) -> DataFrame:
    """Tracker rows whose title holds the words typed so far."""
    q = title.strip().lower()
    key = wishes.sparkSession.range(1).select(X.id_key(F.lit(author or "")).alias("a")).first()["a"]
    exact = F.lit(bool(key)) & (X.id_key("author") == key)
    rows = wishes.where(F.lower(X.strip("title")).contains(q) & F.lit(bool(q)))
    shown = rows.select("id", "title", F.coalesce("author", F.lit("")).alias("author"), X.book_link("library_book_id").isNotNull().alias("in_library"), exact.alias("exact_author"))
    return shown.orderBy(F.desc("exact_author"), F.desc("in_library"), "title", "author", "id").limit(max(1, min(30, limit)))


def duplicate_reasons(incoming: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    """For each incoming record its first k duplicates in the library's order, and why: ISBN, title with author, title.

    (id, isbn, title, author) against live books. Equality joins instead of comparing all with all; the library's side
    keeps k + 1 books a key first (one may be the record itself), which happens before the shuffle, so a key of any
    size gives each record at most 3 * (k + 1) candidates.
    """
    from .tables import ranked

    a = incoming.select(F.col("id"), X.isbn_key("isbn").alias("isbn_key"), X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"))
    b = live(library).select("book_id", X.isbn_key("isbn").alias("isbn_key"), X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"), effective_updated().alias("at"))
    first = lambda d, *keys: ranked(d, keys, [F.desc("at"), F.asc("book_id")], k + 1)
    titled, named = F.col("title_key") != "", F.col("author_key") != ""
    hit = lambda d, rank, why: d.where("id <> book_id").select("id", "book_id", "at", F.lit(rank).alias("rank"), F.lit(why).alias("reason"))
    isbn = a.select("id", "isbn_key").where("isbn_key <> ''").join(first(b, "isbn_key").select("isbn_key", "book_id", "at"), "isbn_key")
    both = a.where(titled & named).join(first(b.where(titled & named), "title_key", "author_key").select("title_key", "author_key", "book_id", "at"), ["title_key", "author_key"])
    no_author = first(b.where(titled & ~named), "title_key").select("title_key", "book_id", "at")
    theirs = a.where(titled & named).join(no_author, "title_key")
    ours = a.where(titled & ~named).join(first(b.where(titled), "title_key").select("title_key", "book_id", "at"), "title_key")
    hits = hit(isbn, 1, "ISBN").unionByName(hit(both, 2, "标题+作者")).unionByName(hit(theirs, 3, "标题")).unionByName(hit(ours, 3, "标题"))
    one = hits.groupBy("id", "book_id", "at").agg(F.min_by("reason", "rank").alias("reason"))
    w = Window.partitionBy("id").orderBy(F.desc("at"), "book_id")
    return one.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("id", "book_id", "reason", "pos")


def _link_greedily(group: pd.DataFrame) -> pd.DataFrame:
    """Books in the library's order each take the first free tracker row whose author does not contradict."""
    books, wishes = group[group["side"] == 0].sort_values("ord"), group[group["side"] == 1].sort_values("ord")
    free = list(zip(wishes["key"], wishes["author_key"], strict=True))
    out = []
    for book, author in zip(books["key"], books["author_key"], strict=True):
        for i, (wish, own) in enumerate(free):
            if not author or not own or author == own:
                out.append((book, wish))
                del free[i]
                break
    return pd.DataFrame(out, columns=["book_id", "wish_id"], dtype=object)


def greedy_links(books: DataFrame, wishes: DataFrame) -> DataFrame:
    """(book_id, wish_id): unlinked tracker rows given to books without one, one to one, by title.

    Books in the library's order each take the first free row of their title whose author does not contradict. Where
    every row of a title names its author, the n-th book of an author takes the author's n-th row: a join of ranks.
    Only titles with rows that name none are walked through, and of those only rows that could be taken at all: of one
    author no more books than there are rows for them, and the other way round.
    """
    linked = wishes.where(X.book_link("library_book_id").isNotNull()).select(X.book_link("library_book_id").alias("book_id"))
    b = live(books).join(linked, "book_id", "left_anti").select(X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"), F.col("book_id").alias("key"), effective_updated().alias("at"), F.lit(0).alias("side"))
    w = wishes.where(X.book_link("library_book_id").isNull()).select(X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"), F.col("id").alias("key"), F.concat_ws("\x01", "updated_at", "created_at").alias("at"), F.lit(1).alias("side"))
    rows = b.unionByName(w).where("title_key <> ''")
    n = lambda side, bare=None: F.count_if((F.col("side") == side) if bare is None else (F.col("side") == side) & (F.col("author_key") == ""))
    titles = rows.groupBy("title_key").agg(n(0).alias("books"), n(1).alias("wishes"), n(0, True).alias("bare_books"), n(1, True).alias("bare_wishes")).where("books > 0 and wishes > 0")
    met = rows.join(titles, "title_key")
    own = Window.partitionBy("title_key", "author_key", "side").orderBy(F.desc("at"), "key")
    ranked = met.withColumn("rank", F.row_number().over(own))
    plain = ranked.where("bare_books = 0 and bare_wishes = 0")
    on = ["title_key", "author_key", "rank"]
    by_rank = plain.where("side = 0").select(*on, F.col("key").alias("book_id")).join(plain.where("side = 1").select(*on, F.col("key").alias("wish_id")), on).select("book_id", "wish_id")
    rest = ranked.where("bare_books > 0 or bare_wishes > 0")
    sizes = rest.groupBy("title_key", "author_key").agg(n(0).alias("own_books"), n(1).alias("own_wishes"))
    rest = rest.join(sizes, ["title_key", "author_key"])
    others = F.when(F.col("author_key") == "", F.when(F.col("side") == 0, F.col("wishes")).otherwise(F.col("books")))
    most = F.coalesce(others, F.when(F.col("side") == 0, F.col("own_wishes") + F.col("bare_wishes")).otherwise(F.col("own_books") + F.col("bare_books")))
    order = Window.partitionBy("title_key", "side").orderBy(F.desc("at"), "key")
    walked = rest.where(F.col("rank") <= most).withColumn("ord", F.row_number().over(order)).select("title_key", "author_key", "key", "ord", "side")
    return by_rank.unionByName(walked.groupBy("title_key").applyInPandas(_link_greedily, "book_id string, wish_id string"))


# --- jobs


def job_rows(jobs: DataFrame, with_log: bool = False) -> DataFrame:
    """The latest row of each job: status changes are appended, and rows arrive twice and out of order.

    The log is long and shown by itself alone: it is neither read nor shuffled unless asked for.
    """
    from .tables import keep_latest

    jobs = jobs if with_log else jobs.drop("log")
    return keep_latest(jobs, ["id"], ["updated_at", "created_at", "status", "stage", "message"])


def job_view(jobs: DataFrame, books: DataFrame) -> DataFrame:
    b = books.select("book_id", F.col("title").alias("b_title"), F.col("author").alias("b_author"), F.coalesce("archived", F.lit(False)).alias("b_archived"), F.lit(True).alias("known"))
    met = jobs.join(b, "book_id", "left")
    action = X.strip(F.coalesce("action", F.lit("")))
    label = X.labelled(action, X.JOB_LABELS, F.coalesce(X.present("action"), F.lit("任务")))
    return met.select("id", "book_id", F.coalesce(X.present("b_title"), F.lit("未关联书籍")).alias("book_title"), F.coalesce(X.present("b_author"), F.lit("未知")).alias("book_author"), (F.coalesce("known", F.lit(False)) & ~F.coalesce("b_archived", F.lit(True))).alias("can_open"), label.alias("action_label"), "status", "stage", "created_at", "updated_at")


def job_tabs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("running", "success", "failed")])


def job_page(jobs: DataFrame, books: DataFrame, status: str, page: int = 1, per_page: int = 12) -> DataFrame:
    skip, size = page_bounds(page, per_page)
    return job_view(jobs.where(F.col("status") == status), books).orderBy(F.desc("created_at"), "id").offset(skip).limit(size)


def invalid_jobs(jobs: DataFrame, books: DataFrame) -> DataFrame:
    """Jobs of no book or of an unknown one."""
    key = X.strip(F.coalesce("book_id", F.lit("")))
    return jobs.withColumn("_key", key).join(books.select(F.col("book_id").alias("_key")).where("book_id <> ''"), "_key", "left_anti").select("id", "book_id", "status")


# --- reading positions, templates, archives


def latest_progress(progress: DataFrame) -> DataFrame:
    """The last position of each book, clamped; of positions at one instant the farthest."""
    from .tables import keep_latest

    rows = progress.select("book_id", X.clamp("section", -1, 999999).alias("section"), X.clamp("page", 0, 999999).alias("page"), X.clamp("page_count", 0, 999999).alias("page_count"), "updated_at")
    return keep_latest(rows, ["book_id"], ["updated_at", "section", "page", "page_count"])


def template_usage(books: DataFrame, column: str) -> DataFrame:
    """Templates that books refer to: those cannot be deleted."""
    return books.where(F.coalesce(column, F.lit("")) != "").groupBy(F.col(column).alias("template")).agg(F.count(F.lit(1)).alias("books"))


def with_templates(books: DataFrame, templates: DataFrame, column: str, fallback: str) -> DataFrame:
    """Each book with its template, or the fallback where it has none or an unknown one."""
    known = templates.select(F.col("id").alias("_id"))
    return books.join(known, F.col(column) == F.col("_id"), "left").withColumn(f"{column}_used", F.coalesce("_id", F.lit(fallback))).drop("_id")


def archive_names(books: DataFrame) -> DataFrame:
    """A file name of its own for each book in id order: 'title-author.epub', else with the next free number from 2.

    Where all books of a family of names (those alike but for a number at the end) have one base, numbers are ranks.
    Only families with several bases, whose numbered names could meet, are walked through.
    """
    base = F.concat_ws("-", X.safe_filename("title", "book"), X.safe_filename("author", "unknown"))
    rows = books.select("book_id", base.alias("base")).withColumn("family", F.regexp_replace("base", r"(-[0-9]+)+$", ""))
    several = rows.groupBy("family").agg((F.min("base") != F.max("base")).alias("several"))
    met = rows.join(several, "family")
    n = F.row_number().over(Window.partitionBy("base").orderBy("book_id"))
    plain = met.where("not several").select("book_id", F.concat("base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".epub")).alias("file_name"))

    def walk(family: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        last: dict[str, int] = {}
        out = []
        for base in family.sort_values("book_id")["base"]:
            name, k = base, last.get(base, 1)
            while name in used:
                k += 1
                name = f"{base}-{k}"
            last[base] = k
            used.add(name)
            out.append(f"{name}.epub")
        return pd.DataFrame({"book_id": family.sort_values("book_id")["book_id"].to_numpy(), "file_name": out})

    walked = met.where("several").select("family", "book_id", "base").groupBy("family").applyInPandas(walk, "book_id string, file_name string")
    return plain.unionByName(walked)


def merged(primary: DataFrame, overlay: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Each field of the overlay where it has one, else the primary's, and which fields changed, in the fields' order."""
    o = overlay.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    met = primary.join(o, key, "left")
    new = {f: F.coalesce(X.present(F.col(f"_o_{f}")), F.col(f)) for f in fields}
    changed = F.array_compact(F.array(*[F.when(X.present(F.col(f"_o_{f}")).isNotNull() & ~F.col(f"_o_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return met.select(key, *[v.alias(f) for f, v in new.items()], changed.alias("changed"))
