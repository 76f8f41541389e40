"""The engine's own queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import python
from ..functions import text as X
from ..operators import header
from ..operators import library as L
from ..operators import lines as N
from ..operators import lookup, records, search, tables
from ..rules import CHAPTERS, SPECIAL, Rules
from ..schemas import BOOKS, WISHLIST, conform, read_table
from ..sources import epub

Query = Callable[[SparkSession, str], DataFrame]

BOOK_COLUMNS = ("book_id", "title", "author", "archived", "created_at", "updated_at")
SEARCHED = "渡口"
WISHED, WISHER = "舫冷伞蝉", "浮薇舫鼎工作室"


def _q(*names: str):
    """A query of tables by name."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda s, d: f(*[read_table(s, d, n) for n in names])

    return wrap


def _headings(docs: DataFrame) -> DataFrame:
    return N.headings(N.lines_of(docs, "doc_id", "text"), "doc_id")


def _sections(docs: DataFrame) -> DataFrame:
    return N.sections(N.lines_of(docs, "doc_id", "text"), "doc_id")


def _manual(w: DataFrame) -> DataFrame:
    """Unlinked tracker rows by the keys of title and author: the latest of each stays."""
    rows = w.where("library_book_id is null").withColumns({"k_title": X.id_key("title"), "k_author": X.id_key("author")}).where("k_title <> ''")
    return tables.keep_latest(rows.select("k_title", "k_author", "id", "updated_at", "created_at"), ["k_title", "k_author"], ["updated_at", "created_at", "id"])


def _linked(w: DataFrame) -> DataFrame:
    rows = w.where("library_book_id is not null").select("library_book_id", "id", "updated_at", "created_at")
    return tables.keep_latest(rows, ["library_book_id"], ["updated_at", "created_at", "id"])


def _scores(b: DataFrame, w: DataFrame) -> DataFrame:
    """Each linked tracker row's book scored against what the tracker says of it."""
    own = w.where("library_book_id is not null").select("id", F.col("library_book_id").alias("book_id"), F.col("title").alias("query"), F.coalesce("author", F.lit("")).alias("expected"))
    return own.join(b.select("book_id", "title", "author", "description", "publisher", "isbn", "published", "tags"), "book_id").select("id", "book_id", X.title_score("title", "query").alias("title_score"), X.author_score("author", "expected").alias("author_score"), X.metadata_score("query", "expected").alias("score"))


def _rank(b: DataFrame, w: DataFrame) -> DataFrame:
    """Tracker rows as queries, the books of the same title key as their suggestions."""
    q = w.where("library_book_id is null").select("id", F.col("title").alias("query"), F.coalesce("author", F.lit("")).alias("expected"), X.id_key("title").alias("k")).where("k <> ''")
    s = b.select("book_id", "title", "author", X.id_key("title").alias("k"))
    pos = F.row_number().over(Window.partitionBy("id").orderBy("book_id"))
    met = q.select("id", "k").join(s, "k").select("id", "title", "author", pos.alias("pos"))
    return lookup.best_suggestion(q.drop("k"), met)


def _upsert(p: DataFrame) -> DataFrame:
    """Positions of the first half of the instants as the old state, the rest written over them."""
    latest = L.latest_progress
    middle = "2022-01-01"
    return tables.upsert(latest(p.where(F.col("updated_at") < middle)), latest(p.where(F.col("updated_at") >= middle)), ["book_id"])


def _tags(b: DataFrame) -> DataFrame:
    joined = F.concat(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "，"), F.lit(", "), F.coalesce("language", F.lit("")))
    return b.select("book_id", F.array_join(X.split_tags(joined), "|").alias("tags"), F.size(X.split_tags(joined)).cast("long").alias("n"))


def _clean(b: DataFrame) -> DataFrame:
    return b.select("book_id", X.clean_date("published").alias("published"), X.clean_isbn("isbn").alias("isbn"), X.isbn_key("isbn").alias("isbn_key"), X.clean_text("description").alias("description"))


def _names(b: DataFrame) -> DataFrame:
    t, a = X.title_from_name(F.concat(F.lit("《"), "title", F.lit("》作者："), F.coalesce("author", F.lit("")), F.lit("（完）.txt")))
    return b.select("book_id", t.alias("title"), a.alias("author"))


def _decoded(d: DataFrame) -> DataFrame:
    """The corpus's texts as bytes with and without a mark of their order, decoded again."""
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit(bytearray(b"\xef\xbb\xbf"))).otherwise(F.lit(bytearray())), F.encode("text", "UTF-8"))
    return d.select("doc_id", python.decoded(content).alias("d")).select("doc_id", "d.encoding", "d.text")


def _volumes_by_rule(d: DataFrame) -> DataFrame:
    """The volumes of rules that take numbered chapters for such."""
    return N.volumes(N.lines_of(d, "doc_id", "text"), "doc_id", Rules(chapters=(), volumes=CHAPTERS, special=()))


def _changed_keys(w: DataFrame) -> DataFrame:
    """Rows whose title took on the author's name: their keys are no longer those stored."""
    return records.refreshed_keys(w.withColumn("title", F.concat_ws(" ", "title", "author")))


def _round_trip(b: DataFrame, s: DataFrame) -> DataFrame:
    """Books built as packages from their sections and read back."""
    made = epub.build(b, s).withColumnRenamed("epub", "content")
    return epub.read_sections(made).select("book_id", "section_idx", "title")


def _patched(b: DataFrame, s: DataFrame) -> DataFrame:
    """Packages patched with a new publisher and series, and read back."""
    made = epub.build(b, s.where("section_idx = 0")).withColumnRenamed("epub", "content")
    return epub.read_metadata(epub.patched(made, {"publisher": "新社", "series": "丛书"}).withColumn("source_name", F.lit("x.epub"))).select("book_id", "publisher", "series", "language")


def _headers(d: DataFrame) -> DataFrame:
    """Header metadata of the corpus's texts; the name of the source stands for a missing title."""
    return header.headers(d, "doc_id", "text", "source").drop("skipped")


def queries() -> dict[str, Query]:
    bw = _q("books", "wishlist")
    wb = _q("wishlist", "books")
    out: dict[str, Query] = {
        "library_page": bw(lambda b, w: L.library_page(b, w, read_filter="unread", page=2)),
        "library_page_within": bw(lambda b, w: L.library_page_within(b, w, read_filter="unread", page=10_000)),
        "library_page_created": bw(lambda b, w: L.library_page(b, w, sort="created", per_page=48)),
        "library_search": bw(lambda b, w: L.library_page(b, w, query="的", per_page=96)),
        "library_count": bw(lambda b, w: L.library_count(b, w, query="之", read_filter="unread")),
        "archived_books": _q("books")(lambda b: L.archived_page(b).select(*BOOK_COLUMNS)),
        "all_books": _q("books")(lambda b: L.all_books(b).select(*BOOK_COLUMNS)),
        "conformed_books": _q("books")(lambda b: conform(b.drop("custom_css"), BOOKS).select("book_id", "language", "tags", "custom_css", "status")),
        "conformed_wishes": _q("wishlist")(lambda w: L.wish_rows(conform(w, WISHLIST)).select("id", "read_status", "book_status", "link")),
        "book_view": bw(lambda b, w: L.book_view(b, _latest_links(w))),
        "status_view": _q("books")(lambda b: b.select("book_id", L.status_view().alias("state"))),
        "effective_theme": _q("books")(lambda b: b.select("book_id", L.effective_theme().alias("theme"))),
        "tracker_sync": bw(lambda b, w: L.tracker_state(b, _latest_links(w))),
        "seed_missing_tracker": bw(L.missing_wishes),
        "tracker_match": wb(L.library_match),
        "tracker_stats": wb(L.tracker_stats),
        "tracker_filtered": wb(lambda w, b: L.tracker_rows(w, b, query="的", read_filter="reading", status_filter="ongoing").drop("updated_at", "created_at")),
        "tracker_page": wb(lambda w, b: L.tracker_page(w, b, page=2).select("id", "title", "updated_at")),
        "export_rows": wb(lambda w, b: L.export_rows(w, b, read_filter="read").drop("date")),
        "dedupe_linked": _q("wishlist")(_linked),
        "dedupe_manual": _q("wishlist")(_manual),
        "duplicate_check": _q("wishlist")(lambda w: L.duplicate_check(w, WISHED, WISHER, limit=20)),
        "title_suggestions": _q("wishlist")(lambda w: L.title_suggestions(w, "长夜", limit=30)),
        "duplicate_reasons": _q("books")(lambda b: L.duplicate_reasons(b.withColumnRenamed("book_id", "id"), b)),
        "identity_keys": _q("books")(lambda b: b.select("book_id", X.id_key("title").alias("title_key"), X.id_key("author").alias("author_key"), X.isbn_key("isbn").alias("isbn_key"))),
        "new_wishes": _q("wishlist")(records.new_wishes),
        "refreshed_keys": _q("wishlist")(records.refreshed_keys),
        "merged_wishes": _q("wishlist")(lambda w: records.merged_wishes(w).select("id", "title", "updated_at")),
        "stale_books": _q("books")(lambda b: records.stale(b).select("book_id", "status")),
        "regenerate_rule": _q("books")(lambda b: records.to_regenerate(b, "rule", "loose").select("book_id")),
        "regenerate_theme": _q("books")(lambda b: records.to_regenerate(b, "theme", "default").select("book_id")),
        "book_headers": _q("documents")(_headers),
        "greedy_links": bw(L.greedy_links),
        "jobs_latest": _q("jobs")(lambda j: L.job_rows(j).select("id", "book_id", "status", "updated_at")),
        "jobs_view": _q("jobs", "books")(lambda j, b: L.job_view(L.job_rows(j), b)),
        "jobs_page": _q("jobs", "books")(lambda j, b: L.job_page(L.job_rows(j), b, "failed", page=2)),
        "jobs_tabs": _q("jobs")(lambda j: L.job_tabs(L.job_rows(j))),
        "jobs_invalid": _q("jobs", "books")(lambda j, b: L.invalid_jobs(L.job_rows(j), b)),
        "jobs_delete_invalid": _q("jobs", "books")(lambda j, b: tables.delete(L.job_rows(j), L.invalid_jobs(L.job_rows(j), b), "id").select("id", "book_id")),
        "archive_failed": _q("books")(lambda b: tables.change(b, b.where("status = 'failed'"), "book_id", archived=F.lit(True)).select("book_id", "archived")),
        "progress_latest": _q("reader_progress")(L.latest_progress),
        "progress_upsert": _q("reader_progress")(_upsert),
        "rule_usage": _q("books")(lambda b: L.template_usage(b, "rule_template")),
        "theme_usage": _q("books")(lambda b: L.template_usage(b, "theme_template")),
        "rule_used": _q("books")(lambda b: L.with_templates(b, b.sparkSession.createDataFrame([("default",), ("loose",)], "id string"), "rule_template", "default").select("book_id", "rule_template_used")),
        "archive_names": _q("books")(L.archive_names),
        "decoded_texts": _q("documents")(_decoded),
        "volumes_by_rule": _q("documents")(_volumes_by_rule),
        "changed_keys": _q("wishlist")(_changed_keys),
        "epub_round_trip": _q("books", "sections")(_round_trip),
        "metadata_patch": _q("books", "sections")(_patched),
        "tags_split": _q("books")(_tags),
        "clean_fields": _q("books")(_clean),
        "names_of_files": _q("books")(_names),
        "merge_fields": _q("books", "wishlist")(lambda b, w: L.merged(b.select("book_id", "title", "author"), _latest_links(w).select(F.col("library_book_id").alias("book_id"), "title", "author"), "book_id", ("title", "author"))),
        "metadata_score": _q("books", "wishlist")(_scores),
        "lookup_rank": _q("books", "wishlist")(_rank),
        "doc_lines": _q("documents")(lambda d: N.lines_of(d, "doc_id", "text").withColumn("content", X.content_line("line"))),
        "doc_lines_in_memory": _q("documents")(lambda d: N.lines_of(d, "doc_id", "text", in_memory=True)),
        "has_content": _q("documents")(lambda d: d.select("doc_id", N.has_content("text").alias("has_content"))),
        "headings": _q("documents")(lambda d: _headings(d).where("kind is not null").select("doc_id", "line_no", "line", "kind")),
        "sections": _q("documents")(_sections),
        "section_counts": _q("documents")(lambda d: N.section_counts(_sections(d), "doc_id")),
        "volumes": _q("documents")(lambda d: N.volumes(N.lines_of(d, "doc_id", "text"), "doc_id")),
        "section_names": _q("sections")(N.numbered),
        "book_counts": _q("sections")(lambda s: N.section_counts(s, "book_id", 10)),
        "tree_round_trip": _q("sections")(lambda s: N.from_tree(N.book_tree(s))),
        "search_hits": _q("sections")(lambda s: search.hits(search.section_text(s), SEARCHED, limit=10, offset=1)),
        "search_summary": _q("sections")(lambda s: search.summary(search.section_text(s), SEARCHED, limit=2)),
    }
    return out


def _latest_links(w: DataFrame) -> DataFrame:
    """One tracker row a book: the link is unique only after the dedupe."""
    rows = w.where("library_book_id is not null").select("library_book_id", "id", "title", "author", "rating", "read_status", "updated_at", "created_at")
    return tables.keep_latest(rows, ["library_book_id"], ["updated_at", "created_at", "id"])


# --- SQL

_WS = X.SPACE
_KEY = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '{X.IDENTITY_DROPS}', '', 'g')"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_EFFECTIVE = "coalesce(nullif(b.updated_at, ''), b.created_at)"
_LINK = f"CASE WHEN regexp_matches(lower({_STRIP('w.library_book_id')}), '^[a-f0-9]{{32}}$') THEN lower({_STRIP('w.library_book_id')}) END"
_LATEST_LINK = "lw AS (SELECT * FROM wishlist WHERE library_book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY library_book_id ORDER BY updated_at DESC, created_at DESC, id DESC) = 1)"
_JOBS = "j AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, status DESC NULLS LAST, stage DESC NULLS LAST, message DESC NULLS LAST) = 1)"
_STATUS = "CASE WHEN b.status = 'failed' THEN 'failed' WHEN b.status = 'dirty' THEN 'pending' WHEN coalesce(b.epub_updated_at, '') <> '' AND coalesce(b.updated_at, '') <> '' AND b.epub_updated_at >= b.updated_at THEN 'ok' ELSE 'pending' END"
_THEME = f"CASE WHEN b.source_type = 'epub' AND {_STRIP('b.theme_template')} = '__book__' THEN NULL WHEN coalesce({_STRIP('b.theme_template')}, '') <> '' THEN {_STRIP('b.theme_template')} ELSE 'default' END"
_READ = f"CASE WHEN lower({_STRIP('w.read_status')}) IN ('unread', 'reading', 'read') THEN lower({_STRIP('w.read_status')}) WHEN coalesce(w.read, false) THEN 'read' ELSE 'unread' END"
_MATCH = f"""
idx AS (SELECT b.book_id, {_KEY('b.title')} AS tk, {_KEY('b.author')} AS ak, {_EFFECTIVE} AS at_ FROM books b WHERE NOT b.archived),
bt AS (SELECT tk, book_id FROM idx WHERE tk <> '' QUALIFY row_number() OVER (PARTITION BY tk ORDER BY at_ DESC, book_id) = 1),
bta AS (SELECT tk, ak, book_id FROM idx WHERE tk <> '' AND ak <> '' QUALIFY row_number() OVER (PARTITION BY tk, ak ORDER BY at_ DESC, book_id) = 1),
ww AS (SELECT w.*, {_LINK} AS link, {_KEY('w.title')} AS tk, {_KEY('w.author')} AS ak, {_READ} AS shown_read FROM wishlist w),
m AS (SELECT ww.*, coalesce(idx.book_id, CASE WHEN bt.book_id IS NULL THEN NULL WHEN ww.ak = '' THEN bt.book_id ELSE bta.book_id END) AS match_id
      FROM ww LEFT JOIN idx ON idx.book_id = ww.link LEFT JOIN bt ON bt.tk = ww.tk LEFT JOIN bta ON bta.tk = ww.tk AND bta.ak = ww.ak)"""
_BOOKSTATUS = f"CASE WHEN lower({_STRIP('m.book_status')}) IN ('hiatus', 'completed') THEN lower({_STRIP('m.book_status')}) ELSE 'ongoing' END"
_TAGTEXT = f"coalesce(array_to_string(list_filter(list_transform(m.tags, lambda t: {_STRIP('t')}), lambda t: t <> ''), ', '), '')"
_LINES = r"""
t AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM t),
ln AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM c)"""
_SPECIAL = " OR ".join(f"s = '{w}' OR starts_with(s, '{w} ') OR starts_with(s, '{w}：') OR starts_with(s, '{w}:')" for w in SPECIAL)
_N = f"{_WS}*[0-9一二三四五六七八九十百千万两零〇]+{_WS}*"
_HEADINGS = f"""{_LINES},
x AS (SELECT *, {_STRIP('line')} AS s, lag(line) OVER w AS prev, lead(line) OVER w AS nxt FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
y AS (SELECT *, (prev IS NULL OR {_STRIP('prev')} = '' OR nxt IS NULL OR {_STRIP('nxt')} = '') AS alone FROM x),
h AS (SELECT doc_id, line_no, line, s, CASE WHEN s = '' OR NOT (alone OR (NOT regexp_matches(s, '[。！？]$') AND length(s) <= 40 AND length(s) - length(regexp_replace(s, '[，,]', '', 'g')) <= 1)) THEN NULL
  WHEN regexp_matches(s, '^第{_N}[章节回]') OR regexp_matches(s, '(?i)^Chapter{_WS}+[0-9]+') OR {_SPECIAL} THEN 'chapter'
  WHEN regexp_matches(s, '^第{_N}[卷部]') OR regexp_matches(s, '^卷{_N}') THEN 'volume' END AS kind FROM y)"""
_CONTENT = lambda c: f"replace({_STRIP(c)}, '　', '')"
_SECTIONS = f"""{_HEADINGS},
g AS (SELECT *, count(kind) OVER o AS part, last_value(CASE WHEN kind = 'volume' THEN s END IGNORE NULLS) OVER o AS volume, {_CONTENT('line')} AS content FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, part, max(kind) AS k, max(CASE WHEN kind IS NOT NULL THEN s END) AS title, arg_min(volume, line_no) AS volume, coalesce(list(content ORDER BY line_no) FILTER (WHERE kind IS NULL AND content <> ''), []) AS lines FROM g GROUP BY doc_id, part),
sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_idx, coalesce(k, 'chapter') AS kind, CASE WHEN coalesce(k, 'chapter') = 'chapter' THEN volume END AS volume_title, coalesce(title, '正文') AS title, lines FROM p WHERE len(lines) > 0 OR k = 'chapter')"""
_TEXT = f"st AS (SELECT book_id, section_idx, title, {_STRIP('text')} AS text FROM (SELECT book_id, section_idx, title, regexp_replace(array_to_string(lines, ' '), '{_WS}+', ' ', 'g') AS text FROM sections) WHERE {_STRIP('text')} <> '')"


_TOLD = lambda c: f"CASE WHEN {_KEY(c)} <> '' THEN {c} END"
_TRIM = lambda c: rf"regexp_replace({c}, '^[ \t\r\n\-_.，。;；:：]+|[ \t\r\n\-_.，。;；:：]+$', '', 'g')"
_PLAIN = lambda c: f"nullif(trim(regexp_replace(regexp_replace({_UNESCAPED(c)}, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')), '')"


def _UNESCAPED(c: str) -> str:
    """The entities that these tables hold; the ampersand's last."""
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{text}')"
    return c


def oracle_sql() -> dict[str, str]:
    page = f"SELECT b.book_id, b.title, b.author, w.read_status AS tracker_status, w.rating AS tracker_rating, b.created_at, b.updated_at FROM books b LEFT JOIN wishlist w ON w.library_book_id = b.book_id WHERE NOT b.archived"
    like = lambda q: f"(lower(b.title) LIKE '%{q}%' OR lower(coalesce(b.author, '')) LIKE '%{q}%')"
    unread = "coalesce(w.read_status, 'unread') <> 'read'"
    books = ", ".join(BOOK_COLUMNS)
    return {
        "library_page": f"{page} AND {unread} ORDER BY {_EFFECTIVE} DESC NULLS LAST, b.book_id LIMIT 24 OFFSET 24",
        "library_page_within": f"WITH z AS ({page} AND {unread}) SELECT * EXCLUDE (rn, n) FROM (SELECT z.*, row_number() OVER (ORDER BY coalesce(nullif(updated_at, ''), created_at) DESC NULLS LAST, book_id) AS rn, count(*) OVER () AS n FROM z) WHERE rn > ((n - 1) // 24) * 24",
        "epub_round_trip": "SELECT s.book_id, (row_number() OVER (PARTITION BY s.book_id ORDER BY section_idx) - 1)::INTEGER AS section_idx, s.title FROM sections s JOIN books b USING (book_id) WHERE len(lines) > 0 OR kind = 'chapter'",
        "library_page_created": f"{page} ORDER BY b.created_at DESC NULLS LAST, b.book_id LIMIT 48",
        "library_search": f"{page} AND {like('的')} ORDER BY {_EFFECTIVE} DESC NULLS LAST, b.book_id LIMIT 96",
        "library_count": f"SELECT count(*) AS total FROM books b LEFT JOIN wishlist w ON w.library_book_id = b.book_id WHERE NOT b.archived AND {like('之')} AND {unread}",
        "archived_books": f"SELECT {books} FROM books WHERE archived",
        "all_books": f"SELECT {books} FROM books WHERE NOT archived UNION ALL SELECT {books} FROM books WHERE archived",
        "conformed_books": "SELECT book_id, coalesce(language, 'zh-CN') AS language, coalesce(tags, []) AS tags, NULL::VARCHAR AS custom_css, coalesce(status, 'synced') AS status FROM books",
        "conformed_wishes": f"SELECT w.id, {_READ} AS read_status, coalesce(nullif(w.book_status, ''), 'ongoing') AS book_status, {_LINK} AS link FROM wishlist w",
        "book_view": f"WITH {_LATEST_LINK} SELECT b.book_id, b.title, b.author, CASE WHEN w.id IS NOT NULL THEN w.read_status = 'read' ELSE coalesce(b.read, false) END AS is_read, CASE WHEN w.id IS NOT NULL THEN w.rating ELSE b.rating END AS shown_rating, {_STATUS} AS state, {_THEME} AS theme, coalesce(b.cover_file, '') <> '' AS has_cover FROM books b LEFT JOIN lw w ON w.library_book_id = b.book_id",
        "status_view": f"SELECT b.book_id, {_STATUS} AS state FROM books b",
        "effective_theme": f"SELECT b.book_id, {_THEME} AS theme FROM books b",
        "tracker_sync": f"WITH {_LATEST_LINK} SELECT b.book_id, w.read_status = 'read' AS new_read, w.rating AS new_rating, b.read IS DISTINCT FROM (w.read_status = 'read') AS stamp_read_time FROM books b JOIN lw w ON w.library_book_id = b.book_id WHERE b.read IS DISTINCT FROM (w.read_status = 'read') OR b.rating IS DISTINCT FROM w.rating",
        "seed_missing_tracker": "SELECT md5(b.book_id) AS id, b.title, b.book_id AS library_book_id, b.author, '' AS identity_title, '' AS identity_author, b.rating, coalesce(b.read, false) AS read, CASE WHEN b.read THEN 'read' ELSE 'unread' END AS read_status, 'ongoing' AS book_status, coalesce(nullif(b.created_at, ''), nullif(b.updated_at, ''), '') AS created_at, coalesce(nullif(b.updated_at, ''), nullif(b.created_at, ''), '') AS updated_at FROM books b WHERE NOT EXISTS (SELECT 1 FROM wishlist w WHERE w.library_book_id = b.book_id)",
        "tracker_match": f"WITH {_MATCH} SELECT id, match_id FROM m",
        "tracker_stats": f"WITH {_MATCH} SELECT count(*) AS total, count_if(shown_read = 'read')::BIGINT AS read, count_if(shown_read = 'reading')::BIGINT AS reading, count_if(shown_read NOT IN ('read', 'reading'))::BIGINT AS unread, count(match_id) AS in_library, count(*) - count(match_id) AS out_of_library FROM m",
        "tracker_filtered": f"WITH {_MATCH} SELECT m.id, m.title, m.author, m.rating, m.shown_read AS read_status, CASE m.shown_read WHEN 'read' THEN '已读' WHEN 'reading' THEN '在读' ELSE '未读' END AS read_label, {_BOOKSTATUS} AS book_status, CASE {_BOOKSTATUS} WHEN 'hiatus' THEN '已断更' WHEN 'completed' THEN '已完结' ELSE '更新中' END AS book_label, {_TAGTEXT} AS tag_text, m.comment, m.match_id, m.match_id IS NOT NULL AS in_library FROM m WHERE (contains(lower(m.title), '的') OR contains(lower(coalesce(m.author, '')), '的') OR contains(lower(coalesce(array_to_string(m.tags, ' '), '')), '的')) AND m.shown_read = 'reading' AND {_BOOKSTATUS} = 'ongoing'",
        "tracker_page": "SELECT id, title, updated_at FROM wishlist ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 20 OFFSET 20",
        "export_rows": f"WITH {_MATCH} SELECT id, coalesce(title, '') AS title, coalesce(author, '') AS author, coalesce(rating::VARCHAR, '') AS rating, coalesce(comment, '') AS comment FROM m WHERE shown_read = 'read'",
        "dedupe_linked": "SELECT library_book_id, id, updated_at, created_at FROM wishlist WHERE library_book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY library_book_id ORDER BY updated_at DESC, created_at DESC, id DESC) = 1",
        "dedupe_manual": f"WITH k AS (SELECT w.*, {_KEY('w.title')} AS k_title, {_KEY('w.author')} AS k_author FROM wishlist w WHERE library_book_id IS NULL) SELECT k_title, k_author, id, updated_at, created_at FROM k WHERE k_title <> '' QUALIFY row_number() OVER (PARTITION BY k_title, k_author ORDER BY updated_at DESC, created_at DESC, id DESC) = 1",
        "duplicate_check": f"SELECT id, title, coalesce(author, '') AS author, {_LINK} IS NOT NULL AS in_library, {_KEY('w.author')} = '{WISHER}' AS exact_author, {_KEY('w.author')} = '{WISHER}' AS blocking FROM wishlist w WHERE {_KEY('w.title')} = '{WISHED}' ORDER BY blocking DESC, in_library DESC, title, author, id LIMIT 20",
        "title_suggestions": f"SELECT id, title, coalesce(author, '') AS author, {_LINK} IS NOT NULL AS in_library, false AS exact_author FROM wishlist w WHERE contains(lower({_STRIP('w.title')}), '长夜') ORDER BY in_library DESC, title, author, id LIMIT 30",
        "duplicate_reasons": f"""
WITH k AS (SELECT b.book_id, b.archived, upper(regexp_replace(coalesce(b.isbn, ''), '[^0-9Xx]+', '', 'g')) AS i, {_KEY('b.title')} AS t, {_KEY('b.author')} AS a, {_EFFECTIVE} AS at_ FROM books b),
h AS (SELECT x.book_id AS id, y.book_id, y.at_, 1 AS rank, 'ISBN' AS reason FROM k x JOIN k y ON x.i = y.i AND x.i <> '' AND NOT y.archived AND x.book_id <> y.book_id
      UNION ALL SELECT x.book_id, y.book_id, y.at_, CASE WHEN x.a <> '' AND y.a <> '' THEN 2 ELSE 3 END, CASE WHEN x.a <> '' AND y.a <> '' THEN '标题+作者' ELSE '标题' END
      FROM k x JOIN k y ON x.t = y.t AND x.t <> '' AND NOT y.archived AND x.book_id <> y.book_id WHERE x.a = '' OR y.a = '' OR x.a = y.a),
o AS (SELECT id, book_id, at_, arg_min(reason, rank) AS reason FROM h GROUP BY ALL)
SELECT id, book_id, reason, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_ DESC, book_id) AS pos FROM o) WHERE pos <= 3""",
        "identity_keys": f"SELECT b.book_id, {_KEY('b.title')} AS title_key, {_KEY('b.author')} AS author_key, upper(regexp_replace(coalesce(b.isbn, ''), '[^0-9Xx]+', '', 'g')) AS isbn_key FROM books b",
        "new_wishes": f"WITH w AS (SELECT *, {_READ} AS shown FROM wishlist w) SELECT w.id, coalesce({_STRIP('w.title')}, '') AS title, {_LINK} AS library_book_id, nullif({_STRIP('w.author')}, '') AS author, {_KEY(_STRIP('w.title'))} AS identity_title, {_KEY(_STRIP('w.author'))} AS identity_author, CASE WHEN rating IS NOT NULL THEN greatest(0, least(5, rating)) END AS rating, shown = 'read' AS read, shown AS read_status, CASE WHEN lower({_STRIP('w.book_status')}) IN ('hiatus', 'completed') THEN lower({_STRIP('w.book_status')}) ELSE 'ongoing' END AS book_status, nullif({_STRIP('w.comment')}, '') AS comment FROM w",
        "refreshed_keys": f"SELECT id, {_KEY('title')} AS identity_title, {_KEY('author')} AS identity_author FROM wishlist WHERE coalesce(identity_title, '') <> {_KEY('title')} OR coalesce(identity_author, '') <> {_KEY('author')}",
        "merged_wishes": f"WITH w2 AS (SELECT w.*, {_LINK} AS link, {_KEY('w.title')} AS tk, {_KEY('w.author')} AS ak FROM wishlist w) SELECT id, title, updated_at FROM w2 WHERE link IS NOT NULL OR tk = '' UNION ALL SELECT id, title, updated_at FROM (SELECT * FROM w2 WHERE link IS NULL AND tk <> '' QUALIFY row_number() OVER (PARTITION BY tk, ak ORDER BY updated_at DESC, created_at DESC, id DESC) = 1)",
        "stale_books": "SELECT book_id, status FROM books WHERE status <> 'failed' AND (coalesce(epub_updated_at, '') = '' OR epub_updated_at < updated_at)",
        "regenerate_rule": "SELECT book_id FROM books WHERE NOT archived AND source_type <> 'epub' AND coalesce(nullif(rule_template, ''), 'default') = 'loose'",
        "regenerate_theme": f"SELECT b.book_id FROM books b WHERE NOT b.archived AND {_THEME} IS NOT DISTINCT FROM 'default'",
        "jobs_latest": f"WITH {_JOBS} SELECT id, book_id, status, updated_at FROM j",
        "jobs_view": f"WITH {_JOBS} SELECT j.id, j.book_id, coalesce(nullif(b.title, ''), '未关联书籍') AS book_title, coalesce(nullif(b.author, ''), '未知') AS book_author, b.book_id IS NOT NULL AND NOT coalesce(b.archived, false) AS can_open, CASE {_STRIP('j.action')} WHEN 'upload' THEN '上传并转换' WHEN 'upload-epub' THEN 'EPUB 入库' WHEN 'edit-writeback' THEN '编辑并写回' WHEN 'regenerate' THEN '重新生成' WHEN 'retry' THEN '重试生成' WHEN 'ingest' THEN '入库检查' ELSE coalesce(nullif(j.action, ''), '任务') END AS action_label, j.status, j.stage, j.created_at, j.updated_at FROM j LEFT JOIN books b ON b.book_id = j.book_id",
        "jobs_page": f"WITH {_JOBS} SELECT j.id, j.book_id, coalesce(nullif(b.title, ''), '未关联书籍') AS book_title, coalesce(nullif(b.author, ''), '未知') AS book_author, b.book_id IS NOT NULL AND NOT coalesce(b.archived, false) AS can_open, CASE {_STRIP('j.action')} WHEN 'upload' THEN '上传并转换' WHEN 'upload-epub' THEN 'EPUB 入库' WHEN 'edit-writeback' THEN '编辑并写回' WHEN 'regenerate' THEN '重新生成' WHEN 'retry' THEN '重试生成' WHEN 'ingest' THEN '入库检查' ELSE coalesce(nullif(j.action, ''), '任务') END AS action_label, j.status, j.stage, j.created_at, j.updated_at FROM j LEFT JOIN books b ON b.book_id = j.book_id WHERE j.status = 'failed' ORDER BY j.created_at DESC NULLS LAST, j.id LIMIT 12 OFFSET 12",
        "jobs_tabs": f"WITH {_JOBS} SELECT count_if(status = 'running')::BIGINT AS running, count_if(status = 'success')::BIGINT AS success, count_if(status = 'failed')::BIGINT AS failed FROM j",
        "jobs_invalid": f"WITH {_JOBS} SELECT id, book_id, status FROM j WHERE coalesce({_STRIP('j.book_id')}, '') NOT IN (SELECT book_id FROM books WHERE book_id <> '')",
        "jobs_delete_invalid": f"WITH {_JOBS} SELECT id, book_id FROM j WHERE coalesce({_STRIP('j.book_id')}, '') IN (SELECT book_id FROM books WHERE book_id <> '')",
        "archive_failed": "SELECT book_id, CASE WHEN status = 'failed' THEN true ELSE archived END AS archived FROM books",
        "progress_latest": _progress("reader_progress"),
        "progress_upsert": f"WITH o AS ({_progress('''(SELECT * FROM reader_progress WHERE updated_at < '2022-01-01')''')}), n AS ({_progress('''(SELECT * FROM reader_progress WHERE updated_at >= '2022-01-01')''')}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE book_id NOT IN (SELECT book_id FROM n)",
        "rule_usage": "SELECT rule_template AS template, count(*) AS books FROM books WHERE coalesce(rule_template, '') <> '' GROUP BY 1",
        "theme_usage": "SELECT theme_template AS template, count(*) AS books FROM books WHERE coalesce(theme_template, '') <> '' GROUP BY 1",
        "rule_used": "SELECT book_id, CASE WHEN rule_template IN ('default', 'loose') THEN rule_template ELSE 'default' END AS rule_template_used FROM books",
        "tags_split": f"WITH s AS (SELECT book_id, list_filter(list_transform(string_split_regex(array_to_string(coalesce(tags, []), '，') || ', ' || coalesce(language, ''), '[，,]'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS l FROM books) SELECT book_id, coalesce(array_to_string(l, '|'), '') AS tags, len(l) AS n FROM s",
        "merge_fields": f"WITH {_LATEST_LINK} SELECT b.book_id, coalesce(nullif(w.title, ''), b.title) AS title, coalesce(nullif(w.author, ''), b.author) AS author, list_filter([CASE WHEN nullif(w.title, '') IS NOT NULL AND w.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN nullif(w.author, '') IS NOT NULL AND w.author IS DISTINCT FROM b.author THEN 'author' END], lambda x: x IS NOT NULL) AS changed FROM books b LEFT JOIN lw w ON w.library_book_id = b.book_id",
        "doc_lines": f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, line, {_CONTENT('line')} AS content FROM ln",
        "doc_lines_in_memory": r"WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM t) SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS line_no, regexp_replace(unnest(p), '[\r\n]+$', '') AS line FROM c",
        "has_content": f"SELECT doc_id, coalesce({_STRIP('text')} <> '', false) AS has_content FROM documents",
        "headings": f"WITH {_HEADINGS} SELECT doc_id, line_no::INTEGER AS line_no, line, kind FROM h WHERE kind IS NOT NULL",
        "sections": f"WITH {_SECTIONS} SELECT doc_id, section_idx::INTEGER AS section_idx, kind, volume_title, title, lines FROM sec",
        "section_counts": f"WITH {_SECTIONS} SELECT doc_id, count_if(kind = 'volume')::BIGINT AS volumes, count_if(kind = 'chapter')::BIGINT AS chapters, sum(len(lines))::BIGINT AS n_lines, (list(title ORDER BY section_idx))[:10] AS first_titles FROM sec GROUP BY doc_id",
        "decoded_texts": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'utf-8-sig' END AS encoding, text FROM documents",
        "volumes_by_rule": f"WITH {_HEADINGS}, v AS (SELECT doc_id, line_no, s FROM y WHERE s <> '' AND (alone OR (NOT regexp_matches(s, '[。！？]$') AND length(s) <= 40 AND length(s) - length(regexp_replace(s, '[，,]', '', 'g')) <= 1)) AND (regexp_matches(s, '^第{_N}[章节回]') OR regexp_matches(s, '(?i)^Chapter{_WS}+[0-9]+'))) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS volume_idx, s AS title FROM v",
        "changed_keys": f"SELECT id, {_KEY('t')} AS identity_title, {_KEY('author')} AS identity_author FROM (SELECT *, concat_ws(' ', title, author) AS t FROM wishlist) WHERE coalesce(identity_title, '') <> {_KEY('t')} OR coalesce(identity_author, '') <> {_KEY('author')}",
        "clean_fields": f"SELECT book_id, coalesce(nullif(regexp_extract({_PLAIN('published')}, '[0-9]{{4}}(-[0-9]{{1,2}}(-[0-9]{{1,2}})?)?', 0), ''), {_PLAIN('published')}) AS published, coalesce(nullif(upper(regexp_extract({_PLAIN('isbn')}, '[0-9Xx-]{{10,20}}', 0)), ''), {_PLAIN('isbn')}) AS isbn, upper(regexp_replace(coalesce(isbn, ''), '[^0-9Xx]+', '', 'g')) AS isbn_key, {_PLAIN('description')} AS description FROM books",
        "names_of_files": f"WITH r AS (SELECT book_id, {_STRIP("concat('《', title, '》作者：', coalesce(author, ''), '（完）.txt')")} AS raw FROM books), p AS (SELECT book_id, {_STRIP(f"regexp_extract(raw, '《{_WS}*([^》]+?){_WS}*》', 1)")} AS wrapped, {_TRIM(rf"regexp_extract(raw, '作{_WS}*者{_WS}*[:：]{_WS}*([^(\[（【<《》]+)', 1)")} AS author, {_TRIM(rf"regexp_replace(regexp_replace(raw, '作{_WS}*者{_WS}*[:：][\s\S]*$', ''), '[(\[（【][\s\S]*$', '')")} AS head FROM r) SELECT book_id, coalesce({_TOLD('wrapped')}, {_TOLD('head')}) AS title, {_TOLD('author')} AS author FROM p",
        "volumes": f"WITH {_HEADINGS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS volume_idx, s AS title FROM h WHERE kind = 'volume'",
        "section_names": f"""
WITH s AS (SELECT book_id, section_idx, title, kind, row_number() OVER w AS n, lag(section_idx) OVER w AS prev_idx, lead(section_idx) OVER w AS next_idx,
  nullif(CASE WHEN kind = 'chapter' THEN regexp_extract(title, '^{_WS}*(第[0-9零〇一二两三四五六七八九十百千万亿]+章){_WS}*[:：、.\\-·]?{_WS}*(.+?){_WS}*$', 1) END, '') AS stamp FROM sections WINDOW w AS (PARTITION BY book_id ORDER BY section_idx))
SELECT book_id, section_idx, title, format('section_{{:04d}}.xhtml', n) AS file_name, stamp, CASE WHEN stamp IS NOT NULL THEN regexp_extract(title, '^{_WS}*(第[0-9零〇一二两三四五六七八九十百千万亿]+章){_WS}*[:：、.\\-·]?{_WS}*(.+?){_WS}*$', 2) ELSE title END AS main_title, prev_idx, next_idx FROM s""",
        "book_counts": "SELECT book_id, count_if(kind = 'volume')::BIGINT AS volumes, count_if(kind = 'chapter')::BIGINT AS chapters, sum(coalesce(len(lines), 0))::BIGINT AS n_lines, (list(title ORDER BY section_idx))[:10] AS first_titles FROM sections GROUP BY book_id",
        "tree_round_trip": "SELECT book_id, section_idx, kind, volume_title, title, lines FROM sections",
        "search_hits": f"""
WITH {_TEXT}, f AS (SELECT *, strpos(lower(text), '{SEARCHED}') - 1 AS at_ FROM st WHERE contains(lower(text), '{SEARCHED}')),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_idx) AS n, greatest(0, at_ - 30) AS b, least(length(text), at_ + {len(SEARCHED)} + 70) AS e FROM f)
SELECT book_id, section_idx, title, at_::INTEGER AS "offset", CASE WHEN b > 0 THEN '...' ELSE '' END || text[b + 1 : e] || CASE WHEN e < length(text) THEN '...' ELSE '' END AS snippet FROM n WHERE n > 1 AND n <= 11""",
        "search_summary": f"WITH {_TEXT} SELECT book_id, count(*) AS indexed_sections, count_if(contains(lower(text), '{SEARCHED}'))::BIGINT AS matches, count_if(contains(lower(text), '{SEARCHED}')) > 2 AS has_more, least(2, count_if(contains(lower(text), '{SEARCHED}')))::BIGINT AS next_offset FROM st GROUP BY book_id",
    }


def _progress(source: str) -> str:
    return f"SELECT book_id, CASE WHEN section IS NOT NULL THEN greatest(-1, least(999999, section)) END AS section, CASE WHEN page IS NOT NULL THEN greatest(0, least(999999, page)) END AS page, CASE WHEN page_count IS NOT NULL THEN greatest(0, least(999999, page_count)) END AS page_count, updated_at FROM {source} p QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, section DESC NULLS LAST, page DESC NULLS LAST, page_count DESC NULLS LAST) = 1"
