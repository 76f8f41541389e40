"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, copies, entity, lookalike, mixture, mojibake, names, pii, site_lines
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _matches(s: SparkSession, d: str) -> DataFrame:
    books = table(s, d, "books")
    garbled = mojibake.judged(books, table(s, d, "sections"), lines=False, fields=("title",)).select("book_id", "restored").dropDuplicates(["book_id"])
    return entity.matched(books, table(s, d, "wishlist"), garbled)


def _lookalikes(s: SparkSession, d: str) -> DataFrame:
    books = table(s, d, "books")
    garbled = mojibake.judged(books, table(s, d, "sections"), lines=False, fields=("title",))
    return lookalike.found(books, table(s, d, "wishlist"), garbled)


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: names.pairs(table(s, d, "books"), table(s, d, "wishlist")),
        "p1_entities": lambda s, d: names.entities(table(s, d, "books"), table(s, d, "wishlist")),
        "p2_found": lambda s, d: site_lines.occurrences(table(s, d, "sections")),
        "p2_clean": lambda s, d: site_lines.cleaned(table(s, d, "sections")),
        "p3_found": lambda s, d: copies.pairs(table(s, d, "books")),
        "p3_records": lambda s, d: copies.records(table(s, d, "books")),
        "p4_found": lambda s, d: _matches(s, d).select("wish_id", "book_id"),
        "p4_matches": _matches,
        "p5_found": lambda s, d: copies.found_survivors(table(s, d, "books")),
        "p5_survivors": lambda s, d: copies.survivors(table(s, d, "books")),
        "p6_found": _lookalikes,
        "p6_consistent": lambda s, d: lookalike.normalized(table(s, d, "books"), table(s, d, "wishlist")),
        "p7_found": lambda s, d: mojibake.found(table(s, d, "books"), table(s, d, "sections")),
        "p7_repaired": lambda s, d: mojibake.repaired(table(s, d, "books"), table(s, d, "sections")),
        "p8_ids": lambda s, d: bpe.encoded(table(s, d, "documents")),
        "p8_round_trip": lambda s, d: bpe.round_trip(table(s, d, "documents")),
        "p9_mix": lambda s, d: mixture.mixed(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: pii.found(table(s, d, "documents")),
        "p10_redacted": lambda s, d: pii.redacted(table(s, d, "documents")),
        "p5_ranked": lambda s, d: copies.ranked(table(s, d, "books")),
    }


#: Letters of any case as one: the regular expressions speak of the same general categories as the operators.
_T = r"regexp_replace(lower(upper(coalesce(title, ''))), '[^\p{L}\p{Nd}]', '', 'g')"
_A = r"regexp_replace(lower(upper(coalesce(author, ''))), '[^\p{L}\p{Nd}]', '', 'g')"
_GROUPS = f"k AS (SELECT book_id, least({_T}, {_A}) x, greatest({_T}, {_A}) y FROM books)"


#: The same words and forms as copies.STAND_INS, usable_text, usable_cover and usable_isbn.
_BARE = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '[\s\x{{a0}}\x{{3000}}\p{{Cf}}]+', '', 'g')"
_WORDS = ", ".join(f"'{w}'" for w in copies.STAND_INS)
_TEXT = lambda c: f"({_BARE(c)} NOT IN ({_WORDS}) AND regexp_matches({_BARE(c)}, '[\\p{{L}}\\p{{N}}]'))"
_STEM = r"regexp_replace(" + _BARE("cover_file") + r", '\.(jpe?g|png|gif|webp|bmp|svg)$', '')"
_COVER = f"({_TEXT('cover_file')} AND {_STEM} NOT IN ({_WORDS}) AND NOT regexp_matches({_BARE('cover_file')}, 'placeholder|default|no[-_ ]?cover|no[-_ ]?image|missing|blank|dummy|unknown'))"
_DIGITS = r"regexp_replace(upper(coalesce(isbn, '')), '^\s*ISBN(-1[03])?[:：]?|[\s\x{a0}\x{3000}\-‐‑–—]+', '', 'g')"
_NTH = f"CASE WHEN substr({_DIGITS}, i, 1) = 'X' THEN 10 ELSE try_cast(substr({_DIGITS}, i, 1) AS INT) END"
_ISBN = f"""(CASE WHEN length(replace({_DIGITS}, left({_DIGITS}, 1), '')) = 0 THEN false
 WHEN regexp_full_match({_DIGITS}, '[0-9]{{9}}[0-9X]') THEN list_sum(list_transform(range(1, 11), lambda i: (11 - i) * ({_NTH}))) % 11 = 0
 WHEN regexp_full_match({_DIGITS}, '[0-9]{{13}}') THEN list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END * ({_NTH}))) % 10 = 0 ELSE false END)"""


_SITE_LINES = r"""l AS (SELECT book_id, section_idx, site, unnest(lines) line, generate_subscripts(lines, 1) - 1 AS line_no FROM sections),
k AS (SELECT book_id, section_idx, site, line_no::INTEGER line_no, regexp_replace(lower(upper(line)), '[^\p{L}\p{M}]', '', 'g') AS key FROM l),
n AS (SELECT site, count(*) AS site_rows FROM sections GROUP BY site),
r AS (SELECT k.site, key FROM k JOIN n ON k.site IS NOT DISTINCT FROM n.site WHERE key <> '' GROUP BY k.site, key, site_rows
      HAVING count(DISTINCT (book_id, section_idx)) >= greatest(5, 0.05 * site_rows) AND count(DISTINCT book_id) >= 3)"""
_AT = "try_cast(nullif(trim(updated_at), '') AS TIMESTAMPTZ)"
_COPIES = f"""{_GROUPS}, g AS (SELECT x, y, min(book_id) AS group_book_id, count(*) AS copies FROM k GROUP BY x, y HAVING count(*) > 1),
m AS (SELECT g.group_book_id, g.copies, b.* FROM g JOIN k USING (x, y) JOIN books b USING (book_id)),
f AS (SELECT group_book_id, copies, book_id, updated_at, unnest(['isbn', 'publisher', 'cover_file']) AS field, unnest([isbn, publisher, cover_file]) AS value, unnest([{_ISBN}, {_TEXT('publisher')}, {_COVER}]) AS ok, {_ISBN}::INT + {_TEXT('publisher')}::INT + {_COVER}::INT AS used FROM m)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_clean": f"""
WITH {_SITE_LINES}, g AS (SELECT book_id, section_idx, list(DISTINCT line_no) AS gone FROM k JOIN r ON k.site IS NOT DISTINCT FROM r.site AND k.key = r.key GROUP BY ALL)
SELECT s.book_id, s.section_idx, s.site, CASE WHEN g.gone IS NULL THEN s.lines ELSE list_filter(s.lines, lambda x, i: NOT list_contains(g.gone, (i - 1)::INTEGER)) END AS lines, coalesce(len(g.gone), 0)::INTEGER AS removed
FROM sections s LEFT JOIN g ON s.book_id = g.book_id AND s.section_idx = g.section_idx""",
        "p5_survivors": f"""
WITH {_COPIES}, s AS (SELECT group_book_id, field, value FROM f WHERE ok QUALIFY row_number() OVER (PARTITION BY group_book_id, field ORDER BY {_AT} DESC NULLS LAST, used DESC, book_id) = 1)
SELECT h.group_book_id, h.copies, h.updated_at, max(CASE WHEN field = 'isbn' THEN value END) AS isbn, max(CASE WHEN field = 'publisher' THEN value END) AS publisher, max(CASE WHEN field = 'cover_file' THEN value END) AS cover_file
FROM (SELECT group_book_id, copies, updated_at FROM m QUALIFY row_number() OVER (PARTITION BY group_book_id ORDER BY {_AT} DESC NULLS LAST, updated_at DESC) = 1) h LEFT JOIN s USING (group_book_id) GROUP BY ALL""",
        "p5_ranked": f"""
WITH {_COPIES}, v AS (SELECT *, count(*) OVER (PARTITION BY group_book_id, field, value) AS votes FROM f WHERE ok),
t AS (SELECT book_id, sum(votes)::BIGINT AS trust FROM v GROUP BY book_id)
SELECT group_book_id, book_id, copies, used AS usable_fields, coalesce(trust, 0) AS trust FROM (SELECT DISTINCT group_book_id, book_id, copies, used, updated_at FROM f) LEFT JOIN t USING (book_id)
QUALIFY row_number() OVER (PARTITION BY group_book_id ORDER BY used DESC, coalesce(trust, 0) DESC, {_AT} DESC NULLS LAST, book_id) = 1""",
        "p2_found": r"""
WITH l AS (SELECT book_id, section_idx, site, unnest(lines) line, generate_subscripts(lines, 1) - 1 AS line_no FROM sections),
k AS (SELECT book_id, section_idx, site, line_no::INTEGER line_no, regexp_replace(lower(upper(line)), '[^\p{L}\p{M}]', '', 'g') AS key FROM l),
n AS (SELECT site, count(*) AS site_rows FROM sections GROUP BY site),
r AS (SELECT k.site, key FROM k JOIN n ON k.site IS NOT DISTINCT FROM n.site WHERE key <> '' GROUP BY k.site, key, site_rows
      HAVING count(DISTINCT (book_id, section_idx)) >= greatest(5, 0.05 * site_rows) AND count(DISTINCT book_id) >= 3)
SELECT DISTINCT book_id, section_idx, line_no FROM k JOIN r ON k.site IS NOT DISTINCT FROM r.site AND k.key = r.key""",
        "p3_found": f"WITH {_GROUPS} SELECT a.book_id AS book_a, b.book_id AS book_b FROM k a JOIN k b ON a.x = b.x AND a.y = b.y AND a.book_id < b.book_id",
        "p5_found": f"""
WITH {_GROUPS}, g AS (SELECT x, y, min(book_id) AS group_book_id FROM k GROUP BY x, y HAVING count(*) > 1),
m AS (SELECT g.group_book_id, b.* FROM g JOIN k USING (x, y) JOIN books b USING (book_id)),
f AS (SELECT group_book_id, 'isbn' AS field, book_id, updated_at, {_ISBN} AS ok, {_ISBN}::INT + {_TEXT('publisher')}::INT + {_COVER}::INT AS used FROM m
      UNION ALL SELECT group_book_id, 'publisher', book_id, updated_at, {_TEXT('publisher')}, {_ISBN}::INT + {_TEXT('publisher')}::INT + {_COVER}::INT FROM m
      UNION ALL SELECT group_book_id, 'cover_file', book_id, updated_at, {_COVER}, {_ISBN}::INT + {_TEXT('publisher')}::INT + {_COVER}::INT FROM m)
SELECT group_book_id, field, book_id FROM f WHERE ok
QUALIFY row_number() OVER (PARTITION BY group_book_id, field ORDER BY try_cast(nullif(updated_at, '') AS TIMESTAMPTZ) DESC NULLS LAST, used DESC, book_id) = 1""",
        "p3_records": f"WITH {_GROUPS}, g AS (SELECT min(book_id) AS book_id, count(*) AS copies FROM k GROUP BY x, y) SELECT g.book_id, b.title, b.author, g.copies FROM g JOIN books b USING (book_id)",
    }
