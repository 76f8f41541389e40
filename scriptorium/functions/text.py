"""Scalar functions on text, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the same class works in Java's and in RE2's regular expressions.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one, for trimming without a regular expression.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
IDENTITY_DROPS = r"[^0-9a-zA-Z\x{4e00}-\x{9fff}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def present(c: Column | str) -> Column:
    """NULL where the value is NULL or empty, so that coalesce() falls through."""
    return F.nullif(col(c), F.lit(""))


def stripped_or_null(c: Column | str) -> Column:
    return present(strip(c))


def id_key(c: Column | str) -> Column:
    """Lower case letters of the basic alphabet, digits and common ideographs; '' for NULL."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), IDENTITY_DROPS, "")


def isbn_key(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9Xx]+", ""))


def content_line(c: Column | str) -> Column:
    return F.replace(strip(c), F.lit("　"), F.lit(""))


def unescape(c: Column | str) -> Column:
    """Numeric entities and the named ones of HTML 4, by a function that the engine brings along; &apos; besides."""
    given = F.coalesce(F.replace(col(c), F.lit("&apos;"), F.lit("&#39;")), F.lit("\0"))  # NULL would come back as a word
    read = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), given)
    return F.get(F.filter(F.array(read), lambda x: x != "\0"), F.lit(0))  # said once: nested calls would double it


def one_space(c: Column | str) -> Column:
    plain = F.translate(col(c), SPACES[1:], " " * (len(SPACES) - 1))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def clean_text(c: Column | str) -> Column:
    """Entities read, tags taken out, white space joined; NULL where nothing is left."""
    return present(one_space(F.regexp_replace(unescape(c), "<[^>]+>", " ")))


def clean_date(c: Column | str) -> Column:
    text = clean_text(c)
    return F.coalesce(present(F.regexp_extract(text, r"\d{4}(?:-\d{1,2}(?:-\d{1,2})?)?", 0)), text)


def clean_isbn(c: Column | str) -> Column:
    text = clean_text(c)
    return F.coalesce(present(F.upper(F.regexp_extract(text, r"[0-9Xx-]{10,20}", 0))), text)


def clean_url(c: Column | str) -> Column:
    url = strip(unescape(c))
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(url.rlike("(?i)^https?://"), url)


def html_text(c: Column | str) -> Column:
    """What a reader sees of HTML: scripts, styles and tags out, entities read, white space joined."""
    out = F.regexp_replace(col(c), r"(?is)<script\b[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style>", " ")
    return one_space(unescape(F.regexp_replace(out, r"(?s)<[^>]+>", " ")))


def html_title(c: Column | str) -> Column:
    """The first of title, h1 and h2 with text."""
    parts = [clean_text(F.regexp_extract(col(c), rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) for t in ("title", "h1", "h2")]
    return F.coalesce(*parts)


def distinct_no_case(items: Column) -> Column:
    """An array without repeats that differ in letter case only; the first stays."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: F.lower(y) == F.lower(x)))


def split_tags(c: Column | str, marks: str = "[，,]", distinct: bool = False) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), marks), strip), lambda x: x != "")
    return distinct_no_case(parts) if distinct else parts


def lookup_tags(c: Column | str) -> Column:
    """Tags of a scraped field: more separators, exact repeats go."""
    return F.array_distinct(split_tags(F.coalesce(clean_text(c), F.lit("")), "[，,;/|]"))


def tag_text(tags: Column | str) -> Column:
    return F.array_join(F.filter(F.transform(col(tags), strip), lambda x: x != ""), ", ")


def clamp(c: Column | str, lo: int, hi: int) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(c))))


def rating(c: Column | str) -> Column:
    """A whole number clamped to 0..5; NULL where the text is none."""
    number = F.regexp_extract(strip(c), r"^[+-]?\d{1,9}$", 0)
    return clamp(present(number).cast("int"), 0, 5)


def read_status(status: Column | str, read: Column | str) -> Column:
    s = F.lower(strip(F.coalesce(col(status), F.lit(""))))
    return F.when(s.isin("unread", "reading", "read"), s).when(F.coalesce(col(read), F.lit(False)), "read").otherwise("unread")


def book_status(c: Column | str) -> Column:
    s = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.when(s.isin("hiatus", "completed"), s).otherwise("ongoing")


#: What the tracker and the job list show.
BOOK_STATUS_LABELS = {"ongoing": "更新中", "hiatus": "已断更", "completed": "已完结"}
READ_STATUS_LABELS = {"unread": "未读", "reading": "在读", "read": "已读"}
JOB_LABELS = {"upload": "上传并转换", "upload-epub": "EPUB 入库", "edit-writeback": "编辑并写回", "regenerate": "重新生成", "retry": "重试生成", "ingest": "入库检查"}


def labelled(c: Column, labels: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, c), other)


def book_link(c: Column | str) -> Column:
    """A stored link as a book id: stripped, lower case, 32 hexadecimal digits; else NULL."""
    v = F.lower(strip(c))
    return F.when(v.rlike(r"^[a-f0-9]{32}$"), v)


def safe_filename(c: Column | str, fallback: str = "book") -> Column:
    v = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_"), F.lit(" ._"))
    return F.coalesce(present(v), F.lit(fallback))


#: File endings and their media types.
MEDIA_TYPES = {"xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "css": "text/css", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "ncx": "application/x-dtbncx+xml"}


def media_type(name: Column | str) -> Column:
    return labelled(F.lower(F.regexp_extract(col(name), r"\.([^./]+)$", 1)), MEDIA_TYPES, F.lit("application/octet-stream"))


def displayed_instant(c: Column | str, zone: str = "UTC") -> Column:
    """'YYYY-MM-DD HH:MM'; '-' where empty; what is no instant is shown shortened."""
    v = strip(F.coalesce(col(c), F.lit("")))
    short = F.substring(F.replace(F.replace(v, F.lit("T"), F.lit(" ")), F.lit("+00:00"), F.lit(" UTC")), 1, 16)
    return F.when(v == "", "-").otherwise(F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.try_to_timestamp(v).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm"), short))


_NUMBER = "0-9零〇一二两三四五六七八九十百千万亿"


def chapter_stamp(title: Column | str, kind: Column | str) -> Column:
    """'第N章' of a chapter's title where more text follows; else NULL."""
    pattern = rf"^{SPACE}*(第[{_NUMBER}]+章){SPACE}*[:：、.\-·]?{SPACE}*(.+?){SPACE}*$"
    return F.when(col(kind) == "chapter", present(F.regexp_extract(col(title), pattern, 1)))


def chapter_main(title: Column | str, kind: Column | str) -> Column:
    pattern = rf"^{SPACE}*(第[{_NUMBER}]+章){SPACE}*[:：、.\-·]?{SPACE}*(.+?){SPACE}*$"
    return F.when(chapter_stamp(title, kind).isNotNull(), F.regexp_extract(col(title), pattern, 2)).otherwise(col(title))


def title_from_name(name: Column | str) -> tuple[Column, Column]:
    """Title and author as a file's name tells them: 《title》, '作者：author', else what stands before a mark or bracket."""
    raw = strip(F.coalesce(col(name), F.lit("")))
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r\n\-_.，。;；:：]+|[ \t\r\n\-_.，。;；:：]+$", "")
    told = lambda c: F.when(id_key(c) != "", c)
    wrapped = told(strip(F.regexp_extract(raw, rf"《{SPACE}*([^》]+?){SPACE}*》", 1)))
    author = told(trim(F.regexp_extract(raw, rf"作{SPACE}*者{SPACE}*[:：]{SPACE}*([^(\[（【<《》]+)", 1)))
    head = trim(F.regexp_replace(F.regexp_replace(raw, rf"作{SPACE}*者{SPACE}*[:：][\s\S]*$", ""), r"[(\[（【][\s\S]*$", ""))
    return F.coalesce(wrapped, told(head)), author


# --- match scores


def _match_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(clean_text(c), F.lit("")), IDENTITY_DROPS, ""))


def title_score(title: Column | str, query: Column | str) -> Column:
    """4 equal, 3 one within the other, 2 enough letters in common, else 0."""
    a, b = _match_key(col(title)), _match_key(col(query))
    shared = F.size(F.array_intersect(F.split(a, ""), F.split(b, "")))
    enough = F.greatest(F.lit(2), F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int"))
    return F.when((a == "") | (b == ""), 0).when(a == b, 4).when(a.contains(b) | b.contains(a), 3).when(shared >= enough, 2).otherwise(0)


def author_score(author: Column | str, expected: Column | str) -> Column:
    """0 nothing expected, -1 no author; of the authors named the best: 8 equal, 7 the same words, 6 within, 5 a subset, else -4."""
    target = _match_key(col(expected))
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9a-zA-Z]+|[\x{4e00}-\x{9fff}]+"), F.lit(0)), F.lower))
    want = words(clean_text(expected))
    text = clean_text(author)
    parts = F.filter(F.split(text, rf"{SPACE}*[/,，;；&＆|、]{SPACE}*"), lambda x: x != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))

    def one(p: Column) -> Column:
        k, have = _match_key(p), words(p)
        shared = F.size(F.array_intersect(have, want))
        both = (F.size(have) > 0) & (F.size(want) > 0)
        return F.when(k == "", -4).when(k == target, 8).when(target.contains(k) | k.contains(target), 6).when(both & (shared == F.size(have)) & (shared == F.size(want)), 7).when(both & (shared > 0) & ((shared == F.size(have)) | (shared == F.size(want))), 5).otherwise(-4)

    return F.when(target == "", 0).when(text.isNull(), -1).otherwise(F.array_max(F.transform(parts, one)))


def metadata_score(query: Column | str, expected: Column | str, **c: str) -> Column:
    """How well a record fits: its title threefold, its author, and what else it tells."""
    n = {k: c.get(k, k) for k in ("title", "author", "description", "publisher", "isbn", "published", "tags")}
    has = lambda k, w: F.when(F.coalesce(F.col(n[k]), F.lit("")) != "", w).otherwise(0)
    a = author_score(n["author"], expected)
    asked = F.when(a > 0, a).when(F.coalesce(F.col(n["author"]), F.lit("")) != "", -2).otherwise(0)
    by_author = F.when(F.coalesce(col(expected), F.lit("")) != "", asked).otherwise(has("author", 2))
    return title_score(n["title"], query) * 3 + by_author + has("description", 2) + has("publisher", 1) + has("isbn", 2) + has("published", 1) + F.when(F.size(n["tags"]) > 0, 1).otherwise(0)


def on_host(url: Column | str, *hosts: str) -> Column:
    """Is an address on one of these hosts or below?"""
    host = F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")))
    return host.rlike(rf"(?:^|\.)(?:{'|'.join(h.replace('.', chr(92) + '.') for h in hosts)})$")


def style_differs(stored: Column | str, expected: Column | str) -> Column:
    """Do two style sheets differ in more than line ends and outer blanks? NULL stored: there is none."""
    plain = lambda c: strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n"))
    return F.when(col(stored).isNull(), plain(expected) != "").otherwise(plain(stored) != plain(expected))
