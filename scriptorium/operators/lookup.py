"""Ranking of looked-up records and reading them from web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def best_suggestion(queries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """For each query (id, query, expected) the best of its suggestions (id, pos, title, author).

    By whether the author fits, then the title's score, then the author's; the first of equals. Rejected where authors
    were named but none fits.
    """
    met = queries.join(suggestions, "id")
    expected = X.clean_text("expected")
    a = F.when(expected.isNotNull(), X.author_score("author", "expected")).otherwise(0)
    scored = met.withColumns({"a": a, "t": X.title_score("title", "query"), "named": expected.isNotNull() & X.clean_text("author").isNotNull()})
    rank = F.struct((F.col("a") > 0).cast("int"), F.col("t"), F.col("a"), -F.col("pos"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("pos", "title", "author", "t", "a"), rank).alias("b"), F.bool_or("named").alias("named"), F.max((F.col("a") > 0).cast("int")).alias("fits"))
    return best.where(~(F.col("named") & (F.col("fits") == 0))).select("id", "b.pos", "b.title", "b.author", F.col("b.t").alias("title_score"), F.col("b.a").alias("author_score"))


def ld_json(html: Column | str) -> Column:
    """A page's JSON-LD objects as texts; a block that is a list gives its items."""
    blocks = F.regexp_extract_all(X.col(html), F.lit(r'(?is)<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    return F.flatten(F.transform(blocks, lambda b: _items(X.strip(b))))


def _items(value: Column) -> Column:
    """A JSON value as a list of texts: the items of a list, else itself."""
    listed = F.from_json(value, "array<string>")
    return F.coalesce(F.when(value.startswith("["), listed), F.array_compact(F.array(value)))


def _said(value: Column, *keys: str, clean=X.clean_text) -> Column:
    """The texts of a JSON value that may be a text, an object that says it under one of some keys, or a list of these."""
    of = lambda x: F.when(x.startswith("{"), F.coalesce(*[clean(F.get_json_object(x, f"$['{k}']")) for k in keys])).otherwise(clean(x))
    return F.array_compact(F.transform(_items(value), of))


def _told(html: Column, pattern: str) -> Column:
    return X.clean_text(X.present(F.regexp_extract(html, pattern, 1)))


def _meta(html: Column, name: str) -> Column:
    return X.present(F.regexp_extract(html, rf'(?is)<meta[^>]+(?:property|name)=["\']{name}["\'][^>]+content=["\'](.*?)["\']', 1))


def _object(html: Column, *types: str) -> Column:
    """The first JSON-LD object of one of these types."""
    kind = lambda x: F.get_json_object(x, "$['@type']")
    return F.get(F.filter(ld_json(html), lambda x: kind(x).rlike(rf'(?:^|")(?:{"|".join(types)})(?:"|$)')), 0)


def _of_object(b: Column) -> dict[str, Column]:
    """What both kinds of pages say in their object."""
    value = lambda key: F.get_json_object(b, f"$.{key}")
    return {
        "title": X.clean_text(value("name")),
        "author": X.present(F.array_join(_said(value("author"), "name"), ", ")),
        "description": X.present(F.array_join(_said(value("description"), "@value", "value", "text"), "\n")),
        "published": X.clean_date(value("datePublished")),
        "isbn": X.clean_isbn(value("isbn")),
        "language": X.clean_text(value("inLanguage")),
        "image": F.get(_said(value("image"), "url", "contentUrl", "@id", clean=X.clean_url), 0),
        "tags": X.lookup_tags(F.coalesce(F.when(~value("keywords").rlike(r"^\s*[\[{]"), value("keywords")), F.lit(""))),
        "publisher": X.clean_text(F.get_json_object(b, "$.publisher.name")),
        "brand": X.clean_text(F.get_json_object(b, "$.brand.name")),
    }


def paragraphs(html: Column) -> Column:
    """A piece of HTML as text with line breaks, list marks and blank lines between paragraphs; NULL for nothing."""
    steps = [(r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)<\s*li[^>]*>", "- "), (r"(?i)</\s*(?:p|div|li|h[1-6]|tr)\s*>", "\n\n"), ("<[^>]+>", "")]
    tidy = [("\r\n", "\n"), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]
    out = html
    for pattern, text in steps:
        out = F.regexp_replace(out, pattern, text)
    out = X.unescape(out)
    for pattern, text in tidy:
        out = F.regexp_replace(out, pattern, text)
    return X.stripped_or_null(out)


_SHAPE = ("title", "author", "publisher", "published", "isbn", "language", "description", "cover_url", "tags")


def page_record(pages: DataFrame) -> DataFrame:
    """(url, title, author, publisher, published, isbn, language, description, cover_url, tags) of review pages (url, html).

    The object of a Book goes first; its last introduction, the cover's link and the tags of the page stand above it.
    """
    html = F.col("html")
    b = _of_object(_object(html, "Book"))
    page = X.clean_text(html)
    intros = F.regexp_extract_all(html, F.lit(r'(?is)<div[^>]*class=["\'][^"\']*\bintro\b[^"\']*["\'][^>]*>(.*?)</div>'), F.lit(1))
    links = F.regexp_extract_all(html, F.lit(r"(?is)<a\b([^>]*)>"), F.lit(1))
    covers = F.filter(links, lambda a: F.regexp_extract(a, r'(?is)class=["\']([^"\']*)["\']', 1).rlike(r"(?i)(^|\s)nbg(\s|$)"))
    linked = F.get(F.array_compact(F.transform(covers, lambda a: X.clean_url(X.present(F.regexp_extract(a, r'(?is)href=["\'](.*?)["\']', 1))))), 0)
    distinct = lambda xs: F.array_distinct(F.array_compact(F.transform(xs, X.clean_text)))
    tag_links = distinct(F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]*class=["\'][^"\']*\btag\b[^"\']*["\'][^>]*>(.*?)</a>'), F.lit(1)))
    # Fixed value: criteria of kind 7 are tags.
    criteria = F.filter(F.transform(F.split(X.unescape(F.regexp_extract(html, r"(?is)criteria\s*=\s*([\"'])(.*?)\1", 2)), r"\|"), X.strip), lambda x: x.startswith("7:"))
    by_criteria = distinct(F.transform(criteria, lambda x: F.substring(x, 3, 1 << 20)))
    out = {
        "title": b["title"],
        "author": b["author"],
        "publisher": F.coalesce(b["publisher"], _told(page, r"出版社[:：]\s*(.+?)(?=\s+(?:作者|原作名|副标题|译者|出版年|页数|定价|装帧|丛书|ISBN|统一书号|出品方|品牌方)[:：]|$)")),
        "published": F.coalesce(b["published"], X.clean_date(X.present(F.regexp_extract(page, r"出版年[:：]\s*([0-9-]{4,10})", 1)))),
        "isbn": F.coalesce(b["isbn"], X.clean_isbn(X.present(F.regexp_extract(page, r"ISBN[:：]\s*([0-9Xx-]{10,20})", 1)))),
        "language": b["language"],
        "description": F.coalesce(paragraphs(F.try_element_at(intros, F.lit(-1))), b["description"], X.clean_text(_meta(html, "description"))),
        "cover_url": F.coalesce(linked, X.clean_url(_meta(html, "og:image")), b["image"]),
        "tags": F.when(F.size(tag_links) > 0, tag_links).when(F.size(by_criteria) > 0, by_criteria).otherwise(b["tags"]),
    }
    return pages.select("url", *[out[c].alias(c) for c in _SHAPE])


def product_record(pages: DataFrame) -> DataFrame:
    """The same of shop pages: the object of a Book or Product, then the page's own marks, then its text."""
    html = F.col("html")
    b = _of_object(_object(html, "Book", "Product"))
    page = X.clean_text(html)
    detail = lambda key: _told(html, rf'(?is)id=["\']rpi-attribute-book_details-{key}["\'][^>]*>.*?<div[^>]+rpi-attribute-value[^>]*>\s*<span>(.*?)</span>')
    headline = X.clean_text(_meta(html, "title"))
    own = X.clean_text(X.present(F.regexp_extract(headline, r"(?i)Amazon\.com[:：]\s*(.+?)(?:\s*:\s*[0-9Xx-]{10,20}\b|$)", 1)))  # Fixed value: how the site's headlines begin
    byline = F.regexp_extract(html, r'(?is)<div[^>]+id=["\']bylineInfo["\'][^>]*>(.*?)</div>', 1)
    names = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(byline, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), X.clean_text)))
    block = F.regexp_extract(html, r'(?is)<div[^>]*id=["\']bookDescription_feature_div["\'][^>]*>(.*?)(?=<div[^>]*\bid=|$)', 1)
    told = F.concat(F.regexp_extract_all(block, F.lit(r'(?is)<span[^>]*a-expander-partial-collapse-content[^>]*>(.*?)</span>'), F.lit(1)), F.regexp_extract_all(block, F.lit(r'(?is)<div[^>]*a-expander-content[^>]*>(.*?)</div>'), F.lit(1)), F.array(block))
    long = F.transform(F.filter(F.transform(told, X.clean_text), lambda x: F.length(x) >= 40), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    points = F.regexp_extract(html, r'(?is)id=["\']feature-bullets["\'][^>]*>(.*?)(?=<div[^>]*\bid=|$)', 1)
    bullets = F.filter(F.transform(F.regexp_extract_all(points, F.lit(r'(?is)<span[^>]*a-list-item[^>]*>(.*?)</span>'), F.lit(1)), X.clean_text), lambda x: F.length(x) >= 12)
    listed = X.present(F.array_join(F.transform(F.slice(X.distinct_no_case(bullets), 1, 6), lambda x: F.concat(F.lit("- "), x)), "\n"))
    spoken = X.clean_text(_meta(html, "description"))
    out = {
        "title": F.coalesce(b["title"], _told(html, r'(?is)<span[^>]+id=["\']productTitle["\'][^>]*>(.*?)</span>'), own, headline),
        "author": F.coalesce(b["author"], X.present(F.array_join(names, ", "))),
        "publisher": F.coalesce(b["brand"], detail("publisher"), _told(page, r"Publisher[:：]\s*([^\n\r]+?)\s{2,}")),
        "published": F.coalesce(b["published"], X.clean_date(detail("publication_date")), X.clean_date(X.present(F.regexp_extract(page, r"Publication date[:：]\s*([0-9A-Za-z,\- ]+)", 1)))),
        "isbn": F.coalesce(b["isbn"], X.clean_isbn(detail("isbn13")), X.clean_isbn(detail("isbn10")), X.clean_isbn(X.present(F.regexp_extract(page, r"ISBN-1[03][:：]\s*([0-9Xx-]{10,20})", 1)))),
        "language": F.coalesce(b["language"], detail("language"), _told(page, r"Language[:：]\s*([A-Za-z\- ]+)")),
        "description": F.coalesce(b["description"], F.array_max(long)["x"], listed, F.when(~F.lower(spoken).startswith("amazon.com:"), spoken)),
        "cover_url": F.lit(None).cast("string"),
        "tags": b["tags"],
    }
    return pages.select("url", *[out[c].alias(c) for c in _SHAPE])
