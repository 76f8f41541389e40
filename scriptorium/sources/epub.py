"""Packaged e-books: reading members, metadata, contents and sections; writing and patching packages.

Everything here turns bytes into rows or bytes: tasks run it on Arrow batches, one book at a time.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MEDIA_TYPES

MIMETYPE = b"application/epub+zip"


def canonical(path: str) -> str:
    """A member's path without '.', '..' and leading slashes."""
    p = posixpath.normpath(unquote(path).replace("\\", "/").lstrip("/"))
    while p.startswith("../"):
        p = p[3:]
    return "" if p in (".", "..") else p


def kind_of(path: str) -> str:
    return MEDIA_TYPES.get(path.rpartition(".")[2].lower(), "application/octet-stream")


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in root.iter() if local(x.tag) == name]


def _xml(data: bytes) -> ET.Element:
    """XML; where it is broken, once more without what breaks most often: bare ampersands, named entities, controls."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        text = data.decode("utf-8", "replace")
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?>", "", text))
        text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)(\w+;)?", lambda m: escape(html.unescape(m.group())) if m.group(1) else "&amp;", text)
        return ET.fromstring(text.encode())


@dataclass
class Item:
    id: str
    href: str
    media: str
    properties: list[str]
    path: str


class Package:
    """An opened package: members by canonical path, the manifest, the reading order, titles of the contents."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.members: dict[str, str] = {}
        for i in self.zip.infolist():
            if not i.is_dir() and (c := canonical(i.filename)):
                self.members.setdefault(c, i.filename)
        self.opf = self._root_file()
        self.root = _xml(self.read(self.opf) or b"")
        folder = posixpath.dirname(self.opf)
        self.items = []
        for x in _all(self.root, "item"):
            href = (x.get("href") or "").strip()
            if href:
                self.items.append(Item((x.get("id") or "").strip(), href, (x.get("media-type") or "").strip(), (x.get("properties") or "").split(), canonical(posixpath.join(folder, href.partition("#")[0]))))
        self.by_id = {i.id: i for i in self.items}

    def _root_file(self) -> str:
        container = self.read("META-INF/container.xml")
        for x in _all(_xml(container), "rootfile") if container else []:
            if x.get("full-path"):
                return canonical(x.get("full-path"))
        found = next((p for p in self.members if p.lower().endswith(".opf")), None)
        if not found:
            raise ValueError("no package document")
        return found

    def locate(self, path: str) -> str | None:
        """A member by its path, with or without the usual folder, else by its name alone."""
        p = canonical(path)
        for q in (p, p[5:] if p.startswith("EPUB/") else f"EPUB/{p}"):
            if q in self.members:
                return q
        name = posixpath.basename(p)
        same = [m for m in self.members if posixpath.basename(m) == name and name]
        for end in (f"/Text/{name}", f"/text/{name}", f"/{name}"):
            for m in same:
                if m.endswith(end):
                    return m
        return same[0] if same else None

    def read(self, path: str) -> bytes | None:
        at = self.locate(path)
        return self.zip.read(self.members[at]) if at else None

    @staticmethod
    def _document(i: Item) -> bool:
        nav = "nav" in i.properties or posixpath.basename(i.href).lower() in ("nav.xhtml", "nav.html")
        return "html" in i.media.lower() and not nav

    def reading_order(self) -> list[Item]:
        refs = [self.by_id.get((x.get("idref") or "").strip()) for x in _all(self.root, "itemref")]
        return [i for i in refs if i and self._document(i)] or [i for i in self.items if self._document(i)]

    def contents(self) -> dict[str, str]:
        """Titles by member: the navigation document's go before the older table's; first ones stay."""
        out: dict[str, str] = {}
        for nav in (i for i in self.items if "nav" in i.properties or posixpath.basename(i.href).lower().startswith("nav.")):
            try:
                root = _xml(self.read(nav.path) or b"")
            except ET.ParseError:
                continue
            toc = [n for n in _all(root, "nav") if next((v for k, v in n.attrib.items() if local(k) == "type"), "toc").strip().lower() in ("toc", "")]
            for a in [a for n in toc for a in _all(n, "a")] or _all(root, "a"):
                title = "".join(a.itertext()).strip()
                if a.get("href") and title:
                    out.setdefault(canonical(posixpath.join(posixpath.dirname(nav.path), a.get("href").partition("#")[0])), title)
        for ncx in (i for i in self.items if i.media == MEDIA_TYPES["ncx"] or i.href.lower().endswith(".ncx")):
            try:
                root = _xml(self.read(ncx.path) or b"")
            except ET.ParseError:
                continue
            for p in _all(root, "navPoint"):
                text = next(("".join(t.itertext()).strip() for t in _all(p, "text")), "")
                src = next((c.get("src") for c in _all(p, "content") if c.get("src")), None)
                if text and src:
                    out.setdefault(canonical(posixpath.join(posixpath.dirname(ncx.path), src.partition("#")[0])), text)
        return out

    def sections(self) -> Iterator[tuple[int, str, str, bytes, str]]:
        """(index, title, path, content, media type); missing members use up an index."""
        titles = self.contents()
        for n, item in enumerate(self.reading_order()):
            data = self.read(item.path)
            if data is None:
                continue
            title = titles.get(item.path) or titles.get(self.locate(item.path) or "") or _html_title(data.decode("utf-8", "replace"))
            yield n, title or posixpath.splitext(posixpath.basename(item.href))[0] or f"章节 {n + 1}", item.path, data, item.media

    def metadata(self, fallback: str = "") -> dict:
        meta = next((x for x in self.root.iter() if local(x.tag) == "metadata"), None)
        dc: dict[str, list[tuple[str, str]]] = {}
        out: dict = {"title": fallback, "author": None, "language": "zh-CN", "description": None, "series": None, "identifier": None, "publisher": None, "tags": [], "published": None, "isbn": None, "rating": None}
        for x in meta if meta is not None else []:
            name, text = local(x.tag), "".join(x.itertext()).strip()
            if name == "meta":
                if x.get("property") == "belongs-to-collection" and text:
                    out["series"] = text
                value = text or (x.get("content") or "").strip()
                if x.get("name") == "rating" and value:
                    try:
                        out["rating"] = max(0, min(5, int(float(value))))
                    except ValueError:
                        pass
            elif name and text:
                dc.setdefault(name, []).append((text, (x.get("id") or "").strip()))
        first = lambda n: next((t for t, _ in dc.get(n, [])), None)
        out |= {"title": first("title") or fallback, "author": first("creator"), "language": first("language") or "zh-CN", "description": first("description"), "publisher": first("publisher"), "published": first("date"), "tags": [t for t, _ in dc.get("subject", [])]}
        for text, own in dc.get("identifier", []):
            if own == "isbn" or len(re.sub(r"[^0-9Xx]", "", text)) in (10, 13) and not re.search(r"[^0-9Xx\- ]", text):
                out["isbn"] = out["isbn"] or text
            elif own == "identifier" or out["identifier"] is None:
                out["identifier"] = text
        return out

    def cover(self) -> tuple[str, bytes] | None:
        """By the metadata's pointer, the manifest's property, then a name with 'cover' in it."""
        pointers = [x.get("content") for x in _all(self.root, "meta") if x.get("name") == "cover"]
        images = [i for i in self.items if i.media.startswith("image/")]
        order = [i for c in pointers for i in images if i.id == c] + [i for i in images if "cover-image" in i.properties] + [i for i in images if "cover" in (i.id + i.path).lower()]
        for i in order:
            if data := self.read(i.path):
                return i.path, data
        return None


def documents_root(paths: list[str]) -> str:
    """The folder that all documents share, without a last part that only says text; '' for the package's own."""
    folders = [posixpath.dirname(p) for p in paths]
    shared = posixpath.commonpath(folders) if folders and all(folders) else ""
    head, last = posixpath.split(shared)
    return head if last.lower() in ("text", "xhtml", "html") else shared


def _html_title(text: str) -> str | None:
    for tag in ("title", "h1", "h2"):
        m = re.search(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", text)
        if m and (t := html.unescape(re.sub(r"<[^>]+>", " ", m.group(1))).strip()):
            return re.sub(r"\s+", " ", t)
    return None


_SECTIONS = "book_id string, section_idx int, title string, item_path string, media_type string, html string"
_META = "book_id string, title string, author string, language string, description string, series string, identifier string, publisher string, tags array<string>, published string, isbn string, rating int"


def read_sections(books: DataFrame) -> DataFrame:
    """Section documents of (book_id, content); unreadable packages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for book, data in zip(pdf["book_id"], pdf["content"], strict=True):
                try:
                    rows = [(book, n, t, p, m, d.decode("utf-8", "replace")) for n, t, p, d, m in Package(bytes(data)).sections()]
                except (zipfile.BadZipFile, ET.ParseError, ValueError, TypeError):
                    continue
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SECTIONS.split(", ")])

    return books.select("book_id", "content").mapInPandas(run, _SECTIONS)


def read_metadata(books: DataFrame) -> DataFrame:
    """Metadata of (book_id, source_name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _META.split(", ")]
        types = [pa.string()] * 8 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
        for b in batches:
            rows = []
            for book, name, data in zip(*(b.column(c).to_pylist() for c in ("book_id", "source_name", "content")), strict=True):
                try:
                    rows.append({"book_id": book} | Package(data).metadata(name or ""))
                except (zipfile.BadZipFile, ET.ParseError, ValueError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return books.select("book_id", "source_name", "content").mapInArrow(run, _META)


# --- writing

_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang={lang} lang={lang}><head><title>{title}</title><link rel="stylesheet" type="text/css" href="../Styles/style.css"/></head><body class="{kind}">{body}</body></html>'


@dataclass
class Book:
    meta: dict
    sections: list[dict]
    intro: str | None = None
    css: str = ""
    cover: tuple[str, bytes] | None = None
    files: dict[str, bytes] = field(default_factory=dict)


def stamp_of(title: str, kind: str) -> tuple[str | None, str]:
    m = re.match(r"\s*(第[0-9零〇一二两三四五六七八九十百千万亿]+章)\s*[:：、.\-·]?\s*(.+)", title or "", re.S) if kind == "chapter" else None
    return (m.group(1), m.group(2).strip()) if m and m.group(2).strip() else (None, title)


def _page(title: str, lines: list[str], kind: str, lang: str) -> bytes:
    stamp, main = stamp_of(title, kind)
    head = (f'<p class="stamp">{escape(stamp)}</p>' if stamp else "") + f"<h{1 if kind == 'volume' else 2}>{escape(main)}</h{1 if kind == 'volume' else 2}>"
    body = head + "".join(f"<p>{escape(x)}</p>" for x in lines if x)
    return _PAGE.format(lang=quoteattr(lang), title=escape(title), kind=kind, body=body).encode()


def write(book: Book) -> bytes:
    """A package: mimetype first and stored, container, package document, both tables of contents, style, sections."""
    meta, lang = book.meta, book.meta.get("language") or "zh-CN"
    parts = [("简介", [x.strip() for x in book.intro.splitlines() if x.strip()], "intro")] if book.intro else []
    parts += [(s["title"], list(s.get("lines") if s.get("lines") is not None else []), s.get("kind") or "chapter") for s in book.sections if s.get("kind") != "volume" or len(s.get("lines") if s.get("lines") is not None else [])]
    parts = parts or [("正文", ["（无内容）"], "chapter")]
    begin = 0 if book.intro else 1
    names = [f"Text/section_{n:04d}.xhtml" for n in range(begin, begin + len(parts))]
    e = lambda v: escape(str(v))
    ident = str(meta.get("identifier") or meta.get("book_id") or "")
    dc = [f'<dc:identifier id="bookid">{e(ident if ident.startswith("urn:") else "urn:uuid:" + ident)}</dc:identifier>']
    if meta.get("identifier"):
        dc.append(f'<dc:identifier id="identifier">{e(meta["identifier"])}</dc:identifier>')
    if meta.get("isbn"):
        dc.append(f'<dc:identifier id="isbn">{e(meta["isbn"])}</dc:identifier>')
    dc.append(f"<dc:title>{e(meta.get('title') or '')}</dc:title><dc:language>{e(lang)}</dc:language>")
    dc += [f"<dc:{tag}>{e(meta[k])}</dc:{tag}>" for tag, k in (("creator", "author"), ("description", "description"), ("publisher", "publisher"), ("date", "published")) if meta.get(k)]
    tags = meta.get("tags")
    dc += [f"<dc:subject>{e(t)}</dc:subject>" for t in (tags if tags is not None else []) if t]
    if meta.get("series"):
        dc.append(f'<meta property="belongs-to-collection">{e(meta["series"])}</meta>')
    if meta.get("rating") is not None and meta.get("rating") == meta.get("rating"):
        dc.append(f'<meta name="rating">{int(meta["rating"])}</meta>')
    dc.append(f'<meta property="dcterms:modified">{e(meta.get("modified") or "2000-01-01T00:00:00Z")}</meta>')
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="css" href="Styles/style.css" media-type="text/css"/>']
    items += [f'<item id="sec{n:04d}" href="{name}" media-type="application/xhtml+xml"/>' for n, name in enumerate(names, begin)]
    if book.cover:
        dc.append('<meta name="cover" content="cover-image"/>')
        items.append(f'<item id="cover-image" href="Images/{e(book.cover[0])}" media-type="{kind_of(book.cover[0])}" properties="cover-image"/>')
    spine = "".join(f'<itemref idref="sec{n:04d}"/>' for n in range(begin, begin + len(parts)))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{"".join(dc)}</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{spine}</spine></package>'
    links = "".join(f'<li><a href="{n}">{e(p[0])}</a></li>' for n, p in zip(names, parts, strict=True))
    nav = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{e(meta.get("title") or "")}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    points = "".join(f'<navPoint id="p{i}" playOrder="{i}"><navLabel><text>{e(p[0])}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, p) in enumerate(zip(names, parts, strict=True), 1))
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{e(meta.get("title") or "")}</text></docTitle><navMap>{points}</navMap></ncx>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda n, d: z.writestr(zipfile.ZipInfo(n, (2000, 1, 1, 0, 0, 0)), d, zipfile.ZIP_STORED if n == "mimetype" else zipfile.ZIP_DEFLATED)
        put("mimetype", MIMETYPE)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        put("EPUB/content.opf", opf)
        put("EPUB/nav.xhtml", nav)
        put("EPUB/toc.ncx", ncx)
        put("EPUB/Styles/style.css", book.css.strip())
        for name, (title, lines, kind) in zip(names, parts, strict=True):
            put(f"EPUB/{name}", _page(title, lines, kind, lang))
        if book.cover:
            put(f"EPUB/Images/{book.cover[0]}", book.cover[1])
    return out.getvalue()


def build(books: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, epub): a package a book from its metadata and its sections in order.

    One task holds one book at a time; its sections travel as one array, bounded by the book.
    """
    item = F.struct("section_idx", "kind", "title", "lines")
    parts = sections.groupBy("book_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("sections"))
    fields = ["title", "author", "language", "description", "series", "identifier", "publisher", "tags", "published", "isbn", "rating"]
    rows = books.select("book_id", F.to_json(F.struct("book_id", *fields)).alias("meta"), "custom_css").join(parts, "book_id")

    @F.pandas_udf(T.BinaryType())
    def made(meta: pd.Series, own: pd.Series, css: pd.Series) -> pd.Series:
        import json

        return pd.Series([write(Book(json.loads(m), json.loads(s), css=c or "")) for m, s, c in zip(meta, own, css, strict=True)])

    return rows.select("book_id", made("meta", "sections", "custom_css").alias("epub"))


# --- patching


def rewrite(data: bytes, change) -> bytes:
    """A package with members changed: change(path, bytes) gives new bytes or None to drop. Paths become canonical, the first of a path stays."""
    src = zipfile.ZipFile(io.BytesIO(data))
    out, seen = io.BytesIO(), {"mimetype"}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype", (2000, 1, 1, 0, 0, 0)), MIMETYPE, zipfile.ZIP_STORED)
        for i in src.infolist():
            p = canonical(i.filename)
            if i.is_dir() or not p or p in seen:
                continue
            new = change(p, src.read(i.filename))
            if new is not None:
                seen.add(p)
                z.writestr(zipfile.ZipInfo(p, (2000, 1, 1, 0, 0, 0)), new, zipfile.ZIP_DEFLATED)
    return out.getvalue()


_DC, _OPF = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/opf"
#: Fields of the metadata that are one element of Dublin Core each, in the order in which they are written.
_DC_FIELDS = {"title": "title", "language": "language", "author": "creator", "description": "description", "publisher": "publisher", "published": "date"}


def _field_of(node: ET.Element) -> str | None:
    """The field that a child of the metadata holds."""
    tag, prop, name = local(node.tag), (node.get("property") or "").strip(), (node.get("name") or "").strip()
    if tag == "meta":
        return {"dcterms:modified": "modified", "belongs-to-collection": "series"}.get(prop) or ("rating" if name == "rating" else None)
    if tag == "identifier":
        return "isbn" if node.get("id") == "isbn" else "identifier"
    return "tags" if tag == "subject" else next((f for f, t in _DC_FIELDS.items() if t == tag), None)


def with_metadata(data: bytes, meta: dict, now: datetime | None = None) -> bytes:
    """The fields that meta names anew, NULL ones taken out, and the time of the change; all else stays.

    The package's own identifier is that of meta or its book_id, as a URN; title and language are never taken out.
    """
    opf = Package(data).opf
    ET.register_namespace("dc", _DC)
    ET.register_namespace("", _OPF)
    stamp = (now or datetime.now(UTC)).astimezone(UTC).replace(microsecond=0, tzinfo=None).isoformat() + "Z"

    def change(path: str, raw: bytes) -> bytes:
        if path != opf:
            return raw
        root = _xml(raw)
        node = next((x for x in root.iter() if local(x.tag) == "metadata"), None)
        if node is None:
            node = ET.Element(f"{{{_OPF}}}metadata")
            root.insert(0, node)
        wanted = {f for f in meta if f not in ("title", "language", "identifier", "book_id") or meta[f]} | {"modified"}
        if "identifier" in meta and (meta.get("identifier") or meta.get("book_id")):
            wanted.add("identifier")
        own_id = root.get("unique-identifier")
        for x in [x for x in node if _field_of(x) in wanted]:
            node.remove(x)

        def add(tag: str, text: object, ns: str = _DC, **attributes: str) -> None:
            if text not in (None, ""):
                ET.SubElement(node, f"{{{ns}}}{tag}", attributes).text = str(text)

        if "identifier" in wanted:
            own = str(meta.get("identifier") or meta.get("book_id"))
            add("identifier", own if own.startswith("urn:") else f"urn:uuid:{own}", **({"id": own_id} if own_id else {}))
            if own_id != "identifier":
                add("identifier", meta.get("identifier"), id="identifier")
        for f, tag in _DC_FIELDS.items():
            if f in wanted:
                add(tag, meta[f])
        if "isbn" in wanted:
            add("identifier", meta["isbn"], id="isbn")
        for t in meta.get("tags") or []:
            add("subject", t)
        if "series" in wanted:
            add("meta", meta["series"], _OPF, property="belongs-to-collection")
        if "rating" in wanted:
            add("meta", meta["rating"], _OPF, name="rating")
        add("meta", stamp, _OPF, property="dcterms:modified")
        return ET.tostring(root, encoding="utf-8", xml_declaration=True)

    return rewrite(data, change)


def patched(books: DataFrame, meta: dict) -> DataFrame:
    """(book_id, content) with the metadata of every package patched; unreadable packages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for book, data in zip(b.column("book_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out.append(with_metadata(data, meta))
                except (zipfile.BadZipFile, ET.ParseError, ValueError, TypeError):
                    continue
                ids.append(book)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["book_id", "content"])

    return books.select("book_id", "content").mapInArrow(run, "book_id string, content binary")


def without_webp(data: bytes) -> bytes:
    """WebP images, their manifest rows and the pictures that show them go; a package without them stays as it is."""
    p = Package(data)
    gone = {i.path for i in p.items if i.media == "image/webp" or i.href.lower().endswith(".webp")}
    if not gone:
        return data

    def change(path: str, raw: bytes) -> bytes | None:
        if path in gone:
            return None
        if path == p.opf:
            return re.sub(rb'<(?:\w+:)?item\b[^>]*(?:image/webp|\.webp["\'])[^>]*?(?:/>|>\s*</(?:\w+:)?item>)', b"", raw)
        if kind_of(path) == MEDIA_TYPES["xhtml"]:
            text = re.sub(r'(?is)<source\b[^>]*\.webp[^>]*?/?>(?:</source>)?|<img\b[^>]*src=["\'][^"\']*\.webp[^>]*?/?>', "", raw.decode("utf-8", "replace"))
            return text.encode()
        return raw

    return rewrite(data, change)


def without_styles(text: str) -> str:
    """HTML without style sheets: links, blocks and processing instructions."""
    text = re.sub(r'(?is)<link\b[^>]*rel=["\'][^"\']*stylesheet[^"\']*["\'][^>]*/?>', "", text)
    text = re.sub(r"(?is)<style\b[^>]*>.*?</style>", "", text)
    return re.sub(r"(?is)<\?xml-stylesheet\b.*?\?>", "", text)


def with_style(text: str, href: str) -> str:
    """HTML with one more style sheet at the end of its head."""
    link = f'<link rel="stylesheet" type="text/css" href={quoteattr(href)}/>'
    new, n = re.subn(r"(?i)</head>", lambda m: link + m.group(), text, count=1)
    return new if n else link + text


def for_reader(text: str, base: str) -> str:
    """HTML to show: no scripts, and a base for its links."""
    text = re.sub(r"(?is)<script\b[^>]*>.*?</script>|<script\b[^>]*/>", "", text)
    tag = f"<base href={quoteattr(base)}/>"
    new, n = re.subn(r"(?i)<head\b[^>/]*>", lambda m: m.group() + tag, text, count=1)
    return new if n else tag + text


def with_cover_and_style(data: bytes, cover: tuple[str, bytes] | None = None, css: str | None = None, plain: bool = False) -> bytes:
    """A new cover and one overlay style sheet, other documents kept; plain=True drops the package's own styles.

    css='' takes an earlier overlay away.
    """
    p = Package(data)
    folder = posixpath.dirname(p.opf)
    overlay = posixpath.join(folder, "Styles/overlay.css")
    own_styles = {i.path for i in p.items if i.media == MEDIA_TYPES["css"] and i.path != overlay} if plain else set()
    image = posixpath.join(folder, "Images", cover[0]) if cover else ""
    old_cover = p.cover()[0] if cover and p.cover() else ""

    def change(path: str, raw: bytes) -> bytes | None:
        if path in own_styles or (css is not None and path == overlay) or (cover and path in (image, old_cover)):
            return None
        if path == p.opf:
            text = raw.decode("utf-8", "replace")
            dropped = {i.id for i in p.items if i.path in own_styles or (css is not None and i.path == overlay) or (cover and (i.path in (image, old_cover) or "cover-image" in i.properties))}
            for d in dropped:
                text = re.sub(rf'(?s)<(?:\w+:)?item\b[^>]*\bid=["\']{re.escape(d)}["\'][^>]*?/?>', "", text)
            new = '<item id="overlay-css" href="Styles/overlay.css" media-type="text/css"/>' if css else ""
            if cover:
                text = re.sub(r'(?s)<(?:\w+:)?meta\b[^>]*\bname=["\']cover["\'][^>]*?/?>', "", text)
                text = re.sub(r"</((?:\w+:)?metadata)>", lambda m: '<meta name="cover" content="cover-image"/>' + m.group(), text, count=1)
                new += f'<item id="cover-image" href="Images/{escape(cover[0])}" media-type="{kind_of(cover[0])}" properties="cover-image"/>'
            return re.sub(r"</((?:\w+:)?manifest)>", lambda m: new + m.group(), text, count=1).encode()
        if kind_of(path) == MEDIA_TYPES["xhtml"]:
            text = raw.decode("utf-8", "replace")
            text = without_styles(text) if plain else text
            if css is not None:
                text = re.sub(r'(?i)<link\b[^>]*overlay\.css[^>]*/?>', "", text)
            return (with_style(text, posixpath.relpath(overlay, posixpath.dirname(path) or ".")) if css else text).encode()
        return raw

    out = io.BytesIO(rewrite(data, change))
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        if css:
            z.writestr(zipfile.ZipInfo(overlay, (2000, 1, 1, 0, 0, 0)), css)
        if cover:
            z.writestr(zipfile.ZipInfo(image, (2000, 1, 1, 0, 0, 0)), cover[1])
    return out.getvalue()


#: First bytes of image files and their endings.
_MAGIC = ((b"\xff\xd8", ".jpg"), (b"\x89PNG", ".png"), (b"GIF8", ".gif"), (b"RIFF", ".webp"))


def cover_ending(name: str | None, data: bytes) -> str:
    """The ending of a cover's file: its name's, else by its first bytes, else '.jpg'."""
    end = posixpath.splitext(name or "")[1].lower()
    if end in (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"):
        return end
    return next((e for m, e in _MAGIC if data.startswith(m)), ".jpg")


def bundle(rows: DataFrame, path: str) -> int:
    """One archive of the packages (file_name, epub), fetched one partition after another. Returns how many."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for r in rows.select("file_name", "epub").toLocalIterator():
            z.writestr(zipfile.ZipInfo(r["file_name"], (2000, 1, 1, 0, 0, 0)), bytes(r["epub"]))
            n += 1
    return n
