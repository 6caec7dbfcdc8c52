"""EPUB books as rows of entries: package, spine, navigation, spans, output policy, books put together again and their audit
(SC5, SC7, SC8, SC27, PR22, SK3, SK4, V47, V54-V58).

A book is unzipped once into a row for each entry; from there on everything is joins and functions of entries, and a book
becomes a group again only when it is zipped. Spans of its documents are those of `xhtml`, so a book without changes gets
the same documents back.

Defined results: what is no zip, or has no container or package, gives no rows but a fault in `faults`; entries that the spine
names and the book lacks are left out; a book without navigation has no rows of it; null contents are no zip.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.plans.shared import written
from segmenta.sources import texts
from segmenta.sources.batches import pieces

# Names in the format.
CONTAINER = "META-INF/container.xml"
STYLE_ID = "output-policy"

# What an output policy says of hyphenation, for running text, headings and code.
HYPHENATION = {"auto": ("auto", "none", "manual"), "manual": ("manual", "", ""), "none": ("none", "", "")}
# Declarations that may defeat the policy.
CONFLICTS = [r"-epub-word-break\s*:\s*break-all", r"(?<![-\w])word-break\s*:\s*break-all", r"overflow-wrap\s*:\s*anywhere", r"word-wrap\s*:\s*break-word", r"-epub-hyphens\s*:\s*[^;}{]+", r"(?<![-\w])hyphens\s*:\s*[^;}{]+"]


def _rows(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """A row for each tuple that work(*columns) yields, one row of df at a time."""
    fields = {n: t for n, t in (f.split() for f in schema.split(", "))}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out := list(work(*values)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[t]) for i, t in enumerate(fields.values())], names=list(fields))

    return df.select(*columns).mapInArrow(run, schema)


def entries(books: DataFrame) -> DataFrame:
    """(book, ordinal, name, data) of each entry of books (book, content); a book that is no zip has one row with ordinal -1 and its fault as name."""

    def work(book: int, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                found = [(book, k, i.filename, z.read(i)) for k, i in enumerate(z.infolist()) if not i.is_dir()]
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as error:
            found = [(book, -1, type(error).__name__, None)]
        yield from found

    return _rows(books, ["book", "content"], "book long, ordinal long, name string, data binary", work)


def resolve(base: str, href: str) -> str:
    """PR22: a reference from an entry to another: percent-decoded, relative to the entry's folder, without its fragment."""
    path = unquote(urlsplit(href).path)
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _package(book: int, name: str, data: bytes) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return
    items, spine = {}, []
    for e in root.iter():
        tag = _local(e.tag)
        if tag == "language" and (e.text or "").strip():
            yield book, name, "language", 0, e.text.strip()
        elif tag == "item":
            items[e.get("id")] = resolve(name, e.get("href") or "")
            if "nav" in (e.get("properties") or "").split() or e.get("media-type") == "application/x-dtbncx+xml":
                yield book, name, "nav", 0 if "nav" in (e.get("properties") or "").split() else 1, items[e.get("id")]
        elif tag == "itemref":
            spine.append(e.get("idref"))
    yield from ((book, name, "spine", k, items[i]) for k, i in enumerate(spine) if i in items)


def package(found: DataFrame) -> DataFrame:
    """SC5: (book, opf, kind, place, value): languages, navigation files and the spine's entries of each book's package."""
    container = found.where(F.col("name") == CONTAINER).select("book", F.regexp_extract(F.col("data").cast("string"), r"full-path\s*=\s*[\"']([^\"']+)", 1).alias("name"))
    opf = found.join(container, ["book", "name"]).select("book", "name", "data")
    return _rows(opf, ["book", "name", "data"], "book long, opf string, kind string, place long, value string", _package)


def documents(found: DataFrame, packed: DataFrame) -> DataFrame:
    """(book, place, name, html): the spine's documents in order."""
    spine = packed.where("kind = 'spine'").select("book", "place", F.col("value").alias("name"))
    return found.join(spine, ["book", "name"]).select("book", "place", "name", F.col("data").cast("string").alias("html"))


def spans(docs: DataFrame) -> DataFrame:
    """SC5, SC7: the spans of `texts.xhtml_spans` for each document of a book."""
    return texts.xhtml_spans(docs, {"book": "long", "place": "long", "name": "string"}, "html")


def _toc(book: int, name: str, data: bytes) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return
    number = 0
    if _local(root.tag) == "ncx":
        for point in root.iter():
            if _local(point.tag) == "navPoint":
                title = next(("".join(e.itertext()) for e in point.iter() if _local(e.tag) == "navLabel"), "")
                href = next((e.get("src") for e in point.iter() if _local(e.tag) == "content"), "")
                yield book, number, resolve(name, href), urlsplit(href).fragment, " ".join(title.split())
                number += 1
        return
    navs = [e for e in root.iter() if _local(e.tag) == "nav"]
    toc = [e for e in navs if any(_local(k) == "type" and "toc" in v.split() for k, v in e.attrib.items())] or navs[:1]
    for nav in toc:
        for a in nav.iter():
            if _local(a.tag) == "a" and a.get("href"):
                yield book, number, resolve(name, a.get("href")), urlsplit(a.get("href")).fragment, " ".join("".join(a.itertext()).split())
                number += 1


def navigation(found: DataFrame, packed: DataFrame) -> DataFrame:
    """SC8: (book, number, name, fragment, title) of the table of contents: the navigation document's, or else the NCX file's."""
    files = packed.where("kind = 'nav'").groupBy("book").agg(F.min_by("value", "place").alias("name"))
    return _rows(found.join(files, ["book", "name"]), ["book", "name", "data"], "book long, number long, name string, fragment string, title string", _toc)


def css_conflicts(found: DataFrame) -> DataFrame:
    """SC27, SK4: (book, name, declaration): each different declaration of a style sheet that may defeat the policy."""
    sheets = found.where(F.lower("name").endswith(".css")).select("book", "name", F.col("data").cast("string").alias("css"))
    each = F.flatten(F.array(*(F.regexp_extract_all("css", F.lit(f"(?i){p}"), F.lit(0)) for p in CONFLICTS)))
    return sheets.select("book", "name", F.explode(F.array_distinct(F.transform(each, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))).alias("declaration"))


def policy_css(mode: str) -> str:
    """SK4: the style sheet of a hyphenation mode; empty where it is to be preserved."""
    if mode not in HYPHENATION:
        return ""
    text, heads, code = HYPHENATION[mode]
    groups = (("html, body, p, li, blockquote, dd, dt", text), ("h1, h2, h3, h4, h5, h6, nav", heads), ("pre, code, kbd, samp", code))
    return "\n".join(f"{names} {{ -epub-hyphens: {value}; hyphens: {value}; }}" for names, value in groups if value)


def with_policy(page: str, language: str | None, css: str) -> str:
    """A document with the policy's language on its root and the style sheet at its head's end, once, however often it is applied."""
    if language:
        m = re.search(r"<html\b[^>]*>", page)
        if m:
            bare = re.sub(r"\s(?:xml:)?lang\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", m[0])
            page = page[: m.start()] + bare[:5] + f' lang="{language}" xml:lang="{language}"' + bare[5:] + page[m.end() :]
    page = re.sub(rf'<style id="{STYLE_ID}"[^>]*>.*?</style>\n?', "", page, flags=re.S)
    if css and "</head>" in page:
        page = page.replace("</head>", f'<style id="{STYLE_ID}" type="text/css">\n{css}\n</style>\n</head>', 1)
    return page


def _applied(name: str, data: bytes, language: str | None, css: str) -> bytes:
    text = data.decode("utf-8", "surrogateescape")
    if name.endswith(".opf"):
        text = re.sub(r"(<dc:language\b[^>]*>)[^<]*(</dc:language>)", lambda m: m[1] + language + m[2], text, count=1) if language else text
    else:
        text = with_policy(text, language, css)
    return text.encode("utf-8", "surrogateescape")


def apply_policy(found: DataFrame, packed: DataFrame, languages: DataFrame, mode: str) -> DataFrame:
    """SK4: the entries with each book's language (book, language; null: preserved) and a mode of hyphenation, in packages and spine documents."""
    css = policy_css(mode)
    touched = packed.where("kind = 'spine'").select("book", F.col("value").alias("name")).union(packed.select("book", "opf")).distinct().withColumn("touched", F.lit(True))
    met = found.join(touched, ["book", "name"], "left").join(languages, "book", "left")
    changed = _rows(met.where("touched"), ["book", "ordinal", "name", "data", "language"], "book long, ordinal long, name string, data binary", lambda book, k, name, data, language: [(book, k, name, _applied(name, data, language, css))])
    return met.where("touched IS NULL").select("book", "ordinal", "name", "data").unionByName(changed)


def replaced(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The entries with documents (book, name, text) in place of their own."""
    new = docs.select("book", "name", F.col("text").cast("binary").alias("new"))
    return found.join(new, ["book", "name"], "left").select("book", "ordinal", "name", F.coalesce("new", "data").alias("data"))


def rebuilt_documents(rows: DataFrame, content: Column) -> DataFrame:
    """SK3: (book, name, text) of documents put together from their spans."""
    return texts.rebuilt(rows, ["book", "place", "name"], content).drop("place")


def zipped(found: DataFrame) -> DataFrame:
    """SK3: (book, content): books of their entries in order, `mimetype` stored, the rest deflated, without times; a book is written by one worker, entry by entry."""
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = found.where("ordinal >= 0").repartition(parts, "book").sortWithinPartitions("book", "ordinal").select("book", "name", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, out, z = None, None, None

        def done() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([book], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["book", "content"])

        for batch in pieces(batches):
            for b, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z is None or b != book:
                    if z is not None:
                        yield done()
                    book, out = b, io.BytesIO()
                    z = zipfile.ZipFile(out, "w")
                z.writestr(zipfile.ZipInfo(name), data or b"", zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        if z is not None:
            yield done()

    return ordered.mapInArrow(run, "book long, content binary")


def audit(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """(book, severity, rule, detail) of built books against the books that are wanted with their language.

    wanted: book, language (null: whatever it is). built: book, content.
    Books are unzipped once into the shared folder, since all rules read their entries.
    """
    found = written(entries(built), "entries")
    packed = written(package(found), "package")
    columns = ["book", "severity", "rule", "detail"]

    def finding(rows: DataFrame, severity: str, rule: str, detail: Column) -> DataFrame:
        return rows.select("book", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail")).select(*columns)

    missing = finding(wanted.join(built.select("book").distinct(), "book", "left_anti"), "error", "epub_output_missing", F.lit(""))
    broken = finding(found.where("ordinal < 0"), "error", "epub_output_audit_failed", F.col("name"))
    bare = finding(found.where("ordinal >= 0").select("book").distinct().join(packed.select("book").distinct(), "book", "left_anti"), "error", "epub_output_audit_failed", F.lit("no package"))
    first = packed.where("kind = 'language'").groupBy("book").agg(F.min("value").alias("tag"))
    unlike = finding(wanted.where("language IS NOT NULL").join(packed.select("book").distinct(), "book").join(first, "book", "left").where(~F.col("tag").eqNullSafe(F.col("language"))), "error", "epub_output_policy_not_applied", F.coalesce("tag", F.lit("")))
    docs = documents(found, packed).join(wanted.where("language IS NOT NULL"), "book")
    tag = F.regexp_extract("html", r"<html\b[^>]*\slang=\"([^\"]*)\"", 1)
    pages = finding(docs.where(tag != F.col("language")), "error", "epub_output_policy_not_applied", F.col("name"))
    clash = finding(css_conflicts(found), "warn", "epub_output_css_conflict", F.concat("name", F.lit(": "), "declaration"))
    return missing.unionByName(broken).unionByName(bare).unionByName(unlike).unionByName(pages).unionByName(clash)
