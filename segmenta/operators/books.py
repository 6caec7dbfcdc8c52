"""Queries over EPUB books made of documents: spans, navigation, books built again, output policy and audit."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators.wired import xhtml_turns
from segmenta.plans.shared import written
from segmenta.sources import epub, xhtml

Over = Callable[[str], DataFrame]
_OPEN = '<html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>t</title></head><body>\n'
_CLOSE = "\n</body></html>"


def _book(doc: int, lang: str | None, chapters: list, texts: list) -> list[tuple[int, bytes]]:
    """A book: a chapter's file has a blank in its name; every third book has an NCX file instead of a navigation document."""
    ncx, out = doc % 3 == 0, io.BytesIO()
    files = [f"text/ch {c}.xhtml" for c in chapters]
    hrefs = [f.replace(" ", "%20") for f in files]
    nav = "".join(f'<li><a href="{h}#top">Chapter <b>{c}</b></a></li>' for h, c in zip(hrefs, chapters, strict=True))
    points = "".join(f'<navPoint><navLabel><text>Chapter {c}</text></navLabel><content src="{h}#top"/></navPoint>' for h, c in zip(hrefs, chapters, strict=True))
    manifest = "".join(f'<item id="c{c}" href="{h}" media-type="application/xhtml+xml"/>' for h, c in zip(hrefs, chapters, strict=True)) + ('<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else '<item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>')
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:language>{lang or "en"}</dc:language></metadata><manifest>{manifest}</manifest><spine>{"".join(f"<itemref idref={chr(34)}c{c}{chr(34)}/>" for c in chapters)}</spine></package>'
    made = {"mimetype": "application/epub+zip", epub.CONTAINER: '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>', "OEBPS/book.opf": opf}
    made["OEBPS/toc.ncx" if ncx else "OEBPS/nav.xhtml"] = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>' if ncx else f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><a href="x">no</a></nav><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>'
    made["OEBPS/style.css"] = "p { hyphens:  none; word-break: break-all } h1 { color: red }" if doc % 4 == 1 else "p { margin: 0 }"
    made |= {f"OEBPS/{f}": _OPEN + t + _CLOSE for f, t in zip(files, texts, strict=True)}
    with zipfile.ZipFile(out, "w") as z:
        for name, text in made.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return [(doc, out.getvalue())]


def books(over: Over) -> DataFrame:
    """(book, content) of all documents with text."""
    rows = over("SELECT c.doc_id, c.chapter, c.text, d.lang FROM v_chapters c JOIN documents d ON d.doc_id = c.doc_id")
    one = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("chapter", "text"))).alias("c"))
    return epub._rows(one.select("doc_id", "lang", F.col("c.chapter").alias("chapters"), F.col("c.text").alias("texts")), ["doc_id", "lang", "chapters", "texts"], "book long, content binary", _book)


def opened(over: Over) -> tuple[DataFrame, DataFrame]:
    found = written(epub.entries(books(over)), "entries")
    return found, written(epub.package(found), "package")


def translated(docs: DataFrame) -> DataFrame:
    """(book, name, text): documents whose blocks come back between marks."""

    def work(book: int, name: str, page: str) -> list[tuple[int, str, str]]:
        return [(book, name, "".join(before + (xhtml.refill(f"«{block}»", tokens, tags, forms) if block is not None else "") for block, before, tokens, tags, forms in xhtml.with_forms(page)))]

    return epub._rows(docs, ["book", "name", "html"], "book long, name string, text string", work)


def epub_rebuild(over: Over) -> DataFrame:
    """Books unzipped, translated, zipped and unzipped again: each document's text as it was put together unchanged, and translated."""
    found, packed = opened(over)
    docs = epub.documents(found, packed)
    same = epub.rebuilt_documents(epub.spans(docs), F.col("content")).select("book", "name", F.sha2("text", 256).alias("same_sha256"))
    again = written(epub.entries(epub.zipped(epub.replaced(found, translated(docs)))), "entries")
    back = epub.documents(again, epub.package(again)).select("book", "name", F.sha2("html", 256).alias("translated_sha256"))
    return same.join(back, ["book", "name"])


def built(over: Over) -> tuple[DataFrame, DataFrame]:
    """(wanted, built): books under a policy; of some the output is missing, no zip, or without the policy."""
    found, packed = opened(over)
    languages = packed.select("book").distinct().withColumn("language", F.when(F.col("book") % 5 < 3, F.lit("de-AT")))
    kept = languages.withColumn("language", F.when(F.col("book") % 5 != 1, F.col("language")))
    made = epub.zipped(epub.apply_policy(found, packed, kept, "auto")).where("book % 7 <> 2")
    return languages, made.withColumn("content", F.when(F.col("book") % 7 == 3, F.lit(b"no zip")).otherwise(F.col("content")))


FRAMES: dict[str, Callable[[SparkSession, Over], DataFrame]] = {
    # SC5, SC7
    "epub_spans": lambda spark, over: epub.spans(epub.documents(*opened(over))).where("element <> 'tail' AND element <> 'title'").select("book", "name", "pos", "element", "block"),
    # SC8, PR22
    "epub_navigation": lambda spark, over: epub.navigation(*opened(over)),
    # SC27
    "epub_css_conflicts": lambda spark, over: epub.css_conflicts(opened(over)[0]),
    # SK3
    "epub_rebuild": lambda spark, over: epub_rebuild(over),
    # SK4, V47, V54-V58
    "epub_output_audit": lambda spark, over: epub.audit(*built(over)),
}

_NAME = "'OEBPS/text/ch ' || chapter::VARCHAR || '.xhtml'"
_LISTED = f"SELECT DISTINCT doc_id AS book, chapter, {_NAME} AS name FROM v_chapters"
_BUILT = "book % 7 NOT IN (2, 3)"

ORACLES: dict[str, str] = {
    "epub_spans": f"SELECT doc_id AS book, {_NAME} AS name, pos, b.kind AS element, b.block AS block FROM ({xhtml_turns('doc_id, chapter')}) t",
    "epub_navigation": f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY chapter) - 1 AS number, name, 'top' AS fragment, 'Chapter ' || chapter::VARCHAR AS title FROM ({_LISTED}) c",
    "epub_css_conflicts": "SELECT DISTINCT doc_id AS book, 'OEBPS/style.css' AS name, unnest(['hyphens: none', 'word-break: break-all']) AS declaration FROM v_chapters WHERE doc_id % 4 = 1",
    "epub_rebuild": f"SELECT a.doc_id AS book, 'OEBPS/text/ch ' || a.chapter::VARCHAR || '.xhtml' AS name, sha256('{_OPEN}' || a.text || '{_CLOSE}') AS same_sha256, sha256('{_OPEN}' || b.text || '{_CLOSE}') AS translated_sha256 FROM v_chapters a JOIN v_chapters_translated b ON b.doc_id = a.doc_id AND b.chapter = a.chapter",
    "epub_output_audit": f"""SELECT * FROM (WITH c AS ({_LISTED}), b AS (SELECT DISTINCT book FROM c)
SELECT book, 'error' AS severity, 'epub_output_missing' AS rule, '' AS detail FROM b WHERE book % 7 = 2
UNION ALL SELECT book, 'error', 'epub_output_audit_failed', 'BadZipFile' FROM b WHERE book % 7 = 3
UNION ALL SELECT b.book, 'error', 'epub_output_policy_not_applied', coalesce(d.lang, 'en') FROM b JOIN documents d ON d.doc_id = b.book WHERE {_BUILT.replace('book', 'b.book')} AND b.book % 5 = 1
UNION ALL SELECT book, 'error', 'epub_output_policy_not_applied', name FROM c WHERE {_BUILT} AND book % 5 = 1
UNION ALL SELECT book, 'warn', 'epub_output_css_conflict', 'OEBPS/style.css: ' || unnest(['hyphens: none', 'word-break: break-all']) FROM b WHERE {_BUILT} AND book % 4 = 1) f""",
}
