"""EPUB books: written expectations, books put together again, policy and audit, odd books."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from segmenta.operators import books as B
from segmenta.sources import epub

CHAPTER = '<?xml version="1.0"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en">\n<head><title>T</title></head>\n<body><h1>One &amp; two</h1><p>A <i>b</i>&#160;c.</p></body></html>'


def book(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def sample(extra="", language="en"):
    opf = f'<package xmlns:dc="d"><metadata><dc:language>{language}</dc:language></metadata><manifest><item id="a" href="a%20b.xhtml"/><item id="gone" href="gone.xhtml"/><item id="n" href="../nav.xhtml" properties="nav scripted"/></manifest><spine><itemref idref="gone"/><itemref idref="a"/><itemref idref="unknown"/></spine></package>'
    nav = '<html xmlns:epub="e"><nav epub:type="page-list"><a href="no">no</a></nav><nav epub:type="toc"><a href="O/a%20b.xhtml#x">  One\n<b>two</b> </a></nav></html>'
    return book(**{"mimetype": "application/epub+zip", epub.CONTAINER: "<rootfile full-path='O/p.opf'/>", "O/p.opf": opf, "O/a b.xhtml": CHAPTER, "nav.xhtml": nav, "O/s.css": "p{hyphens : none;Word-Break:\n break-all} a{-webkit-hyphens: x}" + extra})


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, sample()), (2, b"no zip"), (3, None), (4, book(**{"mimetype": "x"})), (5, book(**{epub.CONTAINER: "<rootfile full-path='p'/>", "p": "<package"}))]
    return epub.entries(spark.createDataFrame(rows, "book long, content binary"))


def test_package_spine_and_navigation(found):
    packed = epub.package(found)
    assert sorted((r["book"], r["kind"], r["place"], r["value"]) for r in packed.collect()) == [(1, "language", 0, "en"), (1, "nav", 0, "nav.xhtml"), (1, "spine", 0, "O/gone.xhtml"), (1, "spine", 1, "O/a b.xhtml")]
    assert [tuple(r) for r in epub.navigation(found, packed).collect()] == [(1, 0, "O/a b.xhtml", "x", "One two")]
    docs = epub.documents(found, packed)
    assert [(r["book"], r["place"], r["name"]) for r in docs.collect()] == [(1, 1, "O/a b.xhtml")]
    assert [(r["element"], r["block"]) for r in epub.spans(docs).where("element <> 'tail'").orderBy("pos").collect()] == [("h1", "One & two"), ("p", "A __TAG_001__b__TAG_002__\xa0c.")]
    assert epub.rebuilt_documents(epub.spans(docs), F.col("content")).first()["text"] == CHAPTER
    assert sorted((r["book"], r["name"]) for r in found.where("ordinal < 0").collect()) == [(2, "BadZipFile"), (3, "BadZipFile")]


def test_css_conflicts(found):
    assert sorted(r["declaration"] for r in epub.css_conflicts(found).collect()) == ["Word-Break: break-all", "hyphens : none"]


@pytest.mark.parametrize(("base", "href", "want"), [("a/b.xhtml", "../c%20d.xhtml#e", "c d.xhtml"), ("b.xhtml", "c/./d", "c/d"), ("a/b.xhtml", "#x", "a/b.xhtml"), ("a/b", "c?q=1", "a/c")])
def test_references(base, href, want):
    assert epub.resolve(base, href) == want


def test_policy_is_applied_once():
    once = epub.with_policy(CHAPTER, "de-AT", epub.policy_css("auto"))
    assert once == epub.with_policy(once, "de-AT", epub.policy_css("auto")) and once.count("lang=") == 2 and 'xml:lang="de-AT"' in once and once.count("<style") == 1
    assert epub.with_policy(once, None, "").count("<style") == 0 and epub.with_policy("<p>x</p>", "de", "") == "<p>x</p>" and epub.policy_css("preserve") == ""


def test_books_are_zipped_again(spark, found):
    back = epub.entries(epub.zipped(found))
    assert sorted((r["book"], r["ordinal"], r["name"], bytes(r["data"])) for r in back.collect()) == sorted((r["book"], r["ordinal"], r["name"], bytes(r["data"])) for r in found.where("ordinal >= 0").collect())
    content = epub.zipped(found).where("book = 1").first()["content"]
    assert zipfile.ZipFile(io.BytesIO(content)).infolist()[0].compress_type == zipfile.ZIP_STORED
    assert epub.zipped(found.where("false")).count() == 0


def test_audit_of_built_books(spark, found):
    packed = epub.package(found)
    languages = spark.createDataFrame([(1, "de")], "book long, language string")
    good = epub.zipped(epub.apply_policy(found.where("book = 1"), packed, languages, "auto"))
    wanted = spark.createDataFrame([(1, "de"), (2, "de"), (4, None), (9, "de")], "book long, language string")
    built = good.union(spark.createDataFrame([(2, bytearray(b"x")), (4, bytearray(book(a="b")))], "book long, content binary"))
    got = {tuple(r) for r in epub.audit(wanted, built).collect()}
    assert got == {(9, "error", "epub_output_missing", ""), (2, "error", "epub_output_audit_failed", "BadZipFile"), (4, "error", "epub_output_audit_failed", "no package"), (1, "warn", "epub_output_css_conflict", "O/s.css: Word-Break: break-all"), (1, "warn", "epub_output_css_conflict", "O/s.css: hyphens : none")}
    unlike = {(r["rule"], r["detail"]) for r in epub.audit(wanted.where("book = 1").withColumn("language", F.lit("fr")), good).where("severity = 'error'").collect()}
    assert unlike == {("epub_output_policy_not_applied", "de"), ("epub_output_policy_not_applied", "O/a b.xhtml")}


def test_made_books_open_without_a_fault(spark):
    ((_, content),) = B._book(3, "de", [0, 1], ["<p>a</p>", "<p>b</p>"])
    found = epub.entries(spark.createDataFrame([(3, bytearray(content))], "book long, content binary"))
    assert [r["title"] for r in epub.navigation(found, epub.package(found)).orderBy("number").collect()] == ["Chapter 0", "Chapter 1"]
