"""Markdown, XHTML and inline sources: written expectations, and round trips of random texts, the tables and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from segmenta.sources import markdown, texts, xhtml
from tests.test_oracles import SF


def blocks(text):
    return [(k, b) for k, b, _, _ in markdown.rows(text) if k != "tail"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<em>Hello</em> world, this is prose.", [("paragraph", "<em>Hello</em> world, this is prose.")]),
        ("<https://x.org> is a site.", [("paragraph", "<https://x.org> is a site.")]),
        ("<em class='a'>\nraw\n\nprose", [("paragraph", "prose")]),
        ("<script>\na\n\nb\n</script>\nprose", [("paragraph", "prose")]),
        ("<!-- a\n\nb -->\nprose", [("paragraph", "prose")]),
        ("[ref]: http://x.org\n\n[ref]: u 'title'\nprose", [("paragraph", "prose")]),
        ("> a\nlazy\n> b\n\n> - item\n>   more\n> - two\n\nend", [("quote", "a\nlazy\nb"), ("item", "item\nmore"), ("item", "two"), ("paragraph", "end")]),
        ("1. one\n\n   still one\n\n2. two\n\n       code\n\npara", [("item", "one"), ("item", "still one"), ("item", "two"), ("paragraph", "para")]),
        ("- a\n  - b\n\n    c\n- d", [("item", "a"), ("item", "b"), ("item", "c"), ("item", "d")]),
        ("> ```\n> code\n\nprose", [("paragraph", "prose")]),
        ("| a | b |\n|---|---|\n| c \\| x |  |\nd | e\n\nz", [("cell", "a"), ("cell", "b"), ("cell", "c \\| x"), ("cell", "d"), ("cell", "e"), ("paragraph", "z")]),
        ("a | b\n---\n", [("heading", "a | b")]),
        ("a\n***\nb\n---\nc", [("paragraph", "a"), ("heading", "b"), ("paragraph", "c")]),
        ("text\n14. no item\nmore", [("paragraph", "text\n14. no item\nmore")]),
        ("\tcode\n\nx\r\ny", [("paragraph", "x\ny")]),
        ("", []),
        ("\n \n", []),
    ],
)
def test_markdown_spans(text, want):
    assert blocks(text) == want


def whole(rows):
    out = []
    for _, block, before, joints in rows:
        out.append(before)
        lines = block.split("\n") if block is not None else []
        out += [x for k, line in enumerate(lines) for x in ([joints[k - 1]] if k else []) + [line]]
    return "".join(out)


def test_markdown_goes_back_byte_for_byte():
    r = random.Random(2)
    bits = ["# ", "> ", "- ", "1. ", "2) ", "```", "~~~", "|", "a", "b c", "<div>", "</div>", "<b>", "<!--", "-->", "\n", "\n", "\n\n", "    ", "\t", " ", "---", "===", "| a | b |\n|---|---|", "[r]: u", "\r\n", "`x`", "*", " \n", "\r", "---\n", "\x0c", " "]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.choice([3, 8, 20])))
        assert whole(markdown.rows(text)) == text


def test_markdown_of_long_texts_is_linear():
    import time

    def took(n):
        at = time.process_time()
        markdown.rows("> - a line of prose\n" * n + "|a|b|\n|-|-|\n" + "|x|y|\n" * n)
        return time.process_time() - at

    took(500)
    assert took(20_000) < 30 * max(took(2_000), 0.01)


def test_targets_with_other_numbers_of_lines(spark):
    df = spark.createDataFrame([(1, "> a\n> b\n\nend"), (2, None), (3, "x")], "id long, text string")
    rows = texts.markdown_spans(df, {"id": "long"}, "text")
    for target, want in ((F.lit("one"), "> one\n\none"), (F.lit("1\n2\n3"), "> 1\n> 2\n> 3\n\n1\n2\n3")):
        got = {r["id"]: r["text"] for r in texts.rebuilt(rows, ["id"], texts.relined(F.when(F.col("kind") != "tail", target), F.col("joints"))).collect()}
        assert got[1] == want and got[2] == "" and got[3] == want.split("\n\n")[1]


def test_xhtml_blocks_with_tags_inside_code():
    got = xhtml.rows("<p>a <code>x<b>y</b></code> b</p>")
    assert got[0][:2] == ("p", "a __TAG_001__ b") and got[0][4] == ["<code>x<b>y</b></code>"]
    got = xhtml.rows("<p>a&nbsp;b  c&quot;\"__TAG_001__ <i>x</i></p><!-- <p>no</p> --><pre>no</pre>")
    assert [r[1] for r in got] == ["a\xa0b c\"\"__TAG_001__ __TAG_002__x__TAG_003__", None]


def test_xhtml_translation_keeps_references_and_tags():
    ((block, _, tokens, tags, forms), _) = xhtml.with_forms("<p>It&#8217;s <b>A &amp; B</b> &lt; it’s</p>")
    assert block == "It’s __TAG_001__A & B__TAG_002__ < it’s"
    assert xhtml.refill("C’est __TAG_001__B & A__TAG_002__ > l’un > 1", tokens, tags, forms) == "C&#8217;est <b>B &amp; A</b> &gt; l’un &gt; 1"


def test_xhtml_goes_back_byte_for_byte(spark):
    r = random.Random(3)
    bits = ["<p>", "</p>", "<b>", "</b>", "<br/>", "<code>", "</code>", "<pre>", "</pre>", "text", " ", "\n", "&amp;", "&nbsp;", "&#8217;", "’", '"', "&quot;", "<", "&", ">", "&gt;", "<!-- c -->", "<script>", "</script>", "__TAG_001__", "<div class='>'>", "</div>", "<img src=x>", "é", "<![CDATA[", "]]>", '<a href="u">', "</a>", "&notareal;", "&lt", "<head>", "</head>", "\xa0"]
    pages = ["".join(r.choice(bits) for _ in range(r.choice([3, 8, 25]))) for _ in range(20_000)]
    pages += [x["html"] or "" for x in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for page in pages:
        assert "".join(before + content for _, _, before, _, _, content in xhtml.rows(page)) == page


def test_hidden_parts_pass_over_numbers_in_use():
    hidden, tokens = texts.hide_inline("__TAG_001__ [1](1) and 1 `x` <b>1</b>")
    assert hidden == "__TAG_001__ [1](__TAG_005__) and 1 __TAG_003__ __TAG_004__1__TAG_002__" and [o for _, o in tokens] == ["</b>", "`x`", "<b>", "1"]
    assert texts.restore(hidden, tokens) == "__TAG_001__ [1](1) and 1 `x` <b>1</b>"
    assert texts.restore("__TAG_002__", [("__TAG_002__", "__TAG_001__"), ("__TAG_001__", "x")]) == "__TAG_001__"


def test_block_submissions_report_the_first_error():
    assert texts.block_submission(">>> a\n>>> b\nx")[0] == ("a", "", "empty_block_target")
    assert texts.block_submission(">>> a\nx\n>>> a\n")[0] == ("a", "", "duplicate_block_record")
    assert texts.block_submission("# c\n\n>>> a\n# kept\nx\n\n# gone\n") == [("a", "# kept\nx", "")]
    assert texts.block_submission("# c\nx\n>>> a\ny") == [("", "", "malformed_block")]
