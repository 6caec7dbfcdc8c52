"""Term, record and text operators against expectations written by hand and plain loops."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from segmenta.operators import records as R
from segmenta.operators import terms as T
from segmenta.sources import segments, texts

ENTRIES = [T.Entry("the", target="le", require=True, forbidden=("trash",)), T.Entry("of the", ("of  the",), "du", forbidden=("de le",), enforce="warn"), T.Entry("Wasp", target="Wespe", require=True, case_sensitive=True), T.Entry("C++", target="C++", require=True), T.Entry("day", enforce="off", require=True, target="Tag")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- glossary ------------------------------------------------------------------------------------


def test_term_spans_against_a_plain_loop():
    r, matcher = random.Random(2), T.Matcher(ENTRIES)
    for _ in range(500):
        text = "".join(r.choice(["the", "of the", " ", " ", "Wasp", "wasp", "x", ",", "C++", "theme", "day"]) for _ in range(12))
        got = matcher.spans(text)
        accepted = []
        for k, term, start, end, shadowed in got:
            assert text[start:end].lower() == term.lower()
            assert shadowed == any(a <= start and end <= b for a, b in accepted)
            if not shadowed:
                accepted.append((start, end))
        for k, entry in enumerate(ENTRIES):
            for term in T.terms_of(entry.source, entry.variants):
                body, low = (text, term) if entry.case_sensitive else (text.lower(), term.lower())
                places = [i for i in range(len(body)) if body.startswith(low, i) and not (low[0].isalnum() and i and (body[i - 1].isalnum() or body[i - 1] == "_")) and not (low[-1].isalnum() and i + len(low) < len(body) and (body[i + len(low)].isalnum() or body[i + len(low)] == "_"))]
                assert sorted(s[2] for s in got if s[0] == k and s[1] == term) == places


@pytest.mark.parametrize(
    "source, target, want",
    [
        ("End of the day", "Fin du jour", []),
        ("End of the day", "Fin de le jour", [(1, "warn", "forbidden_term_used", "de le")]),
        ("the end of the day", "le trash", [(0, "warn", "glossary_alignment_ambiguous", "trash")]),
        ("the end", "trash", [(0, "error", "forbidden_term_used", "trash"), (0, "error", "glossary_target_missing", "")]),
        ("theme", "trash", []),
        ("wasp", "x", []),
        ("Wasp", "wespe", [(2, "error", "glossary_target_missing", "")]),
        ("in C++ now", "in C", [(3, "error", "glossary_target_missing", "")]),
        ("the end", None, []),
    ],
)
def test_glossary_rules(source, target, want):
    assert T.Matcher(ENTRIES).rules(source, target) == want


def test_glossary_findings_on_odd_rows(spark):
    rows = [(1, 0, "a", None, "x"), (1, 1, "b", "", None), (1, 1, "b", "the", "x"), (1, 1, "b", "the", "x")]
    pairs = spark.createDataFrame(rows, "doc_id long, record_pos long, record_id string, source string, target string").withColumn("term", F.lit("clash"))
    assert T.glossary_findings(pairs, ENTRIES).count() == 2 and T.glossary_findings(pairs.limit(0), ENTRIES).count() == 0
    assert T.glossary_findings(pairs, []).count() == 0 == T.term_spans(pairs.limit(0), ENTRIES).count()


# --- mining --------------------------------------------------------------------------------------


def windows(source, common, longest):
    """Every window, trimmed and judged one by one."""
    out = []
    for unit in re.split(r"[.,;:!?\n]", source):
        w = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)+|[^\W\d_]+", unit)
        edge = lambda x: x.lower() in common or len(x) <= 1
        for size in range(2, longest + 1):
            for i in range(len(w) - size + 1):
                part = w[i : i + size]
                while len(part) > 1 and edge(part[0]):
                    part = part[1:]
                while len(part) > 1 and edge(part[-1]):
                    part = part[:-1]
                if len(part) > 1 and not any(edge(x) or "-" in x for x in part):
                    out.append(" ".join(part))
    return sorted(out)


def test_phrases_against_every_window():
    r = random.Random(1)
    for _ in range(300):
        source = "".join(r.choice(["the ", "of ", "Wasp ", "kinden ", "ten-day ", "a ", ", ", "EMPIRE ", "low "]) for _ in range(14))
        for longest in (2, 3, 4):
            got = sorted(s for s, _, _, n in T.phrases_of(source, {"the", "of"}, longest) for _ in range(n))
            assert got == windows(source, {"the", "of"}, longest)


def test_case_buckets_and_ids(spark):
    words = {"Empire": "title", "empire": "lower", "EMPIRE": "upper", "eMpire": "mixed", "X": "upper", "McX": "mixed", "Éa": "title", "日本": "lower"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.case_bucket(F.col("w")).alias("b"), T.candidate_id(F.lit("en"), F.lower("w"), F.array(F.lower("w")), F.lit("title")).alias("i")).collect()
    for r in rows:
        assert r["b"] == words[r["w"]] == T.bucket_of(r["w"])
        payload = {"identity_ruleset_version": "1", "source_language": "en", "normalized": r["w"].lower(), "token_count": 1, "tokens": [r["w"].lower()], "case_bucket": "title"}
        assert r["i"] == "CAND-" + sha(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")))[:16].upper()


def test_risk_by_hand(spark):
    rows = [("ten-day", "lower", "hyphenated_term", ["ten", "day"], 3, 2), ("the", "lower", "word", ["the"], 50, 9), ("wasp", "title", "proper_name", ["wasp"], 1, 1), ("low lands", "lower", "phrase", ["low", "lands"], 1, 1), ("low lands", "lower", "phrase", ["low", "lands"], 9, 5)]
    made = spark.createDataFrame([(n, b, k, t, o, o, c, n) for n, b, k, t, o, c in rows], "normalized string, bucket string, kind string, tokens array<string>, occurrences long, records long, chapters long, surface string")
    got = {(r["normalized"], r["occurrences"]): r for r in T.scored(made, ["the", "of"], ["day"], []).collect()}
    import math

    ten = got["ten-day", 3]
    assert ten["review_bucket"] == "binding_glossary" and ten["rarity"] == 1.0 and ten["genericity"] == round(0.5 + 0.6 + 0.8, 6)
    assert ten["risk"] == round(4 * 1.6 + 2.5 + 2 * 1.4 + 1.5 * 1.5 + math.log(4) + 0.5 * 2 / 3 - 3 * 1.9, 6) and ten["score"] == round(math.log(4) * (1 + math.log(3)) * 1.5, 6)
    assert got["the", 50]["review_bucket"] == "no_action" and got["wasp", 1]["review_bucket"] == "name_policy" and got["wasp", 1]["lone"]
    assert got["low lands", 1]["review_bucket"] == "no_action" and got["low lands", 9]["review_bucket"] == "domain_phrase"


# --- reviews, exports, selectors -----------------------------------------------------------------


def test_chains_follow_their_bases(spark):
    """A review on another version is fresh though an earlier one is stale; missing, later and circular bases are stale."""
    candidates = spark.createDataFrame([(1, 0, "1.1", "a"), (1, 0, "1.10", "b"), (2, 0, "1.1", "z")], "doc_id long, record_pos long, version_ref string, target string")
    reviews = [("R1.1", 1, 1, "1.1", sha("wrong"), "c"), ("R1.2", 1, 2, "1.10", sha("b"), "d"), ("R2.1", 2, 1, "R1.2", sha("d"), "e"), ("R2.2", 2, 2, "R1.1", sha("c"), "f"), ("R2.3", 2, 3, "9.9", sha("x"), "g"), ("R3.1", 3, 1, "R3.2", sha("i"), "h"), ("R3.2", 3, 2, "R3.1", sha("h"), "i"), ("R3.3", 3, 3, "R2.1", sha("e"), "j")]
    table = spark.createDataFrame([(1, 0, *r) for r in reviews] + [(3, 0, "R1.1", 1, 1, "1.1", sha("a"), "q")], "doc_id long, record_pos long, review_ref string, pass_number long, run_number long, base_ref string, base_target_sha256 string, target string")
    got = {(r["doc_id"], r["review_ref"]): (r["direct_stale"], r["chain_stale"], r["chain"]) for r in R.chains(table, candidates).collect()}
    assert got == {
        (1, "R1.1"): (True, True, None), (1, "R1.2"): (False, False, "1.10>R1.2"), (1, "R2.1"): (False, False, "1.10>R1.2>R2.1"), (1, "R2.2"): (False, True, None), (1, "R2.3"): (True, True, None),
        (1, "R3.1"): (False, True, None), (1, "R3.2"): (False, True, None), (1, "R3.3"): (False, False, "1.10>R1.2>R2.1>R3.3"), (3, "R1.1"): (True, True, None),
    }
    assert R.chains(table.limit(0), candidates).count() == 0


def test_newest_version_by_numbers(spark):
    rows = [(1, 0, f"{v}.{s}", v, s) for v, s in ((1, 2), (1, 10), (1, 9))] + [(1, 1, "9.1", 9, 1), (1, 1, "10.1", 10, 1)]
    got = {r["record_pos"]: r["version_ref"] for r in R.newest(spark.createDataFrame(rows, "doc_id long, record_pos long, version_ref string, version long, subversion long")).collect()}
    assert got == {0: "1.10", 1: "10.1"}


def test_export_needs_every_record(spark):
    records = spark.createDataFrame([(1, p, f"000{1 + p // 2}") for p in range(6)], "doc_id long, record_pos long, chunk_id string")
    candidates = spark.createDataFrame([(1, p, f"1.{s}", 1, s, f"t{s}", "rejected" if (p, s) == (3, 10) else "accepted") for p in (0, 1, 2, 3, 4) for s in (9, 10)], "doc_id long, record_pos long, version_ref string, version long, subversion long, target string, status string")
    store = spark.createDataFrame([(1, p, "1.10") for p in range(5)], "doc_id long, record_pos long, active_version string")
    none = records.limit(0)

    def chunks(mode, ref=None, errors=none):
        return sorted(r["chunk_id"] for r in R.export(records, R.picks(store, candidates, mode, ref), errors).collect())

    assert chunks("active") == ["0001"] and chunks("version", "1.9") == ["0001", "0002"] == chunks("track", "1") and chunks("version", "2.1") == []
    assert chunks("track", "1", records.where("record_pos = 1")) == ["0002"]
    assert {r["version_ref"] for r in R.picks(store, candidates, "track", "1").where("record_pos <> 3").collect()} == {"1.10"}


def test_record_ranges(spark):
    rows = spark.createDataFrame([(d, p, f"{p // 3 + 1:04d}-{p % 3 + 1:06d}", f"{p // 3 + 1:04d}", p // 4 + 1) for d in (1, 2) for p in range(9 if d == 1 else 4)], "doc_id long, record_pos long, record_id string, chunk_id string, chapter_no int")

    def at(selector):
        return sorted((r["doc_id"], r["record_pos"]) for r in R.record_range(selector, rows).collect())

    assert at("1@2..0003-000001") == [(1, p) for p in range(1, 7)] and at(" 2-1+3 ") == [(1, 3), (1, 4), (1, 5), (2, 3)]
    assert at("chunk:2") == [(1, 3), (1, 4), (1, 5), (2, 3)] and at("chapter:1") == [(d, p) for d in (1, 2) for p in range(4)] and at("1-1") == [(1, 0), (2, 0)]
    for wrong in ("1..2", "x", "1-1+0"):
        with pytest.raises(ValueError):
            R.record_range(wrong, rows)


def test_language_policy(spark):
    rows = [(1, "explicit", None, "en", "de"), (2, "explicit", "de-AT", "en", "de"), (3, "explicit", "german!", "en", "de"), (4, "preserve", None, "en", "de"), (5, "preserve", None, "en", "en"), (6, "explicit", "zh-Hant-TW", "en", "zh")]
    got = {r["doc_id"]: (r["rule"], r["severity"]) for r in R.language_policy(spark.createDataFrame(rows, "doc_id long, policy string, tag string, source_language string, target_language string")).collect()}
    assert got == {1: ("epub_output_explicit_language_missing", "error"), 3: ("invalid_epub_output_language", "error"), 4: ("epub_output_language_policy_preserves_source", "warn")}


# --- texts ---------------------------------------------------------------------------------------


def test_front_matter_and_markdown():
    text = "---\ntitle: x\n---\n# Head *one* #\n\nPara one\nline two\n\n- item a\n- item b\n  more\n\n```py\ncode\n```\n\n> quoted text\n\n| a | b |\n|---|---|\n| c |  |\n\n    indented code\n\nUnder\n=====\n\n<div>\nraw\n</div>\n\n1. first\n\n***\nlast"
    assert texts.front_matter(text)[0] == "---\ntitle: x\n---\n" and texts.front_matter("a\n---\n") == ("", "a\n---\n")
    want = [("heading", "Head *one*"), ("paragraph", "Para one\nline two"), ("item", "item a"), ("item", "item b\nmore"), ("quote", "quoted text"), ("cell", "a"), ("cell", "b"), ("cell", "c"), ("heading", "Under"), ("item", "first"), ("paragraph", "last")]
    assert texts.markdown_blocks(text) == want and texts.markdown_blocks("") == []


def test_xhtml_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>A &amp; b</h1><p>One <b>two</b><br/>three <code>x &lt; y</code></p><ul><li>item</li></ul><pre>no</pre><p> </p>tail</body></html>"
    got = texts.xhtml_blocks(page)
    assert [(e, t) for e, t, _ in got] == [("h1", "A & b"), ("p", "One __TAG_001__two__TAG_002____TAG_003__three __TAG_004__"), ("li", "item"), ("body", "tail")]
    assert got[1][2][:3] == ["<b>", "</b>", "<br/>"] and got[1][2][3].startswith("<code>")
    assert texts.xhtml_blocks("") == []


def test_hidden_inline_is_restored():
    hidden, tokens = texts.hide_inline("See `a <b>` and [x](http://u.v/w \"t\") or <i>it</i> `a <b>`")
    assert hidden == "See __TAG_002__ and [x](__TAG_001__ \"t\") or __TAG_004__it__TAG_003__ __TAG_002__" and len(tokens) == 4
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["`a`", "<b>", "](u)", "[x", " ", "word", "<", ">"]) for _ in range(10))
        assert texts.restore(*texts.hide_inline(text)) == text


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("Dr. Who came. He left!", "en", ["Dr. Who came.", "He left!"]),
        ("Das ist z.B. gut. Ende", "de", ["Das ist z.B. gut.", "Ende"]),
        ("J. R. Smith saw it. “Really?” she said.", "en", ["J. R. Smith saw it.", "“Really?” she said."]),
        ("One… two. Three\n\nFour", "xx", ["One… two.", "Three", "Four"]),
        ("Es kostet ca. 5 Euro.", "de-AT", ["Es kostet ca. 5 Euro."]),
        ("", "en", []),
    ],
)
def test_sentences(text, language, want):
    assert segments.sentences(text, language) == want


def test_submissions():
    block = "# note: first\n>>> 1-1\n\nEin Satz.\n# keep me\nNoch einer.\n\n# tail\n>>> 1-2\nZwei.\n"
    assert texts.block_submission(block) == [("1-1", "Ein Satz.\n# keep me\nNoch einer.", ""), ("1-2", "Zwei.", "")]
    assert [texts.block_submission(t)[0][2] for t in ("", "x\n>>> a\ny", ">>> a\n# c\n", ">>> a\nx\n>>> a\ny")] == ["empty_block_submission", "malformed_block", "empty_block_target", "duplicate_block_record"]
    assert texts.tsv_submission("a\tb\tc\n\n x \t") == [("a", "b\tc", ""), ("x", "", "")] and texts.tsv_submission("ab")[0][2] == "malformed_tsv"
    assert texts.json_submission('{"records": [{"id": " a ", "target": "b"}]}') == [("a", "b", "")]
    for bad in ("", "[]", '{"records": 1}', '{"records": [{"id": 1, "target": "b"}]}', 'x {"records": []}', '{"records": []} y', '{"version": "1", "records": []}'):
        assert texts.json_submission(bad) == [("", "", "invalid_json_submission")]
    assert texts.judge_submission("## 1-1\nDECISION: copy A\nTARGET:\nx\n\ny\n\n## 1-2\nDECISION: edit\nTARGET: z") == [("1-1", "copy A", "x\n\ny"), ("1-2", "edit", "z")]


def test_surface_histograms_by_hand(spark):
    rows = [(2, 0, "Wasp wasp WASP Wasp."), (1, 5, "wasp, Bee y Y"), (1, 6, None)]
    got = {(r["normalized"], r["bucket"]): (r["surfaces"], r["first_doc"], r["first_pos"]) for r in T.histograms(spark.createDataFrame(rows, "doc_id long, record_pos long, source string")).collect()}
    assert got == {("wasp", "title"): ("Wasp=2", 2, 0), ("wasp", "lower"): ("wasp=2", 1, 5), ("wasp", "upper"): ("WASP=1", 2, 0), ("bee", "title"): ("Bee=1", 1, 5), ("y", "lower"): ("y=1", 1, 5), ("y", "upper"): ("Y=1", 1, 5)}
