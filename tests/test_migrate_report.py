"""Safe migrations and protected names by hand and at random; the report's content rules against plain functions."""

import random
import re
from collections import Counter

import pytest

from segmenta.functions import migrate
from segmenta.functions.fragments import issues
from segmenta.operators.validate import SOURCE_QUOTES, TARGET_QUOTES
from segmenta.plans import registry
from tests.test_oracles import SF


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ('<em class="a">x</em>', "y", '<em class="a">y</em>'),
        (" <em>x</em> ", "y &amp; z", "<em>y &amp; z</em>"),
        ("see <b>Ten-day</b>.", "siehe Ten-day.", "siehe <b>Ten-day</b>."),
        ("see <b>A &amp; B</b>", "siehe A &amp; B", "siehe <b>A &amp; B</b>"),
        ("see <b>x</b>", "x und x", None),
        ("see <b>x</b>", "nichts", None),
        ('<b title="q">x</b> and', '<i title="x">y</i> x', None),
        ("<b>x</b> <i>y</i>", "x", None),
        ("a<br/>b", "a", None),
        ("<b>x", "x", None),
        ("<em>x</em>", "", None),
        ("plain", "plain", None),
    ],
)
def test_migrations_by_hand(source, target, want):
    assert migrate.migrated(source, target) == want


def test_every_mapped_target_breaks_no_rule(spark):
    r = random.Random(3)
    bits = ["<b>", "</b>", "<i a='1'>", "</i>", "x", "ten-day", " ", "&amp;", "–", "<br/>", "<code>k</code>"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.choice([2, 4, 6]))), "".join(r.choice(bits[4:8] if r.random() < 0.7 else bits) for _ in range(r.choice([1, 3, 6])))) for k in range(3000)] + [(9999, None, None)]
    got = migrate.migrations(spark.createDataFrame(rows, "k long, source string, target string"), {"k": "long"}).collect()
    by = {r[0]: r for r in rows}
    broken = {k for k, s, t in rows if any(x == "error" for x, _ in issues(s, t))}
    assert {x["k"] for x in got} == broken and Counter(x["action"] for x in got)["mapped"] >= 5
    for x in got:
        assert (x["new_target"] is None) == (x["action"] == "review")
        if x["new_target"] is not None:
            assert not any(sev == "error" for sev, _ in issues(by[x["k"]][1], x["new_target"]))


def test_protected_names():
    assert migrate.protect_names("Anna Maria and Anna", ["Anna", "Anna Maria", "", "Bob"]) == ("__NAME_001__ and __NAME_002__", [("__NAME_001__", "Anna Maria"), ("__NAME_002__", "Anna")])
    assert migrate.protect_names("x", ["Anna"]) == ("x", [])
    text, tokens = migrate.protect_names_in_text('<a title="Anna">Anna</a> Anna', ["Anna"])
    assert text == '<a title="Anna">__NAME_001__</a> __NAME_002__' and [n for _, n in tokens] == ["Anna", "Anna"]


def test_content_rules_equal_plain_functions(spark):
    from segmenta.operators import report
    from segmenta.plans.dialect import SPARK

    def plain(s, t):
        tokens, names = (re.compile(p).findall for p in (r"__(?:NAME|TAG)_\d+__", r"__NAME_\d+__"))
        either = lambda x, marks: len(x) >= 2 and x[0] + x[-1] in marks
        found = {
            "empty_target": not t.strip(), "placeholder_removed": set(tokens(s)) - set(tokens(t)), "placeholder_added": set(tokens(t)) - set(tokens(s)), "protected_name_changed": set(names(s)) - set(names(t)),
            "outer_quotation_marks_preserved": either(s, SOURCE_QUOTES) and not either(t, TARGET_QUOTES), "dash_semantic_cue_missing": re.search("[–—]", s) and not re.search("[–—]", t), "target_contains_soft_hyphen": "­" in t, "epub_legacy_placeholders": "__TAG_" in s or "__SPANTX_" in s,
        }
        return {k for k, v in found.items() if v}

    r = random.Random(7)
    bits = ["“", "”", "„", "«", "»", '"', "–", "x", " ", "­", "__NAME_001__", "__TAG_002__", "__NAME_003__", "\t"]
    rows = ["".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5]))) for _ in range(4000)]
    pairs = list(zip(rows[::2], rows[1::2], strict=True))
    spark.createDataFrame(pairs, "source string, target string").createOrReplaceTempView("content_pairs")
    cases = ", ".join(f"CASE WHEN {where} THEN '{rule}' END" for rule, (_, where) in report.content_rules(SPARK).items())
    for x in spark.sql(f"SELECT source, target, array_compact(array({cases})) AS rules FROM content_pairs").collect():
        assert set(x["rules"]) == plain(x["source"], x["target"])


def test_the_report_knows_most_rules(spark):
    rows = registry.queries()["validation_report"](spark, SF).collect()
    assert len({x["rule"] for x in rows}) >= 30 and {x["scope"] for x in rows} == {"active", "inactive"}
    assert all(x["severity"] == "warn" for x in rows if x["scope"] == "inactive")
