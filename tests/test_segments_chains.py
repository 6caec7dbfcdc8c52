"""Sentences by SQL in both engines against the plain function; review chains that a running OR would get wrong."""

import random

import duckdb
import pandas as pd
import pytest

from segmenta.operators import records as R
from segmenta.plans import registry
from segmenta.plans.dialect import DUCK, SPARK
from segmenta.sources import segments
from tests.test_oracles import SF

BITS = ["Mr", "etc", "z.B", "No", "A", "3", "12", "345", "word", "Word", "núm", "NÚM", "Déc", ".", ".", "!", "?", "…", "...", '"', ")", "(", "“", "”", " ", " ", " ", "\n", "\t", " x", " Y", "'", "l'", "e.g", "\x0b", "\r\n", ""]


def expression(d):
    return d.trimmed(segments.split(d, "t", "coalesce(l, 'en')"))


def test_sentences_in_both_engines(spark):
    r = random.Random(1)
    rows = [("".join(r.choice(BITS) for _ in range(r.choice([3, 12, 40]))), r.choice(["en", "de", "fr", "es-MX", "da", "xx", None, "DE-at"])) for _ in range(5000)]
    spark.createDataFrame(rows, "t string, l string").createOrReplaceTempView("x")
    x = pd.DataFrame(rows, columns=["t", "l"])  # noqa: F841
    for found in (spark.sql(f"SELECT t, l, {expression(SPARK)} AS s FROM x").collect(), duckdb.sql(f"SELECT t, l, {expression(DUCK)} AS s FROM x").fetchall()):
        assert all([p for p in s if p] == segments.sentences(t, lang) for t, lang, s in found) and len(found) == len(rows)


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("Mr. Smith came. He left.", "en", ["Mr. Smith came.", "He left."]),
        ("Am 3. Mai 2020 kam er. Dann ging er.", "de", ["Am 3. Mai 2020 kam er.", "Dann ging er."]),
        ("It was 3. Then more.", "en", ["It was 3.", "Then more."]),
        ("1. 2. 3. 4. go", "en", ["1. 2. 3. 4. go"]),
        ("He said “Go.” Then left…  and came! Yes", "en", ["He said “Go.”", "Then left…  and came!", "Yes"]),
        ("J. R. Smith wrote p. ex. a book. End", "fr", ["J. R. Smith wrote p. ex. a book.", "End"]),
        ("one\ntwo\r\n\r\n three", "en", ["one", "two", "three"]),
        ("", None, []),
        (" \t\n", "de", []),
    ],
)
def test_sentences(text, language, want):
    assert segments.sentences(text, language) == want


def test_records_are_the_sentences(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in registry.queries()["sentence_records"](spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["record_pos"]] = r["source"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: s for k, d in docs.items() if (s := segments.sentences(d["text"] or "", d["lang"]))}


def test_a_chain_follows_bases_not_neighbours(spark):
    candidates = spark.createDataFrame([(1, 0, "1.1", "text")], "doc_id long, record_pos long, version_ref string, target string")
    held = candidates.selectExpr("sha2(target, 256)").first()[0]
    rows = [(1, 0, "R1.1", 1, 1, "1.1", "wrong", "a"), (1, 0, "R1.2", 1, 2, "1.1", held, "b"), (1, 0, "R1.3", 1, 3, "R1.1", "wrong", "c"), (1, 0, "R2.1", 2, 1, "R1.9", held, "d"), (1, 7, "R1.1", 1, 1, "1.1", held, "e")]
    reviews = spark.createDataFrame(rows, "doc_id long, record_pos long, review_ref string, pass_number int, run_number int, base_ref string, base_target_sha256 string, target string")
    got = {(r["record_pos"], r["review_ref"]): (r["has_base"], r["direct_stale"], r["chain_stale"], r["target"]) for r in R.chains(reviews, candidates).collect()}
    assert got == {(0, "R1.1"): (True, True, True, "a"), (0, "R1.2"): (True, False, False, "b"), (0, "R1.3"): (True, True, True, "c"), (0, "R2.1"): (False, True, True, "d"), (7, "R1.1"): (False, True, True, "e")}
    assert R.chains(reviews.limit(0), candidates).count() == 0


def test_the_effective_target_takes_the_fresh_review_beside_a_stale_one(spark):
    rows = registry.over(spark, SF, "SELECT active_review, kind FROM v_effective WHERE active_review = 'R1.3' AND review_status = 'accepted'").collect()
    assert rows and {r["kind"] for r in rows} == {"review"}
    stale = registry.over(spark, SF, "SELECT review_ref, bool_or(chain_stale) AS some, bool_and(chain_stale) AS every FROM v_chains GROUP BY review_ref").collect()
    assert {r["review_ref"]: (r["some"], r["every"]) for r in stale} == {"R1.1": (True, False), "R1.2": (True, False), "R1.3": (False, False), "R2.1": (True, False)}


def test_findings_take_one_pass(spark):
    plan = registry.queries()["findings_rollup"](spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("FileScan") < 15 and "NestedLoop" not in physical
