"""Gates, fragments and streams: oracles and hand-made cases."""

import duckdb
import pytest

from segmenta.functions.fragments import fragment_findings, issues
from segmenta.operators import gates
from segmenta.plans import registry
from segmenta.streaming.windows import windowed
from tests.test_oracles import SF, rows


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*gates.QUERIES, "stream_event_windows"])
def test_matches_oracle(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF).toPandas())
    assert got and got == rows(duck.execute(registry.oracles()[name]).df())


@pytest.mark.parametrize(
    ("source", "target", "rules"),
    [
        ("<em>a</em> b", "<em>x</em> y", set()),
        ("<br/>a", "<br></br>b", set()),
        ("a", "", {"inline_xhtml_visible_text_not_empty"}),
        (None, None, {"inline_xhtml_visible_text_not_empty"}),
        ("<em>a</em>", "x", {"inline_xhtml_preserved"}),
        ("<em>a</em>", "<em>x", {"inline_xhtml_parseable"}),
        ("a", "<!-- c -->x", {"inline_xhtml_parseable"}),
        ("<em>a</em>", '<em onclick="f">x</em>', {"inline_xhtml_preserved", "inline_xhtml_no_new_attributes"}),
        ("a", "<p>x</p>", {"inline_xhtml_no_block_tags", "inline_xhtml_preserved", "inline_xhtml_no_new_attributes"}),
        ("<code>a</code>", "<code>b</code>", {"inline_xhtml_opaque_preserved"}),
        ("a – b", "x, y", {"dash_semantic_cue_missing"}),
    ],
)
def test_fragment_rules(source, target, rules):
    assert {rule for _, rule in issues(source, target)} == rules


def test_fragment_frame(spark):
    pairs = spark.createDataFrame([(1, "<i>a</i>", "a", "k"), (2, "a", "b", "k"), (1, "<i>a</i>", "a", "k"), (3, None, None, None)], "id long, source string, target string, rule string")
    assert sorted((r["id"], r["rule"]) for r in fragment_findings(pairs, ["id"]).collect()) == [(1, "inline_xhtml_preserved")] * 2 + [(3, "inline_xhtml_visible_text_not_empty")]
    assert fragment_findings(pairs.limit(0), ["id"]).count() == 0


def test_inline_rule_over_the_table(spark):
    found = {r["rule"] for r in registry.queries()["rule_inline_xhtml"](spark, SF).select("rule").distinct().collect()}
    assert {"inline_xhtml_parseable", "inline_xhtml_preserved", "inline_xhtml_no_new_attributes", "inline_xhtml_opaque_preserved", "inline_xhtml_no_block_tags"} <= found


def test_invalid_files(spark):
    chunks = registry.queries()["chunk_packing"](spark, SF).select("doc_id", "chunk_id").collect()
    found = {(r["doc_id"], r["chunk_id"]) for r in registry.queries()["rule_invalid_json"](spark, SF).collect()}
    assert found == {(r["doc_id"], r["chunk_id"]) for r in chunks if (r["doc_id"] + int(r["chunk_id"])) % 8}


def test_windows_leave_out_events_without_time(spark):
    rows_in = [(1, None, 2.0, "a"), (2, "2026-01-01 10:59:59", None, "a"), (3, "2026-01-01 11:00:00", 1.0, None)]
    events = spark.createDataFrame(rows_in, "event_id long, ts string, value double, event_type string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "value", "event_type")
    assert sorted((str(r[0]), r[1] or "", r[2], r[3], r[4]) for r in windowed(events).collect()) == [("2026-01-01 10:00:00", "a", 1, None, 2), ("2026-01-01 11:00:00", "", 1, 1.0, 3)]


def test_block_lint_and_acceptance_reach_every_chunk(spark):
    records = registry.queries()["sentence_records"](spark, SF).select("doc_id", "record_id").collect()
    assert any(r["record_id"][:4] > "0001" for r in records)
    lint = {(r["doc_id"], r["record_id"]): r["lint"] for r in registry.queries()["block_lint"](spark, SF).collect()}
    gate = {(r["doc_id"], r["record_id"]): r["gate"] for r in registry.queries()["acceptance_gates"](spark, SF).collect()}
    for r in records:
        key, at = (r["doc_id"], r["record_id"]), int(r["record_id"][5:]) - 1
        pos = 50 * (int(r["record_id"][:4]) - 1) + at
        assert lint[key] == ("empty_target" if pos % 7 == 3 else "missing" if pos % 7 == 5 else "ok")
        assert gate[key] == ("missing" if at < 3 else "not_in_task" if 10 <= at <= 12 else "duplicate" if at == 5 else "ok")
    assert len(lint) == len(gate) == len(records)
