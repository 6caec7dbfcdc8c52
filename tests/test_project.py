"""Scans, snapshots, extraction, acceptance, todos, merges, preflight and analysis against brute force and written expectations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from segmenta.functions.fragments import issues
from segmenta.operators import merging, preflight, writes
from segmenta.plans import registry
from segmenta.plans.snapshots import Conflict, Snapshots
from segmenta.sources import analysis, scans, texts
from segmenta.streaming import todos
from tests.test_oracles import SF

# --- scans ---------------------------------------------------------------------------------------


def test_chunk_files_on_disk(spark, tmp_path):
    whole = {"chunk_id": "0001", "records": [{"id": "0001-000001", "source": "A “b”\n", "more": 1}, {"id": "0001-000002", "source": ""}]}
    files = {
        "good": json.dumps(whole, indent=1), "cut": json.dumps(whole)[:-1], "around": "Here: " + json.dumps(whole), "two": json.dumps(whole) + ", " + json.dumps(whole), "list": "[1]", "empty": "", "old": json.dumps(whole | {"schema_version": 9}),
        "text_version": json.dumps(whole | {"schema_version": "1"}), "no_version": json.dumps(whole | {"schema_version": None}), "number": json.dumps(whole | {"chunk_id": 1}), "no_records": json.dumps({"chunk_id": "x"}), "bad_record": json.dumps(whole | {"records": [{"id": "a"}]}), "no_object": json.dumps(whole | {"records": [3]}), "no_chunks": json.dumps(whole | {"records": []}),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content, "utf-8")
    rows = scans.json_files(spark, f"{tmp_path}/*.json").withColumn("name", F.regexp_extract("path", r"(\w+)\.json$", 1))
    got = {r["name"]: (r["rule"], r["detail"]) for r in scans.chunk_findings(rows, ["name"]).collect()}
    bad = {"cut": "json", "around": "json", "two": "json", "empty": "json", "list": "object", "text_version": "field schema_version", "number": "field chunk_id", "no_records": "field records", "bad_record": "records field source", "no_object": "records object"}
    assert got == {k: ("invalid_source_chunk", v) for k, v in bad.items()} | {"old": ("unsupported_chunk_schema_version", "version 9")}
    records = [(r["pos"], r["record_id"], r["source"]) for r in scans.chunk_records(rows.where("name = 'good'"), ["name"]).collect()]
    assert sorted(records) == [(0, "0001-000001", "A “b”\n"), (1, "0001-000002", "")]
    assert scans.chunk_findings(rows.limit(0), ["name"]).count() == 0


def test_stores_of_both_versions(spark):
    version = {"version": 1, "subversion": 2, "version_ref": "1.2", "target": "t", "status": "accepted"}
    stores = [{"version": 2, "records": {"1-1": {"source_sha256": "x", "active_version": None, "versions": [version]}}}, {"records": {"1-1": {"target": "u", "status": "accepted"}}}, {"version": 2, "records": {"1-1": {"target": "u"}}}, {"version": 2, "records": {"1-1": {"source_sha256": "x", "versions": [version | {"target": 1}]}}}, {"version": 1, "records": []}]
    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(stores)] + [(9, None)], "k int, content string")
    assert sorted((r["k"], r["version_ref"], r["target"], r["active"]) for r in scans.store_candidates(df, ["k"]).collect()) == [(0, "1.2", "t", False), (1, "1.1", "u", True)]
    assert {r["k"]: r["detail"] for r in scans.store_findings(df, ["k"]).collect()} == {2: "records field source_sha256", 3: "records versions field target", 4: "field records", 9: "json"}


# --- writes --------------------------------------------------------------------------------------


def test_snapshots_are_whole_and_conflicts_are_told(spark, tmp_path):
    one, two = Snapshots(spark, f"{tmp_path}/t"), Snapshots(spark, f"{tmp_path}/t")
    assert one.latest() == 0
    assert one.commit(spark.range(3).toDF("x"), 0) == 1
    held = two.read()
    assert one.commit(spark.range(5).toDF("x"), 1) == 2
    with pytest.raises(Conflict):
        two.commit(spark.range(9).toDF("x"), 1)
    assert held.count() == 3 and two.read().count() == 5 and two.read(1).count() == 3
    (tmp_path / "t/versions/000000003").write_text("data-half")  # a writer that is not done
    assert two.latest() == 2


def test_extraction_writes_what_changed(spark, tmp_path):
    rows = [(d, f"{c:04d}", c * 50 + i, f"{c:04d}-{i:06d}", f"text {d} {c} {i}") for d in range(4) for c in range(3) for i in range(5)]
    schema, path = "doc_id long, chunk_id string, record_pos long, record_id string, source string", f"{tmp_path}/x"

    def run(given):
        return writes.extract(spark.createDataFrame(given, schema), path)

    assert run(rows) == writes.Extracted(1, 12, 0, 0)
    assert run(rows[::-1]) == writes.Extracted(1, 0, 12, 0)
    changed = [(*r[:4], r[4] + "!" if r[0] == 2 and r[1] == "0001" else r[4]) for r in rows if not (r[0] == 3 and r[1] == "0002")]
    assert run(changed) == writes.Extracted(2, 1, 10, 1)
    assert sorted(tuple(r) for r in writes.extracted(spark, path).select("doc_id", "chunk_id", "record_pos", "record_id", "source").collect()) == sorted(changed)
    assert run([]) == writes.Extracted(3, 0, 0, 11) and writes.extracted(spark, path).count() == 0


def test_of_two_submissions_for_a_record_one_is_refused(spark, tmp_path):
    records = spark.createDataFrame([(1, p, f"r{p}", f"text __NAME_00{p}__", "h") for p in range(4)], "doc_id long, record_pos long, record_id string, source string, source_sha256 string")
    tasks = records.where("record_pos < 3").select("doc_id", "record_id", F.when(F.col("record_pos") == 2, "old").otherwise("h").alias("source_sha256"))

    def given(*rows):
        return spark.createDataFrame(rows, "submission string, turn long, doc_id long, record_id string, target string")

    store = Snapshots(spark, f"{tmp_path}/store")
    rows = given(("a", 1, 1, "r0", "x __NAME_000__"), ("a", 1, 1, "r1", "y __NAME_001__"), ("b", 2, 1, "r1", "z __NAME_001__"), ("c", 3, 1, "r2", "t __NAME_002__"), ("d", 4, 1, "r3", "t"), ("e", 5, 1, "r9", "t"), ("f", 0, 1, "r0", None))
    got = {r["submission"]: (r["accepted"], r["rules"]) for r in writes.accept(store, rows, tasks, records, "1.1").collect()}
    assert got == {"a": (False, "conflicting_submission"), "b": (False, "conflicting_submission"), "c": (False, "source_drift"), "d": (False, "record_not_in_task"), "e": (False, "unknown_record_id"), "f": (False, "empty_target")}
    got = {r["submission"]: r["accepted"] for r in writes.accept(store, rows.where("submission IN ('a', 'b')"), tasks, records, "1.1").collect()}
    assert got == {"a": True, "b": False}
    writes.accept(store, given(("g", 1, 1, "r0", "new __NAME_000__")), tasks, records, "1.2")
    writes.accept(store, given(("h", 1, 1, "r1", "over __NAME_001__")), tasks, records, "1.1")
    held = sorted((r["record_id"], r["version_ref"], r["target"][:4], r["active"]) for r in store.read().collect())
    assert held == [("r0", "1.1", "x __", True), ("r0", "1.2", "new ", False), ("r1", "1.1", "over", True)]
    active = writes.set_active(store.read(), spark.createDataFrame([(1, "r0", "1.2"), (1, "r1", "7.7")], "doc_id long, record_id string, version_ref string"))
    assert sorted((r["record_id"], r["version_ref"]) for r in active.where("active").collect()) == [("r0", "1.2"), ("r1", "1.1")]


# --- runs of work --------------------------------------------------------------------------------


def plain_status(events):
    slots = {}
    for _, seq, kind, value in sorted(events, key=lambda e: (e[1], e[3] or "", e[2])):
        todos.put(slots, seq, kind, value)
    return todos.status(slots)


def test_todo_stream_equals_the_fold(spark, tmp_path):
    r = random.Random(5)
    rows = [(t, r.randrange(40), kind, value) for t in range(60) for kind, value in [("plan", "1")] * (t % 7 > 0) + [r.choice([("plan", "2"), ("plan", "3"), ("done", "1"), ("done", "2"), ("undone", "1"), ("source", "a"), ("source_now", "b"), ("source_now", "a"), ("context", "a"), ("context_now", "b"), ("errors", "1"), ("errors", "0"), ("errors", None)]) for _ in range(r.randrange(9))]]
    rows += [(None, 1, "plan", "1"), (3, None, "done", "1")]
    events = spark.createDataFrame(rows, todos.EVENTS)
    events.repartition(5).write.parquet(f"{tmp_path}/events")
    want = {}
    for e in rows:
        if e[0] is not None and e[1] is not None:
            want.setdefault(e[0], []).append(e)
    want = {(t, *plain_status(v)) for t, v in want.items()}
    assert {tuple(x) for x in todos.folded(events).collect()} == want
    assert {tuple(x) for x in todos.streamed(spark, f"{tmp_path}/events", 1).collect()} == want
    assert {s for _, s, *_ in want} == {"ready", "blocked", "complete"} and {x[2] for x in want} == {None, "source", "context", "validation"}


def test_latest_incomplete_todo(spark):
    rows = [("p", 1, 5, False, ["a", "b"]), ("p", 2, 5, False, ["b", "b"]), ("p", 3, 9, True, ["b"]), ("p", 4, 1, False, ["c"]), ("q", 5, 1, False, []), ("r", 6, 1, True, ["a"])]
    got = {r["project"]: (r["todo_id"], r["overlaps"], r["rule"]) for r in todos.latest_incomplete(spark.createDataFrame(rows, "project string, todo_id long, created_at long, complete boolean, chapters array<string>")).collect()}
    assert got == {"p": (2, 1, "ambiguous_latest_todo"), "q": (5, 0, None)}


def test_every_todo_state_is_reached(spark):
    assert {(r["state"], r["reason"]) for r in registry.queries()["todo_states"](spark, SF).collect()} == {("ready", None), ("complete", None), ("blocked", "source"), ("blocked", "context"), ("blocked", "validation")}


# --- contexts ------------------------------------------------------------------------------------


def test_three_way_merge(spark):
    def table(**values):
        return spark.createDataFrame(list(values.items()), "k string, value string")

    base, local, incoming = table(a="x", b="x", c="x", d="x", g="x"), table(a="x", b="mine", c="x", d="mine", e="mine", f=" ", h="m  n"), table(a="x", b="x", c="new", d="theirs", f="new", g="new", i="new", j=None, h="m n", e=None)
    want = {"a": ("skip", "x"), "b": ("skip", "mine"), "c": ("update", "new"), "e": ("skip", "mine"), "f": ("update", "new"), "g": ("add", "new"), "h": ("skip", "m n"), "i": ("add", "new"), "j": ("skip", "")}
    for policy, d in (("fail", ("conflict", "mine")), ("keep-local", ("skip", "mine")), ("replace", ("update", "theirs"))):
        got = {r["k"]: (r["action"], r["value"]) for r in merging.three_way(base, local, incoming, ["k"], policy).collect()}
        assert got == want | {"d": d}
    with pytest.raises(ValueError):
        merging.three_way(base, local, incoming, ["k"], "both")


def test_decisions_leave_candidates_out(spark):
    found = spark.createDataFrame([("1", "ten-day"), ("2", "wasp"), ("3", "bee"), ("4", "ant")], "candidate_id string, normalized string")
    glossary = spark.createDataFrame([("Bee",), ("bee",), ("wasp",)], "source string")
    decided = spark.createDataFrame([("2", None, "ignore"), (None, "WASP", "approve"), (None, "Ant", "ignore")], "candidate_id string, normalized string, disposition string")
    got = {r["candidate_id"]: r["disposition"] for r in merging.resolved(found, glossary, decided).collect()}
    assert got == {"1": "open", "2": "ignore", "3": "in_glossary", "4": "ignore"}
    assert [r["candidate_id"] for r in merging.still_open(found, glossary, decided).collect()] == ["1"]


# --- preflight -----------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_span_records_equal_a_range_join(spark, width):
    r = random.Random(width)
    spans = {(d, r.randrange(200)) for d in range(5) for _ in range(r.choice([1, 3, 30]))}
    records = [(d, r.choice([None, r.randrange(-5, 260)]), k) for d in range(6) for k in range(80)]
    got = preflight.span_records(spark.createDataFrame(sorted(spans), "doc_id long, span_index long"), spark.createDataFrame(records, "doc_id long, span_index long, k long"), width)
    want = {(d, k, max(s for e, s in spans if e == d and s <= at)) for d, at, k in records if at is not None and any(e == d and s <= at for e, s in spans)}
    assert {(x["doc_id"], x["k"], x["start"]) for x in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_preflight_equals_plain_loops(spark):
    r = random.Random(4)
    bits = ["<em>a</em>", "<b>x</b> y", "plain – text", "<code>k</code>", "z"]
    spans = [(d, s) for d in range(8) for s in (0, 3, 4, 5, 7, 10, 20, 40)]
    records = []
    for d in range(8):
        for p in range(30):
            source = r.choice(bits)
            records.append((d, p, p, f"r{p:02d}", source, r.choice([source, source, source, None, source.replace("–", ","), source.replace("em>", "i>"), source + "<p>", source.replace("k", "K")])))
    got = preflight.findings(spark.createDataFrame(spans, "doc_id long, span_index long"), spark.createDataFrame(records, "doc_id long, record_pos long, span_index long, record_id string, source string, target string"))
    want = set()
    for d, start in spans:
        stop = min((s for e, s in spans if e == d and s > start), default=1 << 30)
        own = [x for x in records if x[0] == d and start <= x[2] < stop]
        ids = ",".join(x[3] for x in own)
        if not own:
            want.add((d, start, "error", "span_without_records", "", ""))
        want |= {(d, start, "error", "missing_translation", x[3], x[3]) for x in own if x[5] is None}
        given = [x[4] if x[5] is None else x[5] for x in own]
        if given == [x[4] for x in own]:
            continue
        each = [{rule for _, rule in issues(x[4], g)} for x, g in zip(own, given, strict=True)]
        for severity, rule in issues(" ".join(x[4] for x in own), " ".join(given)):
            by = {"dash_semantic_cue_missing"} if rule == "dash_semantic_cue_missing" else {"inline_xhtml_preserved", "inline_xhtml_parseable"}
            want.add((d, start, severity, rule, next((x[3] for x, found in zip(own, each, strict=True) if found & by), ""), ids))
    assert {tuple(x) for x in got.collect()} == want and {x[3] for x in want} >= {"span_without_records", "missing_translation", "dash_semantic_cue_missing", "inline_xhtml_preserved", "inline_xhtml_parseable"}


# --- analysis ------------------------------------------------------------------------------------


def test_words_inside_opaque_places_are_not_mined(spark):
    page = "<p>See <b>Ten</b>day <code>wasp <i>ant</i></code> and __NAME_001__ <kbd>x</kbd>bee <!-- no --> end&nbsp;it</p><pre>gone</pre><p><svg><text>pic</text></svg></p>"
    (element, block, _, tokens, tags, _), *_ = [r for r in map(tuple, texts.xhtml_spans(spark.createDataFrame([(1, page)], "id long, html string"), {"id": "long"}, "html").drop("id", "pos").collect())]
    text, opaque, protected = analysis.prepared(block, [*tokens, "__NAME_001__"], [*tags, "Anna Maria"])
    assert element == "p" and text == "See Tenday wasp ant and Anna Maria xbee  end\xa0it"
    assert [text[a:b] for a, b in opaque] == ["wasp ant", "x"] and [text[a:b] for a, b in protected] == ["Anna Maria"]
    words = analysis.words(block, [*tokens, "__NAME_001__"], [*tags, "Anna Maria"])
    # "xbee" touches an opaque place
    assert [(w, p) for w, _, p in words] == [("See", False), ("Tenday", False), ("and", False), ("Anna", True), ("Maria", True), ("end", False), ("it", False)]
    assert analysis.words("", [], []) == []


def test_places_by_bisection():
    r = random.Random(1)
    for _ in range(500):
        cuts = sorted(r.sample(range(40), 8))
        places = list(zip(cuts[::2], cuts[1::2], strict=True))
        a = r.randrange(40)
        b = a + 1 + r.randrange(6)
        assert analysis.touches(places, a, b) == any(x < b and y > a for x, y in places)
