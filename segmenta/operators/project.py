"""Queries over project files, writes, runs of work and contexts, each beside a DuckDB text of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions import migrate
from segmenta.operators import gates, glossary, merging, preflight, sinks, writes
from segmenta.plans.shared import shared_path, written
from segmenta.plans.snapshots import Snapshots
from segmenta.sources import analysis, scans, texts
from segmenta.streaming import todos

Over = Callable[[str], DataFrame]

# --- files ---------------------------------------------------------------------------------------

#: What befalls a chunk's file, by (doc_id + chunk) % 10.
_DAMAGE = "(doc_id + CAST(chunk_id AS BIGINT)) % 10"


def chunk_files(over: Over) -> DataFrame:
    rows = over("SELECT doc_id, chunk_id, record_pos, record_id, source FROM v_records")
    kind = F.pmod(F.col("doc_id") + F.col("chunk_id").cast("long"), F.lit(10))
    records = F.transform(F.array_sort(F.collect_list(F.struct("record_pos", "record_id", "source"))), lambda r: F.struct(r["record_id"].alias("id"), r["source"].alias("source")))
    files = rows.groupBy("doc_id", "chunk_id").agg(records.alias("records")).withColumn("kind", kind)
    whole = F.to_json(F.struct(F.when(F.col("kind") == 7, 9).when(F.col("kind") != 9, 2).cast("long").alias("schema_version"), "chunk_id", F.when(F.col("kind") != 5, F.col("records")).alias("records")))
    content = (
        F.when(F.col("kind") == 1, F.substring(whole, F.lit(1), F.length(whole) - 1))
        .when(F.col("kind") == 2, F.concat(F.lit("Here it is: "), whole))
        .when(F.col("kind") == 3, F.concat(F.lit("["), whole, F.lit("]")))
        .when(F.col("kind") == 4, F.replace(whole, F.lit('"chunk_id":"'), F.lit('"chunk_id":1,"old":"')))
        .when(F.col("kind") == 6, F.replace(whole, F.lit('"source":"'), F.lit('"source":3,"old":"')))
        .when(F.col("kind") == 8, F.replace(whole, F.lit('"schema_version":2'), F.lit('"schema_version":"2"')))
        .otherwise(whole)
    )
    return files.select("doc_id", "chunk_id", content.alias("content"))


def store_files(over: Over) -> DataFrame:
    """A store for each document: an old one, one of now, or one at fault, by doc_id % 5."""
    rows = over("SELECT c.doc_id, c.record_id, c.version, c.subversion, c.version_ref, c.target, c.status, s.source_sha256, s.active_version FROM v_candidates c JOIN v_store s ON s.doc_id = c.doc_id AND s.record_pos = c.record_pos")
    version = F.struct(F.col("version").cast("long").alias("version"), F.col("subversion").cast("long").alias("subversion"), "version_ref", "target", "status")
    one = rows.groupBy("doc_id", "record_id").agg(F.min("source_sha256").alias("source_sha256"), F.min("active_version").alias("active_version"), F.array_sort(F.collect_list(version)).alias("versions"))
    now = one.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_id", F.struct("source_sha256", "active_version", "versions"))))).alias("records")).select("doc_id", F.to_json(F.struct(F.lit(2).alias("version"), "records")).alias("content"))
    old = over("SELECT doc_id, record_id, target FROM v_legacy").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_id", F.struct("target", F.lit("accepted").alias("status")))))).alias("records")).select("doc_id", F.to_json(F.struct("records")).alias("content"))
    broken = F.when(F.expr("doc_id % 5 = 4"), F.replace("content", F.lit('"versions":['), F.lit('"versions":[7,'))).otherwise(F.col("content"))
    cut = F.when(F.expr("doc_id % 5 = 3"), F.concat("content", F.lit("}"))).otherwise(F.col("content"))
    return now.where("doc_id % 5 < 2 OR doc_id % 5 = 4").select("doc_id", broken.alias("content")).union(old.where("doc_id % 5 IN (2, 3)").select("doc_id", cut.alias("content")))


def setting_findings(over: Over) -> DataFrame:
    """Ledgers, manifests and contexts of all documents, some at fault."""
    docs = over("SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL")

    def files(good, bad, turn: int) -> DataFrame:
        return docs.select("doc_id", F.when(F.col("doc_id") % 6 == turn, bad).otherwise(good).alias("content"))

    ledger = files(F.lit('{"versions": [{"version_ref": "1.1"}]}'), F.lit('{"versions": [{"version_ref": 1.1}]}'), 1)
    manifest = files(F.lit('{"chunk_size": 50, "record_id_scheme": "v1"}'), F.concat(F.lit('{"chunk_size": "'), F.coalesce("lang", F.lit("")), F.lit('", "record_id_scheme": "v1"}')), 2)
    context = files(F.lit('{"glossary": [{"source": "a", "target": null}], "style": {}}'), F.lit('{"glossary": [{"target": "a"}]}'), 3)
    made = ((ledger, scans.LEDGER, "invalid_translation_version_ledger"), (manifest, scans.MANIFEST, "invalid_manifest"), (context, scans.CONTEXT, "invalid_context"))
    first, second, third = (scans.findings(f, ["doc_id"], declared, rule) for f, declared, rule in made)
    return first.union(second).union(third)


# --- writes --------------------------------------------------------------------------------------

_EDITED = "SELECT doc_id, chunk_id, record_pos, record_id, CASE WHEN doc_id % 10 = 3 AND record_pos = 0 THEN concat(source, ' !') ELSE source END AS source FROM v_records WHERE NOT (doc_id % 10 = 4 AND chunk_id = '0001')"


def extractions(spark: SparkSession, over: Over) -> tuple[str, list[writes.Extracted]]:
    """Three runs: all documents, the same again, then with one record of some changed and one chunk of others gone."""
    path = shared_path(spark, "extract")
    same = written(over("SELECT doc_id, chunk_id, record_pos, record_id, source FROM v_records"), "records")
    return path, [writes.extract(same, path), writes.extract(same, path), writes.extract(over(_EDITED), path)]


def extract_report(spark: SparkSession, over: Over) -> DataFrame:
    runs = extractions(spark, over)[1]
    return spark.createDataFrame([(k + 1, r.version, r.written, r.kept, r.removed) for k, r in enumerate(runs)], "run long, version long, written long, kept long, removed long")


_STORE = "SELECT c.doc_id, c.record_pos, c.record_id, c.version_ref, c.target, c.status, c.version_ref = s.active_version AS active FROM v_candidates c JOIN v_store s ON s.doc_id = c.doc_id AND s.record_pos = c.record_pos"
#: Two submissions for each chunk; they overlap in odd documents, and the first has one fault of each kind by turns.
_TURN = "(doc_id + CAST(chunk_id AS BIGINT)) % 7"
_SUBMITTED = f"""
SELECT concat(CAST(doc_id AS STRING), '/', chunk_id, '/0') AS submission, CAST(0 AS BIGINT) AS turn, doc_id, CASE WHEN {_TURN} = 2 AND record_pos % 50 = 2 THEN concat(record_id, 'x') ELSE record_id END AS record_id,
 CASE WHEN {_TURN} = 3 AND record_pos % 50 = 4 THEN ' ' WHEN {_TURN} = 6 AND record_pos % 50 = 2 THEN concat(source, ' __NAME_001__') ELSE concat(source, ' S0') END AS target FROM v_records WHERE record_pos % 2 = 0
UNION ALL SELECT concat(CAST(doc_id AS STRING), '/', chunk_id, '/0'), CAST(0 AS BIGINT), doc_id, record_id, concat(source, ' again') FROM v_records WHERE {_TURN} = 1 AND record_pos % 50 = 2
UNION ALL SELECT concat(CAST(doc_id AS STRING), '/', chunk_id, '/1'), CAST(1 AS BIGINT), doc_id, record_id, concat(source, ' S1') FROM v_records WHERE record_pos % 6 = 3 OR (doc_id % 2 = 1 AND record_pos % 3 = 0)
"""
_TASKS = f"SELECT doc_id, record_id, CASE WHEN {_TURN} = 4 AND record_pos % 50 = 6 THEN 'old' ELSE source_sha256 END AS source_sha256 FROM v_records WHERE NOT ({_TURN} = 5 AND record_pos % 50 = 8)"


def accepted(spark: SparkSession, over: Over) -> tuple[Snapshots, DataFrame]:
    """A store with the versions that there are, and what became of the submissions."""
    store = Snapshots(spark, shared_path(spark, "store"))
    store.commit(over(_STORE), 0)
    return store, writes.accept(store, over(_SUBMITTED), over(_TASKS), over("SELECT doc_id, record_pos, record_id, source, source_sha256 FROM v_records"), "1.2")


# --- runs of work --------------------------------------------------------------------------------

#: Events of a todo for each document over its first chapters: planned, done, taken back; drift, errors and their end.
_CHAPTERS = "(SELECT DISTINCT doc_id, chapter_no FROM v_records WHERE chapter_no <= 4)"
_EVENTS = f"""
SELECT doc_id AS todo_id, chapter_no AS seq, 'plan' AS kind, CAST(chapter_no AS STRING) AS value FROM {_CHAPTERS} a
UNION ALL SELECT doc_id, 100 + chapter_no, 'done', CAST(chapter_no AS STRING) FROM {_CHAPTERS} b WHERE (doc_id + chapter_no) % 3 <> 0 OR doc_id % 4 = 0
UNION ALL SELECT doc_id, 200 + chapter_no, 'undone', CAST(chapter_no AS STRING) FROM {_CHAPTERS} c WHERE doc_id % 9 = 0 AND chapter_no = 1
UNION ALL SELECT doc_id, CAST(10 AS BIGINT), 'source', 'a' FROM documents UNION ALL SELECT doc_id, CAST(300 AS BIGINT), 'source_now', CASE WHEN doc_id % 5 = 1 THEN 'b' ELSE 'a' END FROM documents
UNION ALL SELECT doc_id, CAST(11 AS BIGINT), 'context', 'a' FROM documents UNION ALL SELECT doc_id, CAST(301 AS BIGINT), 'context_now', 'b' FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, CAST(302 AS BIGINT), 'errors', '2' FROM documents WHERE doc_id % 7 = 2 UNION ALL SELECT doc_id, CAST(303 AS BIGINT), 'errors', '0' FROM documents WHERE doc_id % 14 = 2
"""


def todo_states(spark: SparkSession, over: Over) -> DataFrame:
    """The events as files by seq, taken in by the stream some files at a time."""
    path = shared_path(spark, "events")
    over(_EVENTS).repartitionByRange(4, "seq").write.parquet(path)
    return todos.streamed(spark, path, 2)


_TODOS = "SELECT source AS project, doc_id AS todo_id, doc_id % 50 AS created_at, doc_id % 6 = 0 AS complete, doc_id * 7 % 601 AS a, doc_id * 11 % 607 AS b FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL"

# --- contexts ------------------------------------------------------------------------------------

_KEYED = f"SELECT doc_id, source_term AS term, lower(source_term) AS value, place % 1000 + length(source_term) AS k FROM ({glossary.ENTRIES}) e"
_BASE = f"SELECT doc_id, term, value FROM ({_KEYED}) b WHERE k % 13 <> 0"
_LOCAL = f"SELECT doc_id, term, CASE WHEN k % 5 = 1 THEN concat(value, ' L') WHEN k % 11 = 3 THEN ' ' ELSE value END AS value FROM ({_KEYED}) l WHERE k % 7 <> 0"
_INCOMING = f"SELECT doc_id, term, CASE WHEN k % 4 = 1 THEN concat(value, ' P') WHEN k % 17 = 2 THEN NULL ELSE value END AS value FROM ({_KEYED}) i WHERE k % 3 <> 0"
_NOTES = "SELECT doc_id, chapter_no, concat('t', CAST(chapter_no % 3 AS STRING)) AS title, chapter_no, min(record_id) AS a, max(record_id) AS b FROM v_records GROUP BY doc_id, chapter_no"


def merged(over: Over) -> DataFrame:
    made = [merging.three_way(over(_BASE), over(_LOCAL), over(_INCOMING), ["doc_id", "term"], p).select(F.lit(p).alias("policy"), "doc_id", "term", "value", "action") for p in merging.POLICIES]
    return made[0].union(made[1]).union(made[2])


def noted(over: Over, **how: bool) -> DataFrame:
    rows = over("SELECT doc_id, chapter_no, min(record_id) AS a, max(record_id) AS b FROM v_records GROUP BY doc_id, chapter_no")
    title = F.concat(F.lit("t"), (F.col("chapter_no") % 3).cast("string"))
    local = rows.where("chapter_no % 4 <> 0").select("doc_id", "chapter_no", title.alias("title"), F.array("a").alias("decisions"))
    incoming = rows.where("chapter_no % 5 <> 0").select("doc_id", "chapter_no", title.alias("title"), F.when(F.col("chapter_no") % 2 == 0, F.array("a")).otherwise(F.array("b", "a")).alias("decisions"))
    found = merging.merge_notes(local, incoming, **how)
    return found.select("doc_id", "chapter_no", "title", F.array_join("decisions", ",").alias("decisions"), "action")


_CANDIDATES = "SELECT DISTINCT lower(token) AS normalized FROM v_tokens"


def candidates(over: Over) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = over(_CANDIDATES).select(F.substring(F.sha2("normalized", 256), 1, 16).alias("candidate_id"), "normalized")
    size = F.length("normalized")
    by_id = rows.where(size % 6 == 0).select("candidate_id", F.lit(None).cast("string").alias("normalized"), F.lit("ignore").alias("disposition"))
    by_term = rows.where(size % 4 == 1).select(F.lit(None).cast("string").alias("candidate_id"), F.upper("normalized").alias("normalized"), F.lit("approve").alias("disposition"))
    return rows, over(f"SELECT source_term AS source FROM ({glossary.ENTRIES}) e WHERE length(source_term) % 5 = 0"), by_id.union(by_term)


# --- spans ---------------------------------------------------------------------------------------

_SPANS = "SELECT doc_id, record_pos * 5 AS span_index FROM v_records WHERE record_pos % 3 = 1"
_PLACED = "SELECT doc_id, record_pos, record_id, CASE WHEN record_pos % 17 <> 5 THEN record_pos * 5 + 2 END AS span_index FROM v_records"


def span_preflight(over: Over) -> DataFrame:
    placed = over(f"SELECT f.doc_id, r.record_pos, r.record_pos * 5 + 2 AS span_index, f.record_id, f.source, CASE WHEN r.record_pos % 19 = 7 THEN NULL WHEN r.record_pos % 2 = 0 THEN f.source ELSE f.target END AS target FROM ({gates.FRAGMENTS}) f JOIN v_records r ON r.doc_id = f.doc_id AND r.record_id = f.record_id")
    return preflight.findings(over(_SPANS), placed)


def made_words(over: Over) -> DataFrame:
    words = analysis.counted(over("SELECT * FROM v_xhtml"), {"doc_id": "long"}, "text")
    return words.groupBy("doc_id", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


#: Pairs whose target lost its only element, by record_pos % 6: all of it, a phrase, a phrase that stands twice, nothing, two elements, a phrase inside a tag.
_TEXT = "replace(replace(source, '&', '&amp;'), '<', '&lt;')"
_LOST = f"""SELECT doc_id, record_id, CASE record_pos % 6 WHEN 0 THEN concat('<em class="a">', {_TEXT}, '</em>') WHEN 3 THEN {_TEXT} WHEN 4 THEN concat('<b>ten-day</b> <i>', {_TEXT}, '</i>') ELSE concat({_TEXT}, ' <b>ten-day</b>.') END AS source,
 CASE record_pos % 6 WHEN 1 THEN concat('ten-day: ', {_TEXT}) WHEN 2 THEN concat('ten-day ten-day ', {_TEXT}) WHEN 4 THEN concat('ten-day ', {_TEXT}) WHEN 5 THEN concat({_TEXT}, ' <b>no</b> ten-day') ELSE {_TEXT} END AS target FROM v_records"""


def protected_fragments(over: Over) -> DataFrame:
    """PR4: lines with a name in an attribute and in the text."""
    rows = over("SELECT doc_id, span_index, concat('<a title=\"Anna\">', c, ' Anna</a> Anna Maria, Anna') AS fragment FROM v_inline")
    return texts.explode_texts(rows, {"doc_id": "long", "span_index": "long"}, ["fragment"], {"protected": "string", "tokens": "string"}, lambda t: [(p, "|".join(f"{a}={b}" for a, b in k)) for p, k in [migrate.protect_names_in_text(t, ["Anna", "Anna Maria"])]]).drop("pos")


# --- sinks ---------------------------------------------------------------------------------------

_INDEXED = f"SELECT doc_id, record_pos, record_id, source_words, source, target, ref, CASE WHEN record_pos % 3 = 1 THEN kind WHEN record_pos % 3 = 2 THEN '' END AS origin FROM v_progress"
_RUNS = "SELECT source AS project, doc_id AS seq, lang AS actor, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('h', CAST(doc_id % 2 AS STRING)) END AS harness, 'm' AS model, concat('b', CAST(doc_id % 5 AS STRING)) AS baseline FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL"


def task_round_trip(over: Over) -> DataFrame:
    """SK7, SC20: tasks filled in and read again."""
    rows = over("SELECT doc_id, chunk_id, record_pos, record_id, source, concat('T ', source) AS target FROM v_records")
    text = sinks.filled(sinks.task_files(rows), rows)
    back = texts.explode_texts(text, {"doc_id": "long", "chunk_id": "string"}, ["text"], {"record_id": "string", "target": "string", "error": "string"}, texts.block_submission)
    return back.select("doc_id", "chunk_id", "record_id", "target", "error")


FRAMES: dict[str, Callable[[SparkSession, Over], DataFrame]] = {
    # SK5, PR20
    "editor_index": lambda spark, over: sinks.index_lines(over(_INDEXED), "source-target", ["source_words", "source", "target"], ["ref", "origin"], over("SELECT doc_id FROM documents WHERE doc_id % 9 = 4")),
    # SK7
    "task_files": lambda spark, over: sinks.task_files(over("SELECT doc_id, chunk_id, record_pos, record_id, source FROM v_records")),
    "task_round_trip": lambda spark, over: task_round_trip(over),
    # SK12, QV5
    "run_versions": lambda spark, over: sinks.versions(over(_RUNS)),
    # SK18
    "fragment_migrations": lambda spark, over: migrate.migrations(over(_LOST), {"doc_id": "long", "record_id": "string"}),
    # PR2, PR4
    "protected_fragments": lambda spark, over: protected_fragments(over),
    # SC11, V20, V41
    "chunk_scan_findings": lambda spark, over: scans.chunk_findings(chunk_files(over), ["doc_id", "chunk_id"]),
    # SC9
    "chunk_scan_records": lambda spark, over: scans.chunk_records(chunk_files(over), ["doc_id", "chunk_id"]).select("doc_id", "chunk_id", F.col("pos").cast("long").alias("pos"), "record_id", "source"),
    # SC13
    "store_scan": lambda spark, over: scans.store_candidates(store_files(over), ["doc_id"]),
    # V22
    "store_scan_findings": lambda spark, over: scans.store_findings(store_files(over), ["doc_id"]),
    # V22, V41
    "setting_scan_findings": lambda spark, over: setting_findings(over),
    # SK1
    "extract_report": extract_report,
    "extracted_records": lambda spark, over: writes.extracted(spark, extractions(spark, over)[0]),
    # SK13-SK15, V60
    "accept_verdicts": lambda spark, over: accepted(spark, over)[1],
    # EF8-EF10
    "accepted_store": lambda spark, over: accepted(spark, over)[0].read().drop("record_pos"),
    # EF10
    "set_active": lambda spark, over: writes.set_active(over(_STORE), over("SELECT doc_id, record_id, CASE record_pos % 4 WHEN 0 THEN '1.1' WHEN 1 THEN '9.9' WHEN 2 THEN NULL ELSE '1.2' END AS version_ref FROM v_records WHERE record_pos % 5 < 3")).drop("record_pos"),
    # SK17, QV10
    "todo_states": todo_states,
    "todo_states_folded": lambda spark, over: todos.folded(over(_EVENTS)),
    # TK5
    "latest_incomplete_todo": lambda spark, over: todos.latest_incomplete(over(_TODOS).select("project", "todo_id", "created_at", "complete", F.array("a", "b").alias("chapters"))),
    # SO8, JN21
    "context_merge": lambda spark, over: merged(over),
    # GR17
    "context_merge_actions": lambda spark, over: merging.action_counts(merged(over), ["policy"]),
    # SO10
    "chapter_note_append": lambda spark, over: noted(over, append=True),
    "chapter_note_conflicts": lambda spark, over: noted(over),
    # JN22, JN23
    "candidate_dispositions": lambda spark, over: merging.resolved(*candidates(over)),
    # DT16
    "undecided_candidates": lambda spark, over: merging.still_open(*candidates(over)),
    # JN8
    "span_records": lambda spark, over: preflight.span_records(over(_SPANS), over(_PLACED)).select("doc_id", "record_id", "start"),
    # V48
    "span_preflight": lambda spark, over: span_preflight(over),
    # PR16, DT8
    "made_words": lambda spark, over: made_words(over),
    "page_words": lambda spark, over: analysis.counted(over("SELECT page_id, html FROM pages"), {"page_id": "long"}, "html").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"), F.count_distinct("page_id").alias("pages")),
}

_SHA_ACTIVE = "coalesce(max(CASE WHEN active THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, record_id), 0)"
_JUDGED = f"""SELECT s.*, r.record_pos, CASE WHEN count(*) OVER (PARTITION BY submission, s.doc_id, s.record_id) > 1 THEN 'duplicate_record_id' WHEN r.source IS NULL THEN 'unknown_record_id' WHEN t.source_sha256 IS NULL THEN 'record_not_in_task' WHEN t.source_sha256 <> r.source_sha256 THEN 'source_drift'
 WHEN trim(s.target) = '' THEN 'empty_target' WHEN contains(s.target, '__NAME_001__') THEN 'placeholders_preserved' WHEN turn = 1 AND min(turn) OVER (PARTITION BY s.doc_id, s.record_id) = 0 THEN 'conflicting_submission' END AS rule
 FROM ({_SUBMITTED}) s LEFT JOIN v_records r ON r.doc_id = s.doc_id AND r.record_id = s.record_id LEFT JOIN ({_TASKS}) t ON t.doc_id = s.doc_id AND t.record_id = s.record_id"""
_VERDICTS = f"SELECT submission, count(*) AS records, count(rule) = 0 AS accepted, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), '') AS rules FROM ({_JUDGED}) j GROUP BY submission"
_NEW = f"SELECT doc_id, record_id, target FROM ({_JUDGED}) j WHERE submission IN (SELECT submission FROM ({_VERDICTS}) v WHERE accepted)"
_FAULTS = {1: "json", 2: "json", 3: "object", 4: "field chunk_id", 5: "field records", 6: "records field source", 8: "field schema_version"}
_POLICY = {"fail": "conflict", "keep-local": "skip", "replace": "update"}
_MET = f"SELECT coalesce(l.doc_id, i.doc_id) AS doc_id, coalesce(l.term, i.term) AS term, l.term IS NOT NULL AS here, i.term IS NOT NULL AS there, trim(coalesce(l.value, '')) AS mine, trim(coalesce(i.value, '')) AS theirs, b.value AS was FROM ({_LOCAL}) l FULL JOIN ({_INCOMING}) i ON i.doc_id = l.doc_id AND i.term = l.term LEFT JOIN ({_BASE}) b ON b.doc_id = coalesce(l.doc_id, i.doc_id) AND b.term = coalesce(l.term, i.term)"
_MERGED = " UNION ALL ".join(f"SELECT '{p}' AS policy, doc_id, term, CASE WHEN action IN ('add', 'update') THEN theirs ELSE mine END AS value, action FROM (SELECT *, CASE WHEN NOT there THEN 'keep' WHEN theirs IN ('', mine) THEN 'skip' WHEN NOT here THEN 'add' WHEN mine = '' OR mine IS NOT DISTINCT FROM was THEN 'update' WHEN theirs IS NOT DISTINCT FROM was THEN 'skip' ELSE '{a}' END AS action FROM ({_MET}) m) n" for p, a in _POLICY.items())


def _notes(otherwise: str) -> str:
    rows = "(SELECT doc_id, chapter_no, min(record_id) AS a, max(record_id) AS b FROM v_records GROUP BY doc_id, chapter_no) n"
    theirs = "CASE WHEN chapter_no % 2 = 0 THEN a ELSE b || ',' || a END"
    action = f"CASE WHEN chapter_no % 5 = 0 THEN 'keep' WHEN chapter_no % 4 = 0 THEN 'add' WHEN chapter_no % 2 = 0 THEN 'skip' ELSE '{otherwise}' END"
    decisions = f"CASE WHEN chapter_no % 4 = 0 THEN {theirs} WHEN chapter_no % 5 <> 0 AND chapter_no % 2 = 1 AND '{otherwise}' = 'append' AND b <> a THEN a || ',' || b ELSE a END"
    return f"SELECT doc_id, chapter_no, 't' || (chapter_no % 3)::VARCHAR AS title, {decisions} AS decisions, {action} AS action FROM {rows} WHERE chapter_no % 4 <> 0 OR chapter_no % 5 <> 0"


_TODO_HELD = f"SELECT todo_id, kind, value, seq FROM ({_EVENTS}) e"
_TODO_STATES = f"""SELECT todo_id, CASE WHEN current IS NULL THEN 'complete' WHEN reason IS NULL THEN 'ready' ELSE 'blocked' END AS state, CASE WHEN current IS NOT NULL THEN reason END AS reason, current, planned - open AS complete, planned
 FROM (SELECT d.doc_id AS todo_id, CASE WHEN d.doc_id % 5 = 1 THEN 'source' WHEN d.doc_id % 5 = 2 THEN 'context' WHEN d.doc_id % 7 = 2 AND d.doc_id % 14 <> 2 THEN 'validation' END AS reason, count(c.chapter_no) AS planned, count(CASE WHEN {{0}} THEN 1 END) AS open, min(CASE WHEN {{0}} THEN c.chapter_no END) AS current
 FROM documents d LEFT JOIN {_CHAPTERS} c ON c.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id) t""".replace("{0}", "NOT ((c.doc_id + c.chapter_no) % 3 <> 0 OR c.doc_id % 4 = 0) OR (c.doc_id % 9 = 0 AND c.chapter_no = 1)")
_DISPOSED = f"SELECT left(sha256(normalized), 16) AS candidate_id, normalized, CASE WHEN length(normalized) % 6 = 0 THEN 'ignore' WHEN length(normalized) % 4 = 1 THEN 'approve' WHEN normalized IN (SELECT lower(source_term) FROM ({glossary.ENTRIES}) g WHERE length(source_term) % 5 = 0) THEN 'in_glossary' ELSE 'open' END AS disposition FROM ({_CANDIDATES}) c"
_TEXT_WORDS = r"[\p{L}]+(?:[’\x27-][\p{L}]+)*"

_CORE = "'{\"source_words\":' || source_words::VARCHAR || ',\"source\":' || to_json(source)::VARCHAR || ',\"target\":' || coalesce(to_json(target)::VARCHAR, 'null')"
_KEPT = "CASE WHEN ref IS NOT NULL THEN ',\"ref\":\"' || ref || '\"' ELSE '' END || CASE WHEN origin <> '' THEN ',\"origin\":\"' || origin || '\"' ELSE '' END || '}'"
_INDEX_ROWS = f"SELECT *, max(record_pos) OVER (PARTITION BY doc_id) AS last FROM ({_INDEXED}) i WHERE doc_id % 9 <> 4"

ORACLES: dict[str, str] = {
    "editor_index": f"""SELECT doc_id, record_pos AS line_no, '    \"' || record_id || '\": ' || {_CORE} || {_KEPT} || CASE WHEN record_pos < last THEN ',' ELSE '' END AS line FROM ({_INDEX_ROWS}) r
 UNION ALL SELECT DISTINCT doc_id, -1, '{{' || chr(10) || '  \"kind\": \"source-target\",' || chr(10) || '  \"records\": {{' FROM ({_INDEX_ROWS}) h UNION ALL SELECT DISTINCT doc_id, {sinks.FOOT}, '  }}' || chr(10) || '}}' FROM ({_INDEX_ROWS}) f""",
    "task_files": "SELECT doc_id, chunk_id, string_agg('# ' || source || chr(10) || '>>> ' || record_id || chr(10), chr(10) ORDER BY record_pos) AS block, string_agg(record_id || chr(9) || replace(source, chr(9), ' '), chr(10) ORDER BY record_pos) AS tsv FROM v_records GROUP BY doc_id, chunk_id",
    "task_round_trip": "SELECT doc_id, chunk_id, record_id, 'T ' || source AS target, '' AS error FROM v_records",
    "run_versions": f"WITH r AS (SELECT project, seq, coalesce(actor, '') || '/' || coalesce(harness, '') AS who, baseline FROM ({_RUNS}) x), f AS (SELECT *, min(seq) OVER (PARTITION BY project, who) AS opened, min(seq) OVER (PARTITION BY project, who, baseline) AS begun FROM r), v AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY project ORDER BY opened) AS INT) AS version, CAST(dense_rank() OVER (PARTITION BY project, who ORDER BY begun) AS INT) AS subversion FROM f) SELECT project, seq, version, subversion, version::VARCHAR || '.' || subversion::VARCHAR AS version_ref, seq = opened AS new_track, seq = begun AS new_subversion FROM v",
    "fragment_migrations": f"SELECT doc_id, record_id, CASE record_pos % 6 WHEN 0 THEN '<em class=\"a\">' || {_TEXT} || '</em>' WHEN 1 THEN '<b>ten-day</b>: ' || {_TEXT} END AS new_target, CASE WHEN record_pos % 6 < 2 THEN 'mapped' ELSE 'review' END AS action FROM v_records WHERE record_pos % 6 IN (0, 1, 2, 4)",
    "protected_fragments": "SELECT doc_id, span_index, '<a title=\"Anna\">' || c || ' __NAME_001__</a> __NAME_002__, __NAME_003__' AS protected, '__NAME_001__=Anna|__NAME_002__=Anna Maria|__NAME_003__=Anna' AS tokens FROM v_inline",
    "chunk_scan_findings": "SELECT doc_id, chunk_id, 'error' AS severity, CASE k WHEN 7 THEN 'unsupported_chunk_schema_version' ELSE 'invalid_source_chunk' END AS rule, CASE k " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in _FAULTS.items()) + f" ELSE 'version 9' END AS detail FROM (SELECT DISTINCT doc_id, chunk_id, {_DAMAGE} AS k FROM v_records) c WHERE k BETWEEN 1 AND 8",
    "chunk_scan_records": f"SELECT doc_id, chunk_id, record_pos % 50 AS pos, record_id, source FROM v_records WHERE {_DAMAGE} IN (0, 7, 9)",
    "store_scan": "SELECT c.doc_id, c.record_id, c.version_ref, c.target, c.status, c.version_ref = s.active_version AS active FROM v_candidates c JOIN v_store s ON s.doc_id = c.doc_id AND s.record_pos = c.record_pos WHERE c.doc_id % 5 < 2 UNION ALL SELECT doc_id, record_id, '1.1', target, 'accepted', true FROM v_legacy WHERE doc_id % 5 = 2",
    "store_scan_findings": "SELECT DISTINCT doc_id, 'error' AS severity, 'invalid_translation_store' AS rule, CASE doc_id % 5 WHEN 3 THEN 'json' ELSE 'records versions object' END AS detail FROM (SELECT doc_id FROM v_legacy WHERE doc_id % 5 = 3 UNION ALL SELECT doc_id FROM v_store WHERE doc_id % 5 = 4) d",
    "setting_scan_findings": "SELECT doc_id, 'error' AS severity, CASE doc_id % 6 WHEN 1 THEN 'invalid_translation_version_ledger' WHEN 2 THEN 'invalid_manifest' ELSE 'invalid_context' END AS rule, CASE doc_id % 6 WHEN 1 THEN 'versions field version_ref' WHEN 2 THEN 'field chunk_size' ELSE 'glossary field source' END AS detail FROM documents WHERE doc_id % 6 IN (1, 2, 3)",
    "extract_report": "SELECT run, CASE run WHEN 3 THEN 2 ELSE 1 END::BIGINT AS version, CASE run WHEN 1 THEN n WHEN 2 THEN 0 ELSE changed END AS written, CASE run WHEN 1 THEN 0 WHEN 2 THEN n ELSE n - changed - gone END AS kept, CASE run WHEN 3 THEN gone ELSE 0 END AS removed FROM (SELECT count(*) AS n, count(CASE WHEN doc_id % 10 = 3 AND chunk_id = '0001' THEN 1 END) AS changed, count(CASE WHEN doc_id % 10 = 4 AND chunk_id = '0001' THEN 1 END) AS gone FROM (SELECT DISTINCT doc_id, chunk_id FROM v_records) c) s, (VALUES (1::BIGINT), (2), (3)) r(run)",
    "extracted_records": _EDITED,
    "accept_verdicts": _VERDICTS,
    "accepted_store": f"SELECT coalesce(s.doc_id, n.doc_id) AS doc_id, coalesce(s.record_id, n.record_id) AS record_id, coalesce(s.version_ref, '1.2') AS version_ref, CASE WHEN n.target IS NOT NULL THEN n.target ELSE s.target END AS target, CASE WHEN n.target IS NOT NULL THEN 'accepted' ELSE s.status END AS status, coalesce(s.active, coalesce(h.some, 0) = 0) AS active FROM ({_STORE}) s FULL JOIN ({_NEW}) n ON n.doc_id = s.doc_id AND n.record_id = s.record_id AND s.version_ref = '1.2' LEFT JOIN (SELECT doc_id, record_id, max(active::INT) AS some FROM ({_STORE}) a GROUP BY doc_id, record_id) h ON h.doc_id = coalesce(s.doc_id, n.doc_id) AND h.record_id = coalesce(s.record_id, n.record_id)",
    "set_active": f"SELECT doc_id, record_id, version_ref, target, status, CASE WHEN record_pos % 5 >= 3 THEN active WHEN record_pos % 4 = 2 THEN false WHEN record_pos % 4 = 0 THEN version_ref = '1.1' WHEN record_pos % 4 = 1 THEN active WHEN bool_or(version_ref = '1.2') OVER (PARTITION BY doc_id, record_id) THEN version_ref = '1.2' ELSE active END AS active FROM ({_STORE}) s",
    "todo_states": _TODO_STATES,
    "todo_states_folded": _TODO_STATES,
    "latest_incomplete_todo": f"WITH t AS (SELECT * FROM ({_TODOS}) d WHERE NOT complete), n AS (SELECT project, arg_max(todo_id, created_at * 1000000000 + todo_id) AS todo_id FROM t GROUP BY project) SELECT n.project, n.todo_id, o.overlaps, CASE WHEN o.overlaps > 0 THEN 'ambiguous_latest_todo' END AS rule FROM n, LATERAL (SELECT count(*) AS overlaps FROM t x, t y WHERE x.project = n.project AND x.todo_id = n.todo_id AND y.project = n.project AND y.todo_id <> n.todo_id AND (y.a IN (x.a, x.b) OR y.b IN (x.a, x.b))) o",
    "context_merge": _MERGED,
    "context_merge_actions": f"SELECT policy, action, count(*) AS n FROM ({_MERGED}) m GROUP BY policy, action",
    "chapter_note_append": _notes("append"),
    "chapter_note_conflicts": _notes("conflict"),
    "candidate_dispositions": _DISPOSED,
    "undecided_candidates": f"SELECT candidate_id, normalized FROM ({_DISPOSED}) d WHERE disposition = 'open'",
    "span_records": f"SELECT r.doc_id, r.record_id, s.span_index AS start FROM ({_PLACED}) r ASOF JOIN ({_SPANS}) s ON s.doc_id = r.doc_id AND r.span_index >= s.span_index",
    "made_words": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(CASE span_index % 6 WHEN 2 THEN 'a ' || c || 'z' WHEN 3 THEN 'x  ' || c WHEN 5 THEN c || ' & so' ELSE c END, '{_TEXT_WORDS}'))) AS word FROM (SELECT doc_id, span_index, 'x ' || replace(span, '|', '/') || ' x' AS c FROM v_spans WHERE span_index % 6 <> 4) s) w GROUP BY doc_id, word",
}
