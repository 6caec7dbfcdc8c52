"""Gates: files, manifests, fragments, navigation and submissions (SC12, V6, V9-V14, V16, V20-V21, V25, V37-V40, V49-V53, V61-V64)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmenta.functions.fragments import fragment_findings
from segmenta.operators import glossary
from segmenta.plans.dialect import TOKEN, Spark

#: Numbered chapters of each document: which of them the contents list, the chapter map, the spans and the navigation have.
CHAPTERS = (
    "SELECT doc_id, chapter_no AS ordinal, CASE WHEN chapter_no % 7 <> 5 THEN 1 ELSE 0 END AS listed, CASE WHEN chapter_no % 5 <> 0 THEN 1 ELSE 0 END AS mapped, "
    "CASE WHEN chapter_no % 10 <> 0 THEN 1 ELSE 0 END AS extracted, CASE WHEN chapter_no % 3 <> 0 THEN 1 ELSE 0 END AS navigated, CASE WHEN chapter_no % 4 <> 0 THEN 1 ELSE 0 END AS headed "
    "FROM (SELECT DISTINCT doc_id, chapter_no FROM v_records) c"
)


def toc_audit(d: Spark) -> str:
    one = f"SELECT doc_id, CASE WHEN extracted = 1 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN extracted = 1 THEN 'epub_toc_href_extracted_but_unmapped' ELSE 'epub_toc_href_missing_from_extracted_spans' END AS rule, ordinal FROM ({CHAPTERS}) c WHERE listed = 1 AND mapped = 0"
    sums = f"SELECT doc_id, sum(listed * (1 - mapped)) AS unmapped, sum(navigated) AS navigated, sum(navigated * (1 - greatest(headed, listed))) AS nav_only, sum(greatest(headed, listed) * (1 - navigated)) AS signal_only, sum(listed) AS listed, max(CASE WHEN listed = 1 THEN ordinal END) - min(CASE WHEN listed = 1 THEN ordinal END) + 1 AS width FROM ({CHAPTERS}) c GROUP BY doc_id"
    whole = [("epub_toc_chapter_missing_from_map", "unmapped > 0"), ("epub_navigation_partial", "navigated > 0 AND nav_only = 0 AND signal_only > 0"), ("epub_chapter_sequence_gap", "listed >= 2 AND width > listed")]
    return " UNION ALL ".join([one, *[f"SELECT doc_id, 'warning' AS severity, '{rule}' AS rule, CAST(0 AS BIGINT) AS ordinal FROM ({sums}) s WHERE {where}" for rule, where in whole]])


#: A file for each chunk, with commentary around its object, two objects, or a cut end.
FILES = (
    "SELECT doc_id, chunk_id, CASE (doc_id + CAST(chunk_id AS BIGINT)) % 8 WHEN 1 THEN concat('Here it is: ', body) WHEN 2 THEN concat(body, ' done') WHEN 3 THEN concat(body, ' ', body) WHEN 4 THEN concat(body, ', ', body) "
    "WHEN 5 THEN substr(body, 1, length(body) - 1) WHEN 6 THEN concat('[', body, ']') WHEN 7 THEN '' ELSE concat('  ', body, ' ') END AS content "
    "FROM (SELECT doc_id, chunk_id, concat('{\"chunk\": \"', chunk_id, '\", \"records\": ', CAST(count(*) AS STRING), '}') AS body FROM v_records GROUP BY doc_id, chunk_id) b"
)
#: A pack of each document's capitalised words.
PACK = "(SELECT doc_id, source_term AS source, target_term AS target, CASE WHEN length(source_term) % 7 = 0 THEN target_term ELSE forbidden END AS forbidden, CASE WHEN enforce = 'error' THEN 1 ELSE 0 END AS required, CASE WHEN length(source_term) % 2 = 1 THEN 1 ELSE 0 END AS mandatory, enforce FROM (" + glossary.ENTRIES + ") e) p"

PACK_RULES = {"empty_member": "source = ''", "approved_and_forbidden": "target <> '' AND target = forbidden", "require_without_target": "required = 1 AND target = ''", "mandatory_but_off": "mandatory = 1 AND enforce = 'off'", "duplicate_identity": "source <> '' AND same > 1"}

#: A review handed in again for each review row; some with another text, some on another base.
REVIEW_IN = "SELECT doc_id, record_pos, record_id, review_ref, direct_stale, CASE WHEN record_pos % 35 = 5 THEN '9.9' ELSE base_ref END AS base_ref, has_base, target AS held, CASE WHEN record_pos % 15 = 0 THEN concat(target, ' !') ELSE target END AS target FROM v_chains"
#: A judge's decision for each translated record: label, its text, and the text that the candidate has now.
DECISIONS = "SELECT doc_id, record_id, record_pos, CASE WHEN record_pos % 9 = 1 THEN 'C' WHEN record_pos % 9 = 2 THEN 'edited' ELSE 'A' END AS decision, target AS now, CASE WHEN record_pos % 4 = 0 THEN concat(target, chr(13)) WHEN record_pos % 11 = 0 THEN concat(target, ' x') ELSE target END AS text, CASE WHEN record_pos % 13 = 0 THEN '0.0' ELSE ref END AS seen_ref, ref FROM v_progress WHERE ref IS NOT NULL"

QUERIES = {
    # SC12, V20: a file is one JSON object, without anything around it
    "rule_invalid_json": lambda d: f"SELECT doc_id, chunk_id, 'error' AS severity, 'invalid_json_or_commentary' AS rule FROM ({FILES}) f WHERE NOT ({d.found('content', r'^\s*\{')} AND {d.one_json('content')})",
    # V16
    "rule_chunk_id_changed": lambda d: "SELECT doc_id, chunk_id, file_chunk_id, 'error' AS severity FROM (SELECT DISTINCT doc_id, chunk_id, CASE WHEN (doc_id + CAST(chunk_id AS BIGINT)) % 6 = 0 THEN concat('9', substr(chunk_id, 2)) ELSE chunk_id END AS file_chunk_id FROM v_records) f WHERE file_chunk_id <> chunk_id",
    # V21, JN3: translated files whose source chunk is gone
    "rule_stale_translation": lambda d: "SELECT t.doc_id, t.chunk_id, 'warn' AS severity FROM (SELECT DISTINCT doc_id, substr(record_id, 1, 4) AS chunk_id FROM v_legacy) t LEFT JOIN (SELECT DISTINCT doc_id, chunk_id FROM v_records WHERE doc_id % 8 <> 3) s ON s.doc_id = t.doc_id AND s.chunk_id = t.chunk_id WHERE s.doc_id IS NULL",
    # V25
    "rule_source_text_mismatch": lambda d: "SELECT s.doc_id, s.record_id, 'error' AS severity FROM (SELECT doc_id, record_pos, record_id, CASE WHEN record_pos % 31 = 1 THEN concat(source, '~') ELSE source END AS stored FROM v_store) s JOIN (SELECT doc_id AS d2, record_pos AS p2, source FROM v_records) r ON r.d2 = s.doc_id AND r.p2 = s.record_pos WHERE s.stored <> r.source",
    # Settings against manifest against chunk
    "rule_manifest_drift": lambda d: "SELECT doc_id, severity, rule FROM (SELECT m.doc_id, f.severity, f.rule, CASE f.rule WHEN 'manifest_chunk_size_drift' THEN m.size <> 50 WHEN 'manifest_record_id_scheme_mismatch' THEN m.scheme <> 'v1' WHEN 'chunk_manifest_chunk_size_mismatch' THEN m.chunk_size <> m.size ELSE m.chunk_scheme <> m.scheme END AS broken FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 40 ELSE 50 END AS size, CASE WHEN doc_id % 12 = 0 THEN 'v0' ELSE 'v1' END AS scheme, CASE WHEN doc_id % 6 = 0 THEN 40 ELSE 50 END AS chunk_size, CASE WHEN doc_id % 4 = 0 THEN 'v0' ELSE 'v1' END AS chunk_scheme FROM documents) m CROSS JOIN (SELECT 'warn' AS severity, 'manifest_chunk_size_drift' AS rule UNION ALL SELECT 'error', 'manifest_record_id_scheme_mismatch' UNION ALL SELECT 'error', 'chunk_manifest_chunk_size_mismatch' UNION ALL SELECT 'error', 'chunk_manifest_record_id_scheme_mismatch') f) t WHERE broken",
    # V49-V53
    "rule_toc_audit": toc_audit,
    # V61
    "review_acceptance": lambda d: f"SELECT i.doc_id, i.record_id, i.review_ref, CASE WHEN s.source_sha256 <> {d.sha('s.source')} THEN 'source_drift' WHEN i.base_ref = '9.9' OR NOT i.has_base THEN 'base_missing' WHEN i.direct_stale THEN 'base_drift' WHEN i.target <> i.held THEN 'ref_conflict' ELSE 'unchanged' END AS gate FROM ({REVIEW_IN}) i JOIN v_store s ON s.doc_id = i.doc_id AND s.record_pos = i.record_pos",
    # Carriage returns do not count
    "judge_acceptance": lambda d: f"SELECT doc_id, record_id, CASE WHEN decision NOT IN ('A', 'B', 'edited') THEN 'unknown_label' WHEN seen_ref <> ref THEN 'candidate_drift' WHEN decision <> 'edited' AND {d.replace_all('text', chr(92) + 'r', '')} <> {d.replace_all('now', chr(92) + 'r', '')} THEN 'copy_differs' ELSE 'ok' END AS gate FROM ({DECISIONS}) j",
    # V63
    "pack_rules": lambda d: " UNION ALL ".join(f"SELECT doc_id, source, '{rule}' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(source)) AS same FROM {PACK}) t WHERE {where}" for rule, where in PACK_RULES.items()),
    # Coverage of every block and the text rules of its rows, in one pass
    "block_lint": lambda d: f"SELECT doc_id, chunk_id, record_id, CASE WHEN target IS NULL THEN 'missing' WHEN {d.replace_all('target', r'^\s+|\s+$', '')} = '' THEN 'empty_target' WHEN {d.except_(d.matches('source', TOKEN), d.matches('target', TOKEN))} <> '' THEN 'placeholders' ELSE 'ok' END AS lint FROM (SELECT doc_id, chunk_id, record_id, source, CASE WHEN record_pos % 7 = 3 THEN ' ' WHEN record_pos % 7 <> 5 THEN source END AS target FROM v_records) b",
}

#: Records as fragments; by their position the target loses a tag, gains an attribute, changes an opaque part or breaks.
FRAGMENTS = (
    "SELECT doc_id, record_id, concat('<em class=\"a\">', t, '</em><code>k</code>') AS source, CASE WHEN record_pos % 11 = 1 THEN t WHEN record_pos % 11 = 2 THEN concat('<em class=\"b\">', t, '</em><code>k</code>') "
    "WHEN record_pos % 11 = 3 THEN concat('<em class=\"a\">', t, '</em><code>K</code>') WHEN record_pos % 11 = 4 THEN concat('<em class=\"a\">', t) WHEN record_pos % 11 = 5 THEN concat('<p>', t, '</p>') ELSE concat('<em class=\"a\">', t, '</em><code>k</code>') END AS target "
    "FROM (SELECT *, replace(replace(source, '&', '&amp;'), '<', '&lt;') AS t FROM v_records) r"
)


def rule_inline_xhtml(spark: SparkSession, plan) -> DataFrame:
    return fragment_findings(plan(FRAGMENTS), ["doc_id", "record_id"])


#: A parser's work, so without a SQL oracle.
FRAMES = {"rule_inline_xhtml": rule_inline_xhtml}
