"""Progress, selection, review coverage, judging and search (GR1-GR9, FI, WN2-WN6, TK4-TK5, JN13-15)."""

from __future__ import annotations

from segmenta.plans.dialect import LETTER
from segmenta.sources.views import LEFTOVERS

LABEL = "CASE WHEN translated = 0 THEN 'pending' WHEN translated = records THEN 'complete' ELSE 'in_progress' END"
COUNTS = "count(*) AS records, count(target) AS translated, count(*) - count(target) AS remaining, CAST(sum(source_words) AS BIGINT) AS words, CAST(sum(CASE WHEN target IS NULL THEN source_words ELSE 0 END) AS BIGINT) AS remaining_words"


def by(keys: str) -> str:
    return f"SELECT *, {LABEL} AS status FROM (SELECT {keys}, {COUNTS} FROM v_progress GROUP BY {keys}) t"


def snapshot(keys: str) -> str:
    per = "SELECT e.doc_id, e.record_pos, e.chapter_no, p.pass_number, max(CASE WHEN r.status = 'accepted' AND NOT r.chain_stale THEN 1 ELSE 0 END) AS reviewed, max(CASE WHEN r.chain_stale THEN 1 ELSE 0 END) AS stale FROM v_effective e CROSS JOIN (SELECT 1 AS pass_number UNION ALL SELECT 2) p LEFT JOIN v_chains r ON r.doc_id = e.doc_id AND r.record_pos = e.record_pos AND r.pass_number = p.pass_number WHERE e.target IS NOT NULL GROUP BY e.doc_id, e.record_pos, e.chapter_no, p.pass_number"
    return f"SELECT {keys}, pass_number, count(*) AS eligible, CAST(sum(reviewed) AS BIGINT) AS reviewed, CAST(sum(CASE WHEN reviewed = 0 THEN stale ELSE 0 END) AS BIGINT) AS stale, CAST(sum(CASE WHEN reviewed = 0 AND stale = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing, min(CASE WHEN reviewed = 0 THEN record_pos END) AS first_gap FROM ({per}) s GROUP BY {keys}, pass_number"


#: Two profiles judged against each other: the active version and the newest candidate.
JUDGE = "SELECT e.doc_id, e.record_pos, e.record_id, e.chapter_no, e.source_words, e.target AS first_target, c.target AS second_target FROM v_effective e LEFT JOIN v_candidates c ON c.doc_id = e.doc_id AND c.record_pos = e.record_pos AND c.version_ref = '1.2'"

QUERIES = {
    # M0, GR9 by language
    "progress_by_lang": lambda d: f"SELECT lang, {COUNTS} FROM v_progress GROUP BY lang",
    "progress_by_doc": lambda d: f"SELECT doc_id, {COUNTS} FROM v_progress GROUP BY doc_id",
    "chunk_progress": lambda d: by("doc_id, chunk_id"),
    "chapter_progress": lambda d: by("doc_id, chapter_no"),
    # GR2: pending chunks in order
    "chapter_pending_chunks": lambda d: "SELECT doc_id, chapter_no, " + d.joined("chunk_id", "chunk_id", ",") + " AS pending FROM (SELECT DISTINCT doc_id, chapter_no, chunk_id FROM v_progress WHERE target IS NULL) t GROUP BY doc_id, chapter_no",
    "status_totals": lambda d: f"SELECT status, count(*) AS chunks, CAST(sum(records) AS BIGINT) AS records FROM ({by('doc_id, chunk_id')}) c GROUP BY status",
    # FI7, TK4
    "next_chapter": lambda d: f"SELECT doc_id, min(chapter_no) AS next_chapter FROM ({by('doc_id, chapter_no')}) c WHERE remaining > 0 GROUP BY doc_id",
    "profiles_overview": lambda d: "SELECT profile, count(*) AS records, count(target) AS translated, count(DISTINCT doc_id) AS documents FROM v_progress GROUP BY profile",
    # GR15
    "missing_for_build": lambda d: "SELECT doc_id, count(*) AS missing, CAST(sum(source_words) AS BIGINT) AS missing_words FROM v_progress WHERE target IS NULL GROUP BY doc_id",
    # WN2
    "budget_prefix": lambda d: "SELECT doc_id, record_id, source_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_pos) AS rn, sum(source_words) OVER (PARTITION BY doc_id ORDER BY record_pos) AS run FROM v_progress WHERE target IS NULL) t WHERE rn = 1 OR run <= 80",
    # WN3
    "budget_overshoot": lambda d: "SELECT doc_id, record_id, source_words FROM (SELECT *, coalesce(sum(source_words) OVER (PARTITION BY doc_id ORDER BY record_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_progress WHERE target IS NULL) t WHERE before < 80",
    # WN4
    "judge_budget": lambda d: f"SELECT doc_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_pos) AS rn2, sum(source_words) OVER (PARTITION BY doc_id ORDER BY record_pos) AS run2 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_pos) AS rn, sum(source_words) OVER (PARTITION BY doc_id ORDER BY record_pos) AS run FROM ({JUDGE}) j) a WHERE (rn = 1 OR run <= 120) AND first_target IS NOT NULL AND second_target IS NOT NULL) b) c WHERE rn2 = 1 OR run2 <= 60",
    # FI8: units around the first pending record
    "unit_chunk": lambda d: "SELECT p.doc_id, p.record_id FROM v_progress p JOIN (SELECT doc_id, min(chunk_id) AS chunk_id FROM v_progress WHERE target IS NULL GROUP BY doc_id) f ON f.doc_id = p.doc_id AND f.chunk_id = p.chunk_id WHERE p.target IS NULL",
    "unit_chapter": lambda d: "SELECT p.doc_id, p.record_id FROM v_progress p JOIN (SELECT doc_id, min(chapter_no) AS chapter_no FROM v_progress WHERE target IS NULL GROUP BY doc_id) f ON f.doc_id = p.doc_id AND f.chapter_no = p.chapter_no WHERE p.target IS NULL",
    # JN4
    "pending_records": lambda d: "SELECT doc_id, record_id FROM v_progress WHERE target IS NULL",
    # FI9
    "review_missing": lambda d: "SELECT e.doc_id, e.record_id FROM v_effective e LEFT JOIN (SELECT DISTINCT doc_id, record_pos FROM v_chains WHERE pass_number = 1) r ON r.doc_id = e.doc_id AND r.record_pos = e.record_pos WHERE r.doc_id IS NULL",
    "review_stale": lambda d: "SELECT DISTINCT doc_id, record_id, pass_number FROM v_chains WHERE chain_stale",
    "review_changed_base": lambda d: "SELECT doc_id, record_id, review_ref FROM v_chains WHERE direct_stale AND has_base",
    # GR6, GR7
    "review_snapshot": lambda d: snapshot("doc_id"),
    "review_gap_index": lambda d: "SELECT doc_id, chapter_no, pass_number, stale + missing AS gap FROM (" + snapshot("doc_id, chapter_no") + ") s WHERE stale + missing > 0",
    # JN13, GR8
    "judge_matrix": lambda d: f"SELECT doc_id, record_id, first_target, second_target, first_target = second_target AS same FROM ({JUDGE}) j",
    "judge_status": lambda d: f"SELECT doc_id, chapter_no, count(*) AS records, count(CASE WHEN first_target IS NULL OR second_target IS NULL THEN 1 END) AS candidate_gaps FROM ({JUDGE}) j GROUP BY doc_id, chapter_no",
    # WN5, WN6
    "neighbour_context": lambda d: "SELECT doc_id, record_id, lag(source) OVER (PARTITION BY doc_id ORDER BY record_pos) AS before, lead(source) OVER (PARTITION BY doc_id ORDER BY record_pos) AS after FROM v_records",
    "neighbour_in_chapter": lambda d: "SELECT doc_id, record_id, lag(target) OVER (PARTITION BY doc_id, chapter_no ORDER BY record_pos) AS before, lead(target) OVER (PARTITION BY doc_id, chapter_no ORDER BY record_pos) AS after FROM v_progress",
    # FI1: the four selector forms
    "record_range": lambda d: "SELECT doc_id, record_id, record_pos BETWEEN 10 AND 19 AS in_range, record_pos >= 30 AND record_pos < 35 AS in_count, chunk_id = '0002' AS in_chunk, chapter_no = 2 AS in_chapter FROM v_records",
    # FI2
    "search_any": lambda d: f"SELECT doc_id, record_id FROM v_progress WHERE instr(lower(source), 'tion') > 0 OR {d.found('lower(target)', 'ing[.!?]')}",
    "search_all": lambda d: f"SELECT doc_id, record_id FROM v_progress WHERE instr(lower(source), 'tion') > 0 AND {d.found('lower(target)', 'ing[.!?]')} AND instr(lower(source), 'xyz') = 0",
    # FI3, FI4, SO3
    "qa_leftovers": lambda d: f"SELECT * FROM (SELECT doc_id, record_id, {d.intersect(d.matches('lower(target)', LETTER + '+'), d.words(*LEFTOVERS))} AS leftovers FROM v_progress WHERE target IS NOT NULL) t WHERE leftovers <> ''",
    # JN15, GR17
    "todo_status": lambda d: "SELECT p.doc_id, p.planned, coalesce(c.remaining, 0) AS remaining, CASE WHEN c.remaining IS NULL THEN 'missing' WHEN c.remaining = 0 THEN 'complete' ELSE 'ready' END AS state FROM (SELECT doc_id, CAST(k AS BIGINT) AS planned FROM documents CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n) p LEFT JOIN (" + by("doc_id, chapter_no") + ") c ON c.doc_id = p.doc_id AND c.chapter_no = p.planned",
    # FI11, TK1-like: the first incomplete chapters from a start
    "todo_chapters": lambda d: "SELECT doc_id, chapter_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_no) AS k FROM (" + by("doc_id, chapter_no") + ") c WHERE remaining > 0 AND chapter_no >= 2) t WHERE k <= 2",
    # FI13
    "compatible_profiles": lambda d: "SELECT a.profile AS profile, b.profile AS other FROM (SELECT DISTINCT source AS profile, lang FROM documents) a JOIN (SELECT DISTINCT source AS profile, lang FROM documents) b ON a.lang = b.lang AND a.profile < b.profile GROUP BY a.profile, b.profile",
    # FI5
    "validation_scope": lambda d: "SELECT DISTINCT doc_id, chunk_id FROM v_records WHERE chapter_no = 2",
    # SK5
    "source_index": lambda d: "SELECT doc_id, chapter_no, record_id, source FROM v_records",
    "target_index": lambda d: "SELECT doc_id, chapter_no, record_id, target, ref FROM v_progress WHERE target IS NOT NULL",
    "source_target_index": lambda d: "SELECT doc_id, record_id, source, target FROM v_progress WHERE target IS NOT NULL",
    # SK2: document text from its records
    "rebuild_document": lambda d: f"SELECT doc_id, {d.sha(d.joined('coalesce(target, source)', 'record_pos', ' '))} AS text_sha256 FROM v_progress GROUP BY doc_id",
    # turns as records: budget over conversations
    "conversation_budget": lambda d: "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM conversations) t WHERE rn = 1 OR run <= 600",
}
