"""The validation report: every rule's findings as rows of one schema, and their counts by severity (V32, V59, SK9, GR10, TK6).

Content rules are one array for each candidate, so a pass over the candidates finds all that each breaks; rules of the
store come from `validate.all_findings`, rules of chunks and documents from their own queries.
"""

from __future__ import annotations

from segmenta.operators import gates, validate
from segmenta.operators.validate import DAMAGE, SOURCE_QUOTES, TARGET_QUOTES, quoted, trim
from segmenta.plans.dialect import TOKEN, Spark

NAME = r"__NAME_\d+__"


def content_rules(d: Spark) -> dict[str, tuple[str, str]]:
    """Severity and condition over `source` and `target`."""
    before, after = d.matches("source", TOKEN), d.matches("target", TOKEN)
    return {
        "empty_target": ("error", f"{trim(d, 'target')} = ''"),
        "placeholder_removed": ("error", f"{d.except_(before, after)} <> ''"),
        "placeholder_added": ("error", f"{d.except_(after, before)} <> ''"),
        "protected_name_changed": ("error", f"{d.except_(d.matches('source', NAME), d.matches('target', NAME))} <> ''"),
        "outer_quotation_marks_preserved": ("error", f"{quoted('source', SOURCE_QUOTES)} AND NOT {quoted('target', TARGET_QUOTES)}"),
        "dash_semantic_cue_missing": ("warn", f"{d.found('source', '[–—]')} AND NOT {d.found('target', '[–—]')}"),
        "target_contains_soft_hyphen": ("warn", "instr(target, '­') > 0"),
        "epub_legacy_placeholders": ("error", "instr(source, '__TAG_') > 0 OR instr(source, '__SPANTX_') > 0"),
    }


def candidate_findings(d: Spark) -> str:
    """Findings of every candidate's content; those of inactive versions are warnings of scope inactive.

    The candidates' texts are damaged by their records' positions, each version of a record alike.
    """
    either = ["CASE c.record_pos % 13 " + " ".join(f"WHEN {k} THEN {v[i].replace('source', 'c.source')}" for k, v in DAMAGE.items()) + f" ELSE {('c.source', 'c.target')[i]} END" for i in (0, 1)]
    pairs = f"(SELECT c.doc_id, c.record_id, c.version_ref, CASE WHEN e.ref = c.version_ref THEN 'active' ELSE 'inactive' END AS scope, {either[0]} AS source, {either[1]} AS target FROM v_candidates c LEFT JOIN v_effective e ON e.doc_id = c.doc_id AND e.record_pos = c.record_pos) p"
    broken = d.array(*(f"CASE WHEN {where} THEN '{severity}:{rule}' END" for rule, (severity, where) in content_rules(d).items()))
    rows = d.elements(pairs, "doc_id, record_id, version_ref, scope", broken, "x IS NOT NULL")
    return f"SELECT doc_id, record_id, version_ref, scope, CASE WHEN scope = 'inactive' THEN 'warn' ELSE {d.before('piece', ':')} END AS severity, split_part(piece, ':', 2) AS rule FROM ({rows}) f"


def everything(d: Spark) -> str:
    """All findings as (doc_id, scope, severity, rule)."""
    sets = validate.QUERIES["rule_record_sets"](d)
    parts = [
        f"SELECT doc_id, scope, severity, rule FROM ({candidate_findings(d)}) a",
        f"SELECT doc_id, 'active', severity, rule FROM ({validate.all_findings(d)}) b",
        f"SELECT doc_id, 'active', 'error', 'record_count_changed' FROM ({sets}) c WHERE source_count <> target_count",
        f"SELECT doc_id, 'active', 'error', 'record_id_removed' FROM ({sets}) d WHERE removed > 0",
        f"SELECT doc_id, 'active', 'error', 'record_id_added' FROM ({sets}) e WHERE added > 0",
        f"SELECT doc_id, 'active', severity, 'chunk_id_changed' FROM ({gates.QUERIES['rule_chunk_id_changed'](d)}) f",
        f"SELECT doc_id, 'active', severity, 'stale_translation' FROM ({gates.QUERIES['rule_stale_translation'](d)}) g",
        f"SELECT doc_id, 'active', severity, 'source_text_mismatch' FROM ({gates.QUERIES['rule_source_text_mismatch'](d)}) h",
        f"SELECT doc_id, 'active', severity, rule FROM ({gates.QUERIES['rule_manifest_drift'](d)}) i",
        f"SELECT doc_id, 'active', CASE WHEN severity = 'warning' THEN 'warn' ELSE severity END, rule FROM ({gates.QUERIES['rule_toc_audit'](d)}) j",
        f"SELECT doc_id, 'active', severity, rule FROM ({gates.QUERIES['rule_invalid_json'](d)}) k",
        f"SELECT doc_id, 'active', 'warn', rule FROM ({validate.QUERIES['rule_review_coverage'](d)}) l",
    ]
    return " UNION ALL ".join(parts)


RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
QUERIES = {
    "candidate_findings": candidate_findings,
    # V59, SK9, TK6
    "validation_report": lambda d: f"SELECT {RANK} AS severity_rank, severity, rule, scope, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({everything(d)}) t GROUP BY severity, rule, scope",
    # FI6, GR10: whether a document passes, strictly or not
    "validation_outcome": lambda d: f"SELECT doc_id, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warn' THEN 1 END) AS warnings, count(CASE WHEN scope = 'inactive' THEN 1 END) AS inactive, count(CASE WHEN severity = 'error' THEN 1 END) > 0 AS fails FROM ({everything(d)}) t GROUP BY doc_id",
}
