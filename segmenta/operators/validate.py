"""Validation: each rule is a filter or join that emits findings with one schema (V, GR10, SO1-2, TK6)."""

from __future__ import annotations

from segmenta.plans.dialect import TOKEN, Spark

# Enclosing quotation marks that count in a source, and in a target.
SOURCE_QUOTES = ["“”", "‘’", "«»", "„“", "‚‘", "\"\""]
TARGET_QUOTES = [*SOURCE_QUOTES, "»«", "›‹"]


#: What befalls a pair by its position: (source, target).
DAMAGE = {
    1: ("source", "' \t '"),
    2: ("concat('“', source, '”')", "source"),
    3: ("concat('“', source, '”')", "concat('„', source, '“')"),
    4: ("concat(source, ' – so')", "concat(source, ', so')"),
    5: ("source", "concat('So\u00adft ', source)"),
    6: ("concat('A __NAME_001__ b __TAG_002__: ', source)", "concat('Ein __NAME_003__: ', source)"),
    7: ("concat('__NAME_001__ ', source)", "concat(source, ' __NAME_001__')"),
    8: ("concat('__SPANTX_0001__ ', source)", "source"),
}


def pairs(d: Spark) -> str:
    """Pairs of source and target of all records with a target, some of them damaged."""
    either = ["CASE record_pos % 13 " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in DAMAGE.items()) + f" ELSE {('source', 'target')[i]} END" for i in (0, 1)]
    return f"(SELECT doc_id, record_id, {either[0]} AS source, {either[1]} AS target FROM v_progress WHERE target IS NOT NULL) q"


def finding(severity: str, rule: str, where: str, table: str, keys: str = "doc_id, record_id") -> str:
    return f"SELECT {keys}, '{severity}' AS severity, '{rule}' AS rule FROM {table} WHERE {where}"


def quoted(column: str, marks: list[str]) -> str:
    either = ", ".join(f"'{m}'" for m in marks)
    return f"(length({column}) >= 2 AND concat(substr({column}, 1, 1), substr({column}, length({column}), 1)) IN ({either}))"


def pair_rule(severity: str, rule: str, where):
    return lambda d: f"SELECT doc_id, record_id, source, target, '{severity}' AS severity, '{rule}' AS rule FROM {pairs(d)} WHERE {where(d)}"


def trim(d: Spark, column: str) -> str:
    return d.replace_all(column, r"^\s+|\s+$", "")


#: Each record of the store with its effective target and the source that it has now.
JUDGED = "(SELECT e.*, r.source_sha256 AS now_sha256, r.chunk_id AS now_chunk FROM v_effective e LEFT JOIN v_records r ON r.doc_id = e.doc_id AND r.record_pos = e.record_pos) j"
STORE_RULES = {
    "stale_store_record": ("error", "now_sha256 IS NULL OR now_sha256 <> source_sha256"),
    "store_chunk_mismatch": ("error", "substr(record_id, 1, 4) <> chunk_id"),
    "active_review_missing": ("error", "active_review IS NOT NULL AND review_target IS NULL"),
    "active_review_not_accepted": ("error", "review_status <> 'accepted'"),
    "active_review_base_drift": ("error", "review_status = 'accepted' AND chain_stale"),
    "invalid_active_version": ("error", "version_target IS NULL"),
    "active_version_not_accepted": ("error", "kind = 'version' AND version_status <> 'accepted'"),
}


def all_findings(d: Spark) -> str:
    """The store's findings by one pass over its records, which lists what each breaks; candidates outside the ledger by an anti join."""
    broken = d.array(*(f"CASE WHEN {where} THEN '{severity}:{rule}' END" for rule, (severity, where) in STORE_RULES.items()))
    rows = d.elements(JUDGED, "doc_id, record_id, chapter_no", broken, "x IS NOT NULL")
    # a candidate meets the ledger under each version once
    ledger = f"SELECT c.doc_id, c.record_id, 'error:missing_ledger_version' FROM v_candidates c {d.ANTI} v_ledger l ON l.profile = c.profile AND l.version_ref = c.version_ref"
    return f"SELECT doc_id, record_id, {d.before('piece', ':')} AS severity, split_part(piece, ':', 2) AS rule FROM (SELECT doc_id, record_id, piece FROM ({rows}) s UNION ALL {ledger}) u"


QUERIES = {
    "rule_empty_target": pair_rule("error", "empty_target", lambda d: f"{trim(d, 'target')} = ''"),
    "rule_outer_quotes": pair_rule("error", "outer_quotation_marks_preserved", lambda d: f"{quoted('source', SOURCE_QUOTES)} AND NOT {quoted('target', TARGET_QUOTES)}"),
    "rule_dash_cue": pair_rule("warn", "dash_semantic_cue_missing", lambda d: f"{d.found('source', '[–—]')} AND NOT {d.found('target', '[–—]')}"),
    "rule_soft_hyphen": pair_rule("warn", "target_contains_soft_hyphen", lambda d: "instr(target, '­') > 0"),
    # V2, V3, SO2
    "rule_placeholders": lambda d: f"SELECT * FROM (SELECT doc_id, record_id, source, target, {d.except_(d.matches('source', TOKEN), d.matches('target', TOKEN))} AS removed, {d.except_(d.matches('target', TOKEN), d.matches('source', TOKEN))} AS added FROM {pairs(d)}) t WHERE removed <> '' OR added <> ''",
    # V4
    "rule_protected_name": lambda d: f"SELECT doc_id, record_id, token FROM (SELECT doc_id, record_id, target, piece AS token FROM ({d.elements(pairs(d), 'doc_id, record_id, target', d.matches('source', TOKEN))}) e) t WHERE substr(token, 3, 4) = 'NAME' AND instr(target, token) = 0",
    "rule_epub_legacy_placeholders": lambda d: f"SELECT doc_id, record_id, source FROM {pairs(d)} WHERE instr(source, '__TAG_') > 0 OR instr(source, '__SPANTX_') > 0",
    **{f"rule_{rule}": (lambda d, rule=rule: finding(STORE_RULES[rule][0], rule, STORE_RULES[rule][1], JUDGED)) for rule in STORE_RULES},
    # V30, JN9: referential check of every candidate, active or not
    "rule_missing_ledger_version": lambda d: "SELECT c.doc_id, c.record_id, c.version_ref, CASE WHEN s.active_version = c.version_ref THEN 'active' ELSE 'inactive' END AS candidate_scope FROM v_candidates c LEFT JOIN v_ledger l ON l.profile = c.profile AND l.version_ref = c.version_ref JOIN v_store s ON s.doc_id = c.doc_id AND s.record_pos = c.record_pos WHERE l.version_ref IS NULL",
    # V17-V19, JN12, SO1: chunk against its translated file, which lacks and adds some records
    "rule_record_sets": lambda d: "SELECT doc_id, chunk_id, removed, added, removed_ids, added_ids, source_count, target_count FROM (SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, coalesce(s.chunk_id, t.chunk_id) AS chunk_id, coalesce(" + d.joined("CASE WHEN t.record_id IS NULL THEN s.record_id END", "coalesce(s.record_id, t.record_id)", ",") + ", '') AS removed_ids, coalesce(" + d.joined("CASE WHEN s.record_id IS NULL THEN t.record_id END", "coalesce(s.record_id, t.record_id)", ",") + ", '') AS added_ids, count(CASE WHEN t.record_id IS NULL THEN 1 END) AS removed, count(CASE WHEN s.record_id IS NULL THEN 1 END) AS added, count(s.record_id) AS source_count, count(t.record_id) AS target_count FROM (SELECT doc_id, chunk_id, record_id FROM v_records) s FULL OUTER JOIN (SELECT doc_id, chunk_id, CASE WHEN record_pos % 49 = 0 THEN concat(record_id, 'x') ELSE record_id END AS record_id FROM v_records WHERE record_pos % 13 <> 0) t ON t.doc_id = s.doc_id AND t.chunk_id = s.chunk_id AND t.record_id = s.record_id GROUP BY coalesce(s.doc_id, t.doc_id), coalesce(s.chunk_id, t.chunk_id)) c WHERE removed > 0 OR added > 0",
    # Review coverage findings of pass 1
    "rule_review_coverage": lambda d: "SELECT e.doc_id, e.record_id, CASE WHEN r.record_pos IS NULL THEN 'missing_review_candidate' ELSE 'stale_review_candidate' END AS rule FROM v_effective e LEFT JOIN (SELECT doc_id, record_pos, max(CASE WHEN status = 'accepted' AND NOT chain_stale THEN 1 ELSE 0 END) AS fresh FROM v_chains WHERE pass_number = 1 GROUP BY doc_id, record_pos) r ON r.doc_id = e.doc_id AND r.record_pos = e.record_pos WHERE r.fresh IS NULL OR r.fresh = 0",
    # Inactive versions, errors downgraded
    "rule_inactive_versions": lambda d: "SELECT c.doc_id, c.record_id, c.version_ref, 'warn' AS severity, 'inactive' AS candidate_scope FROM v_candidates c JOIN v_effective e ON e.doc_id = c.doc_id AND e.record_pos = c.record_pos WHERE e.ref IS DISTINCT FROM c.version_ref AND c.target = c.source",
    # V59, GR10, TK6
    "findings_rollup": lambda d: f"SELECT severity, rule, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({all_findings(d)}) f GROUP BY severity, rule",
    "validation_counters": lambda d: f"SELECT count(*) AS chunks, count(CASE WHEN errors = 0 THEN 1 END) AS passed FROM (SELECT r.doc_id, r.chunk_id, count(f.rule) AS errors FROM v_records r LEFT JOIN ({all_findings(d)}) f ON f.doc_id = r.doc_id AND f.record_id = r.record_id GROUP BY r.doc_id, r.chunk_id) c",
    # Submission rows against each chunk's task, which lacks three of its records; the submission lacks three others and repeats one
    "acceptance_gates": lambda d: "SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, coalesce(t.chunk_id, s.chunk_id) AS chunk_id, coalesce(t.record_id, s.record_id) AS record_id, CASE WHEN t.record_id IS NULL THEN 'not_in_task' WHEN s.record_id IS NULL THEN 'missing' WHEN s.n > 1 THEN 'duplicate' ELSE 'ok' END AS gate FROM (SELECT doc_id, chunk_id, record_id FROM v_records WHERE record_pos % 50 NOT IN (10, 11, 12)) t FULL OUTER JOIN (SELECT doc_id, chunk_id, record_id, count(*) AS n FROM (SELECT doc_id, chunk_id, record_id FROM v_records WHERE record_pos % 50 >= 3 UNION ALL SELECT doc_id, chunk_id, record_id FROM v_records WHERE record_pos % 50 = 5) u GROUP BY doc_id, chunk_id, record_id) s ON s.doc_id = t.doc_id AND s.chunk_id = t.chunk_id AND s.record_id = t.record_id",
    # V23, JN2: store rows whose source record is gone
    "stale_store_orphans": lambda d: "SELECT s.doc_id, s.record_id FROM v_store s LEFT JOIN (SELECT doc_id, record_pos FROM v_records WHERE record_pos % 29 <> 1) r ON r.doc_id = s.doc_id AND r.record_pos = s.record_pos WHERE r.doc_id IS NULL",
}
