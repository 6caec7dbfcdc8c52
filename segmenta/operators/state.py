"""State: effective targets, reviews, versions, upserts (EF, JN1-5, JN9-10, JN24, WN11, WN13, GR5, TK3)."""

from __future__ import annotations

QUERIES = {
    # EF6, JN1
    "effective_lenient": lambda d: "SELECT doc_id, record_id, kind, ref, target FROM v_effective",
    # EF7
    "effective_strict": lambda d: "SELECT doc_id, record_id, CASE WHEN active_review IS NOT NULL AND review_target IS NULL THEN 'active_review_missing' WHEN active_review IS NOT NULL AND review_status <> 'accepted' THEN 'active_review_not_accepted' WHEN active_review IS NOT NULL AND chain_stale THEN 'active_review_base_drift' WHEN active_review IS NULL AND version_status IS DISTINCT FROM 'accepted' THEN 'no_accepted_version' END AS error_rule, CASE WHEN review_status = 'accepted' AND NOT chain_stale THEN active_review WHEN active_review IS NULL AND version_status = 'accepted' THEN active_version END AS selected_ref FROM v_effective",
    # WN11
    "next_run_number": lambda d: "SELECT doc_id, record_id, pass_number, max(run_number) + 1 AS next_run FROM v_reviews GROUP BY doc_id, record_id, pass_number",
    # WN13
    "latest_review": lambda d: "SELECT doc_id, record_id, pass_number, min_by(review_ref, -run_number) AS review_ref FROM v_reviews WHERE status = 'accepted' GROUP BY doc_id, record_id, pass_number",
    # JN5
    "legacy_store_override": lambda d: "SELECT doc_id, record_id, target, CASE WHEN kind IS NOT NULL THEN 'store' WHEN target IS NOT NULL THEN 'legacy' END AS origin FROM v_progress",
    # GR5, TK3
    "version_coverage": lambda d: "SELECT c.version, c.subversion, c.version_ref, count(*) AS records, count(CASE WHEN s.active_version = c.version_ref THEN 1 END) AS active FROM v_candidates c JOIN v_store s ON s.doc_id = c.doc_id AND s.record_pos = c.record_pos GROUP BY c.version, c.subversion, c.version_ref",
    "track_coverage": lambda d: "SELECT version, count(*) AS records, max(latest) AS latest FROM (SELECT doc_id, record_pos, version, max(subversion) AS latest FROM v_candidates GROUP BY doc_id, record_pos, version) t GROUP BY version",
    # EF8: a submission writes version 1.2; it is new or overwrites; the first accepted one becomes active
    "upsert_versions": lambda d: "SELECT n.doc_id, n.record_id, '1.2' AS version_ref, n.target, CASE WHEN o.target IS NULL THEN 'create' ELSE 'overwrite' END AS action, CASE WHEN s.record_id IS NULL THEN '1.2' ELSE s.active_version END AS active_version FROM (SELECT doc_id, record_pos, record_id, concat(source, ' N') AS target FROM v_records WHERE record_pos % 2 = 0) n LEFT JOIN v_candidates o ON o.doc_id = n.doc_id AND o.record_pos = n.record_pos AND o.version_ref = '1.2' LEFT JOIN v_store s ON s.doc_id = n.doc_id AND s.record_pos = n.record_pos",
    # JN24
    "staged_overlay": lambda d: "SELECT p.doc_id, p.record_id, coalesce(CASE WHEN p.record_pos % 6 = 0 THEN concat(p.source, ' S') END, p.target) AS target FROM v_progress p",
    # FI10: base of a review of pass 2
    "review_base": lambda d: "SELECT e.doc_id, e.record_id, e.ref AS active_base, r.review_ref AS pass_base FROM v_effective e LEFT JOIN (SELECT doc_id, record_pos, min_by(review_ref, -run_number) AS review_ref FROM v_chains WHERE pass_number = 1 AND status = 'accepted' AND NOT chain_stale GROUP BY doc_id, record_pos) r ON r.doc_id = e.doc_id AND r.record_pos = e.record_pos",
}
