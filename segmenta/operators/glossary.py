"""Glossaries: fingerprints, term sets, binding entries (CX5, GL2, GL7, FI14, SK10, SK11, SO6, V36). Each document's glossary is made of its capitalised words."""

from __future__ import annotations

from segmenta.plans.dialect import Spark

#: A document's glossary: each capitalised word with a target, a forbidden word and an enforcement that follow from its letters.
ENTRIES = (
    "SELECT doc_id, token AS source_term, CASE WHEN length(token) % 3 = 0 THEN '' ELSE lower(token) END AS target_term, CASE WHEN length(token) % 4 = 0 THEN token ELSE '' END AS forbidden, "
    "CASE length(token) % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'warn' ELSE 'error' END AS enforce, min(record_pos * 1000 + token_pos) AS place FROM v_tokens WHERE token <> lower(token) GROUP BY doc_id, token"
)

#: Each entry's part in a rendered context, and its line there.
PARTED = (
    "SELECT *, CASE WHEN enforce = 'off' THEN 'disabled' WHEN target_term <> '' OR forbidden <> '' THEN 'binding' ELSE 'advisory' END AS part, "
    "concat('- ', source_term, CASE WHEN target_term <> '' THEN concat(' → ', target_term) ELSE '' END, CASE WHEN forbidden <> '' THEN concat(' (never: ', forbidden, ')') ELSE '' END, CASE WHEN enforce = 'warn' THEN ' [warn]' ELSE '' END) AS line "
    f"FROM ({ENTRIES}) e"
)


def rendered(d: Spark, where: str = "true") -> str:
    """SK10: a document's glossary as Markdown: a heading for each part that has entries, the entries in order of their terms."""
    part = f"SELECT doc_id, part, concat('## ', part, chr(10), {d.joined('line', 'source_term', chr(10))}) AS section FROM ({PARTED}) p WHERE {where} GROUP BY doc_id, part"
    rank = "CASE part WHEN 'binding' THEN 1 WHEN 'advisory' THEN 2 ELSE 3 END"
    return f"SELECT doc_id, {d.joined('section', rank, chr(10) + chr(10))} AS markdown FROM ({part}) s GROUP BY doc_id"


QUERIES = {
    # CX5
    "glossary_parts": lambda d: f"SELECT doc_id, source_term, part FROM ({PARTED}) p",
    "context_render": rendered,
    # SK11: a view is kept under its content's hash
    "context_views": lambda d: f"SELECT doc_id, concat('contexts/', {d.sha('markdown')}, '.md') AS path FROM ({rendered(d)}) r",
    # Contexts stored before their entries of eight letters came
    "rule_context_render_drift": lambda d: f"SELECT r.doc_id, 'warn' AS severity, 'context_render_drift' AS rule FROM ({rendered(d)}) r LEFT JOIN ({rendered(d, 'length(source_term) <> 8')}) k ON k.doc_id = r.doc_id WHERE k.markdown IS NULL OR k.markdown <> r.markdown",
    # GL7, DT13: enforced entries in order of source term
    "glossary_fingerprint": lambda d: "SELECT doc_id, " + d.sha(d.joined("concat(source_term, '=', target_term, '/', forbidden, '/', enforce)", "source_term", ";")) + f" AS fingerprint FROM ({ENTRIES}) e WHERE enforce <> 'off' GROUP BY doc_id",
    # GL2, SO6: terms that differ in case only are one, in the spelling that comes first
    "term_sets": lambda d: f"SELECT doc_id, lower(source_term) AS term, min_by(source_term, place) AS spelling, count(*) AS spellings FROM ({ENTRIES}) e GROUP BY doc_id, lower(source_term)",
    # FI14
    "binding_entries": lambda d: f"SELECT doc_id, source_term, enforce <> 'off' AND (target_term <> '' OR forbidden <> '') AS binding FROM ({ENTRIES}) e",
}
