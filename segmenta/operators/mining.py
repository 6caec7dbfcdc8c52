"""Term mining: tokens, hyphenated forms, phrases, scores, buckets, style (DT, GR11-13, TK1-2, SO7)."""

from __future__ import annotations

from segmenta.plans.dialect import LETTER, Spark

# Quotation marks by style.
QUOTES = {"low_high": "[„‚]", "curly": "[“”‘]", "angled": "[«»]", "straight": '"', "dashes": "[–—]"}
#: Records, some of them said by someone.
SPOKEN = "(SELECT doc_id, CASE record_pos % 7 WHEN 1 THEN concat('“', source, '”') WHEN 2 THEN concat('— ', source) WHEN 3 THEN concat('„', source, '“ – so') WHEN 4 THEN concat(source, ' «ja» ', '\"no\"') ELSE source END AS shown FROM v_records) r"
#: Records, some of which write their pairs of words with a hyphen.
PAIRED = "(SELECT doc_id, CASE WHEN record_pos % 3 = 1 THEN replace(source, ' ', '-') ELSE source END AS shown FROM v_records) r"


def bucket(d: Spark, word: str) -> str:
    """The rule of `terms.case_bucket`: upper where all letters are capitals, title where only the first is one."""
    capitals, letters = d.size(d.matches(word, r"\p{Lu}")), d.size(d.matches(word, r"\p{L}"))
    return f"CASE WHEN {letters} = 0 OR {capitals} = 0 THEN 'lower' WHEN {capitals} = {letters} THEN 'upper' WHEN {capitals} = 1 AND {d.found(word, r'^[^\p{L}]*\p{Lu}')} THEN 'title' ELSE 'mixed' END"


QUERIES = {
    # DT0
    "case_buckets": lambda d: f"SELECT token, {bucket(d, 'token')} AS bucket, count(*) AS occurrences FROM v_tokens GROUP BY token",
    # TK2
    "surface_forms": lambda d: "SELECT normalized, token, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY occurrences DESC, token) AS k FROM (SELECT lower(token) AS normalized, token, count(*) AS occurrences FROM v_tokens GROUP BY lower(token), token) s) t WHERE k <= 3",
    # TK7: first three places of a term
    "term_examples": lambda d: "SELECT normalized, doc_id, record_id FROM (SELECT normalized, doc_id, record_id, row_number() OVER (PARTITION BY normalized ORDER BY doc_id, record_pos) AS k FROM (SELECT DISTINCT lower(token) AS normalized, doc_id, record_pos, record_id FROM v_tokens) u) t WHERE k <= 3",
    # GR13
    "style_metrics": lambda d: f"SELECT doc_id, count(*) AS sentences, round(avg(source_words), 3) AS mean_words, CAST(sum({d.size(d.matches('source', '—'))}) AS BIGINT) AS dashes, CAST(sum({d.size(d.matches('source', '[“”„«»]'))}) AS BIGINT) AS quotes, CAST(sum({d.size(d.matches('source', '[*_]' + LETTER + '+[*_]'))}) AS BIGINT) AS emphasis FROM v_records GROUP BY doc_id",
    # GR13: records of dialogue, by how they begin, and quotation marks by style
    "style_profile": lambda d: "SELECT doc_id, count(*) AS sentences, CAST(sum(speech) AS BIGINT) AS dialogue, round(avg(speech), 6) AS dialogue_ratio, " + ", ".join(f"CAST(sum({d.size(d.matches('shown', p))}) AS BIGINT) AS {n}" for n, p in QUOTES.items()) + f" FROM (SELECT doc_id, shown, CASE WHEN {d.found('shown', '^[–—„“«»‘‚]')} THEN 1 ELSE 0 END AS speech FROM {SPOKEN}) s GROUP BY doc_id",
    # SO7: hyphenated and spaced variants of one term
    "hyphen_variant_merge": lambda d: f"SELECT merged, count(*) AS occurrences, count(DISTINCT form) AS variants, min(form) AS kept FROM (SELECT piece AS form, replace(lower(piece), '-', ' ') AS merged FROM ({d.elements(PAIRED, 'doc_id', d.matches('shown', f'{LETTER}+[ -]{LETTER}+'))}) e) v GROUP BY merged",
    # DT13
    "extracted_fingerprint": lambda d: f"SELECT doc_id, {d.sha(d.joined('source_sha256', 'record_pos', ','))} AS fingerprint FROM v_records GROUP BY doc_id",
}
