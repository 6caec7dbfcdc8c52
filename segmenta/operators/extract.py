"""Extraction: spans, records, chunks, tokens, chapters, submissions (SC, PR, JN6-8, WN1, WN7-10, WN16)."""

from __future__ import annotations

from segmenta.plans.dialect import TOKEN, Spark

NUMBERS = [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five"), (6, "six"), (7, "seven"), (8, "eight"), (9, "nine"), (10, "ten"), (11, "eleven"), (12, "twelve")]


def ordinal(title: str, d: Spark) -> str:
    """Arabic, small Roman or English number, with or without a leading Chapter, Part, Book or Section."""
    bare = d.replace_all(f"lower({title})", r"^(chapter|part|book|section)\s+|[.:]$", "")
    words = " ".join(f"WHEN {bare} = '{w}' THEN {n}" for n, w in NUMBERS)
    roman = " ".join(f"WHEN {bare} = '{r}' THEN {n}" for n, r in enumerate("i ii iii iv v vi vii viii ix x xi xii".split(), 1))
    return f"CAST(CASE WHEN {d.found(bare, '^[0-9]{1,6}$')} THEN CAST({bare} AS INT) {words} {roman} END AS BIGINT)"


#: Chapters of documents with titles of every kind; some numbers are left out.
TITLED = (
    "SELECT doc_id, chapter_no, CASE chapter_no % 6 WHEN 0 THEN CAST(chapter_no AS STRING) WHEN 1 THEN concat('Chapter ', CAST(chapter_no AS STRING), ':') "
    + "".join(f"WHEN {k} THEN CASE chapter_no " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(titles.split(), 1)) + " ELSE 'Prologue' END " for k, titles in ((2, "I II III IV V VI VII VIII IX X XI XII"), (3, "one TWO Three four five six seven eight nine ten eleven twelve")))
    + "WHEN 4 THEN concat('Part ', CAST(chapter_no AS STRING)) ELSE '' END AS title FROM (SELECT DISTINCT doc_id, chapter_no FROM v_records) c WHERE (doc_id + chapter_no) % 5 <> 0"
)

QUERIES = {
    # SC2, SC3: non-blank lines as spans
    "line_spans": lambda d: "SELECT doc_id, span_index, span FROM v_spans",
    # PR7, PR8, PR10, WN1
    "sentence_records": lambda d: "SELECT doc_id, record_pos, record_id, source FROM v_records",
    # PR9, GR1: chunks and their sizes
    "chunk_packing": lambda d: "SELECT doc_id, chunk_id, count(*) AS records, min(record_id) AS first_id, max(record_id) AS last_id FROM v_records GROUP BY doc_id, chunk_id",
    "record_word_counts": lambda d: "SELECT doc_id, record_id, source_words FROM v_records",
    "record_sha": lambda d: "SELECT doc_id, record_id, source_sha256 FROM v_records",
    # PR6: tokens of texts with protected names put in
    "collect_tokens": lambda d: f"SELECT doc_id, pos AS token_pos, piece AS token FROM ({d.elements('(SELECT doc_id, ' + d.replace_all('text', 'the', '__NAME_001__') + ' AS t FROM documents) s', 'doc_id', d.matches('t', TOKEN))}) x",
    # PR2, PR5: protect and restore are inverse
    "restore_tokens": lambda d: f"SELECT doc_id, record_id, replace(replace(source, 'the', '__NAME_001__'), 'of', '__NAME_002__') AS hidden, replace(replace(replace(replace(source, 'the', '__NAME_001__'), 'of', '__NAME_002__'), '__NAME_002__', 'of'), '__NAME_001__', 'the') AS restored FROM v_records",
    # PR2: number of first appearance
    "name_first_appearance": lambda d: f"SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, term) AS BIGINT) AS token_number FROM (SELECT doc_id, term, CAST(instr(text, term) AS BIGINT) AS place FROM documents CROSS JOIN (SELECT 'with' AS term UNION ALL SELECT 'that' UNION ALL SELECT 'from') terms) t WHERE place > 0",
    # PR14, SC26: tags stripped from pages, references kept
    "strip_tags": lambda d: f"SELECT page_id, {d.sha(d.replace_all('html', '<[^>]+>', ''))} AS text_sha256 FROM pages",
    # PR23: anchors of a page
    "toc_anchors": lambda d: f"SELECT page_id, pos AS anchor, {d.replace_all('piece', '^<a href=.|.>.*$', '')} AS href, {d.replace_all(d.replace_all('piece', '^<a [^>]*>', ''), '</a>$', '')} AS title FROM ({d.elements('pages', 'page_id', d.matches('html', '<a href=[^>]*>[^<]*</a>'))}) a",
    "href_parts": lambda d: f"SELECT page_id, {d.replace_all('url', '[?#].*$', '')} AS href, {d.replace_all(d.replace_all('url', '^[a-z]+://', ''), '[/?#].*$', '')} AS host FROM pages",
    # WN7, GR2: chapters begin every 20 records and end before the next
    "chapter_assembly": lambda d: "SELECT doc_id, chapter_no, start_pos, coalesce(lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos) - 1, last_pos) AS end_pos FROM (SELECT doc_id, chapter_no, min(record_pos) AS start_pos, max(max(record_pos)) OVER (PARTITION BY doc_id) AS last_pos FROM v_records GROUP BY doc_id, chapter_no) b",
    # JN6: as-of boundary, by a running maximum instead of a range join
    "chapter_of_record": lambda d: "SELECT doc_id, record_id, CAST(max(CASE WHEN record_pos % 20 = 0 THEN floor(record_pos / 20) + 1 END) OVER (PARTITION BY doc_id ORDER BY record_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chapter_no FROM v_records",
    # PR24
    "chapter_ordinal": lambda d: f"SELECT doc_id, chapter_no, title, {ordinal('title', d)} AS ordinal FROM ({TITLED}) t",
    # WN8
    "chapter_gaps": lambda d: f"SELECT doc_id, title, ordinal, next_ordinal - ordinal - 1 AS missing FROM (SELECT doc_id, title, ordinal, lead(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS next_ordinal FROM (SELECT doc_id, title, {ordinal('title', d)} AS ordinal FROM ({TITLED}) t) o WHERE ordinal IS NOT NULL) g WHERE next_ordinal - ordinal > 1",
    # WN9
    "transition_boundaries": lambda d: "SELECT doc_id, record_pos, chapter_no FROM (SELECT *, lag(chapter_no) OVER (PARTITION BY doc_id ORDER BY record_pos) AS before FROM v_records) t WHERE before IS NULL OR before <> chapter_no",
    # WN10: one boundary a span, titled first
    "boundary_merge": lambda d: "SELECT doc_id, span_index, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_index ORDER BY CASE WHEN title IS NULL THEN 1 ELSE 0 END, record_pos) AS k FROM (SELECT doc_id, record_pos, CAST(floor(record_pos / 3) AS BIGINT) AS span_index, CASE WHEN source_words < 6 THEN source END AS title FROM v_records) t) u WHERE k = 1",
    # WN16: records before each span
    "span_record_starts": lambda d: "SELECT doc_id, chunk_id, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY chunk_id) - n AS BIGINT) AS starts_at FROM (SELECT doc_id, chunk_id, count(*) AS n FROM v_records GROUP BY doc_id, chunk_id) c",
    # JN18: first record at or after a position
    "nav_asof_span": lambda d: "SELECT n.doc_id, n.wanted, min(r.record_pos) AS record_pos FROM (SELECT doc_id, CAST(15 AS BIGINT) AS wanted FROM documents) n JOIN v_records r ON r.doc_id = n.doc_id AND r.record_pos >= n.wanted GROUP BY n.doc_id, n.wanted",
    # PR18: legacy rows with and without a store row
    "legacy_migration": lambda d: "SELECT l.doc_id, l.record_id, CASE WHEN s.record_id IS NULL THEN 'migrated' ELSE 'kept' END AS action FROM v_legacy l LEFT JOIN v_store s ON s.doc_id = l.doc_id AND s.record_pos = l.record_pos",
    # PR19
    "identity_projection": lambda d: "SELECT doc_id, record_id, source AS target FROM v_records",
}
