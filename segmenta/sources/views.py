"""Logical tables as named SQL: records of documents, their chapters, candidates, reviews and glossary.

Each view is a function of the dialect; `closure` lists what a query needs, in order. Records are numbered
inside one document's array before it is exploded, so numbering costs no shuffle.
"""

from __future__ import annotations

import re

from segmenta.plans.dialect import LETTER, WORD, Spark
from segmenta.sources import segments

# A glossary with required, forbidden, overlapping and unenforced entries.
GLOSSARY = [(0, "the", "le", "trash", "error"), (1, "of the", "du", "de le", "error"), (2, "under", "sous", "", "warn"), (3, "that", "que", "trash", "warn"), (4, "erer", "", "", "off"), (5, "with", "avec", "worthless", "error")]
# English function words that betray an untranslated target.
LEFTOVERS = "the and of to in that is was for with".split()


#: Keeps what is not blank.
EMPTY = "x <> ''"
DRIFT = "'drift'"


def v_sentences(d: Spark) -> str:
    """Sentences of documents, numbered: the only view that segments texts."""
    pieces = d.elements("documents", "doc_id, source AS profile, lang", d.trimmed(segments.split(d, "coalesce(text, '')", "coalesce(lang, 'en')")), EMPTY)
    return f"SELECT doc_id, profile, lang, pos AS record_pos, piece AS source, {d.size(d.matches('piece', WORD))} AS source_words FROM ({pieces}) p"


def v_records(d: Spark) -> str:
    return (
        f"SELECT doc_id, profile, lang, record_pos, source, source_words, {d.sha('source')} AS source_sha256, "
        "lpad(CAST(CAST(floor(record_pos / 50) AS BIGINT) + 1 AS STRING), 4, '0') AS chunk_id, "
        "concat(lpad(CAST(CAST(floor(record_pos / 50) AS BIGINT) + 1 AS STRING), 4, '0'), '-', lpad(CAST(record_pos % 50 + 1 AS STRING), 6, '0')) AS record_id, "
        "CAST(floor(record_pos / 20) AS BIGINT) + 1 AS chapter_no FROM v_sentences"
    )


def v_spans(d: Spark) -> str:
    lines = d.trimmed(d.split("coalesce(text, '')", r"\n"))
    return f"SELECT doc_id, pos AS span_index, piece AS span FROM ({d.elements('documents', 'doc_id', lines, EMPTY)}) p"


def v_candidates(d: Spark) -> str:
    """Versions 1.1, 1.2 and 1.10 of translated records, from one scan of them."""
    made = ((1, "true", "source"), (2, "record_pos % 4 = 0", "concat(source, ' B')"), (10, "record_pos % 28 = 0", "concat(source, ' C')"))
    versions = d.array(*(f"CASE WHEN {where} THEN {d.struct(subversion=str(n), version_ref=f"'1.{n}'", target=target)} END" for n, where, target in made))
    keys = "doc_id, profile, record_pos, record_id, chapter_no, chunk_id, source, source_words"
    rows = d.elements("(SELECT * FROM v_records WHERE record_pos % 3 <> 0) r", keys, versions, "x IS NOT NULL")
    return f"SELECT {keys}, 1 AS version, piece.subversion AS subversion, piece.version_ref AS version_ref, piece.target AS target, CASE WHEN record_pos % 17 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM ({rows}) v"


def v_store(d: Spark) -> str:
    """Translated records; some hold another source's hash, some name a version that is not there or stand in another chunk."""
    return (
        "SELECT doc_id, profile, record_pos, record_id, CASE WHEN record_pos % 43 = 0 THEN '0000' ELSE chunk_id END AS chunk_id, chapter_no, source, source_words, "
        f"CASE WHEN record_pos % 37 = 0 THEN '9.9' WHEN record_pos % 8 = 0 THEN '1.2' ELSE '1.1' END AS active_version, CASE WHEN record_pos % 41 = 0 THEN {d.sha(DRIFT)} ELSE source_sha256 END AS source_sha256, "
        "CASE WHEN record_pos % 25 = 0 THEN 'R1.3' WHEN record_pos % 20 = 0 THEN 'R2.1' WHEN record_pos % 10 = 0 THEN 'R1.2' WHEN record_pos % 5 = 0 THEN 'R1.1' WHEN record_pos % 47 = 1 THEN 'R9.9' END AS active_review FROM v_records WHERE record_pos % 3 <> 0"
    )


def v_reviews(d: Spark) -> str:
    """Reviews on a version or on another review, from one scan. R1.1 is stale where R1.3, on the same version, is fresh."""
    wrong = d.sha("'wrong'")
    made = [
        ("R1.1", 1, 1, "version", "1.1", f"CASE WHEN record_pos % 25 = 0 THEN {wrong} ELSE source_sha256 END", 5),
        ("R1.2", 1, 2, "review", "R1.1", f"CASE WHEN record_pos % 70 = 10 THEN {wrong} ELSE {d.sha("concat(source, ' R1.1')")} END", 10),
        ("R1.3", 1, 3, "version", "1.1", "source_sha256", 25),
        ("R2.1", 2, 1, "review", "R1.2", d.sha("concat(source, ' R1.2')"), 20),
    ]
    reviews = d.array(*(f"CASE WHEN record_pos % {every} = 0 THEN {d.struct(review_ref=f"'{ref}'", pass_number=str(p), run_number=str(run), base_kind=f"'{kind}'", base_ref=f"'{base}'", base_target_sha256=sha)} END" for ref, p, run, kind, base, sha, every in made))
    rows = d.elements("(SELECT * FROM v_records WHERE record_pos % 3 <> 0) r", "doc_id, record_pos, record_id, chapter_no, source", reviews, "x IS NOT NULL")
    fields = ", ".join(f"piece.{f} AS {f}" for f in "review_ref pass_number run_number base_kind base_ref base_target_sha256".split())
    return f"SELECT doc_id, record_pos, record_id, chapter_no, {fields}, concat(source, ' ', piece.review_ref) AS target, CASE WHEN record_pos % 35 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM ({rows}) v"


def v_legacy(d: Spark) -> str:
    return "SELECT doc_id, record_pos, record_id, concat(source, ' L') AS target FROM v_records WHERE record_pos % 7 = 0"


def v_ledger(d: Spark) -> str:
    """The versions that each profile has registered; some have 1.1 only."""
    versions = f"CASE WHEN length(profile) % 2 = 0 THEN {d.words('1.1', '1.2')} ELSE {d.words('1.1')} END"
    return f"SELECT profile, piece AS version_ref FROM ({d.elements('(SELECT DISTINCT source AS profile FROM documents) p', 'profile', versions)}) v"


def v_chains(d: Spark) -> str:
    """Reviews with direct_stale, chain_stale and has_base, for DuckDB: what is fresh is reached from the versions, base by base.

    In Spark the view is `records.chains`, see `registry`.
    """
    base = f"SELECT doc_id, record_pos, version_ref AS ref, {d.sha('target')} AS sha FROM v_candidates UNION ALL SELECT doc_id, record_pos, review_ref, {d.sha('target')} FROM v_reviews"
    direct = f"SELECT r.*, b.ref IS NOT NULL AS has_base, coalesce(b.sha <> r.base_target_sha256, true) AS direct_stale FROM v_reviews r LEFT JOIN ({base}) b ON b.doc_id = r.doc_id AND b.record_pos = r.record_pos AND b.ref = r.base_ref"
    fresh = (
        f"WITH RECURSIVE direct AS MATERIALIZED ({direct}), fresh AS (SELECT doc_id, record_pos, review_ref FROM direct WHERE NOT direct_stale AND base_kind = 'version' "
        "UNION ALL SELECT n.doc_id, n.record_pos, n.review_ref FROM direct n JOIN fresh f ON f.doc_id = n.doc_id AND f.record_pos = n.record_pos AND f.review_ref = n.base_ref WHERE NOT n.direct_stale)"
    )
    return f"{fresh} SELECT d.*, f.review_ref IS NULL AS chain_stale FROM direct d LEFT JOIN fresh f ON f.doc_id = d.doc_id AND f.record_pos = d.record_pos AND f.review_ref = d.review_ref"


def v_effective(d: Spark) -> str:
    return (
        "SELECT s.*, c.target AS version_target, c.status AS version_status, r.target AS review_target, r.status AS review_status, r.chain_stale, "
        "CASE WHEN r.status = 'accepted' AND NOT r.chain_stale THEN 'review' WHEN c.target IS NOT NULL THEN 'version' END AS kind, "
        "CASE WHEN r.status = 'accepted' AND NOT r.chain_stale THEN r.review_ref WHEN c.target IS NOT NULL THEN s.active_version END AS ref, "
        "CASE WHEN r.status = 'accepted' AND NOT r.chain_stale THEN r.target ELSE c.target END AS target FROM v_store s "
        "LEFT JOIN v_candidates c ON c.doc_id = s.doc_id AND c.record_pos = s.record_pos AND c.version_ref = s.active_version "
        "LEFT JOIN v_chains r ON r.doc_id = s.doc_id AND r.record_pos = s.record_pos AND r.review_ref = s.active_review"
    )


def v_progress(d: Spark) -> str:
    """Records with their effective target: store first, then legacy rows."""
    return (
        "SELECT r.*, coalesce(e.target, l.target) AS target, e.kind, e.ref FROM v_records r "
        "LEFT JOIN v_effective e ON e.doc_id = r.doc_id AND e.record_pos = r.record_pos AND e.target IS NOT NULL "
        "LEFT JOIN v_legacy l ON l.doc_id = r.doc_id AND l.record_pos = r.record_pos"
    )


def v_glossary(d: Spark) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS entry_index, '{s}' AS source_term, '{t}' AS target_term, '{f}' AS forbidden, '{e}' AS enforce" for i, s, t, f, e in GLOSSARY)


def v_tokens(d: Spark) -> str:
    return f"SELECT doc_id, profile, record_pos, record_id, chapter_no, pos AS token_pos, piece AS token FROM ({d.elements('v_records', 'doc_id, profile, record_pos, record_id, chapter_no', d.matches('source', LETTER + '+'))}) t"


def _made(d: Spark, kinds: tuple[str, ...], sep: str, mark: str, by: str = "") -> str:
    """Texts made of each document's lines by turns of `kinds`; {c} is the line, {o} and {e} what a translation puts around it."""
    o, e = ("«", "»") if mark else ("", "")
    turns = " ".join(f"WHEN {k} THEN concat({kind.format(c='c', o=f"'{o}'", e=f"'{e}'")})" for k, kind in enumerate(kinds))
    return f"SELECT doc_id{by}, {d.joined('piece', 'span_index', sep)} AS text FROM (SELECT doc_id, span_index, CAST(floor(span_index / 12) AS BIGINT) AS chapter, CASE span_index % {len(kinds)} {turns} END AS piece FROM (SELECT doc_id, span_index, concat('x ', replace(span, '|', '/'), ' x') AS c FROM v_spans) l) m GROUP BY doc_id{by}"


#: Markdown of every kind: heading, quote, item, fence, table, HTML, a definition before a paragraph, paragraph.
MARKDOWN = (
    "'# ', {o}, {c}, {e}",
    "'> ', {o}, {c}, '\n> more', {e}",
    "'- ', {o}, {c}, '\n  two', {e}",
    "'```\n', {c}, '\n\n', {c}, '\n```'",
    "'| ', {o}, 'a', {e}, ' | ', {o}, {c}, {e}, ' |\n|---|---|\n| ', {o}, 'b', {e}, ' |  |'",
    "'<div>\n', {c}, '\n</div>'",
    "'[r]: http://x.org\n', {o}, {c}, {e}",
    "{o}, {c}, {e}",
)
#: XHTML of every kind: paragraph, heading, item with inline tags, opaque element with a tag inside, script, comment.
XHTML = (
    "'<p>', {o}, {c}, {e}, '</p>'",
    "'<h2 id=\"a\">\n ', {o}, {c}, {e}, '</h2>'",
    "'<ul><li>', {o}, 'a <b>', {c}, '</b><br/>z', {e}, '</li></ul>'",
    "'<div><p>', {o}, 'x <code>k<i>j</i></code> ', {c}, {e}, '</p></div>'",
    "'<script>', {c}, '</script>'",
    "'<td>', {o}, {c}, '<!-- note -->', ' &amp; so', {e}, '</td>'",
)


def v_markdown(d: Spark) -> str:
    return _made(d, MARKDOWN, "\n\n", "")


def v_markdown_translated(d: Spark) -> str:
    return _made(d, MARKDOWN, "\n\n", "«»")


def _escaped(kinds: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(k.replace("{c}", "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')") for k in kinds)


def v_xhtml(d: Spark) -> str:
    return _made(d, _escaped(XHTML), "\n", "")


def v_xhtml_translated(d: Spark) -> str:
    return _made(d, _escaped(XHTML), "\n", "«»")


def v_chapters(d: Spark) -> str:
    """XHTML of each document by chapters of twelve lines."""
    return _made(d, _escaped(XHTML), "\n", "", ", chapter")


def v_chapters_translated(d: Spark) -> str:
    return _made(d, _escaped(XHTML), "\n", "«»", ", chapter")


def v_inline(d: Spark) -> str:
    """Lines with inline code, a link and raw HTML; some hold a token already."""
    return (
        "SELECT doc_id, span_index, concat(CASE WHEN span_index % 7 = 0 THEN '__TAG_001__ ' ELSE '' END, 'a `k', n, '` b [x](http://h/', n, ' \"t\") <b>', c, '</b> `k', n, '`') AS line, c, n "
        f"FROM (SELECT doc_id, span_index, CAST(span_index AS STRING) AS n, {d.replace_all('span', r'[`<>\[\]()_]', '')} AS c FROM v_spans) s"
    )


VIEWS = {f.__name__: f for f in (v_sentences, v_records, v_spans, v_candidates, v_store, v_reviews, v_legacy, v_ledger, v_chains, v_effective, v_progress, v_glossary, v_tokens, v_markdown, v_markdown_translated, v_xhtml, v_xhtml_translated, v_chapters, v_chapters_translated, v_inline)}


def with_views(sql: str, d: Spark, given: frozenset[str] | set[str] = frozenset()) -> str:
    """The query behind the views that it names, in order of need; `given` views are there already."""
    text: dict[str, str] = {}

    def need(body: str) -> None:
        for name in re.findall(r"\bv_\w+", body):
            if name in VIEWS and name not in text and name not in given:
                view = VIEWS[name](d)
                need(view)
                text[name] = view

    need(sql)
    return (f"WITH {d.RECURSIVE}" + ",\n".join(f"{k} AS {d.ONCE}({v})" for k, v in text.items()) + "\n" if text else "") + sql


def named(sql: str, d: Spark) -> set[str]:
    """The views that the query needs, by whatever way."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name](d))
    return found


def times(sql: str, d: Spark, view: str) -> int:
    """How often a plan reads the view, if no view is computed once for all."""
    return sum(1 if name == view else times(VIEWS[name](d), d, view) for name in re.findall(r"\bv_\w+", sql) if name in VIEWS)
