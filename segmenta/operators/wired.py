"""Queries over the DataFrame operators, each beside a DuckDB text of its own (written apart from the Spark code)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators import records as R
from segmenta.operators import report
from segmenta.operators import terms as T
from segmenta.plans.dialect import DUCK, SPARK
from segmenta.sources import segments, texts, xhtml
from segmenta.sources.views import GLOSSARY, LEFTOVERS

Over = Callable[[str], DataFrame]
ENTRIES = [T.Entry(s, target=t, require=bool(t), forbidden=(f,) if f else (), enforce=e) for _, s, t, f, e in GLOSSARY]
# Lemmas that say little, and parts of words that name things of the book's world.
GENERIC = ["tion", "ing", "ble", "ment", "keit"]
MORPHEMES = ["wh", "pf"]
INCLUDE, EXCLUDE = "^Onth", "xx"


def mined(over: Over) -> DataFrame:
    return T.mined(over("SELECT doc_id, chapter_no, record_pos, source FROM v_records"), LEFTOVERS, lists=(LEFTOVERS, GENERIC))


def risks(over: Over) -> DataFrame:
    return T.scored(mined(over), LEFTOVERS, GENERIC, MORPHEMES, INCLUDE, EXCLUDE)


def top_terms(over: Over, per_bucket: int = 80, top: int = 200) -> DataFrame:
    from pyspark.sql import Window

    order = [F.desc("risk"), F.desc("occurrences"), "normalized", "bucket", "kind"]
    best = risks(over).where("review_bucket <> 'no_action'").withColumn("k", F.row_number().over(Window.partitionBy("review_bucket").orderBy(*order))).where(F.col("k") <= per_bucket)
    return best.orderBy(*order).limit(top).select("review_bucket", "normalized", "bucket", "kind", "occurrences", "risk")


EXPORTED = "SELECT * FROM v_records WHERE floor(record_pos / 50) % 2 = 1 OR (record_pos % 3 <> 0 AND record_pos % 17 <> 0)"
TASKS = "SELECT doc_id, record_pos, record_id, concat('task-', chunk_id) AS task_id, source_sha256 FROM v_records WHERE record_pos % 3 <> 0 OR record_pos % 50 = 0"


def export_pick(over: Over) -> DataFrame:
    store = over("SELECT doc_id, record_pos, active_version, source_sha256 FROM v_store")
    rows = over(EXPORTED)
    drift = rows.select(*R.KEYS, F.col("source_sha256").alias("now")).join(store, R.KEYS).where("now <> source_sha256")
    return R.export(rows, R.picks(store, over("SELECT * FROM v_candidates")), drift)


def submitted(over: Over, lines: str, fold: Callable) -> DataFrame:
    rows = over(f"SELECT doc_id, record_pos, record_id, source, {lines} AS line FROM v_records WHERE substr(source, 1, 1) <> '#'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("record_pos", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(fold(ordered).alias("text"))


def parsed(df: DataFrame, parse: Callable) -> DataFrame:
    rows = texts.explode_texts(df, {"doc_id": "long"}, ["text"], {"record_id": "string", "target": "string", "error": "string"}, parse)
    return rows.select("doc_id", "record_id", "target", "error")


def rebuilt_both(rows: DataFrame, key: str, same, target) -> DataFrame:
    """The texts rebuilt as they were and with targets, from one reading of the spans."""
    both = F.struct(F.concat("before", F.coalesce(same, F.lit(""))).alias("same"), F.concat("before", F.coalesce(target, F.lit(""))).alias("target"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", both.alias("b")))).alias("p"))
    return whole.select(key, F.sha2(F.array_join("p.b.same", ""), 256).alias("same_sha256"), F.sha2(F.array_join("p.b.target", ""), 256).alias("translated_sha256"))


def translated_pages(pages: DataFrame) -> DataFrame:
    """Pages whose blocks come back with a mark at either end."""

    def rows(page: str) -> list[tuple]:
        found = [(before, xhtml.refill(f"«{block}»", tokens, tags, xhtml_forms) if block is not None else "") for block, before, tokens, tags, xhtml_forms in xhtml.with_forms(page)]
        return found

    made = texts.explode_texts(pages, {"doc_id": "long"}, ["text"], {"before": "string", "content": "string"}, rows)
    return texts.rebuilt(made, ["doc_id"], F.col("content")).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def json_lines(ordered):
    return F.concat(F.lit('{"records": ['), F.array_join(ordered, ", "), F.lit("]}"))


FRAMES: dict[str, Callable[[SparkSession, Over], DataFrame]] = {
    # PR25
    "normalised_block": lambda spark, over: over("SELECT doc_id, span_index, span FROM v_spans").select("doc_id", "span_index", F.regexp_replace(F.regexp_replace("span", r"\s+", " "), r"\s+([.,;:!?])", "$1").alias("block")),
    # GL1-GL4, JN11
    "term_matches": lambda spark, over: T.applicable(over("SELECT * FROM v_records"), ENTRIES).select("doc_id", "record_id", "entry_index"),
    # GL3, WN12
    "longest_match_suppression": lambda spark, over: T.term_spans(over("SELECT * FROM v_records"), ENTRIES).groupBy("doc_id", "record_id", "entry_index").agg(F.count_if("shadowed").alias("shadowed"), F.count_if(F.expr("NOT shadowed")).alias("open")),
    # V6: entries with shadowed and open spans in one record
    "rule_alignment_ambiguous": lambda spark, over: T.term_spans(over("SELECT * FROM v_records"), ENTRIES).groupBy("doc_id", "record_id", "entry_index").agg(F.bool_or("shadowed").alias("dim"), F.bool_or(~F.col("shadowed")).alias("open")).where("dim AND open").select("doc_id", "record_id", "entry_index"),
    # V5, V6
    "forbidden_terms": lambda spark, over: T.glossary_findings(over("SELECT * FROM v_progress"), ENTRIES).where("rule <> 'glossary_target_missing'").select("doc_id", "record_id", "entry_index", "severity", "rule"),
    # V7
    "required_terms": lambda spark, over: T.glossary_findings(over("SELECT * FROM v_progress"), ENTRIES).where("rule = 'glossary_target_missing'").select("doc_id", "record_id", "entry_index", "severity"),
    # GL5, GL6, GL8, GR14
    "term_audit": lambda spark, over: T.term_audit(over("SELECT * FROM v_progress"), ENTRIES),
    # JN20
    "profile_glossary_divergence": lambda spark, over: T.term_spans(over("SELECT *, target IS NOT NULL AS translated FROM v_progress"), ENTRIES, ("profile", "translated")).where("not shadowed").groupBy("entry_index").agg(F.count_distinct("profile").alias("profiles"), F.count_distinct(F.when(F.col("translated"), F.col("profile"))).alias("translated_profiles")),
    # GL9
    "audit_block": lambda spark, over: T.applicable(over("SELECT * FROM v_progress WHERE target IS NOT NULL"), ENTRIES).groupBy("doc_id", "entry_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda r: F.concat(F.lit(">>> "), r)), "|").alias("block")),
    # DT1, GR11
    "token_candidates": lambda spark, over: T.words(over("SELECT doc_id, chapter_no, record_pos, source FROM v_records")).drop("tokens"),
    # GR11
    "surface_histograms": lambda spark, over: T.histograms(over("SELECT doc_id, record_pos, source FROM v_records")),
    # DT2
    "hyphenated_candidates": lambda spark, over: T.compounds(over("SELECT doc_id, chapter_no, record_pos, source FROM v_records")).drop("tokens"),
    # DT3, WN15
    "phrase_candidates": lambda spark, over: T.mined(over("SELECT doc_id, chapter_no, record_pos, source FROM v_records"), LEFTOVERS, kinds=("phrase",)).drop("tokens", "surface"),
    # DT6
    "candidate_ids": lambda spark, over: T.words(over("SELECT doc_id, chapter_no, record_pos, source FROM v_records")).select("normalized", "bucket", T.candidate_id(F.lit("en"), F.col("normalized"), F.col("tokens"), F.col("bucket")).alias("candidate_id")),
    # DT7-DT11
    "candidate_scores": lambda spark, over: risks(over),
    # TK1, DT11
    "bucket_topk": lambda spark, over: top_terms(over),
    # GR12
    "suppressed_counts": lambda spark, over: risks(over).groupBy("review_bucket").agg(F.count("*").alias("candidates"), F.sum("occurrences").alias("occurrences")),
    # EF2, EF3
    "stale_reviews": lambda spark, over: R.chains(over("SELECT * FROM v_reviews"), over("SELECT * FROM v_candidates")).select("doc_id", "record_pos", "review_ref", "direct_stale", "chain_stale"),
    # EF4, EF5
    "review_chain": lambda spark, over: R.chains(over("SELECT * FROM v_reviews"), over("SELECT * FROM v_candidates")).where("not chain_stale").select("doc_id", "record_pos", "review_ref", "chain"),
    # EF10, TK3
    "activate_latest": lambda spark, over: R.newest(over("SELECT * FROM v_candidates")),
    # FI16, SK6
    "export_pick": lambda spark, over: export_pick(over),
    # FI1
    **{f"range_{name}": (lambda spark, over, s=selector: R.record_range(s, over("SELECT doc_id, record_pos, record_id, chunk_id, chapter_no FROM v_records")).select("doc_id", "record_id")) for name, selector in (("span", "1@3..2-5"), ("count", "0001-000049+7"), ("chunk", "chunk:2"), ("chapter", "chapter:3"), ("one", "1-12"))},
    # QV1
    "task_status": lambda spark, over: R.task_status(over(TASKS), over("SELECT * FROM v_store"), over("SELECT * FROM v_candidates")),
    # QV2, WN5
    "record_view": lambda spark, over: R.record_view(over("SELECT doc_id, record_pos, record_id, source FROM v_records"), over("SELECT * FROM v_candidates"), 2, 1),
    # QV3
    "version_listing": lambda spark, over: R.listing(over("SELECT * FROM v_records"), over("SELECT * FROM v_store"), over("SELECT * FROM v_candidates")),
    # QV4
    "compare_refs": lambda spark, over: R.compare(over("SELECT * FROM v_candidates"), over("SELECT * FROM v_reviews"), ["1.2", "1.10", "R1.2"]),
    # JN14
    "profile_compare": lambda spark, over: R.compare_profiles(over("SELECT doc_id, record_pos, 'versions' AS profile, target FROM v_candidates WHERE version_ref = '1.1' UNION ALL SELECT doc_id, record_pos, 'reviews', target FROM v_reviews WHERE review_ref = 'R1.1' UNION ALL SELECT doc_id, record_pos, 'legacy', target FROM v_legacy"), over("SELECT * FROM v_records"), ["versions", "reviews", "legacy"]),
    # WN14
    "notes_before": lambda spark, over: R.notes_before(over("SELECT doc_id, chapter_no, record_id AS note FROM v_records WHERE record_pos % 27 = 3"), over("SELECT DISTINCT doc_id, chapter_no FROM v_records")),
    # JN7
    "span_starts": lambda spark, over: R.span_starts(over("SELECT DISTINCT doc_id, CAST(floor(record_pos / 4) * 2 AS BIGINT) AS span_index FROM v_records"), over("SELECT doc_id, record_pos, CAST(floor(record_pos / 3) AS BIGINT) AS span_index FROM v_records")).select("doc_id", "span_index", F.coalesce("record_pos", F.lit(-1).cast("long")).alias("record_pos")),
    # FI6
    "finding_partitions": lambda spark, over: R.partitions(over(report.everything(SPARK))),
    # V44-V46
    "language_policy": lambda spark, over: R.language_policy(over("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'explicit' ELSE 'preserve' END AS policy, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 2 THEN 'de_AT' WHEN doc_id % 10 = 4 THEN lang ELSE concat(lang, '-Latn-419') END AS tag, lang AS source_language, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END AS target_language FROM documents")).select("doc_id", "rule", "severity"),
    # SC20
    "block_submission_parse": lambda spark, over: parsed(submitted(over, "concat('>>> ', record_id, '\\n\\n', source, '\\n# done\\n')", lambda x: F.concat(F.lit("# profile: p\n"), F.array_join(x, ""))), texts.block_submission),
    # SC19
    "tsv_submission_parse": lambda spark, over: parsed(submitted(over, "concat(record_id, '\\t', source, '\\tx')", lambda x: F.array_join(x, "\n\n")), texts.tsv_submission),
    # SC18, SC12
    "json_submission_parse": lambda spark, over: parsed(submitted(over, "to_json(named_struct('id', record_id, 'target', source))", lambda x: F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Here it is: "), json_lines(x))).otherwise(json_lines(x))), texts.json_submission),
    # SC21
    "judge_submission_parse": lambda spark, over: parsed(submitted(over, "concat('## ', record_id, '\\nDECISION: copy\\nTARGET:\\n', source, '\\n')", lambda x: F.array_join(x, "\n")), lambda t: [(i, target, d) for i, d, target in texts.judge_submission(t)]).withColumnRenamed("error", "decision"),
    # SC2, SC3
    "markdown_blocks": lambda spark, over: texts.markdown_spans(over("SELECT * FROM v_markdown"), {"doc_id": "long"}, "text").where("kind <> 'tail'").select("doc_id", "pos", "kind", "block"),
    # PR11, SK2: the text put together again from its spans, as they were and translated
    "markdown_rebuild": lambda spark, over: rebuilt_both(texts.markdown_spans(over("SELECT * FROM v_markdown"), {"doc_id": "long"}, "text"), "doc_id", texts.relined(F.col("block"), F.col("joints")), texts.relined(F.concat(F.lit("«"), "block", F.lit("»")), F.col("joints"))),
    "document_rebuild_markdown": lambda spark, over: texts.rebuilt(texts.markdown_spans(over("SELECT doc_id, text FROM documents"), {"doc_id": "long"}, "text"), ["doc_id"], texts.relined(F.col("block"), F.col("joints"))).select("doc_id", F.sha2("text", 256).alias("text_sha256")),
    # SC4, PR12
    "xhtml_made_blocks": lambda spark, over: texts.xhtml_spans(over("SELECT * FROM v_xhtml"), {"doc_id": "long"}, "text").where("element <> 'tail'").select("doc_id", "pos", "element", "block", F.array_join("tags", "|").alias("tags")),
    "xhtml_rebuild": lambda spark, over: texts.rebuilt(texts.xhtml_spans(over("SELECT page_id, html FROM pages"), {"page_id": "long"}, "html"), ["page_id"], F.col("content")).select("page_id", F.sha2("text", 256).alias("html_sha256")),
    "xhtml_translated": lambda spark, over: translated_pages(over("SELECT * FROM v_xhtml")),
    # PR1, PR3, PR5
    "inline_tokens": lambda spark, over: texts.explode_texts(over("SELECT doc_id, span_index, line FROM v_inline"), {"doc_id": "long", "span_index": "long"}, ["line"], {"hidden": "string", "tokens": "string", "restored": "string"}, lambda t: [(h, "|".join(f"{a}={b}" for a, b in k), texts.restore(h, k)) for h, k in [texts.hide_inline(t)]]).drop("pos"),
    # SC4
    "xhtml_blocks": lambda spark, over: texts.explode_texts(over("SELECT page_id, html FROM pages"), {"page_id": "long"}, ["html"], {"element": "string", "block": "string", "tags": "array<string>"}, texts.xhtml_blocks),
    # PR7, PR8
    "sentence_segments": lambda spark, over: texts.explode_texts(over("SELECT doc_id, text, lang FROM documents"), {"doc_id": "long"}, ["text", "lang"], {"sentence": "string"}, lambda t, lang: [(s,) for s in segments.sentences(t, lang)]),
    # PR1, PR5
    "hidden_inline": lambda spark, over: texts.explode_texts(over("SELECT page_id, html FROM pages"), {"page_id": "long"}, ["html"], {"token_count": "long", "hidden_chars": "long", "restored": "string"}, lambda t: [(len(k), len(t) - len(h), texts.restore(h, k)) for h, k in [texts.hide_inline(t)]]).select("page_id", (F.col("token_count") > 0).alias("hides"), F.sha2("restored", 256).alias("restored_sha256")),
}

_W = r"[^\p{L}\p{N}_]"
_EDGE = f"(^|{_W})", f"($|{_W})"


def _has(text: str, term: str) -> str:
    return f"regexp_matches({text}, '{_EDGE[0]}{term}{_EDGE[1]}')"


_WIDE = "regexp_replace(lower(source), ' ', '  ', 'g')"
_OPEN = f"regexp_replace({_WIDE}, '{_EDGE[0]}of  the{_EDGE[1]}', '\\1#\\2', 'g')"


def _applies(table: str) -> str:
    return " UNION ALL ".join(f"SELECT *, {k} AS entry_index FROM {table} WHERE {_has(_OPEN if k == 0 else _WIDE, w)}" for k, w in enumerate(["the", "of  the", "under", "that", "erer", "with"]))


_TARGET = "lower(target)"
_BAD = f"CASE entry_index WHEN 0 THEN {_has(_TARGET, 'trash')} WHEN 1 THEN {_has(_TARGET, 'de le')} WHEN 3 THEN {_has(_TARGET, 'trash')} WHEN 5 THEN {_has(_TARGET, 'worthless')} ELSE false END"
_GOOD = "CASE entry_index " + " ".join(f"WHEN {k} THEN {_has(_TARGET, t)}" for k, t in ((0, "le"), (1, "du"), (2, "sous"), (3, "que"), (5, "avec"))) + " ELSE false END"
_CAPS = "len(regexp_extract_all({0}, '\\p{{Lu}}'))"


def _bucket(s: str) -> str:
    caps = _CAPS.format(s)
    return f"CASE WHEN {caps} = len(regexp_extract_all({s}, '\\p{{L}}')) THEN 'upper' WHEN {caps} = 0 THEN 'lower' WHEN {caps} = 1 AND regexp_matches({s}, '^[^\\p{{L}}]*\\p{{Lu}}') THEN 'title' ELSE 'mixed' END"


def _counts(found: str, kind: str) -> str:
    return f"SELECT lower(surface) AS normalized, bucket, {kind} AS kind, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT (doc_id, record_pos)) AS records, count(DISTINCT (doc_id, chapter_no)) AS chapters, min(surface) AS surface FROM ({found}) f GROUP BY lower(surface), bucket"


_WORDS = _counts(f"SELECT *, {_bucket('surface')} AS bucket FROM (SELECT doc_id, record_pos, chapter_no, 1 AS n, unnest(regexp_extract_all(source, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS surface FROM v_records) w", "CASE WHEN bucket = 'title' THEN 'proper_name' ELSE 'word' END")
_COMPOUNDS = _counts(f"SELECT *, {_bucket('surface')} AS bucket FROM (SELECT doc_id, record_pos, chapter_no, 1 AS n, unnest(regexp_extract_all(source, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:-[\\p{{L}}\\p{{Nl}}\\p{{No}}]+)+')) AS surface FROM v_records) w", "'hyphenated_term'")
_COMMON = "[" + ", ".join(f"'{w}'" for w in LEFTOVERS) + "]"
_UNITS = "SELECT doc_id, record_pos, chapter_no, regexp_extract_all(unit, '[\\p{L}\\p{Nl}\\p{No}]+(?:-[\\p{L}\\p{Nl}\\p{No}]+)+|[\\p{L}\\p{Nl}\\p{No}]+') AS w FROM (SELECT doc_id, record_pos, chapter_no, unnest(string_split_regex(source, '[.,;:!?…—–\"“”‘’\\n]')) AS unit FROM v_records) u"
# how many windows of up to four words are trimmed to the run of `size` words that begins at i: with the common words that stand beside it
_RUNS = f"""SELECT doc_id, record_pos, chapter_no, array_to_string(list_slice(w, i, i + size - 1), ' ') AS surface, list_slice(w, i, i + size - 1) AS run,
 CASE size WHEN 4 THEN 1 WHEN 3 THEN 1 + l1 + r1 ELSE 1 + l1 + r1 + l1 * l2 + l1 * r1 + r1 * r2 END AS n
 FROM (SELECT *, CASE WHEN i > 1 AND b[i - 1] THEN 1 ELSE 0 END AS l1, CASE WHEN i > 2 AND b[i - 2] THEN 1 ELSE 0 END AS l2, CASE WHEN i + size <= len(w) AND b[i + size] THEN 1 ELSE 0 END AS r1, CASE WHEN i + size + 1 <= len(w) AND b[i + size + 1] THEN 1 ELSE 0 END AS r2
 FROM (SELECT *, list_transform(w, lambda x: list_contains({_COMMON}, lower(x)) OR length(x) <= 1) AS b, unnest(range(1, len(w))) AS i FROM ({_UNITS}) u0) u1 CROSS JOIN (VALUES (2), (3), (4)) s(size)) u2
 WHERE i + size - 1 <= len(w) AND len(list_filter(list_slice(b, i, i + size - 1), lambda x: x)) = 0 AND len(list_filter(list_slice(w, i, i + size - 1), lambda x: contains(x, '-'))) = 0"""
_KINDS = f"list_transform(run, lambda x: {_bucket('x')})"
_PHRASES = _counts(f"SELECT *, CASE WHEN len(list_filter({_KINDS}, lambda k: k NOT IN ('title', 'upper'))) = 0 THEN 'title' WHEN len(list_filter({_KINDS}, lambda k: k <> 'lower')) = 0 THEN 'lower' ELSE 'mixed' END AS bucket FROM ({_RUNS}) r", "CASE WHEN bucket = 'title' THEN 'title_candidate' ELSE 'phrase' END")
_DULL = "[" + ", ".join(f"'{w}'" for w in GENERIC) + "]"
_RISK = f"""SELECT normalized, bucket, kind, CAST(size AS INT) AS token_count, occurrences, records, chapters, round(genericity, 6) AS genericity, rarity, round(risk, 6) AS risk,
 round(ln(1 + occurrences) * (1 + ln(1 + chapters)) * (CASE WHEN dull THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN kind IN ('phrase', 'title_candidate', 'hyphenated_term') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score, lone,
 CASE WHEN first_bucket = 'no_action' OR (occurrences < 2 AND NOT lone) THEN 'no_action' WHEN first_bucket IN ('domain_phrase', 'maybe') AND risk < 3 THEN 'no_action' ELSE first_bucket END AS review_bucket
 FROM (SELECT *, CASE WHEN excluded OR (size = 1 AND length(normalized) <= 1) OR (size = 1 AND lemma AND NOT world AND NOT included) THEN 'no_action'
   WHEN kind = 'hyphenated_term' THEN 'binding_glossary' WHEN kind IN ('proper_name', 'title_candidate') AND NOT (size = 1 AND lemma) THEN 'name_policy' WHEN included OR lone THEN 'invented_or_rare'
   WHEN kind = 'phrase' AND size > 1 AND genericity < 1 THEN 'domain_phrase' WHEN kind = 'phrase' AND size <= 2 AND len(list_filter(tok, lambda t: list_contains({_DULL}, t))) > 0 AND NOT world AND NOT included THEN 'no_action'
   WHEN kind = 'phrase' AND size <= 3 AND genericity >= 1.2 THEN 'no_action' WHEN size = 1 AND genericity >= 1 THEN 'no_action' ELSE 'maybe' END AS first_bucket
 FROM (SELECT *, occurrences = 1 AND kind <> 'phrase' AND (kind = 'hyphenated_term' OR (kind = 'proper_name' AND NOT lemma) OR (kind = 'title_candidate' AND genericity < 1 AND size <= 2) OR world OR included OR (bucket = 'mixed' AND size = 1)) AS lone,
   4 * (CASE WHEN kind = 'hyphenated_term' THEN 1.6::DOUBLE WHEN included OR world THEN 1.4 WHEN kind IN ('proper_name', 'title_candidate') THEN 1.2 WHEN kind = 'phrase' THEN 0.6 ELSE 0.2 END) + 2.5 * rarity
   + 2 * ((CASE WHEN hyphen THEN 1.4::DOUBLE ELSE 0 END) + (CASE WHEN world THEN 1.2::DOUBLE ELSE 0 END) + (CASE WHEN included THEN 1.0::DOUBLE ELSE 0 END) + (CASE bucket WHEN 'mixed' THEN 0.8::DOUBLE WHEN 'title' THEN 0.6 ELSE 0 END))
   + 2 * ((CASE WHEN kind IN ('proper_name', 'title_candidate') THEN 1.6::DOUBLE ELSE 0 END) + (CASE WHEN bucket = 'title' THEN 0.8::DOUBLE ELSE 0 END))
   + 1.5 * (0.4::DOUBLE + (CASE WHEN size > 1 THEN 0.6::DOUBLE ELSE 0 END) + (CASE WHEN kind IN ('hyphenated_term', 'title_candidate') THEN 0.5::DOUBLE ELSE 0 END)) + least(ln(1 + occurrences), 2.0::DOUBLE) + 0.5 * least(chapters, 3) / 3.0::DOUBLE
   - 3 * genericity - (CASE WHEN size = 1 AND length(normalized) <= 1 THEN 2.0::DOUBLE ELSE 0 END) AS risk
 FROM (SELECT *, CASE WHEN occurrences <= 1 THEN 1.6::DOUBLE WHEN occurrences = 2 THEN 1.4 WHEN occurrences <= 4 THEN 1.0 WHEN occurrences <= 8 THEN 0.7 ELSE 0.3 END AS rarity,
   (CASE WHEN dull THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN lemma AND size = 1 THEN 1.2::DOUBLE WHEN lemma THEN 0.5 ELSE 0 END) + (CASE WHEN weak > 0 AND size = 1 THEN 0.8::DOUBLE WHEN weak > 0 THEN least(1.4::DOUBLE, 0.6::DOUBLE * weak) ELSE 0 END)
   + (CASE WHEN size > 1 AND list_contains({_COMMON}, tok[1]) THEN 0.6::DOUBLE ELSE 0 END) + (CASE WHEN size > 1 AND list_contains({_DULL}, tok[-1]) THEN 0.8::DOUBLE ELSE 0 END) + (CASE WHEN kind = 'word' THEN 0.4::DOUBLE ELSE 0 END) AS genericity
 FROM (SELECT *, len(tok) AS size, contains(surface, '-') OR contains(normalized, '-') AS hyphen, regexp_matches(surface, '{INCLUDE}') AS included, regexp_matches(surface, '{EXCLUDE}') AS excluded,
   {' OR '.join(f"contains(replace(replace(normalized, '-', ''), ' ', ''), '{m}')" for m in MORPHEMES)} AS world,
   list_contains({_COMMON}, normalized) OR list_contains({_DULL}, normalized) OR len(list_filter(tok, lambda t: list_contains({_DULL}, t))) > 0 AS lemma,
   list_contains({_COMMON}, normalized) OR len(list_filter(tok, lambda t: NOT list_contains({_COMMON}, t))) = 0 AS dull, len(list_filter(tok, lambda t: list_contains({_COMMON}, t) OR list_contains({_DULL}, t))) AS weak
 FROM (SELECT *, [normalized] AS tok FROM ({_WORDS}) a UNION ALL SELECT *, string_split(normalized, '-') FROM ({_COMPOUNDS}) b UNION ALL SELECT *, string_split(normalized, ' ') FROM ({_PHRASES}) c) m) x) y) z) q"""
_FRESH = "WITH RECURSIVE f AS (SELECT doc_id, record_pos, version_ref AS ref, version_ref AS chain, sha256(target) AS sha FROM v_candidates UNION ALL SELECT r.doc_id, r.record_pos, r.review_ref, f.chain || '>' || r.review_ref, sha256(r.target) FROM v_reviews r JOIN f ON f.doc_id = r.doc_id AND f.record_pos = r.record_pos AND f.ref = r.base_ref AND f.sha = r.base_target_sha256) SELECT * FROM f"
_POS = "CAST(substr(record_id, 1, 4) AS BIGINT) * 50 - 50 + CAST(substr(record_id, 6) AS BIGINT) - 1"



def _turns(lists: list[str], by: str = "doc_id") -> str:
    """Blocks of v_markdown or v_xhtml as the turns of their making say: a list of structs for each line, numbered within the document or chapter."""
    cases = " ".join(f"WHEN {k} THEN [{items}]" for k, items in enumerate(lists) if items)
    return f"SELECT doc_id, chapter, row_number() OVER (PARTITION BY {by} ORDER BY span_index, k) - 1 AS pos, b FROM (SELECT doc_id, chapter, span_index, unnest(range(len(l))) AS k, unnest(l) AS b FROM (SELECT doc_id, span_index // 12 AS chapter, span_index, CASE span_index % {len(lists)} {cases} END AS l FROM (SELECT doc_id, span_index, 'x ' || replace(span, '|', '/') || ' x' AS c FROM v_spans) s) t WHERE l IS NOT NULL) u"


def _block(kind: str, text: str, tags: str = "") -> str:
    return f"{{'kind': '{kind}', 'block': {text}, 'tags': '{tags}'}}"


_FOLDED = r"regexp_replace(c, '[ \t\n\f\r]+', ' ', 'g')"
_MARKDOWN = _turns([_block("heading", "c"), _block("quote", "c || chr(10) || 'more'"), _block("item", "c || chr(10) || 'two'"), "", ", ".join([_block("cell", "'a'"), _block("cell", "c"), _block("cell", "'b'")]), "", _block("paragraph", "c"), _block("paragraph", "c")])
_XHTML_TURNS = [_block("p", _FOLDED), _block("h2", _FOLDED), _block("li", f"'a __TAG_001__' || {_FOLDED} || '__TAG_002____TAG_003__z'", "<b>|</b>|<br/>"), _block("p", f"'x __TAG_001__ ' || {_FOLDED}", "<code>k<i>j</i></code>"), "", _block("td", f"{_FOLDED} || '__TAG_001__ & so'", "<!-- note -->")]
_XHTML = _turns(_XHTML_TURNS)
_TAGS = [f"'__TAG_00' || (CASE WHEN span_index % 7 = 0 THEN {k + 1} ELSE {k} END)::VARCHAR || '__'" for k in range(1, 5)]


def xhtml_turns(by: str) -> str:
    return _turns(_XHTML_TURNS, by)


ORACLES: dict[str, str] = {
    "sentence_segments": "SELECT doc_id, record_pos AS pos, source AS sentence FROM v_records",
    "markdown_blocks": f"SELECT doc_id, pos, b.kind AS kind, b.block AS block FROM ({_MARKDOWN}) m",
    "markdown_rebuild": "SELECT m.doc_id, sha256(m.text) AS same_sha256, sha256(t.text) AS translated_sha256 FROM v_markdown m JOIN v_markdown_translated t ON t.doc_id = m.doc_id",
    "document_rebuild_markdown": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "xhtml_made_blocks": f"SELECT doc_id, pos, b.kind AS element, b.block AS block, b.tags AS tags FROM ({_XHTML}) m",
    "xhtml_rebuild": "SELECT page_id, sha256(coalesce(html, '')) AS html_sha256 FROM pages",
    "xhtml_translated": "SELECT doc_id, sha256(text) AS text_sha256 FROM v_xhtml_translated",
    "inline_tokens": f"SELECT doc_id, span_index, CASE WHEN span_index % 7 = 0 THEN '__TAG_001__ ' ELSE '' END || 'a ' || {_TAGS[1]} || ' b [x](' || {_TAGS[0]} || ' \"t\") ' || {_TAGS[3]} || c || {_TAGS[2]} || ' ' || {_TAGS[1]} AS hidden, {_TAGS[0]} || '=http://h/' || n || '|' || {_TAGS[1]} || '=`k' || n || '`|' || {_TAGS[2]} || '=</b>|' || {_TAGS[3]} || '=<b>' AS tokens, line AS restored FROM v_inline",
    "normalised_block": r"SELECT doc_id, span_index, regexp_replace(array_to_string(regexp_extract_all(span, '\S+'), ' '), ' ([.,;:!?])', '\1', 'g') AS block FROM v_spans",
    "term_matches": "SELECT doc_id, record_id, CAST(entry_index AS BIGINT) AS entry_index FROM (" + _applies("v_records") + ") t",
    "rule_alignment_ambiguous": f"SELECT doc_id, record_id, CAST(0 AS BIGINT) AS entry_index FROM v_records WHERE {_has(_OPEN, 'the')} AND {_has(_WIDE, 'of  the')}",
    "forbidden_terms": f"SELECT doc_id, record_id, CAST(entry_index AS BIGINT) AS entry_index, CASE WHEN entry_index = 0 AND {_has(_WIDE, 'of  the')} THEN 'warn' WHEN entry_index = 3 THEN 'warn' ELSE 'error' END AS severity, CASE WHEN entry_index = 0 AND {_has(_WIDE, 'of  the')} THEN 'glossary_alignment_ambiguous' ELSE 'forbidden_term_used' END AS rule FROM (" + _applies("v_progress") + f") t WHERE target IS NOT NULL AND {_BAD}",
    "required_terms": "SELECT doc_id, record_id, CAST(entry_index AS BIGINT) AS entry_index, CASE WHEN entry_index IN (2, 3) THEN 'warn' ELSE 'error' END AS severity FROM (" + _applies("v_progress") + f") t WHERE target IS NOT NULL AND entry_index <> 4 AND NOT {_GOOD}",
    "term_audit": f"SELECT CAST(entry_index AS BIGINT) AS entry_index, count(*) AS records, count(CASE WHEN {_BAD} THEN 1 END) AS forbidden, count(CASE WHEN {_GOOD} THEN 1 END) AS approved, count(CASE WHEN NOT {_BAD} AND NOT {_GOOD} THEN 1 END) AS missing FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS entry_index FROM v_progress WHERE target IS NOT NULL AND {_has(_WIDE, w)}" for k, w in enumerate(["the", "of  the", "under", "that", "erer", "with"])) + ") t GROUP BY entry_index",
    "profile_glossary_divergence": "SELECT CAST(entry_index AS BIGINT) AS entry_index, count(DISTINCT profile) AS profiles, count(DISTINCT CASE WHEN target IS NOT NULL THEN profile END) AS translated_profiles FROM (" + _applies("v_progress") + ") t GROUP BY entry_index",
    "audit_block": "SELECT doc_id, CAST(entry_index AS BIGINT) AS entry_index, string_agg('>>> ' || record_id, '|' ORDER BY record_id) AS block FROM (" + _applies("v_progress") + ") t WHERE target IS NOT NULL GROUP BY doc_id, entry_index",
    "token_candidates": f"SELECT * EXCLUDE (surface) FROM ({_WORDS}) t",
    "hyphenated_candidates": f"SELECT * EXCLUDE (surface) FROM ({_COMPOUNDS}) t",
    "phrase_candidates": f"SELECT * EXCLUDE (surface) FROM ({_PHRASES}) t",
    "candidate_ids": "SELECT normalized, bucket, 'CAND-' || upper(substr(sha256('{\"case_bucket\":\"' || bucket || '\",\"identity_ruleset_version\":\"1\",\"normalized\":\"' || normalized || '\",\"source_language\":\"en\",\"token_count\":1,\"tokens\":[\"' || normalized || '\"]}'), 1, 16)) AS candidate_id FROM (" + _WORDS + ") w",
    "candidate_scores": _RISK,
    "bucket_topk": f"SELECT review_bucket, normalized, bucket, kind, occurrences, risk FROM (SELECT *, row_number() OVER (PARTITION BY review_bucket ORDER BY risk DESC, occurrences DESC, normalized, bucket, kind) AS k FROM ({_RISK}) s WHERE review_bucket <> 'no_action') t WHERE k <= 80 ORDER BY risk DESC, occurrences DESC, normalized, bucket, kind LIMIT 200",
    "suppressed_counts": f"SELECT review_bucket, count(*) AS candidates, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM ({_RISK}) s GROUP BY review_bucket",
    "stale_reviews": f"SELECT r.doc_id, r.record_pos, r.review_ref, b.sha IS NULL OR b.sha <> r.base_target_sha256 AS direct_stale, f.ref IS NULL AS chain_stale FROM v_reviews r LEFT JOIN (SELECT doc_id, record_pos, version_ref AS ref, sha256(target) AS sha FROM v_candidates UNION ALL SELECT doc_id, record_pos, review_ref, sha256(target) FROM v_reviews) b ON b.doc_id = r.doc_id AND b.record_pos = r.record_pos AND b.ref = r.base_ref LEFT JOIN ({_FRESH}) f ON f.doc_id = r.doc_id AND f.record_pos = r.record_pos AND f.ref = r.review_ref",
    "review_chain": f"SELECT doc_id, record_pos, ref AS review_ref, chain FROM ({_FRESH}) f WHERE ref LIKE 'R%'",
    "activate_latest": "SELECT doc_id, record_pos, CASE WHEN max(subversion) = 10 THEN '1.10' WHEN max(subversion) = 2 THEN '1.2' ELSE '1.1' END AS version_ref FROM v_candidates GROUP BY doc_id, record_pos",
    "export_pick": f"SELECT r.doc_id, r.chunk_id, count(*) AS records FROM ({EXPORTED}) r LEFT JOIN v_store s ON s.doc_id = r.doc_id AND s.record_pos = r.record_pos LEFT JOIN v_candidates c ON c.doc_id = s.doc_id AND c.record_pos = s.record_pos AND c.version_ref = s.active_version GROUP BY r.doc_id, r.chunk_id HAVING bool_and(coalesce(c.status = 'accepted' AND s.source_sha256 = r.source_sha256, false))",
    "range_span": f"SELECT doc_id, record_id FROM v_records WHERE {_POS} BETWEEN 2 AND 54 AND doc_id IN (SELECT doc_id FROM v_records WHERE record_id = '0002-000005')",
    "range_count": f"SELECT doc_id, record_id FROM v_records WHERE {_POS} BETWEEN 48 AND 54 AND doc_id IN (SELECT doc_id FROM v_records WHERE record_id = '0001-000049')",
    "range_chunk": "SELECT doc_id, record_id FROM v_records WHERE record_id LIKE '0002-%'",
    "range_chapter": f"SELECT doc_id, record_id FROM v_records WHERE {_POS} BETWEEN 40 AND 59",
    "range_one": "SELECT doc_id, record_id FROM v_records WHERE record_id = '0001-000012'",
    "task_status": f"SELECT doc_id, task_id, count(CASE WHEN s = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN s = 'missing' THEN 1 END) AS missing, count(CASE WHEN s = 'stale' THEN 1 END) AS stale, min(CASE WHEN s = 'missing' THEN record_id END) AS first_missing, count(*) = count(CASE WHEN s = 'accepted' THEN 1 END) AS complete FROM (SELECT t.doc_id, t.task_id, t.record_id, CASE WHEN o.source_sha256 IS NOT NULL AND o.source_sha256 <> t.source_sha256 THEN 'stale' WHEN EXISTS (SELECT 1 FROM v_candidates c WHERE c.doc_id = o.doc_id AND c.record_pos = o.record_pos AND c.version_ref = o.active_version AND c.status = 'accepted') THEN 'accepted' ELSE 'missing' END AS s FROM ({TASKS}) t LEFT JOIN v_store o ON o.doc_id = t.doc_id AND o.record_pos = t.record_pos) x GROUP BY doc_id, task_id",
    "record_view": "SELECT doc_id, record_id, source, coalesce(concat_ws('|', l2, l1), '') AS before, coalesce(n1, '') AS after, CASE WHEN record_pos % 3 = 0 THEN '' ELSE '1.1=' || st || CASE WHEN record_pos % 4 = 0 THEN ',1.2=' || st ELSE '' END || CASE WHEN record_pos % 28 = 0 THEN ',1.10=' || st ELSE '' END END AS versions FROM (SELECT doc_id, record_pos, record_id, source, lag(source, 2) OVER w AS l2, lag(source) OVER w AS l1, lead(source) OVER w AS n1, CASE WHEN record_pos % 17 = 0 THEN 'rejected' ELSE 'accepted' END AS st FROM v_records WINDOW w AS (PARTITION BY doc_id ORDER BY record_pos)) t",
    "version_listing": "SELECT r.doc_id, r.record_id, c.version_ref, c.target, c.status FROM v_records r LEFT JOIN v_store s ON s.doc_id = r.doc_id AND s.record_pos = r.record_pos LEFT JOIN v_candidates c ON c.doc_id = s.doc_id AND c.record_pos = s.record_pos AND c.version_ref = s.active_version",
    "compare_refs": "SELECT doc_id, record_id, version_ref AS ref, status, target FROM v_candidates WHERE subversion IN (2, 10) UNION ALL SELECT doc_id, record_id, review_ref, status, target FROM v_reviews WHERE pass_number = 1 AND run_number = 2",
    "profile_compare": "SELECT doc_id, record_id, a AS versions, b AS reviews, c AS legacy, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS BIGINT) AS different FROM (SELECT doc_id, record_id, CASE WHEN record_pos % 3 <> 0 THEN source END AS a, CASE WHEN record_pos % 3 <> 0 AND record_pos % 5 = 0 THEN source || ' R1.1' END AS b, CASE WHEN record_pos % 7 = 0 THEN source || ' L' END AS c FROM v_records) t",
    "notes_before": "SELECT c.doc_id, c.chapter_no, count(n.record_pos) AS notes, max(n.record_id) AS latest FROM (SELECT DISTINCT doc_id, chapter_no FROM v_records) c LEFT JOIN (SELECT * FROM v_records WHERE record_pos % 27 = 3) n ON n.doc_id = c.doc_id AND n.chapter_no < c.chapter_no GROUP BY c.doc_id, c.chapter_no",
    "span_starts": "SELECT b.doc_id, b.span_index, CASE WHEN b.span_index * 3 <= m.top THEN b.span_index * 3 ELSE -1 END AS record_pos FROM (SELECT DISTINCT doc_id, CAST(floor(record_pos / 4) * 2 AS BIGINT) AS span_index FROM v_records) b JOIN (SELECT doc_id, max(record_pos) AS top FROM v_records GROUP BY doc_id) m ON m.doc_id = b.doc_id",
    "finding_partitions": f"SELECT count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warn' THEN 1 END) AS warnings, count(CASE WHEN severity = 'error' AND scope = 'active' THEN 1 END) AS blocking, count(CASE WHEN scope = 'inactive' THEN 1 END) AS inactive, count(CASE WHEN severity = 'error' AND scope = 'active' THEN 1 END) > 0 AS fails FROM ({report.everything(DUCK)}) f",
    "surface_histograms": f"SELECT lower(surface) AS normalized, bucket, string_agg(surface || '=' || n::VARCHAR, ',' ORDER BY n DESC, surface) AS surfaces, min(place).doc_id AS first_doc, min(place).record_pos AS first_pos FROM (SELECT surface, {_bucket('surface')} AS bucket, count(*) AS n, min({{'doc_id': doc_id, 'record_pos': record_pos}}) AS place FROM (SELECT doc_id, record_pos, unnest(regexp_extract_all(source, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS surface FROM v_records) w GROUP BY surface) f GROUP BY lower(surface), bucket",
    "language_policy": "SELECT doc_id, 'epub_output_explicit_language_missing' AS rule, 'error' AS severity FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'invalid_epub_output_language', 'error' FROM documents WHERE doc_id % 10 = 2 UNION ALL SELECT doc_id, 'epub_output_language_policy_preserves_source', 'warn' FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 AND lang <> 'en'",
    "block_submission_parse": "SELECT doc_id, record_id, source AS target, '' AS error FROM v_records WHERE substr(source, 1, 1) <> '#'",
    "tsv_submission_parse": "SELECT doc_id, record_id, source || chr(9) || 'x' AS target, '' AS error FROM v_records WHERE substr(source, 1, 1) <> '#'",
    "json_submission_parse": "SELECT doc_id, record_id, source AS target, '' AS error FROM v_records WHERE substr(source, 1, 1) <> '#' AND doc_id % 7 <> 0 UNION ALL SELECT DISTINCT doc_id, '', '', 'invalid_json_submission' FROM v_records WHERE substr(source, 1, 1) <> '#' AND doc_id % 7 = 0",
    "judge_submission_parse": "SELECT doc_id, record_id, source AS target, 'copy' AS decision FROM v_records WHERE substr(source, 1, 1) <> '#'",
    "hidden_inline": "SELECT page_id, contains(html, '<') AS hides, sha256(html) AS restored_sha256 FROM pages",
}
