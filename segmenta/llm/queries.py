"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import bpe, html_main, langid, lm, mixing, multiset, pii, pivots, repair, simhash, token_files, toxicity, trie
from segmenta.llm.common import crc_mod, shared_path, table

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hex_sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", 5)
    model = langid.fit(docs, fold != 0)
    return langid.predict(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "distance", "rejected")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_main.main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, hex_sha256(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


DOMAINS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def domain_mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return mixing.mix(docs.select("doc_id", "text"), labels, domain, DOMAINS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = domain_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


def op7_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = multiset.edited(table(spark, sf_dir, "documents"))
    fp, edited_fp, next_fp = map(F.col, ("fp", "edited_fp", "next_fp"))
    return docs.select(
        "doc_id",
        "next_id",
        "n_chars",
        "edited_sha256",
        multiset.as_hex(fp).alias("fingerprint"),
        multiset.as_hex(edited_fp).alias("edited_fingerprint"),
        multiset.likeness(fp, edited_fp).alias("near_edited"),
        multiset.likeness(fp, next_fp).alias("near_next"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.link(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_mod("doc_id", 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = toxicity.score(docs.select("doc_id", "text", (fold == 1).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_TOKENIZER), end=0)
    back = token_files.read(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("ids").cast("long").alias("n_bytes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations")).drop("key")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_lm": op3_lm,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_multiset": op7_multiset,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}



def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda a, b: {step}), 4294967295)"


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS i FROM t),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM r GROUP BY conv_id),
c AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n b ON b.conv_id = n.base),
a AS (SELECT c.conv_id, r.i AS pos, content, words FROM c JOIN r ON r.conv_id = c.base AND r.i <= c.h UNION ALL SELECT c.conv_id, r.i - c.h + c.k, content, words FROM c JOIN r ON r.conv_id = c.conv_id AND r.i > c.h),
m AS (SELECT conv_id, pos AS depth, words, sha256(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY pos), ',')) AS key FROM a UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
x AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM m GROUP BY key, depth),
p AS (SELECT x.*, m.key AS parent, q.conv_id AS parent_conv_id FROM x LEFT JOIN m ON m.conv_id = x.conv_id AND m.depth = x.depth - 1 LEFT JOIN x q ON q.key = m.key),
d AS (SELECT p.*, (SELECT count(*) FROM p o WHERE o.parent = p.key) AS n_children FROM p),
s AS (SELECT m.key, count(CASE WHEN d.n_children = 0 THEN 1 END) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved FROM d JOIN m ON m.conv_id = d.conv_id AND m.depth <= d.depth GROUP BY m.key),
e AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(key, depth) AS key FROM m GROUP BY conv_id) l GROUP BY key)
SELECT d.conv_id, CAST(d.depth AS BIGINT) AS depth, d.parent_conv_id, d.n_convs, d.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM d JOIN s ON s.key = d.key LEFT JOIN e ON e.key = d.key
"""

def _cheapest() -> str:
    """DuckDB: the four states' cheapest (cost, audit) before a row from those behind it; insertions last."""
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def then(cost: str, letter: str, state: str) -> str:
        return f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a}}"

    row = []
    for q, goes in to.items():
        other = next(t for r, t in goes.items() if r != "s")
        keep = " ".join(f"WHEN ini = '{r}' THEN {then('cut', 'K', f's{t}')}" for r, t in goes.items())
        row.append(f"list_min([{then('2', 'D', f's{q}')}, CASE WHEN fault IN (1, 2) THEN NULL {keep} END, CASE WHEN fault IN (0, 3) THEN {then('1 + cut', 'R', f's{other}')} END]) AS g{q}")
    put = ["list_min([g0, " + then("5", "I", "g2") + ", " + then("10", "II", "g3") + "]) AS s0", "list_min([g1, " + then("5", "I", "g2") + ", " + then("10", "II", "g3") + "]) AS s1"]
    put += ["list_min([g2, " + then("5", "I", "g3") + "]) AS s2", "list_min([g3, " + then("5", "I", "g2") + "]) AS s3"]
    return f"SELECT conv_id, i - 1, {', '.join(put)} FROM (SELECT f.conv_id, f.i, {', '.join(row)} FROM f JOIN o ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND o.i = f.i) w"


REPAIR_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS cut, left(role, 1) AS ini FROM (SELECT conv_id, turn, role, text, i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM p) q),
n AS (SELECT c.conv_id, count(o.i) AS n, count(CASE WHEN fault = 1 THEN 1 END) AS blank, count(CASE WHEN fault = 2 THEN 1 END) AS duplicate, count(CASE WHEN fault = 3 THEN 1 END) AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
l AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, i, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM o) x WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
f AS (SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM n UNION ALL {_cheapest()}),
a AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM f WHERE i = 0),
e AS (SELECT conv_id, step, letter, count(CASE WHEN letter <> 'I' THEN 1 END) OVER w AS i, count(CASE WHEN letter <> 'D' THEN 1 END) OVER w AS put FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS step, unnest(string_split(audit, '')) AS letter FROM a WHERE audit <> '') u WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
r AS (SELECT e.conv_id, step, letter, put, o.role, o.text, max(CASE WHEN put = 1 AND letter = 'K' AND o.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system FROM e LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.i = e.i WHERE letter <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (put - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS lines FROM r GROUP BY conv_id)
SELECT n.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM n JOIN a ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM n.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op12_prefix_trie": TRIE_SQL, "op13_repair": REPAIR_SQL}
