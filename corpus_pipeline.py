"""Corpus pipeline: language ID, near-dedup, personal data, mixing, BPE - each stage over all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import bpe, langid, minhash, mixing, pii, queries
from segmenta.llm.common import crc_mod, remove, stored_at, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects; `lang` becomes the predicted language."""
    model = langid.fit(docs, crc_mod("doc_id", 5) != 0)
    kept = langid.predict(docs.select(*COLUMNS), model).where("not rejected")
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group tied by Jaccard 0.8 or SimHash: the one that names it; of repeated rows with its id and text, one."""
    first = minhash.near_duplicates(docs, words=5, similarity=0.8, distance=4).where("first").select("mark")
    # both sides grow with the input; texts are shuffled once, for the join and for rows alike
    kept = docs.select(*COLUMNS, minhash.row_mark("doc_id", "text").alias("mark")).join(first.hint("merge"), "mark", "left_semi")
    return kept.dropDuplicates(["mark"]).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind."""
    found = pii.find(docs.select(*COLUMNS), redacted=True)
    return found.select("doc_id", F.when(F.col("text").isNotNull(), F.col("redacted")).alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the domains' expected tokens meet the targets."""
    rated = queries.domain_mix(docs, table(spark, sf_dir, "labels"))
    # rows by id and text: null ids and several texts under one id are rows like any other
    copies = rated.groupBy("mark").agg(F.max("copies").alias("copies")).where("copies > 0")
    kept = docs.select(*COLUMNS, mixing.row_mark("doc_id", "text").alias("mark")).join(copies, "mark")
    return kept.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text they decode to."""
    coded = bpe.round_trip(docs.select(*COLUMNS), queries.tokenizer_path(), as_bytes=True)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing", mix_domains),
    ("BPE", encode_texts),
]

#: The stages are models and machines that SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
