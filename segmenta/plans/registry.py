"""All operator queries, as Spark DataFrames and as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators import books, extract, gates, glossary, mining, progress, project, records, report, state, validate, wired
from segmenta.plans.dialect import DUCK, SPARK, WORD
from segmenta.plans.shared import written
from segmenta.sources import batches, segments, texts
from segmenta.sources.views import VIEWS, named, times, with_views
from segmenta.streaming import windows

TABLES = ("documents", "pages", "labels", "conversations", "benchmark", "embeddings", "events")
SQL = extract.QUERIES | state.QUERIES | validate.QUERIES | glossary.QUERIES | progress.QUERIES | mining.QUERIES | gates.QUERIES | report.QUERIES
FRAMES = gates.FRAMES | wired.FRAMES | project.FRAMES | books.FRAMES


#: Reads of the sentences from which on a query segments the texts once, into the shared folder.
STORED_FROM = 3
#: Queries whose parts read the sentences as often between them.
PARTED = ("store_scan", "store_scan_findings", "span_preflight")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_sentences in Spark: texts segmented in Arrow batches, words counted in the JVM; DuckDB has the same in SQL.

    A table of fewer splits than the cluster has cores is dealt out first; a large one never is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("profile"), "lang", "text", F.col("lang").alias("tag"))
    cores = spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    # nearly every query runs this step: it travels whole, so workers need no path to this package for it
    cloudpickle.register_pickle_by_value(segments)
    cloudpickle.register_pickle_by_value(batches)
    cut = segments.sentences
    rows = texts.explode_texts(docs, {"doc_id": "long", "profile": "string", "lang": "string"}, ["text", "tag"], {"source": "string"}, lambda text, tag: [(s,) for s in cut(text, tag)])
    return rows.select("doc_id", "profile", "lang", F.col("pos").alias("record_pos"), "source", F.size(F.regexp_extract_all("source", F.lit(f"({WORD})"), 1)).cast("long").alias("source_words"))


def plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named query over the Parquet tables of a folder."""
    return over(spark, sf_dir, SQL[name](SPARK))


def over(spark: SparkSession, sf_dir: str, sql: str, kept: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL over a folder's tables and the logical views; only tables that it names are opened.

    kept: views that one query has computed already, shared by its parts.
    """
    kept = {} if kept is None else kept
    names = named(sql, SPARK)
    if "v_sentences" in names and ("v_sentences" not in kept or times(sql, SPARK, "v_sentences") >= STORED_FROM and "stored" not in kept):
        kept["v_sentences"] = sentences(spark, sf_dir)
        if times(sql, SPARK, "v_sentences") >= STORED_FROM:
            kept["v_sentences"] = kept["stored"] = written(kept["v_sentences"], "sentences")
    if "v_chains" not in kept and "v_chains" in names:
        kept["v_chains"] = records.chains(over(spark, sf_dir, "SELECT * FROM v_reviews", kept), over(spark, sf_dir, "SELECT * FROM v_candidates", kept))
    sql = with_views(sql, SPARK, kept.keys())
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in kept.keys() & set(VIEWS):
        kept[name].createOrReplaceTempView(name)
    return spark.sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(spark, sf_dir, name)

    def framed(name: str, make: Callable) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kept: dict[str, DataFrame] = {}
            if name in PARTED:
                kept["v_sentences"] = kept["stored"] = written(sentences(spark, sf_dir), "sentences")
            return make(spark, lambda sql: over(spark, sf_dir, sql, kept))

        return run

    return {name: one(name) for name in SQL} | {name: framed(name, make) for name, make in FRAMES.items()} | windows.QUERIES


def oracles() -> dict[str, str]:
    return {name: with_views(make(DUCK), DUCK) for name, make in SQL.items()} | {name: with_views(sql, DUCK) for name, sql in (wired.ORACLES | project.ORACLES | books.ORACLES).items()} | windows.ORACLE_SQL
