"""Merges of contexts: three-way by policy with an action log, chapter notes, and candidates against glossary and decisions
(SO8, SO10, JN21, JN22, JN23, DT16, GR17).

Defined results: keys are unique in each table (of repeated ones the least value counts); null and blank values are empty;
empty tables merge like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("fail", "keep-local", "replace")


def _tidy(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _one(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(_tidy("value")).alias(name))


def three_way(base: DataFrame, local: DataFrame, incoming: DataFrame, keys: list[str], policy: str = "fail") -> DataFrame:
    """SO8, JN21: (keys, local, incoming, value, action) of tables (keys, value).

    add: only incoming has it; update: local is empty or still as in base, or policy is replace; skip: both are equal,
    incoming is empty or as in base, or policy is keep-local; conflict: both changed, policy fail (local stays);
    keep: only local has it.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy: {policy!r}")
    both = _one(local, keys, "local").withColumn("here", F.lit(True)).join(_one(incoming, keys, "incoming").withColumn("there", F.lit(True)), keys, "full_outer").join(_one(base, keys, "base"), keys, "left")
    mine, theirs, was = F.coalesce("local", F.lit("")), F.coalesce("incoming", F.lit("")), F.col("base")
    changed = {"fail": "conflict", "keep-local": "skip", "replace": "update"}[policy]
    action = (
        F.when(F.col("there").isNull(), "keep")
        .when((theirs == "") | (theirs == mine), "skip")
        .when(F.col("here").isNull(), "add")
        .when((mine == "") | mine.eqNullSafe(was), "update")
        .when(theirs.eqNullSafe(was), "skip")
        .otherwise(changed)
    )
    value = F.when(action.isin("add", "update"), theirs).otherwise(mine)
    return both.select(*keys, "local", "incoming", value.alias("value"), action.alias("action"))


def action_counts(log: DataFrame, by: list[str]) -> DataFrame:
    """GR17: how often each action was taken."""
    return log.groupBy(*by, "action").agg(F.count("*").alias("n"))


def merge_notes(local: DataFrame, incoming: DataFrame, replace: bool = False, append: bool = False) -> DataFrame:
    """SO10: (doc_id, chapter_no, title, decisions, action) of notes (doc_id, chapter_no, title, decisions).

    add: a chapter without note; skip: equal notes; replace: the incoming note; append: the local title and the incoming
    decisions behind the local ones, each once; conflict: different notes and neither is asked for.
    """
    keys = ["doc_id", "chapter_no"]
    there = incoming.select(*keys, F.col("title").alias("their_title"), F.col("decisions").alias("theirs"), F.lit(True).alias("there"))
    both = local.withColumn("here", F.lit(True)).join(there, keys, "full_outer")
    same = F.col("title").eqNullSafe(F.col("their_title")) & F.col("decisions").eqNullSafe(F.col("theirs"))
    action = F.when(F.col("there").isNull(), "keep").when(F.col("here").isNull(), "add").when(same, "skip").otherwise("replace" if replace else "append" if append else "conflict")
    taken = action.isin("add", "replace")
    none = F.array().cast("array<string>")
    lists = F.array_distinct(F.concat(F.coalesce("decisions", none), F.coalesce("theirs", none)))
    decisions = F.when(taken, F.col("theirs")).when(action == "append", lists).otherwise(F.col("decisions"))
    return both.select(*keys, F.when(taken, F.col("their_title")).otherwise(F.col("title")).alias("title"), decisions.alias("decisions"), action.alias("action"))


def resolved(candidates: DataFrame, glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """JN22, JN23: candidates (candidate_id, normalized) with `disposition`: a decision on their id, else on their term, else `in_glossary` or `open`.

    decisions: candidate_id or null, normalized, disposition; glossary: source.
    """
    exact = decisions.where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.min("disposition").alias("by_id"))
    term = decisions.where("candidate_id IS NULL").groupBy(F.lower("normalized").alias("normalized")).agg(F.min("disposition").alias("by_term"))
    known = glossary.select(F.lower("source").alias("normalized")).distinct().withColumn("known", F.lit("in_glossary"))
    met = candidates.join(exact, "candidate_id", "left").join(term, "normalized", "left").join(known, "normalized", "left")
    return met.select(*candidates.columns, F.coalesce("by_id", "by_term", "known", F.lit("open")).alias("disposition"))


def still_open(candidates: DataFrame, glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """DT16: the candidates that a rerun offers again: neither decided nor in the glossary."""
    return resolved(candidates, glossary, decisions).where("disposition = 'open'").drop("disposition")
