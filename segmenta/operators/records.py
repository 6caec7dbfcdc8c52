"""Records: review chains, exports, selectors, point queries and overlays, as functions of DataFrames
(EF2-EF5, EF10, FI1, FI6, FI16, JN7, JN14, JN16, QV1-QV4, SO4, TK3, V44-V46, WN5, WN14).

Tables have a document key `doc_id` and a position `record_pos`; parameters stand where the engine's user would choose.
Defined results: empty tables give no rows; null positions meet nothing; repeated keys give repeated rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "record_pos"]


def chains(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """EF2-EF5: each review with has_base, direct_stale, chain_stale and, if it is fresh, the chain of refs from its base version on.

    Bases are followed by their refs, one fold over a record's reviews in order of pass and run: a base comes
    before its review, so a missing, later or circular base is stale. Bases are compared by their hash as stored.
    """
    rest = [c for c in reviews.columns if c not in KEYS]
    one = F.struct("pass_number", "run_number", "review_ref", *(c for c in rest if c not in ("pass_number", "run_number", "review_ref")))
    by_record = reviews.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("r"))
    versions = candidates.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("version_ref", F.sha2("target", 256)))).alias("v"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = by_record.join(versions, KEYS, "left").select(*KEYS, "r", F.coalesce("v", none).alias("v"))
    both = both.withColumn("known", F.map_concat("v", F.map_from_entries(F.transform("r", lambda x: F.struct(x["review_ref"], F.sha2(x["target"], 256))))))
    start = F.struct(F.transform_values("v", lambda k, _: k).alias("path"), F.array().cast("array<struct<has_base:boolean,direct_stale:boolean,chain_stale:boolean,chain:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        base, path = F.try_element_at(F.col("known"), x["base_ref"]), F.try_element_at(acc["path"], x["base_ref"])
        stale = ~F.coalesce(base == x["base_target_sha256"], F.lit(False))
        fresh = ~stale & path.isNotNull()
        chain = F.when(fresh, F.concat(path, F.lit(">"), x["review_ref"]))
        row = F.struct(base.isNotNull().alias("has_base"), stale.alias("direct_stale"), (~fresh).alias("chain_stale"), chain.alias("chain"))
        paths = F.when(fresh, F.map_concat(acc["path"], F.create_map(x["review_ref"], F.coalesce(chain, F.lit(""))))).otherwise(acc["path"])
        return F.struct(paths.alias("path"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = both.select(*KEYS, F.explode(F.arrays_zip("r", F.aggregate("r", start, step)["out"].alias("out"))).alias("x"))
    return folded.select(*KEYS, *(F.col(f"x.r.{c}").alias(c) for c in rest), "x.out.*")


def newest(candidates: DataFrame) -> DataFrame:
    """TK3, EF10: each record's newest version, by numbers: 1.10 comes after 1.9."""
    return candidates.groupBy(*KEYS).agg(F.max_by("version_ref", F.struct("version", "subversion")).alias("version_ref"))


def picks(store: DataFrame, candidates: DataFrame, mode: str = "active", ref: str | None = None) -> DataFrame:
    """FI16: the accepted candidate of each record: its active one, one version's, or the newest of one track."""
    accepted = candidates.where("status = 'accepted'")
    if mode == "version":
        return accepted.where(F.col("version_ref") == ref).select(*KEYS, "version_ref", "target")
    if mode == "track":
        best = F.max_by(F.struct("version_ref", "target"), "subversion").alias("best")
        return accepted.where(F.col("version") == int(ref)).groupBy(*KEYS).agg(best).select(*KEYS, "best.*")
    active = store.select(*KEYS, F.col("active_version").alias("version_ref"))
    return accepted.join(active, [*KEYS, "version_ref"]).select(*KEYS, "version_ref", "target")


def export(records: DataFrame, picked: DataFrame, errors: DataFrame) -> DataFrame:
    """FI16, SK6: a row for each chunk of which every record has a pick and none an error."""
    rows = records.join(picked, KEYS, "left").join(errors.select(*KEYS).distinct().withColumn("wrong", F.lit(True)), KEYS, "left")
    whole = rows.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("records"), F.bool_and(F.col("target").isNotNull() & F.col("wrong").isNull()).alias("ok"))
    return whole.where("ok").drop("ok")


def record_range(selector: str, records: DataFrame) -> DataFrame:
    """FI1: `A..B`, `A+N`, `chunk:N`, `chapter:N` or one record; refs are CHUNK-PART or CHUNK@PART, zeros optional.

    Positions of the refs are looked up in every document; a document without them gives no rows.
    """
    text = selector.strip()

    def canonical(ref: str) -> str:
        m = re.fullmatch(r"(\d+)[@-](\d+)", ref.strip())
        if not m:
            raise ValueError(f"no record reference: {ref!r}")
        return f"{int(m[1]):04d}-{int(m[2]):06d}"

    def place(ref: str, name: str) -> DataFrame:
        return records.where(F.col("record_id") == canonical(ref)).select("doc_id", F.col("record_pos").alias(name))

    if ".." in text:
        first, last = text.split("..", 1)
        ends = place(first, "lo").join(place(last, "hi"), "doc_id")
        return records.join(ends, "doc_id").where("record_pos BETWEEN lo AND hi").drop("lo", "hi")
    if "+" in text:
        first, count = text.split("+", 1)
        if int(count) <= 0:
            raise ValueError(f"no positive count: {selector!r}")
        return records.join(place(first, "lo"), "doc_id").where((F.col("record_pos") >= F.col("lo")) & (F.col("record_pos") < F.col("lo") + int(count))).drop("lo")
    kind, _, number = text.partition(":")
    if kind == "chunk":
        return records.where(F.col("chunk_id") == f"{int(number):04d}")
    if kind == "chapter":
        return records.where(F.col("chapter_no") == int(number))
    return records.where(F.col("record_id") == canonical(text))


def task_status(task: DataFrame, store: DataFrame, candidates: DataFrame) -> DataFrame:
    """QV1: for each task its accepted, missing and stale records (the store's source is not the task's), the first missing, and whether it is complete."""
    active = picks(store, candidates).select(*KEYS, F.lit(True).alias("done"))
    rows = task.join(store.select(*KEYS, F.col("source_sha256").alias("stored")), KEYS, "left").join(active, KEYS, "left")
    state = F.when(F.col("stored") != F.col("source_sha256"), "stale").when(F.col("done"), "accepted").otherwise("missing")
    rows = rows.withColumn("state", state)
    return rows.groupBy("doc_id", "task_id").agg(
        F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "stale").alias("stale"),
        F.min_by("record_id", F.when(F.col("state") == "missing", F.col("record_pos"))).alias("first_missing"), F.bool_and(F.col("state") == "accepted").alias("complete"),
    )


def record_view(records: DataFrame, candidates: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """QV2, WN5: each record with its neighbours' sources, `before` and `after` in number, and all its versions in order."""
    order = Window.partitionBy("doc_id").orderBy("record_pos")
    near = records.select("*", F.array_join(F.collect_list("source").over(order.rowsBetween(-before, -1)), "|").alias("before"), F.array_join(F.collect_list("source").over(order.rowsBetween(1, after)), "|").alias("after"))
    versions = candidates.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("version", "subversion", "version_ref", "status"))).alias("v"))
    shown = F.array_join(F.transform("v", lambda x: F.concat(x["version_ref"], F.lit("="), x["status"])), ",")
    return near.join(versions, KEYS, "left").select("doc_id", "record_id", "source", "before", "after", F.coalesce(shown, F.lit("")).alias("versions"))


def compare(candidates: DataFrame, reviews: DataFrame, refs: list[str]) -> DataFrame:
    """QV4: versions and reviews among `refs`, side by side."""
    a = candidates.select("doc_id", "record_id", F.col("version_ref").alias("ref"), "status", "target")
    b = reviews.select("doc_id", "record_id", F.col("review_ref").alias("ref"), "status", "target")
    return a.union(b).where(F.col("ref").isin(refs))


def listing(records: DataFrame, store: DataFrame, candidates: DataFrame, version: str | None = None) -> DataFrame:
    """QV3: records with one version's target, or else their active one's, whatever its status."""
    wanted = store.select(*KEYS, F.coalesce(F.lit(version), F.col("active_version")).alias("version_ref"))
    found = candidates.select(*KEYS, "version_ref", "target", "status").join(wanted, [*KEYS, "version_ref"])
    return records.select(*KEYS, "record_id").join(found, KEYS, "left").select("doc_id", "record_id", "version_ref", "target", "status")


def partitions(findings: DataFrame, strict: bool = False) -> DataFrame:
    """FI6: errors, warnings, blocking and inactive findings, and whether validation fails."""
    blocking = (F.col("severity") == "error") & (F.lit(strict) | (F.col("scope") != "inactive"))
    return findings.agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity").isin("warn", "warning")).alias("warnings"),
        F.count_if(blocking).alias("blocking"), F.count_if(F.col("scope") == "inactive").alias("inactive"), F.coalesce(F.bool_or(blocking), F.lit(False)).alias("fails"),
    )


def notes_before(notes: DataFrame, chapters: DataFrame) -> DataFrame:
    """WN14: for each chapter how many notes stand strictly before it, and the last of these; a running sum, no range join."""
    by_chapter = notes.groupBy("doc_id", "chapter_no").agg(F.count("*").alias("n"), F.max("note").alias("note"))
    order = Window.partitionBy("doc_id").orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = chapters.join(by_chapter, ["doc_id", "chapter_no"], "left")
    return rows.select("doc_id", "chapter_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("notes"), F.last("note", ignorenulls=True).over(order).alias("latest"))


def span_starts(boundaries: DataFrame, records: DataFrame) -> DataFrame:
    """JN7: the first record of each boundary's span; null where the span has none."""
    first = records.groupBy("doc_id", "span_index").agg(F.min("record_pos").alias("record_pos"))
    return boundaries.join(first, ["doc_id", "span_index"], "left")


def compare_profiles(effective: DataFrame, records: DataFrame, profiles: list[str]) -> DataFrame:
    """JN14: each record's targets by profile, and how many of them differ."""
    by = effective.groupBy(*KEYS).agg(*[F.max(F.when(F.col("profile") == p, F.col("target"))).alias(p) for p in profiles])
    rows = records.select(*KEYS, "record_id").join(by, KEYS, "left")
    given = F.array_distinct(F.filter(F.array(*profiles), lambda x: x.isNotNull()))
    return rows.select("doc_id", "record_id", *profiles, F.size(given).cast("long").alias("different"))


LANGUAGE_TAG = r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?(-([A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*$"


def language_policy(outputs: DataFrame) -> DataFrame:
    """Output language tags that are missing where needed, malformed, or the source's own."""
    policy, tag = F.col("policy"), F.col("tag")
    rule = (
        F.when((policy == "explicit") & F.coalesce(F.trim(tag) == "", F.lit(True)), "epub_output_explicit_language_missing")
        .when((policy == "explicit") & ~F.regexp_like(tag, F.lit(LANGUAGE_TAG)), "invalid_epub_output_language")
        .when((policy == "preserve") & (F.col("source_language") != F.col("target_language")), "epub_output_language_policy_preserves_source")
    )
    severity = F.when(rule == "epub_output_language_policy_preserves_source", "warn").otherwise("error")
    return outputs.select("*", rule.alias("rule"), severity.alias("severity")).where("rule IS NOT NULL")
