"""Preflight of a build: block spans against sentence records, whole spans checked, what breaks blamed on one record (JN8, V48).

Records lie in the span with the greatest start up to theirs. The range join runs on buckets of WIDTH places: a span is
told to the buckets that it reaches into, records look into their own, so neither side is compared whole and a long
document is many keys.

Defined results: places before a document's first span, and null places, lie in none; of spans that begin at one place
each has the records; a span without records gives a finding; no spans, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.fragments import issues
from segmenta.plans.shared import written
from segmenta.sources import texts

WIDTH = 1024


def ranges(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, stop) of each span (doc_id, span_index): up to the next greater start in its document, or null.

    Starts are looked up in their bucket first, the last of a bucket in the next bucket that has any.
    """
    starts = spans.select("doc_id", F.col("span_index").alias("start")).where("start IS NOT NULL").distinct().withColumn("bucket", F.floor(F.col("start") / width))
    inside = Window.partitionBy("doc_id", "bucket").orderBy("start")
    firsts = starts.groupBy("doc_id", "bucket").agg(F.min("start").alias("first"))
    after = firsts.select("doc_id", "bucket", F.lead("first").over(Window.partitionBy("doc_id").orderBy("bucket")).alias("after"))
    found = starts.withColumn("next", F.lead("start").over(inside)).join(after, ["doc_id", "bucket"]).select("doc_id", "start", F.coalesce("next", "after").alias("stop"))
    return spans.withColumnRenamed("span_index", "start").join(found, ["doc_id", "start"])


def span_records(spans: DataFrame, records: DataFrame, width: int = WIDTH) -> DataFrame:
    """JN8: records (doc_id, span_index, ...) with `start`, the span that they lie in, and the span's other columns."""
    last = records.groupBy("doc_id").agg(F.max("span_index").alias("last"))
    reach = ranges(spans, width).join(last, "doc_id").withColumn("end", F.coalesce("stop", F.col("last") + 1)).where("start < end")
    told = reach.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))).drop("last", "stop")
    asked = records.withColumn("bucket", F.floor(F.col("span_index") / width))
    return asked.join(told, ["doc_id", "bucket"]).where("span_index >= start AND span_index < end").drop("bucket", "end")


def blamed(ids: list, sources: list, givens: list) -> list[tuple[str, str, str, str]]:
    """(severity, rule, record_id, record_ids) of one span's records, in order."""

    def first(*rules: str) -> str:
        return next((i for i, *pair in zip(ids, sources, givens, strict=True) if any(rule in rules for _, rule in issues(*pair))), None) or ""

    whole, by_tags = [" ".join(x for x in each if x is not None) for each in (sources, givens)], None
    out = []
    for severity, rule in issues(*whole):
        if rule == "dash_semantic_cue_missing":
            blame = first(rule)
        else:
            blame = by_tags = first("inline_xhtml_preserved", "inline_xhtml_parseable") if by_tags is None else by_tags
        out.append((severity, rule, blame, ",".join(i for i in ids if i is not None)))
    return out


def findings(spans: DataFrame, records: DataFrame, complete: bool = True, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, severity, rule, record_id, record_ids) of spans; records: doc_id, span_index, record_pos, record_id, source, target.

    A span's fragments are joined by a blank and checked whole. What breaks is blamed on the first record whose own tags
    differ (or whose dash is gone), or on none; complete: records without a target are findings of their own.
    Records with their spans are written once to the shared folder, since three parts read them; a span's records go to one call, which asks them one by one only if the span breaks.
    """
    met = written(span_records(spans, records, width).select("doc_id", "start", "record_pos", "record_id", "source", "target"), "preflight")
    done = met.withColumn("given", F.coalesce("target", "source"))
    parts = F.array_sort(F.collect_list(F.struct("record_pos", "record_id", "source", "given")))
    whole = done.groupBy("doc_id", "start").agg(parts.alias("p"), F.bool_and(F.col("source") == F.col("given")).alias("same")).where("NOT same")
    columns = ["doc_id", "start", "severity", "rule", "record_id", "record_ids"]
    keys = {k: whole.schema[k].dataType.simpleString() for k in columns[:2]}
    found = texts.explode_texts(whole.select(*keys, "p.record_id", "p.source", "p.given"), keys, ["record_id", "source", "given"], dict.fromkeys(columns[2:], "string"), blamed).drop("pos")
    empty = spans.select("doc_id", F.col("span_index").alias("start")).join(met.select("doc_id", "start").distinct(), ["doc_id", "start"], "left_anti")
    found = found.unionByName(empty.select("doc_id", "start", F.lit("error").alias("severity"), F.lit("span_without_records").alias("rule"), F.lit("").alias("record_id"), F.lit("").alias("record_ids")))
    if complete:
        missing = met.where("target IS NULL").select("doc_id", "start", F.lit("error").alias("severity"), F.lit("missing_translation").alias("rule"), "record_id", F.col("record_id").alias("record_ids"))
        found = found.unionByName(missing)
    return found
