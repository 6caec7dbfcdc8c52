"""Bounded runs of work as a stream of events with state: ready, blocked or complete (SK17, QV10, TK5, JN15).

An event (todo_id, seq, kind, value) writes a slot of its todo: `plan` and `done` one for each chapter, `undone` takes a
chapter's `done` back, `source` and `context` hold digests of the plan's making, `source_now` and `context_now` those of
now, `errors` a number. The event of the highest seq holds a slot, so state is the same whatever order events come in,
and a fold over the table gives what the stream gives. State is bounded by a todo's chapters.

A todo is complete if all its planned chapters are done; else blocked, if its source or context drifted or there are
errors, in this order; else ready. Defined results: events without todo or seq are left out; of two events of one seq the
greater value holds; a todo without planned chapters is complete; errors that are no number are none; no events, no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segmenta.plans.shared import shared_path

STATUS = "todo_id long, state string, reason string, current long, complete long, planned long"
NONE = -(1 << 62)
EVENTS = "todo_id long, seq long, kind string, value string"


def status(slots: dict[str, list]) -> tuple[str, str | None, int | None, int, int]:
    """(state, reason, current chapter, chapters done, chapters planned) of a todo's slots."""
    value = {slot: v for slot, (_, v, _) in slots.items()}
    planned = sorted(int(s[5:]) for s in slots if s.startswith("plan:"))
    left = [c for c in planned if slots.get(f"done:{c}", [0, "", "undone"])[2] != "done"]
    drift = [k for k in ("source", "context") if value.get(f"{k}_now") is not None and value.get(k) is not None and value[k] != value[f"{k}_now"]]
    errors = (value.get("errors") or "").isdecimal() and int(value["errors"]) > 0
    state, reason = ("complete", None) if not left else ("blocked", drift[0]) if drift else ("blocked", "validation") if errors else ("ready", None)
    return state, reason, left[0] if left else None, len(planned) - len(left), len(planned)


def put(slots: dict[str, list], seq: int, kind: str, value: str | None) -> None:
    slot = f"plan:{value}" if kind == "plan" else f"done:{value}" if kind in ("done", "undone") else kind
    event = [seq, value or "", kind]
    if slot not in slots or event > slots[slot]:
        slots[slot] = event


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slots = json.loads(state.get[0]) if state.exists else {}
    for frame in frames:
        for seq, kind, value in zip(frame["seq"], frame["kind"], frame["value"], strict=True):
            put(slots, int(seq), kind, value)
    state.update((json.dumps(slots),))
    found = status(slots)
    # nothing is null on the way: "" and NONE stand for no reason and no chapter
    yield pd.DataFrame({"todo_id": [key[0]], "state": [found[0]], "reason": [found[1] or ""], "current": [NONE if found[2] is None else found[2]], "complete": [found[3]], "planned": [found[4]]})


def statuses(events: DataFrame) -> DataFrame:
    """The stream's plan: the status of each todo that a batch touches."""
    known = events.where("todo_id IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL")
    found = known.groupBy("todo_id").applyInPandasWithState(_update, STATUS, "slots string", "update", GroupStateTimeout.NoTimeout)
    return found.withColumns({"reason": F.nullif("reason", F.lit("")), "current": F.nullif("current", F.lit(NONE))})


def streamed(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The statuses after all events that lie in a folder now, some files at a time; the newest of each todo."""
    place = shared_path(spark, "todos")
    source = spark.readStream.schema(EVENTS)
    source = source.option("maxFilesPerTrigger", files) if files else source

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/status/batch-{number:06d}")

    query = statuses(source.parquet(path)).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{STATUS}, batch int").option("recursiveFileLookup", "true").parquet(f"{place}/status")
    return rows.groupBy("todo_id").agg(F.max_by(F.struct("state", "reason", "current", "complete", "planned"), "batch").alias("s")).select("todo_id", "s.*")


def folded(events: DataFrame) -> DataFrame:
    """The same statuses by one fold over a table of events."""
    known = events.where("todo_id IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL").withColumn("value", F.coalesce("value", F.lit("")))
    slot = F.when(F.col("kind").isin("plan", "done", "undone"), F.concat(F.when(F.col("kind") == "plan", "plan:").otherwise("done:"), "value")).otherwise(F.col("kind"))
    held = known.groupBy("todo_id", slot.alias("slot")).agg(F.max_by(F.struct("value", "kind"), F.struct("seq", "value", "kind")).alias("h"))
    chapters = held.where("slot LIKE 'plan:%' OR slot LIKE 'done:%'").groupBy("todo_id", F.col("h.value").cast("long").alias("chapter")).agg(F.bool_or(F.col("slot").startswith("plan:")).alias("planned"), F.bool_or(F.col("h.kind") == "done").alias("done")).where("planned")
    work = chapters.groupBy("todo_id").agg(F.count("*").alias("planned"), F.count_if("done").alias("complete"), F.min(F.when(~F.col("done"), F.col("chapter"))).alias("current"))

    def now(name: str):
        return F.max(F.when(F.col("slot") == name, F.col("h.value")))

    digests = held.groupBy("todo_id").agg(*(now(n).alias(n) for n in ("source", "source_now", "context", "context_now", "errors")))
    rows = digests.join(work, "todo_id", "left")
    reason = F.when(F.col("source") != F.col("source_now"), "source").when(F.col("context") != F.col("context_now"), "context").when(F.col("errors").try_cast("long") > 0, "validation")
    state = F.when(F.col("current").isNull(), "complete").when(reason.isNotNull(), "blocked").otherwise("ready")
    return rows.select("todo_id", state.alias("state"), F.when(state == "blocked", reason).alias("reason"), "current", F.coalesce("complete", F.lit(0)).alias("complete"), F.coalesce("planned", F.lit(0)).alias("planned"))


def latest_incomplete(todos: DataFrame) -> DataFrame:
    """TK5: (project, todo_id, overlaps, rule) - each project's newest incomplete todo and how many other incomplete ones share a chapter with it.

    todos: project, todo_id, created_at, complete, chapters. The chapters are an inverted index that only the newest todo's
    chapters are looked up in. rule: `ambiguous_latest_todo` where the choice is not safe, else null.
    """
    left = todos.where("NOT complete")
    latest = left.groupBy("project").agg(F.max_by(F.struct("todo_id", "chapters"), F.struct("created_at", "todo_id")).alias("l")).select("project", F.col("l.todo_id").alias("todo_id"), F.array_distinct("l.chapters").alias("chapters"))
    index = left.select("project", F.col("todo_id").alias("other"), F.explode(F.array_distinct("chapters")).alias("chapter"))
    asked = latest.select("project", "todo_id", F.explode("chapters").alias("chapter"))
    shared = index.join(asked, ["project", "chapter"]).where("other <> todo_id").groupBy("project").agg(F.count_distinct("other").alias("overlaps"))
    rule = F.when(F.col("overlaps") > 0, "ambiguous_latest_todo")
    return latest.join(shared, "project", "left").select("project", "todo_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), rule.alias("rule"))
