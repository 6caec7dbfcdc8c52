"""Streams of events: watermarked counts of windows.

`windowed` is the streaming plan: in append or update mode its state is bounded by the watermark. `counted`
drains what its source has now (trigger availableNow) in complete mode, whose state has a row for every
window and type, and reads the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.plans.shared import shared_path

LATE = "10 minutes"
WIDTH = "1 hour"
EPOCH = "1970-01-01 00:00:00"


def windowed(events: DataFrame, late: str = LATE, width: str = WIDTH) -> DataFrame:
    """Events, largest value and first id for each window and type; events without a time are left out."""
    # local times as if of UTC, whatever the session's zone: a watermark needs instants
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    timed = events.where("ts IS NOT NULL").withColumn("at", F.timestamp_micros(micros)).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.max("value").alias("top_value"), F.min("event_id").alias("first_id"))
    return grouped.select(F.timestamp_add("MICROSECOND", F.unix_micros("w.start"), epoch).alias("window_start"), "event_type", "events", "top_value", "first_id")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Windowed counts of all events that lie at `path` (a file or folder) now; each batch replaces the table."""
    place = shared_path(spark, "stream")
    # a pattern: a stream takes a plain path for a folder, and the table may be a single file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table")

    query = windowed(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/table")


QUERIES = {"stream_event_windows": lambda spark, sf_dir: counted(spark, f"{sf_dir}/events.parquet")}
ORACLE_SQL = {"stream_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, max(value) AS top_value, min(event_id) AS first_id FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"}
