"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A Python worker holds one Arrow batch at a time; texts may be long, so batches are short and of bounded size.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: Keys with more than a share of 1 / HOT of all rows are joined apart; there are fewer than HOT of them.
HOT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by rows and bytes, in this session; plans read the limits when they run, so they stay set.

    Limits below these, set by the user, are left alone.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the folder that the cluster shares (spark.checkpoint.dir)."""
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_dir(spark: SparkSession) -> None:
    """Where the session names no folder: one in the warehouse, which a cluster shares; in local mode a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="segmenta-") if sc.master.startswith("local") and "-cluster" not in sc.master else f"{spark.conf.get('spark.sql.warehouse.dir')}/.segmenta"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own)


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; -1 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % m, F.lit(-1)).cast("int")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """Run make() once a task, then its result once an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield step(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: smaller than a checkpoint; removed at exit."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As `stored`, with the table's path, for `remove` once nothing reads it any more."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new place in the shared checkpoint folder; what is written there is removed at exit."""
    durable_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups (one row a key, `size` its rows of `total`) on `key`, without a task for a hot key.

    Hot groups, fewer than HOT whatever the tables' sizes, are broadcast; the others meet by a shuffle.
    """
    most = max(1000, total // HOT)
    hot, rest = groups.where(F.col(size) > most).drop(size), groups.where(F.col(size) <= most).drop(size)
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def running(df: DataFrame, keys: list[str], order: list, sums: list[str]) -> DataFrame:
    """df with `rank`, a row's place from 1 on in its group by `order`, and the running totals of `sums`, however long a group.

    Rows are dealt by ranges, so a long group lies in several parts; what stands before the first group of a part is
    one row a part and is broadcast. Rows that tie in `order` take any order.
    """
    spark = df.sparkSession
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, "_place"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = stored(dealt.select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = at.select(*df.columns, "_part", F.count("*").over(inside).alias("rank"), *(F.sum(s).over(inside).alias(f"_{s}") for s in sums))
    totals = at.groupBy("_part", *keys).agg(F.count("*").alias("_n"), *(F.sum(s).alias(f"_t{s}") for s in sums))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *(F.col(k).alias(f"_k{k}") for k in keys), F.sum("_n").over(before).alias("_n"), *(F.sum(f"_t{s}").over(before).alias(f"_t{s}") for s in sums)).where("_n IS NOT NULL")
    carried = carried.withColumnRenamed("_part", "_p")
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys)]
    met = local.join(F.broadcast(carried), same, "left")
    own = [c for c in df.columns if c not in sums]
    return met.select(*own, (F.col("rank") + F.coalesce("_n", F.lit(0))).alias("rank"), *((F.col(f"_{s}") + F.coalesce(f"_t{s}", F.lit(0))).alias(s) for s in sums))


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
