"""Trie of conversation prefixes: which conversations begin alike, and what sharing their beginnings saves.

A prefix is named by sums: each turn gives LANES 32-bit numbers hashed from its position and content, and the name of
a prefix is their running totals modulo 2^32 (160 bits). So the parent of a node is its name less the last turn's
numbers, names need no pass along a conversation, and conversations of any length are summed in parts (`running`).

Leaf counts and savings reach all ancestors by pointer jumping: in round k each node adds its totals to the node 2^k
above and takes over that node's pointer, so the number of rounds is the logarithm of the depth. Sums are aggregated
before they are shuffled; nodes with many below them are joined apart (`spread_join`); the root, above everything, is a
plain total. Ids that end at one node are packed in sorted blocks where they lie and hashed from these.

Defined results: a null role or text is empty; null turns come first, turns of equal number in the order of a hash of
role and text; a repeated row is a turn of its own; rows without conv_id are left out; no conversations, no nodes; columns
beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import running, small_batches, spread_join, stored

LANES = [f"l{i}" for i in range(5)]
ROOT = "0" * (8 * len(LANES))
#: Ids in a packed block.
PACK = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, content, words): each turn's digest and number of words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return df.where("conv_id IS NOT NULL").select("conv_id", "turn", content.alias("content"), F.size(F.regexp_extract_all(text, F.lit(WORDS), 0)).cast("long").alias("words"))


def rebuilt(df: DataFrame, every: int, most: Column) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, content, words) and (conv_id): each conversation c with the first `most` turns of conversation c - c % every in place of its own.

    most: a number of turns from 0 to 3, by conv_id.
    """
    ranked = stored(running(turns(df), ["conv_id"], [F.col("turn").asc_nulls_first(), "content"], []))
    n = ranked.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", most.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    lengths = n.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = stored(n.join(lengths, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k")))
    heads = ranked.where("rank <= 3").select(F.col("conv_id").alias("base"), "rank", "content", "words")
    begun = convs.select("conv_id", "base", "h").join(heads, "base").where("rank <= h").select("conv_id", F.col("rank").alias("pos"), "content", "words")
    own = spread_join(ranked, convs.select("conv_id", "h", "k", "n"), "conv_id", "n", ranked.count()).where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("pos"), "content", "words")
    return begun.unionByName(own), convs.select("conv_id")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, words, key, parent) of each prefix of (conv_id, pos, content, words)."""
    hashed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("content")), 256)
    numbers = [F.conv(F.substring("hash", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(len(LANES))]
    named = rows.withColumn("hash", hashed).select("conv_id", "pos", "words", *(x.alias(c) for x, c in zip(numbers, LANES, strict=True)), *(x.alias(f"own_{c}") for x, c in zip(numbers, LANES, strict=True)))
    summed = running(named, ["conv_id"], ["pos"], LANES)

    def name(values: list[Column]) -> Column:
        return F.concat(*(F.lpad(F.hex(F.pmod(v, F.lit(1 << 32))), 8, "0") for v in values))

    key, parent = name([F.col(c) for c in LANES]), name([F.col(c) - F.col(f"own_{c}") for c in LANES])
    return summed.select("conv_id", F.col("pos").alias("depth"), "words", key.alias("key"), F.when(F.col("pos") == 1, ROOT).otherwise(parent).alias("parent"))


def rollup(nodes: DataFrame, depth: int, values: list[str]) -> DataFrame:
    """(key, *values) of nodes (key, up, *values), values summed over each node's subtree; up: the parent, or null. depth: the longest path's nodes."""
    total, state = nodes.count(), nodes.select("key", "up", *values)
    for k in range(max(0, depth - 1).bit_length()):
        if k:
            state = stored(state)
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n"), *(F.sum(v).alias(f"add_{v}") for v in values))
        met = stored(state.join(given, "key", "left"))
        jumps = met.where("n IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("next"), "n")
        sums = [(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]
        state = spread_join(met.where("up IS NOT NULL"), jumps.withColumnRenamed("n", "size"), "up", "size", total).select("key", F.col("next").alias("up"), *sums).unionByName(met.where("up IS NULL").select("key", "up", *sums))
    return state.select("key", *values)


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of the decimal ids, ascending, joined by commas."""
    spark = ends.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, held = zstandard.ZstdCompressor(), None, []

        def block() -> pa.RecordBatch:
            ids = np.array(held, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(ids[:1]), pa.array([machine.compress(np.diff(ids, prepend=0).tobytes())], pa.binary())], names=["key", "first", "block"])

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) == PACK):
                    yield block()
                    held = []
                key = k
                held.append(i)
        if held:
            yield block()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, running_hash = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            done = []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, running_hash.hexdigest()))
                    key, running_hash, sep = k, hashlib.sha256(), ""
                running_hash.update((sep + ",".join(map(str, np.cumsum(np.frombuffer(machine.decompress(blob), np.int64)).tolist()))).encode())
                sep = ","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(2)], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running_hash.hexdigest()])], names=["key", "ends_sha256"])

    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = dealt.mapInArrow(pack, "key string, first long, block binary")
    return blocks.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends_sha256 string")


def trie(df: DataFrame, every: int = 20, most: Column | None = None) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations (see `rebuilt`); most: by default crc32 of the decimal id, modulo 4."""
    most = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 if most is None else most
    rows, convs = rebuilt(df, every, most)
    members = stored(prefixes(rows))
    nodes = members.groupBy("key", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children")))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    top = convs.agg(F.min("conv_id"), F.count("*")).first()
    whole = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count_if(F.col("depth") == 1), F.coalesce(F.sum(leaf), F.lit(0)), F.coalesce(F.sum(saved), F.lit(0)), F.count("*")).first()
    below = nodes.select("key", F.when(F.col("depth") > 1, F.col("parent")).alias("up"), leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    sums = rollup(below, whole[0], ["n_leaves", "saved_tokens"])
    deep = spread_join(nodes.where("depth > 1"), nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size")), "parent", "size", whole[4])
    inner = deep.unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top[0]).cast("long"))).join(sums, "key")
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", *(F.lit(x).cast("long").alias(c) for c, x in zip(columns[5:], (whole[1], whole[2] or 1, whole[3]), strict=True)))
    last = members.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"))
    found = inner.select(*columns).unionByName(root).join(ends_hashed(ends), "key", "left")
    return found.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
