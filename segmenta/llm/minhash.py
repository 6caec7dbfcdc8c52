"""Near-duplicates by SimHash and by shingle Jaccard.

Texts whose SimHashes differ in few bits are linked as in `simhash`. At a similarity of 0.8 most fingerprints
differ in more bits than an index can enumerate, so MinHash bands find these pairs and exact Jaccard decides.

A text's shingles are its runs of `words` lower-cased words (a shorter text is one shingle). Texts that
agree in all ROWS values of one of BANDS bands meet in a bucket; a pair at similarity 0.8 meets in none with
probability (1 - 0.8^ROWS)^BANDS, 3.2e-6. Pairs of a bucket are then compared by their whole shingle sets.

Exact copies are one node. Buckets of the same members are compared once, those longer than BLOCK are dealt
into blocks, each pair of blocks being its own unit of work; a unit returns a tree of links, never all
pairs. Pairs that a unit has already tied together are not compared.

Defined results: null, empty and blank texts are alike; one row for each input row; null ids take part but
name a component only where there are no others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm import simhash
from segmenta.llm.common import map_batches, small_batches, spread_join, stored
from segmenta.llm.components import components
from segmenta.llm.pivots import runs

SEED = 42
ROWS, BANDS = 4, 24
BLOCK = 256
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS, 1), np.uint64)
_MULTIPLY = _MULTIPLY * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted different XXH64 values of the text's shingles."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the set's MinHash values."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, i : i + 2048] * _MULTIPLY + _ADD).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) >> 1 for k, row in enumerate(least.reshape(BANDS, ROWS))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _keys(df: DataFrame, words: int) -> DataFrame:
    """(node, fp, keys) of each (node, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            fps = [simhash.fingerprint(t, words) for t in texts]
            keys = [bands(shingles(t, words)) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "keys"])

        return step

    return map_batches(df, make, "node long, fp long, keys array<long>")


def links(texts: DataFrame, words: int, similarity: float, distance: int) -> DataFrame:
    """(a, b): links that tie together the nodes of (node, text) at this similarity or more, or within this distance."""
    found = stored(_keys(texts, words).dropDuplicates(["node"]))
    named = stored(found.groupBy("fp").agg(F.min("node").alias("b")))
    same = found.select("node", "fp").join(named, "fp").select(F.col("node").alias("a"), "b")
    first, second = (named.select(F.col("fp").alias(fp), F.col("b").alias(node)) for fp, node in (("a", "x"), ("b", "y")))
    close = simhash.links(named.select("fp"), distance).join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(close).union(_alike(texts, found.select("node", F.explode("keys").alias("key")), words, similarity))


def _alike(texts: DataFrame, entry: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links of nodes that share a bucket of (node, key) and have this Jaccard similarity."""
    spark = texts.sparkSession
    sizes = entry.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node") % 1_000_000_007).alias("x"), F.sum(F.xxhash64("node", F.lit(1)) % 1_000_000_009).alias("y")).where("n > 1")
    # buckets of the same members: one of them
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = entry.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("p"), F.greatest(k, F.col("part")).alias("q")))
    work = stored(dealt.select("key", F.explode(others).alias("pq"), "part", "node").select("key", "pq.p", "pq.q", "part", "node"))
    asked = work.select("node").distinct()
    # nodes and texts both grow with the input: merged, never broadcast, and by the one key that the next join needs
    wanted = texts.join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = work.join(wanted.hint("merge"), "node").select("key", "p", "q", "part", "node", "text").repartition(count, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    small_batches(spark)
    return units.mapInArrow(_verify(words, similarity), "a long, b long")


def _verify(words: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            p, q = rows[0][1:3]
            part, nodes = [r[3] for r in rows], [r[4] for r in rows]
            sets = [shingles(r[5], words) for r in rows]
            root = list(range(len(rows)))
            a, b = [], []
            for i in range(len(rows)):
                for j in range(i):
                    if root[i] == root[j] or (p != q and part[i] == part[j]):
                        continue
                    few, many = sorted((len(sets[i]), len(sets[j])))
                    if few >= similarity * many and jaccard(sets[i], sets[j]) >= similarity:
                        a.append(nodes[i])
                        b.append(nodes[j])
                        old, new = root[i], root[j]
                        root = [new if x == old else x for x in root]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """(id, node, mark, component_id, first) for each row: the least id it is linked with, and whether it is the row that stays.

    node names the text, mark the row (see row_mark).
    """
    texts = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    roots = components(links(texts.select("node", "text"), words, similarity, distance))
    marked = stored(texts.select(id_col, "node").join(roots, "node", "left").select(id_col, "node", F.coalesce("root", "node").alias("root")))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("node").alias("node"))
    least = marked.groupBy("root").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    own = F.col(id_col).eqNullSafe(F.col("least")["id"]) & (F.col("node") == F.col("least")["node"])
    found = spread_join(marked, least, "root", "n", marked.count()).select(id_col, "node", F.xxhash64(id_col, "node").alias("mark"), F.col("least")["id"].alias("component_id"), own.alias("first"))
    return stored(found)


def row_mark(id_col: str, text_col: str) -> Column:
    """The mark that `near_duplicates` gives a row; equal for rows alike in id and text."""
    return F.xxhash64(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
