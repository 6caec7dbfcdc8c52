"""Embedding near-duplicates by a pivot-permutation index.

Reference points are picked from a bounded, hashed sample (`sample` times as many vectors as pivots) by
farthest-first search, so a dense group does not own them all. A vector is described by its nearest pivots
in order; the index lists, under each pair of pivots, the vectors that have both among their nearest
`prefix`. Vectors with two shared pivots or more thus meet in a list, where their cosine is verified in
double precision. A pair that meets in several lists counts in the first of them only.

Lists longer than `block` are dealt into blocks, and each pair of blocks is its own unit of work, so no list
lands in one task whole. A unit of work returns counts and each vector's least reachable one, never all pairs.

Every vector is indexed; the number of pivots grows with the root of their number, and so do the pivots' bytes, which are broadcast.
Defined results: null or zero vectors, and those with null, non-finite or missing components, link with
nothing and are their own component; vectors of different lengths never link; rows with equal vec_id are
one vector if equal, and never count each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import durable, small_batches
from segmenta.llm.components import components

MIN_PIVOTS = 24
#: So many pivots are chosen far from each other; more, where there are over 8 million vectors, as their hashes fall.
FAR_PIVOTS = 2048
#: Pivots closer than this would rank linked vectors at random.
PIVOT_COSINE = 0.8


def unit(v: list | None) -> np.ndarray | None:
    """The vector at length one, in double precision; None if it links with nothing."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (x / top) / np.linalg.norm(x / top)


def farthest_first(x: np.ndarray, m: int) -> np.ndarray:
    chosen = [0]
    near = x @ x[0]
    for _ in range(min(m, len(x)) - 1):
        k = int(np.argmin(near))
        if near[k] > PIVOT_COSINE:
            break
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indices of each row's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def lists_of(order: np.ndarray, pivots: int) -> np.ndarray:
    """Numbers of the pivot pairs of each row, sorted; a single pivot pairs with itself."""
    if order.shape[1] < 2:
        return order[:, :1].astype(np.int64)
    i, j = np.triu_indices(order.shape[1], 1)
    low, high = np.minimum(order[:, i], order[:, j]), np.maximum(order[:, i], order[:, j])
    return np.sort(low.astype(np.int64) * pivots + high, axis=1)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least position that each of n positions reaches by the links u - v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first `keys` columns, from a stream sorted by these."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and rows[0][:keys] != row[:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def link(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, prefix: int = 5, sample: int = 4, block: int = 2048) -> DataFrame:
    """(id, n_links, component_id) for each input row."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(usable).dropDuplicates(["id", "v"])
    n = good.count()
    own = rows.select("id")
    if not n:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    m = int(max(MIN_PIVOTS, (n / 2) ** 0.5))
    far = min(m, FAR_PIVOTS)
    picked = good.orderBy(F.xxhash64("id", "v"), "id").limit(far * sample + m - far).collect()
    width = max(set(map(len, (r["v"] for r in picked))), key=[len(r["v"]) for r in picked].count)
    units = [unit(r["v"]) for r in picked if len(r["v"]) == width]
    pivots = np.concatenate([farthest_first(np.stack(units[: far * sample]), far), *(u[None] for u in units[far * sample :])])
    held = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            lists = []
            for u in units:
                # other lengths: compared with their like through one list per length
                lists.append([-len(u)] if len(u) != pivots.shape[1] else None)
            at = [k for k, x in enumerate(lists) if x is None]
            if at:
                found = lists_of(permutation(np.stack([units[k] for k in at]), pivots, prefix), len(pivots))
                for k, x in zip(at, found.tolist(), strict=True):
                    lists[k] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "unit", "lists"])

    indexed = durable(good.mapInArrow(describe, "id long, unit binary, lists array<long>"))
    entry = indexed.select("id", "unit", "lists", F.explode("lists").alias("list"))
    sizes = entry.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = entry.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id", "unit"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("p"), F.greatest(k, F.col("part")).alias("q")))
    work = dealt.select("list", F.explode(others).alias("pq"), "part", "id", "unit", "lists").select("list", "pq.p", "pq.q", "part", "id", "unit", "lists")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = work.repartition(count, "list", "p", "q").sortWithinPartitions("list", "p", "q")
    found = durable(units.mapInArrow(_verify(cosine), "a long, b long, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    out = own.join(counts, own["id"] == counts["a"], "left").select("id", "n").join(roots, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "id").alias("component_id"))


def _verify(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[int] = []
        b_out: list[int | None] = []
        n_out: list[int] = []
        for rows in runs(batches, 3):
            here, p, q = rows[0][:3]
            part = np.array([r[3] for r in rows])
            ids = np.array([r[4] for r in rows], np.int64)
            x = np.stack([np.frombuffer(r[5], np.float64) for r in rows])
            lists = np.array([r[6] for r in rows], np.int64)
            left, right = (np.arange(len(rows)),) * 2 if p == q else (np.flatnonzero(part == p), np.flatnonzero(part == q))
            kinds, kind = np.unique(lists, axis=0, return_inverse=True)
            kind, first_shared = kind.ravel(), _first_shared(kinds)
            n_links = np.zeros(len(rows), np.int64)
            label = np.arange(len(rows))
            for i in range(0, len(left), 1024):
                some = left[i : i + 1024]
                u, v = np.nonzero(x[some] @ x[right].T >= cosine)
                u, v = some[u], right[v]
                ok = (u < v if p == q else True) & (ids[u] != ids[v])
                u, v = u[ok], v[ok]
                if len(u):
                    first = first_shared[kind[u], kind[v]] == here
                    n_links += np.bincount(u[first], minlength=len(rows)) + np.bincount(v[first], minlength=len(rows))
                    label = roots(len(rows), np.concatenate((u, np.arange(len(rows)))), np.concatenate((v, label)))
            who, tied = np.flatnonzero(n_links), np.flatnonzero(label != np.arange(len(rows)))
            a_out += [*ids[who].tolist(), *ids[tied].tolist()]
            b_out += [*[None] * len(who), *ids[label[tied]].tolist()]
            n_out += [*n_links[who].tolist(), *[0] * len(tied)]
            if len(a_out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(n_out, pa.int64())], schema=schema)
                a_out, b_out, n_out = [], [], []
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(n_out, pa.int64())], schema=schema)

    return verify


def _first_shared(kinds: np.ndarray, step: int = 256) -> np.ndarray:
    """The least list that each two rows of sorted lists share."""
    out = np.full((len(kinds), len(kinds)), np.iinfo(np.int64).max)
    for i in range(0, len(kinds), step):
        some = kinds[i : i + step]
        for k in range(kinds.shape[1] - 1, -1, -1):
            hit = (some[:, k, None, None] == kinds[None]).any(2)
            out[i : i + step][hit] = np.broadcast_to(some[:, k, None], hit.shape)[hit]
    return out
