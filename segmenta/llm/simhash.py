"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments with a radius each, so chosen that the radii plus one sum to more than
the allowed distance: two fingerprints within it then agree in some segment up to its radius. Each one
enumerates the small Hamming ball of every segment (some radius is 1 at least, whatever the table's size),
fetches the fingerprints stored under these values and verifies the whole distance. The cut follows from the
number of distinct fingerprints: it weighs probes against the expected matches, and never changes the result.

Only distinct fingerprints are compared, so exact copies, however many, are one entry. A table entry with its
probes is a *bucket*; verified links of a bucket leave it as a tree, never as all pairs, and an entry with more
than BLOCK fingerprints is dealt into parts, each compared with all of the bucket as a unit of its own.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like any
other; null ids take part but never name a component, unless there are no others (then null); one row for
each input row, equal rows included; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.llm.common import map_batches, spread_join, stored
from segmenta.llm.components import components

SEED = 42
#: Fingerprints stored under one value that one unit of work compares with the whole bucket.
BLOCK = 16_384
#: Hot values that are broadcast; were there more, they would meet the others by a shuffle.
BROADCAST_ROWS = 100_000


def fingerprint(text: str, words: int) -> int:
    """Signed 64-bit SimHash of the shingles' XXH64 values."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """Replace the text column by `out`, its fingerprint as a long."""
    kept = [f for f in df.schema.fields if f.name not in {text_col, out}]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            fps = pa.array([fingerprint(t or "", words) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), fps], names=[*(f.name for f in kept), out])

        return step

    return map_batches(df, make, T.StructType([*kept, T.StructField(out, T.LongType())]))


def cut(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment, for n fingerprints: the cheapest of the valid cuts."""
    best = None
    for m in range(1, max(1, distance) + 1):
        base, wide = divmod(64, m)
        widths = [base + (i < wide) for i in range(m)]
        spare = distance + 1 - m
        radii = [spare // m + (i < spare % m) for i in range(m)]
        probes = [sum(_choose(w, k) for k in range(r + 1)) for w, r in zip(widths, radii, strict=True)]
        cost = sum(p * (1 + n / 2.0**w) for p, w in zip(probes, widths, strict=True))
        if best is None or cost < best[0]:
            starts = [sum(widths[:i]) for i in range(m)]
            best = cost, list(zip(starts, widths, radii, strict=True))
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` ones among `width` bits."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(distinct: DataFrame, distance: int = 4, fp: str = "fp") -> DataFrame:
    """Pairs (a, b) of fingerprints at most `distance` bits apart that tie together all such; `distinct` has each once."""
    spark = distinct.sparkSession
    segments = cut(distinct.count(), distance)

    def key(k: int, start: int, width: int, mask: int = 0):
        value = F.shiftrightunsigned(F.col(fp), start).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        return F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(F.lit(mask)).alias("value"), F.lit(mask == 0).alias("stored"))

    every = [key(k, s, w, mask) for k, (s, w, r) in enumerate(segments) for mask in ball(w, r)]
    entry = distinct.select(F.col(fp).alias("fp"), F.explode(F.array(*every)).alias("at")).select("at.segment", "at.value", "at.stored", "fp")
    # the values that many fingerprints are stored under: few, if any
    held = distinct.select(F.explode(F.array(*[key(k, s, w) for k, (s, w, _) in enumerate(segments)])).alias("at")).groupBy("at.segment", "at.value").count()
    hot = stored(held.where(F.col("count") > BLOCK).select("segment", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    n = hot.count()
    if n:
        entry = entry.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, ["segment", "value"], "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        entry = entry.select("segment", "value", "stored", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        entry = entry.select("segment", "value", "part", (F.col("stored") & (F.col("own") == F.col("part"))).alias("stored"), "fp")
    else:
        entry = entry.select("segment", "value", F.lit(0).alias("part"), "stored", "fp")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = entry.repartition(count, "segment", "value", "part").sortWithinPartitions("segment", "value", "part")
    return units.mapInArrow(_verify(distance), "a long, b long").distinct()


def _verify(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = tied(columns, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        waiting: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 500_000:
                continue
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            # the last bucket may go on
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns[:3]]))
            whole = int(last[-1]) + 1 if len(last) else 0
            yield from settle([c[:whole] for c in columns])
            waiting, rows = [[c[whole:] for c in columns]], 0
        if waiting:
            yield from settle([np.concatenate(x) for x in zip(*waiting, strict=True)])

    return verify


def tied(columns: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets: columns segment, value, part, stored, fp, sorted by the first three."""
    *keys, held, fp = columns
    if len(fp) < 2:
        return fp[:0], fp[:0]
    bits = fp.view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
    ends = np.append(starts[1:], len(fp))
    inside = np.add.reduceat(held.astype(np.int64), starts)
    work = (inside > 0) & (ends - starts > 1)
    starts, ends, inside = starts[work], ends[work], inside[work]
    out: list[np.ndarray] = []
    dense = inside * (ends - starts) > 4096
    for s, e in zip(starts[dense].tolist(), ends[dense].tolist(), strict=True):
        out.append(forest(bits[s:e], np.flatnonzero(held[s:e]), distance) + s)
    starts, ends, inside = starts[~dense], ends[~dense], inside[~dense]
    # the others, many buckets at once: each stored row with each row of its bucket
    for i in range(0, len(starts), 20_000):
        s, e = starts[i : i + 20_000], ends[i : i + 20_000]
        group = np.repeat(np.arange(len(s)), e - s)
        row = np.arange(len(group)) - np.repeat(np.cumsum(e - s) - (e - s), e - s) + np.repeat(s, e - s)
        mine, bucket = row[held[row]], group[held[row]]
        width = (e - s)[bucket]
        u = np.repeat(mine, width)
        v = np.arange(len(u)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(s[bucket], width)
        near = (u != v) & (np.bitwise_count(bits[u] ^ bits[v]) <= distance)
        out.append(np.stack((u[near], v[near]), 1))
    if not out:
        return fp[:0], fp[:0]
    pairs = np.concatenate(out)
    a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return both[:, 0], both[:, 1]


def forest(bits: np.ndarray, held: np.ndarray, distance: int) -> np.ndarray:
    """Links (rows of positions) that tie what the `held` positions reach: a row for each position at most.

    Fingerprints that are reached already are not compared again as the far end, but each held one is
    compared with all that may belong to another tree.
    """
    root = np.arange(len(bits))
    out: list[tuple[int, int]] = []
    for h in held.tolist():
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[h]) <= distance)
        other = near[root[near] != root[h]]
        if len(other):
            trees, first = np.unique(root[other], return_index=True)
            out += [(h, int(k)) for k in other[first]]
            root[np.isin(root, trees)] = root[h]
    return np.array(out, np.int64).reshape(-1, 2)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row: the least id among the rows it reaches by links, itself included."""
    marked = stored(fingerprints(df.select(id_col, text_col), text_col, words))
    distinct = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    rows, kinds = marked.count(), distinct.count()
    roots = components(links(distinct.select("fp"), distance))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    groups = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = spread_join(member.select("fp", "n", "root"), groups, "root", "size", kinds).select("fp", "n", "component_id")
    return spread_join(marked, named, "fp", "n", rows).select(id_col, "fp", "component_id")
