"""LM scoring by a weighted backoff automaton over word pairs and triples.

Counts cover every training text and every n-gram up to three tokens, without thresholds. A state is a history
that training has seen: the last two tokens, the last one, or none; a text begins in the state of the end
token. A state's arc for a token that followed it carries the smoothed probability
(c(history, token) + prior * p(token | shorter history)) / (c(history) + prior); its failure arc, for all other
tokens, leads to the shorter history and weighs prior / (c(history) + prior), so each state's probabilities sum
to one; the prior is one of PRIORS, by the history's length. The last state's arcs are discounted word frequencies, what discounting takes away is the unknown
word's. One pass from left to right carries the state and adds up log10 probabilities.

The table of counts grows with the corpus and is never gathered or broadcast: texts are dealt into blocks (a file's
texts into a few of them, so that one task holds most of a block), each block asks for the n-grams it holds, with its own counts of them, and is told the counts of those that other
blocks have too. N-grams travel as hashes, many to a row, in sorted runs of differences; asks meet by ranges
of the hash, so a frequent n-gram is one entry of each run. A collision adds two counts: words have 64 bits,
pairs and triples as many as the corpus needs for a chance of 2**-SPARE_BITS or less that one of them collides.

Defined results: null and empty texts are a single end token; with no training rows every count is zero and
the score is that of unknown words; equal texts get equal scores; an empty table gives an empty result.
Null ids are taken for training only where the fold says so. Rows alike in id and text are scored once and
counted as often as they occur, where there are more than HOT_ROWS of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import small_batches, stored

END = b""
#: Weight of the shorter history's probability, as a count, for histories of one and of two tokens.
PRIORS = (128.0, 4.0)
DISCOUNT = 0.5
ORDER = 3
#: Characters of text in a block, and for each range of hashes, about; either fits into one worker.
BLOCK_CHARS, RANGE_CHARS = 14_000_000, 8_000_000
SPARE_BITS = 14
#: Tokens that a task gathers before it sends asks.
FLUSH = 4_500_000
HOT_ROWS = 1000
BROADCAST_ROWS = 100_000


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end; bytes are UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
    out = raw.lower().split()
    out.append(END)
    return out


class Hashes(dict):
    """64-bit hashes of words; forgets all once there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_END_HASH = np.uint64(xxhash.xxh64_intdigest(END, 42))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for odd in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        x ^= x >> np.uint64(32)
        x *= np.uint64(odd)
    return x ^ (x >> np.uint64(32))


def hashed(texts: list[str | bytes | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, end to end, and where each text starts."""
    lists = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for words in lists for h in map(hashes.__getitem__, words)), np.uint64, int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes


def grams(flat: np.ndarray, starts: np.ndarray, bits: int = 64) -> list[np.ndarray]:
    """Keys of the word (64 bits), pair and triple (`bits`) that end at each token; a text's first token has no triple (zero)."""
    before = np.concatenate((flat[:1], flat[:-1]))
    before[starts] = _END_HASH
    pairs = mix(before, flat)
    triples = mix(np.concatenate((pairs[:1], pairs[:-1])), flat)
    triples[starts] = 0
    return [flat, pairs >> np.uint64(64 - bits), triples >> np.uint64(64 - bits)]


def key_bits(chars: int) -> int:
    """Bits of a pair's or triple's key in a corpus of so many characters, which has fewer tokens."""
    return min(64, max(40, chars.bit_length() + SPARE_BITS))


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def packed(a: np.ndarray) -> bytes:
    """Byte planes, compressed: what is alike in all entries takes no room. The first four bytes are the length."""
    return len(a).to_bytes(4, "little") + pa.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.concatenate((keys[:1], np.diff(keys))))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def _asks(df: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(part, block, gram, keys, n): the n-grams of each block and how often its training texts have them, by range of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, tokens = Hashes(), {}, 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("gram", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                sizes = np.array([len(flat) for flat, *_ in parts])
                shift = np.cumsum(sizes) - sizes
                flat, starts, weight = (np.concatenate(x) for x in zip(*[(f, s + k, w) for (f, s, w), k in zip(parts, shift, strict=True)], strict=True))
                rows: list[list] = [[], [], [], [], []]
                for gram, keys in enumerate(grams(flat, starts, bits), 1):
                    use = keys != 0 if gram == ORDER else slice(None)
                    keys, n = counted(keys[use], weight[use])
                    part = (keys >> np.uint64((bits if gram > 1 else 64) - 32)) * np.uint64(ranges) >> np.uint64(32)
                    cut = np.flatnonzero(np.concatenate((part[:1] == part[:1], part[1:] != part[:-1], [True])))
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        for column, value in zip(rows, (int(part[a]), block, gram, pack_keys(keys[a:b]), packed(n[a:b])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            held.clear()

        for batch in batches:
            blocks, texts, weights = (c.to_pylist() for c in batch.columns)
            for block in set(blocks):
                mine = [k for k, b in enumerate(blocks) if b == block]
                flat, starts = hashed([texts[k] for k in mine], hashes)
                each = np.diff(np.append(starts, len(flat)))
                held.setdefault(block, []).append((flat, starts, np.repeat(np.array([weights[k] for k in mine], np.uint64), each)))
                tokens += len(flat)
            if tokens > FLUSH:
                yield from flush()
                tokens = 0
        yield from flush()

    return df.select("block", "text", "weight").mapInArrow(run, "part int, block long, gram int, keys binary, n binary")


_REPLY = pa.schema([("block", pa.int64()), ("gram", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _answer(asked: pa.Table) -> pa.Table:
    """For one range of hashes: to each block the counts of those of its n-grams that others count too."""
    rows: list[list] = [[] for _ in _REPLY]

    def add(*values) -> None:
        for column, value in zip(rows, values, strict=True):
            column.append(value)

    asked = asked.sort_by("block")
    of = asked.column("gram").to_numpy()
    for gram in range(1, ORDER + 1):
        some = asked.filter(pa.array(of == gram))
        if not some.num_rows:
            continue
        lists = [unpack_keys(x) for x in some.column("keys").to_pylist()]
        keys, n = np.concatenate(lists), np.concatenate([unpacked(x) for x in some.column("n").to_pylist()])
        block = np.repeat(some.column("block").to_numpy(), [len(x) for x in lists])
        # runs are sorted, so this merges them; equal keys stay in order of block
        order = np.argsort(keys, kind="stable")
        keys, n, block = keys[order], n[order], block[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.flatnonzero(new | np.concatenate(([True], block[1:] != block[:-1])))
        own, keys, block, new = np.add.reduceat(n, at), keys[at], block[at], new[at]
        first = np.flatnonzero(new)
        total = np.add.reduceat(own, first)
        total = np.repeat(total, np.diff(np.append(first, len(keys))))
        tell = np.flatnonzero(total != own)
        tell = tell[np.argsort(block[tell], kind="stable")]
        cut = np.flatnonzero(np.concatenate(([True], block[tell][1:] != block[tell][:-1], [True]))) if len(tell) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = tell[a:b]
            add(int(block[mine[0]]), gram, pack_keys(keys[mine]), packed(total[mine]))
    return pa.table([pa.array(c, f.type) for c, f in zip(rows, _REPLY, strict=True)], schema=_REPLY)


def totals(keys: np.ndarray, weight: np.ndarray, known: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The corpus's count of each key: what the block was told, else its own."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate((sorted_keys[:1] == sorted_keys[:1], sorted_keys[1:] != sorted_keys[:-1])))
    count = np.add.reduceat(weight[order], first)
    if len(known):
        at = np.minimum(np.searchsorted(known, sorted_keys[first]), len(known) - 1)
        hit = known[at] == sorted_keys[first]
        count[hit] = told[at[hit]]
    out = np.empty(len(keys), np.float64)
    out[order] = np.repeat(count, np.diff(np.append(first, len(keys))))
    return out


def word_arcs(count: np.ndarray, total: int, types: int) -> np.ndarray:
    """Probabilities of the last state's arcs; a count of zero takes the unknown word's."""
    if not types:
        return np.full(len(count), 0.5)
    return np.where(count > 0, np.maximum(count - DISCOUNT, DISCOUNT), DISCOUNT * types) / total


def traverse(counts: list[np.ndarray], starts: np.ndarray, total: int, types: int, priors: tuple[float, float] = PRIORS) -> np.ndarray:
    """Log10 weight of every token's way: failure arcs down to a state that has an arc for it, then that arc.

    counts: of the word, pair and triple that end at each token. The state before a token is its history of
    two tokens (one at a text's start); a history never seen is no state, and its failure arc costs nothing.
    """
    word, pair, triple = counts
    ends = np.append(starts[1:], len(word)) - 1
    last = np.concatenate((word[:1], word[:-1]))
    # a text begins after an end token, whose count its own end knows
    last[starts] = word[ends]
    two = np.concatenate((pair[:1], pair[:-1]))
    two[starts] = 0
    p = word_arcs(word, total, types)
    way = np.log10(p)
    for followed, history, prior in zip((pair, triple), (last, two), priors, strict=True):
        seen = followed > 0
        arc = (followed + prior * p) / (history + prior)
        failure = np.log10(prior / (history + prior))
        way = np.where(seen, np.log10(arc), failure + way)
        p = np.where(seen, arc, prior * p / (history + prior))
    return way


def _parcels(df: DataFrame) -> DataFrame:
    """(block, id, weight, times, size, texts): the rows of a block that come together, their texts compressed as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            blocks, ids, texts, weights, times = (c.to_pylist() for c in batch.columns)
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            rows: list[list] = [[], [], [], [], [], []]
            for block in set(blocks):
                mine = [k for k, b in enumerate(blocks) if b == block]
                whole = b"".join([raw[k] for k in mine])
                values = (block, *([c[k] for k in mine] for c in (ids, weights, times)), [len(raw[k]) for k in mine], pa.compress(whole, codec="zstd", asbytes=True))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            types = (pa.int64(), longs, longs, longs, longs, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["block", "id", "weight", "times", "size", "texts"])

    return df.select("block", "id", "text", "weight", "times").mapInArrow(run, "block long, id array<long>, weight array<long>, times array<long>, size array<long>, texts binary")


def _texts(parcels: pa.Table) -> Iterator[list[bytes]]:
    for sizes, raw in zip(parcels.column("size").to_pylist(), parcels.column("texts").to_pylist(), strict=True):
        whole = pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
        ends = np.cumsum(sizes).tolist()
        yield [whole[b - n : b] for b, n in zip(ends, sizes, strict=True)]


def _vocabulary(df: DataFrame, ranges: int) -> tuple[int, int]:
    """Tokens and different words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, tokens = Hashes(), set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            runs = [pack_keys(x) for x in np.split(keys, np.flatnonzero(part[1:] != part[:-1]) + 1)] if len(keys) else []
            parts = np.unique(part).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(parts + [-1], pa.int32()), pa.array([*runs, None], pa.binary()), pa.array([0] * len(parts) + [tokens], pa.int64())], names=["part", "keys", "n"])

        for batch in batches:
            for text, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = words_of(text)
                tokens += len(mine) * weight
                words.update(mine)
                if len(words) > 1_000_000:
                    yield from flush()
                    words, tokens = set(), 0
        yield from flush()

    def types(runs: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in runs.column("keys").to_pylist() if x is not None]
        n = len(np.unique(np.concatenate(keys))) if keys else 0
        return pa.table({"types": [n], "tokens": [sum(runs.column("n").to_pylist())]}, schema=pa.schema([("types", pa.int64()), ("tokens", pa.int64())]))

    asked = df.where("weight > 0").select("text", "weight").mapInArrow(run, "part int, keys binary, n long")
    tokens, words = asked.groupBy("part").applyInArrow(types, "types long, tokens long").agg(F.sum("tokens"), F.sum("types")).first()
    return tokens or 0, words or 0


def _rows(df: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key, file, weight, times): weight is how often the row trains; rows alike are one where there are many."""
    rows = df.select(F.input_file_name().alias("file"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).cast("long").alias("weight"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    hot = stored(rows.groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key"))
    n = hot.count()
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    if not n:
        return rows
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    many = rows.join(hot, "key", "left_semi").groupBy("key", "weight").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.lit("").alias("file"), F.count("*").alias("times"))
    many = many.withColumn("weight", F.col("weight") * F.col("times"))
    return rows.join(hot, "key", "left_anti").unionByName(many.select(rows.columns))


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", priors: tuple[float, float] = PRIORS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row; learns where `train` holds."""
    spark = df.sparkSession
    small_batches(spark)
    rows = _rows(df, train, id_col, text_col)
    files = df.groupBy(F.input_file_name().alias("file")).agg(F.sum(F.length(text_col)).alias("chars"))
    chars, largest = (x or 0 for x in files.agg(F.sum("chars"), F.max("chars")).first())
    least = spark.sparkContext.defaultParallelism
    ranges, bits = max(least, math.ceil(chars / RANGE_CHARS)), key_bits(chars)
    total, types = _vocabulary(rows, ranges)
    # by file and key, so a row's block is the same in every run of a task, wherever the scan cuts the file
    rows = rows.withColumn("block", F.xxhash64("file", F.pmod("key", F.lit(max(1, math.ceil(largest / BLOCK_CHARS))))))
    told = _asks(rows, ranges, bits).groupBy("part").applyInArrow(lambda t: _answer(t.drop_columns(["part"])), "block long, gram int, keys binary, n binary")
    schema = "id long, times long, n_tokens long, n_known long, base_score double, score double"

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        hashes = Hashes()
        parts = [hashed(texts, hashes) for texts in _texts(docs)]
        shift = np.cumsum([0, *(len(f) for f, _ in parts)])
        flat = np.concatenate([f for f, _ in parts] or [np.zeros(0, np.uint64)])
        starts = np.concatenate([s + k for (_, s), k in zip(parts, shift[:-1], strict=True)] or [np.zeros(0, np.int64)])
        ids, weights, times = (docs.column(c).combine_chunks().flatten() for c in ("id", "weight", "times"))
        out = [ids, times]
        if not len(flat):
            return pa.table([*out, *[pa.array([], pa.int64())] * 2, *[pa.array([], pa.float64())] * 2], names=["id", "times", "n_tokens", "n_known", "base_score", "score"])
        sizes = np.diff(np.append(starts, len(flat)))
        weight = np.repeat(weights.to_numpy(zero_copy_only=False).astype(np.uint64), sizes)
        gram, counts = told.column("gram").to_numpy(), []
        for k, keys in enumerate(grams(flat, starts, bits), 1):
            mine = told.filter(pa.array(gram == k))
            known = np.concatenate([unpack_keys(x) for x in mine.column("keys").to_pylist()] or [np.zeros(0, np.uint64)])
            n = np.concatenate([unpacked(x) for x in mine.column("n").to_pylist()] or [np.zeros(0, np.uint64)])
            order = np.argsort(known, kind="stable")
            count = totals(keys, weight, known[order], n[order])
            if k == ORDER:
                count[starts] = 0
            counts.append(count)
        base = np.log10(counts[0] + 1) - math.log10(total + types + 1)
        sums = [np.add.reduceat(x, starts) for x in ((counts[0] > 0).astype(np.int64), base, traverse(counts, starts, total, types, priors))]
        return pa.table([*out, pa.array(sizes), *[pa.array(x) for x in sums]], names=["id", "times", "n_tokens", "n_known", "base_score", "score"])

    scored = _parcels(rows).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
