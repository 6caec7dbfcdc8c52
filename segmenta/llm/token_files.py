"""Files of token ids: each document compressed apart under one shared zstandard dictionary, found again by an offset index.

A set of files is a folder with `dictionary` (one file) and `shards`. A shard holds consecutive documents:

    magic 8, id width 4, dictionary SHA-256 32 | a zstandard frame for each document |
    ids int64[n], null flags uint8[n], offsets uint64[n + 1], counts uint32[n] (little-endian) |
    index offset, documents, token ids, partition, number, magic: 8 bytes each, big-endian | line feed

Ids are 16 bits wide where the vocabulary allows, else 32. The dictionary is trained on the serialized ids of a
bounded sample (SAMPLE_DOCS windows of at most SAMPLE_CHARS characters, of the documents least by hash): it decides how
small the frames get, never what they hold. A short document costs its frame, not its neighbours'.

Documents are dealt by ranges of (id, hash of text, place in the input), so that neither a hot id nor copies crowd a
task; a range becomes one or more shards of about SHARD_BYTES. Spark's writer places the shards, one a file, so lost
executors and remote stores are its concern. First places of shards are running totals of their trailers, taken in
two steps, so that no task meets more than a share of the shards.

Ids are those of the tokenizers library without special tokens added. The library itself reads about 2.9 MB a second
and core; so where a vocabulary's merges are in the order of its ids, the tiktoken library encodes with the same merges,
which tests hold against the tokenizers library; texts with a special token's string go to the latter.

Defined results: null and empty texts have no ids but `end`; null doc_ids come first; repeated ids are rows like any
other, ordered by the hash of their texts; an empty table gives no rows; a shard of another dictionary is refused.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.llm.bpe import byte_symbols
from segmenta.llm.common import small_batches

MAGIC = b"SEGMIDS1"
HEAD, TAIL = struct.Struct("<8sI32s"), struct.Struct(">QQQQQ8s")
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 4096, 1 << 16
#: Compressed bytes after which a shard is closed, and text bytes of a range.
SHARD_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Bytes of texts or shards that a worker is handed at once.
BATCH_BYTES = 8 << 20
LEVEL = 3
#: Shards whose totals are summed together before the sums are.
BLOCK = 1024
#: Shards up to which their first places are broadcast.
BROADCAST_SHARDS = 1_000_000
# Fixed value: how the vocabulary's byte-level pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(content: bytes) -> tuple[Callable[[str], list[int]], int]:
    """A function from text to ids for a byte-level tokenizer file, and the bytes an id takes."""
    import tiktoken

    library: list = []
    spec = json.loads(content)
    vocab, specials = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
    width = 2 if max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else 4

    def whole(text: str) -> list[int]:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_buffer(content))
        return library[0].encode(text, add_special_tokens=False).ids

    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    plain = spec["normalizer"] is None and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("type") == "ByteLevel"
    if not plain or any(vocab[m] != 256 + i for i, m in enumerate(merged)):
        return whole, width
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in specials}
    fast = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: whole(text) if any(s in text for s in specials) else fast(text), width


_ENCODERS: dict[str, tuple[Callable[[str], list[int]], int]] = {}


def _encoder(content: bytes) -> tuple[Callable[[str], list[int]], int]:
    """One encoder for each Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = encoder(content)
    return _ENCODERS[key]


def packed(ids: list[int], width: int) -> bytes:
    return np.array(ids, f"<u{width}").tobytes()


def train(samples: list[bytes]) -> bytes:
    """A dictionary for these serialized ids: trained, or their last bytes where there are too few to train on."""
    whole = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, whole).as_bytes()
    except zstandard.ZstdError:
        return b"".join(whole)[-DICTIONARY_BYTES:]


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class Shard:
    """Documents in the making of one shard."""

    def __init__(self, compressor: zstandard.ZstdCompressor, width: int, digest: bytes) -> None:
        self.compressor, self.head = compressor, HEAD.pack(MAGIC, width, digest)
        self.frames: list[bytes] = []
        self.ids, self.counts, self.size = array("q"), array("I"), 0
        self.none = bytearray()

    def add(self, doc_id: int | None, raw: bytes, count: int) -> None:
        self.frames.append(self.compressor.compress(raw))
        self.size += len(self.frames[-1])
        self.ids.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.counts.append(count)

    def close(self, part: int, number: int) -> bytes:
        offsets = np.cumsum([len(self.head), *map(len, self.frames)], dtype="<u8")
        index = np.array(self.ids, "<i8").tobytes() + bytes(self.none) + offsets.tobytes() + np.array(self.counts, "<u4").tobytes()
        tail = TAIL.pack(int(offsets[-1]), len(self.frames), sum(self.counts), part, number, MAGIC)
        return b"".join([self.head, *self.frames, index, tail])


class Reader:
    """One shard's content: its index at once, its documents one by one."""

    def __init__(self, content: bytes, dictionary: bytes) -> None:
        self.content = content
        at, self.n, self.total, self.part, self.number, tail = TAIL.unpack_from(content, len(content) - TAIL.size)
        head, self.width, digest = HEAD.unpack_from(content)
        if (head, tail) != (MAGIC, MAGIC) or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("no shard of token ids, or one of another dictionary")
        n = self.n
        self.ids = np.frombuffer(content, "<i8", n, at)
        self.none = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(content, "<u4", n, at + 17 * n + 8)
        self.first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.machine = zstandard.ZstdDecompressor(dict_data=_shared(dictionary))

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, end included."""
        count = int(self.counts[k])
        raw = self.machine.decompress(self.content[int(self.offsets[k]) : int(self.offsets[k + 1])], max_output_size=count * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of each whole text, `end` behind them, in ascending id order. The tokenizer file (a few MB) is broadcast."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text", "id"))
    seen = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    at = F.lit(1) + F.pmod("mark", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS))
    window = F.substring(F.col("text"), at.cast("int"), F.lit(SAMPLE_CHARS)).alias("window")
    # the documents least by hash, about SAMPLE_DOCS of them, twice as many at most
    least = F.shiftright("mark", 2) <= int((min(1.0, SAMPLE_DOCS / max(1, seen["rows"])) - 0.5) * (1 << 62))
    sampled = rows.where(least).select(window).limit(2 * SAMPLE_DOCS).collect()
    encode, width = encoder(content.value)
    trained = train([packed(encode(r.window), width) for r in sampled])
    dictionary, digest = spark.sparkContext.broadcast(trained), hashlib.sha256(trained).digest()
    _place(spark.createDataFrame([(bytearray(trained),)], "content binary"), f"{path}/dictionary")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(seen["bytes"] / RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _encoder(content.value)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary.value), write_content_size=False, write_dict_id=False)
        part, number, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shard or Shard(compressor, width, digest)
                ids = encode(text) if text else []
                ids.append(end)
                shard.add(doc_id, packed(ids, width), len(ids))
                if shard.size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([shard.close(part, number)], pa.binary())], names=["content"])
                    number, shard = number + 1, None
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array([shard.close(part, number)], pa.binary())], names=["content"])

    small_batches(spark, BATCH_BYTES)
    order = [F.col("id").asc_nulls_first(), "mark", "place"]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    _place(dealt.select("id", "text").mapInArrow(run, "content binary"), f"{path}/shards")


def _place(blobs: DataFrame, path: str) -> None:
    """Each binary row as a file of its own, by Spark's writer of lines: the bytes and a line feed."""
    blobs.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").mode("overwrite").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.col("content").substr(F.lit(1), F.length("content") - 1).alias("content"))


def _starts(shards: DataFrame) -> DataFrame:
    """(part, number, start): how many ids stand before each shard, by sums of blocks of shards and sums within."""

    def field(i: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("content"), F.length("content") - TAIL.size + 8 * i + 1, F.lit(8))), 16, 10).cast("long")

    totals = shards.select(field(3).alias("part"), field(4).alias("number"), field(2).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = [Window.orderBy("block"), Window.partitionBy("block").orderBy("part"), Window.partitionBy("part").orderBy("number")]
    blocks, within, inside = (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for w in before)
    by_block = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", blocks.alias("b"))
    by_part = parts.select("part", "block", within.alias("w")).join(by_block, "block").select("part", (F.col("b") + F.col("w")).alias("p"))
    return totals.select("part", "number", inside.alias("i")).join(by_part, "part").select("part", "number", (F.col("p") + F.col("i")).alias("start"))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: ids as unsigned 32-bit little-endian bytes, start the ids of all before it.

    doc_ids: only these are decompressed, each by its place in the index.
    """
    dictionary = spark.sparkContext.broadcast(bytes(_files(spark, f"{path}/dictionary").select("content").first()[0]))
    shards = _files(spark, f"{path}/shards")
    wanted = None if doc_ids is None else np.array(doc_ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                shard = Reader(content, dictionary.value)
                places = np.arange(shard.n) if wanted is None else np.flatnonzero(np.isin(shard.ids, wanted) & ~shard.none)
                for i in range(0, len(places), 256):
                    at = places[i : i + 256]
                    raw = [shard.document(k).astype("<u4").tobytes() for k in at]
                    columns = [pa.array(shard.ids[at], pa.int64(), mask=shard.none[at]), *(pa.array(np.full(len(at), x), pa.int64()) for x in (shard.part, shard.number)), pa.array(shard.first[at], pa.int64()), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "number", "within", "ids"])

    small_batches(spark, BATCH_BYTES)
    found = shards.select("content").mapInArrow(run, "doc_id long, part long, number long, within long, ids binary")
    rows = found.select("doc_id", "part", "number", "within", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")
    starts = _starts(shards)
    # 24 bytes a shard; beyond the bound both sides are shuffled
    starts = F.broadcast(starts) if shards.count() <= BROADCAST_SHARDS else starts
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids")
