"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a line) has a wide vector: EXACT lanes hashed from the paragraph as a whole, and lanes that
count, over its pieces (runs of up to three words within a clause), the ones at each bit of the pieces' hashes,
with the number of pieces itself. A text's fingerprint is the lane-wise sum over its paragraphs, modulo
2**LANE_BITS. Sums commute, so the order of paragraphs does not matter, and a paragraph's vector can
be added or taken away later (`combine`). Equal multisets have equal fingerprints; different ones differ
unless EXACT * 32 bits collide. Under one key a call takes up to 2**31 paragraphs and pieces (a text cannot
have more); beyond, the sum stops with an overflow error, and parts' fingerprints are to be combined instead.

The counted lanes, read as signs, are a tug-of-war sketch: products of two sketches estimate the inner
product of the texts' piece counts. `likeness` is 2ab / (aa + bb), the share of pieces in common, 1 for
equal fingerprints, 0 at least; with 128 lanes its standard error is about 0.09 for unlike texts.

Defined results: null and empty texts have the zero fingerprint and are like each other (1) and nothing
else; in `edited`, rows with the same id and text are one document, and null ids come last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import durable

EXACT = 8
LANE_BITS = 32
HASHES = 2
_LANES = (1 << LANE_BITS) - 1
#: One bit in each of the two lanes that a long carries.
_ONES = 1 | 1 << LANE_BITS
#: Counted lanes of a fingerprint.
COUNTED = 2 * LANE_BITS * HASHES
PIECE = r"[^\s.!?,;:|]+(?:[ \t]+[^\s.!?,;:|]+){0,2}"


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", out: str = "fp") -> DataFrame:
    """(keys, out): the summed vectors of all texts with equal keys, as an array of longs.

    EXACT lanes, the number of pieces, then 64 lanes for each hash. Paragraphs and pieces are exploded and
    summed inside generated code; partial sums come first, so many texts under one key are no burden.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sets = F.array(F.struct(F.lit(True).alias("whole"), F.split(text, "\n").alias("parts")), F.struct(F.lit(False).alias("whole"), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("parts")))
    parts = df.select(*keys, F.inline(sets)).select(*keys, "whole", F.explode("parts").alias("part"))
    clause = ~F.col("whole")
    words = [F.when(F.col("whole"), F.xxhash64("part", F.lit(k))).otherwise(F.lit(0)) for k in range(EXACT // 2)]
    marks = [F.when(clause, F.xxhash64("part", F.lit(1000 + k))).otherwise(F.lit(0)) for k in range(HASHES)]
    parts = parts.select(*keys, clause.cast("long").alias("c"), *[w.alias(f"w{k}") for k, w in enumerate(words)], *[h.alias(f"h{k}") for k, h in enumerate(marks)])
    sums = [F.sum(half).alias(f"e{2 * k + j}") for k in range(EXACT // 2) for j, half in enumerate((F.col(f"w{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"w{k}", 32)))]
    sums += [F.sum(F.shiftrightunsigned(f"h{i}", k).bitwiseAND(F.lit(_ONES))).alias(f"s{i}_{k}") for i in range(HASHES) for k in range(LANE_BITS)]
    lanes = [F.col(f"e{k}").bitwiseAND(F.lit(_LANES)) for k in range(EXACT)] + [F.col("n").bitwiseAND(F.lit(_LANES))]
    lanes += [F.shiftrightunsigned(f"s{i}_{k}", LANE_BITS * j).bitwiseAND(F.lit(_LANES)) for i in range(HASHES) for j in range(2) for k in range(LANE_BITS)]
    return parts.groupBy(*keys).agg(*sums, F.sum("c").alias("n")).select(*keys, F.array(*lanes).alias(out))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of both texts' paragraphs together (sign 1), or of the first's without the second's (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * F.lit(sign), F.lit(1 << LANE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints."""
    def signs(fp: Column) -> Column:
        return F.transform(F.slice(fp, EXACT + 2, COUNTED), lambda x: x * 2 - fp[EXACT])

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, v: s + v)

    def share(both: Column, shared: Column) -> Column:
        return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * shared / both))).otherwise(F.lit(0.0))

    def compare(z: Column) -> Column:
        return share(dot(z["x"], z["x"]) + dot(z["y"], z["y"]), dot(z["x"], z["y"]))

    signed = F.array(F.struct(signs(a).alias("x"), signs(b).alias("y")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.transform(signed, compare)[0])


def as_hex(fp: Column) -> Column:
    """Text form: 8 hexadecimal digits for each lane."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), F.lit(8), F.lit("0"))), ""))


def followers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each distinct (id, text hash): the document before it in descending order, and half its length.

    Columns at, at_hash (the document), for_id, for_hash (whose next document it is), take (code points).
    Ids are dealt by range and neighbours found inside each range; only the ranges' first rows, one for each
    partition, are looked at together.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(row_key(id_col).alias("at"), F.xxhash64(text).alias("at_hash"), F.length(text).cast("long").alias("n")).distinct()
    dealt = durable(keys.repartitionByRange(n, "at", "at_hash").withColumn("part", F.spark_partition_id()))
    after = F.lead(F.struct("at", "at_hash", "n")).over(Window.partitionBy("part").orderBy("at", "at_hash"))
    first = dealt.groupBy("part").agg(F.min(F.struct("at", "at_hash", "n")).alias("first"))
    # one row for each partition, so this window is small
    order = Window.orderBy("part")
    first = first.select((F.lag("part").over(order)).alias("before"), "first", F.max("part").over(Window.partitionBy()).alias("top"))
    next_first = F.broadcast(first.select(F.coalesce("before", "top").alias("border"), F.col("first").alias("wrap")))
    pairs = dealt.withColumn("after", after).join(next_first, F.col("part") == F.col("border"), "left")
    target = F.coalesce("after", "wrap")
    return pairs.select("at", "at_hash", target["at"].alias("for_id"), target["at_hash"].alias("for_hash"), F.floor(target["n"] / 2).alias("take"))


def row_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with n_chars, its edited text's sha256, and the fingerprints of text, edited text and next document.

    Edited: the last floor(n/2) code points give way to the first as many of the next document, in
    descending id order (after the last document comes the first). Texts are shuffled once by id; only heads
    and fingerprints travel to the documents that they follow.
    """
    docs = df.select(F.col(id_col).alias("id"), row_key(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    given = followers(df, id_col, text_col)
    # summed on the scan's side: texts are not shuffled for it
    own = fingerprints(docs, ["key", "hash", "row"]).dropDuplicates(["key", "hash"]).drop("row")
    led = docs.join(given, (F.col("key") == F.col("at")) & (F.col("hash") == F.col("at_hash")))
    # both joins read the same columns of docs, so its texts are shuffled once
    led = led.select("id", "row", "for_id", "for_hash", F.expr("substring(text, 1, int(take))").alias("head"))
    heads = led.groupBy("for_id", "for_hash").agg(F.min_by(F.struct("id", "head"), "row").alias("next")).select("for_id", "for_hash", F.col("next.id").alias("next_id"), F.col("next.head").alias("head"))
    both = docs.join(heads, (F.col("key") == F.col("for_id")) & (F.col("hash") == F.col("for_hash")))
    half = F.expr("concat(substring(text, 1, length(text) - int(floor(length(text) / 2))), head)")
    both = both.select("id", "key", "hash", "row", "next_id", F.length("text").cast("long").alias("n_chars"), half.alias("edited"))
    both = both.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    changed = fingerprints(both, ["id", "key", "hash", "row", "next_id", "n_chars", "edited_sha256"], "edited", "edited_fp")
    after = own.join(given, (F.col("key") == F.col("at")) & (F.col("hash") == F.col("at_hash"))).select(F.col("for_id").alias("key"), F.col("for_hash").alias("hash"), F.col("fp").alias("next_fp"))
    out = changed.join(own.select("key", "hash", "fp"), ["key", "hash"]).join(after, ["key", "hash"])
    return out.select(F.col("id").alias(id_col), "next_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
