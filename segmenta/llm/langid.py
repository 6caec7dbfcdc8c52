"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text, everything but letters counting
as one space. Fitting takes at most about `train_rows` labelled rows of each language (picked by a hash of
the row, so the model does not depend on partitions), weights buckets by inverse document frequency and
clusters each language's unit vectors into `centroids` spherical k-means centres. Predicting maps each
whole text to its unit vector and takes the language of the closest centre; `score` is the softmax of the
languages' best cosines. A text is rejected if it has no letter, or if it has `MIN_LETTERS` letters at least
and its best cosine falls below the model's threshold, a fraction of the lowest usual cosine in training.

Defined results: a text that is null, empty or without letters: `und`, score 0, rejected; no labelled rows:
`und`, score 0, for every row; ties: the alphabetically first language. Equal texts get equal results.
Columns of the input that are named like an output column are replaced, others pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.llm.common import map_batches, texts_of

UNKNOWN = "und"
BITS = 12
#: Buckets: 2**BITS for each n-gram length.
SIZE = 3 << BITS
MIN_LETTERS = 40
SHARPNESS = 25.0
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """Bucket counts of the whole text, and its number of letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[code]
    n = int(np.count_nonzero(letter))
    if not n:
        return np.zeros(SIZE, np.float32), 0
    code = np.where(letter, code, np.uint32(32))
    gap = ~letter
    code = code[~(gap & np.concatenate(([True], gap[:-1])))]
    code = np.concatenate(([np.uint32(32)], code, [np.uint32(32)])).astype(np.uint32)
    out, mixed = np.zeros(SIZE, np.float32), np.zeros(len(code), np.uint32)
    for k in range(min(3, len(code))):
        mixed = mixed[: len(code) - k] * np.uint32(0x01000193) + code[k:] * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        at = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        out[k << BITS : (k + 1) << BITS] = np.bincount(at, minlength=1 << BITS)
    return out, n


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    threshold: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Best cosine of each language, row by row."""
        cos = self.vectors(counts) @ self.centres.T
        return np.stack([cos[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres; starts from the mean's nearest row and then farthest rows, so it is repeatable."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        owner = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[owner == j].sum(0) if (owner == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit_counts(languages: list[str], counts: np.ndarray, centroids: int = 4, slack: float = 0.5) -> Model:
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, 0))) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64), 0.0)
    x = model.vectors(counts)
    parts = [spherical_kmeans(x[label == k], centroids) for k in range(len(names))]
    model.centres = np.concatenate(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    if len(x):
        own = model.best(counts)[np.arange(len(x)), label]
        model.threshold = float(np.quantile(own, 0.01)) * slack
    return model


def fit(df: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", train_rows: int = 400, centroids: int = 4) -> Model | None:
    """Model from the rows where `train` holds; None if there are none. The number of languages must be small."""
    rows = df.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_rows / n))])
    rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {"lang": [], "at": [], "n": []}
            for text, lang in zip(texts_of(batch), batch.column(batch.schema.get_field_index("lang")).to_pylist(), strict=True):
                counts, letters = ngram_counts(text)
                if letters:
                    at = np.flatnonzero(counts)
                    out["lang"].append(lang)
                    out["at"].append(at.astype("<u2").tobytes())
                    out["n"].append(counts[at].astype("<f4").tobytes())
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

        return step

    got = sorted(map(tuple, map_batches(rows, make, "lang string, at binary, n binary").collect()))
    if not got:
        return None
    counts = np.zeros((len(got), SIZE), np.float32)
    for row, (_, at, n) in zip(counts, got, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
    return fit_counts([g[0] for g in got], counts, centroids)


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score, distance (1 - best cosine) and rejected."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def label(texts: list[str]) -> tuple[np.ndarray, ...]:
            pairs = [ngram_counts(t) for t in texts]
            letters = np.array([n for _, n in pairs])
            best = model.best(np.stack([c for c, _ in pairs]))
            top = best.argmax(1)
            odds = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
            return letters, top, 1 / odds.sum(1), best.max(1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, text_col)
            out: list[list] = [[], [], [], []]
            for i in range(0, len(texts), 64):
                part = texts[i : i + 64]
                if model is None:
                    rows = [(UNKNOWN, 0.0, 1.0, True)] * len(part)
                else:
                    rows = [(model.languages[k], float(s), float(1 - c), bool(n >= MIN_LETTERS and c < model.threshold)) if n else (UNKNOWN, 0.0, 1.0, True) for n, k, s, c in zip(*label(part), strict=True)]
                for column, values in zip(out, zip(*rows, strict=True), strict=True):
                    column.extend(values)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f.name for f in fields])

        return step

    return map_batches(df, make, T.StructType(kept + fields))
