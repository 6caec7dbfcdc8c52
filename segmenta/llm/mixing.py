"""Mixing to target weights by soft membership.

A softmax classifier over hashed byte trigrams, fitted on at most about `train_rows` labelled rows of each
domain, predicts every text's posterior over domains. Rates r >= 0 of documents are then fitted so that the
expected tokens of each domain, sum of r * tokens * posterior, meet the targets: projected gradient on least
squares, weighted by the inverse of the domains' second moments over the rows whose rate is above zero, so
that one step settles what no bound hinders, and halved while a step makes the fit worse. Rates start at one. An iteration is one job that sums a few numbers over a small table
(tokens and posteriors of each row); nothing of it reaches the driver but those sums.

A row's number of copies is its rate, rounded up or down by a hash of the row, so that expectations hold.
Defined results: null and empty texts have no tokens, the classifier's prior as posterior, and a rate as any
other; without labelled rows all posteriors are uniform; targets no rates can meet are met as nearly as
least squares has it; equal rows get equal rates; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.llm.common import durable, map_batches, texts_of

BITS = 12
SIZE = 1 << BITS


def trigram_counts(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text} ".encode("utf-8", "replace").lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(SIZE, np.float32)
    mixed = b[:-2] * np.uint32(0x01000193) ^ b[1:-1] * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    return np.bincount((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS), minlength=SIZE).astype(np.float32)


def vectors(texts: list[str]) -> np.ndarray:
    x = np.log1p(np.stack([trigram_counts(t) for t in texts]))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Domains:
    """Posteriors over named domains."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.names, self.weights, self.bias = names, weights, bias

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def learn(names: list[str], x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 400, ridge: float = 1e-5) -> Domains:
    """Softmax regression by Adam on balanced rows; the bias then takes up the domains' prior shares."""
    w, b = np.zeros((x.shape[1], len(names)), np.float32), np.zeros(len(names), np.float32)
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / len(names))[y].astype(np.float32)
    gold = np.eye(len(names), dtype=np.float32)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    model = Domains(names, w, b)
    for t in range(1, steps + 1):
        off = (model.posterior(x) - gold) * weight[:, None] / len(x)
        g = x.T @ off + ridge * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weights = model.weights - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model.bias = model.bias - 1.0 * off.sum(0)
    model.bias = model.bias + np.log(np.maximum(prior, 1e-6) * len(names))
    return model


def fit(df: DataFrame, labels: DataFrame, domain: Column, names: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = 800) -> Domains | None:
    """domain: a column over `labels` that names each labelled row's domain (null: not used)."""
    marks = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where(F.col("domain").isin(*names))
    sizes = {r["domain"]: r["n"] for r in marks.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, train_rows / n))])
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("domain")] * (1 << 20))
    # about train_rows a domain, so this side is small whatever the tables' sizes
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").select("text", "domain")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, n = [], []
            for text in texts_of(batch):
                counts = trigram_counts(text)
                some = np.flatnonzero(counts)
                at.append(some.astype("<u2").tobytes())
                n.append(counts[some].astype("<f4").tobytes())
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["domain", "at", "n"])

        return step

    got = sorted(map(tuple, map_batches(rows, make, "domain string, at binary, n binary").collect()))
    if not got:
        return None
    x = np.zeros((len(got), SIZE), np.float32)
    for row, (_, at, n) in zip(x, got, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
    x = np.log1p(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    total = sum(sizes.values())
    return learn(names, x, np.array([names.index(g[0]) for g in got]), np.array([sizes.get(d, 0) / total for d in names]))


def row_mark(id_col: str, text_col: str) -> Column:
    """A hash of the row; equal for equal rows only."""
    return F.xxhash64(id_col, text_col)


def memberships(df: DataFrame, model: Domains | None, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_tokens, posterior): mark hashes the row; tokens are white-space words."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            posterior = np.full((len(texts), len(names)), 1 / len(names))
            for i in range(0, len(texts) if model else 0, 128):
                posterior[i : i + 128] = model.posterior(vectors(texts[i : i + 128]))
            tokens = pa.array([len(t.split()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens, pa.array(posterior.tolist(), pa.list_(pa.float64()))], names=["id", "mark", "n_tokens", "posterior"])

        return step

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_mark(id_col, text_col).alias("mark"))
    return map_batches(rows, make, "id long, mark long, n_tokens long, posterior array<double>")


def rate_of(posterior: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient moves, projected onto r >= 0 each time."""
    r = np.ones(len(posterior))
    for u in moves:
        r = np.maximum(0.0, r - posterior @ u)
    return r


def _totals(table: DataFrame, moves: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after these moves, and the second moments of the rows with a rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                p = np.array(batch.column(1).to_pylist())
                rate, tokens = rate_of(p, moves), batch.column(0).to_numpy()
                total[:k] += (rate * tokens) @ p
                total[k:] += ((p * (tokens * (rate > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(total))), pa.int32()), pa.array(total)], names=["k", "v"])

    got = table.select("n_tokens", "posterior").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k + k * k)
    for r in got:
        out[r["k"]] = r["v"]
    return out[:k], out[k:].reshape(k, k)


def solve(table: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-4) -> list[np.ndarray]:
    """Gradient moves that bring expected domain tokens to `targets` (shares of all tokens)."""
    k = len(targets)
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return []
    wanted = np.array(targets) / sum(targets)

    def off_at(moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        reached, moment = _totals(table, moves, k)
        return reached / total - wanted, moment / total

    moves: list[np.ndarray] = []
    off, moment = off_at(moves)
    step = 1.0
    for _ in range(rounds):
        if np.abs(off).max() <= tolerance or step < 1e-3:
            break
        # a ridge in proportion keeps nearly parallel domains from throwing the step far
        move = step * np.linalg.solve(moment + (1e-6 + 1e-3 * np.trace(moment) / k) * np.eye(k), off)
        new_off, new_moment = off_at([*moves, move])
        if np.square(new_off).sum() < np.square(off).sum():
            moves.append(move)
            off, moment, step = new_off, new_moment, min(1.0, 2 * step)
        else:
            step /= 2
    return moves


def mix(df: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_tokens, posterior, rate, copies) for each row; see the module for what they mean."""
    names = list(targets)
    table = durable(memberships(df, fit(df, labels, domain, names, id_col, text_col), names, id_col, text_col))
    moves = solve(table, [targets[n] for n in names])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.array(batch.column(3).to_pylist()).reshape(batch.num_rows, len(names))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate_of(p, moves))], names=["id", "mark", "n_tokens", "posterior", "rate"])

        return step

    rated = map_batches(table, make, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())]))
    chance = F.pmod(F.xxhash64("mark", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", copies).withColumnRenamed("id", id_col)
