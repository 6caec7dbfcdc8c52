"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, normalised by length.

Folding lower-cases, turns look-alike letters of other scripts and digits or signs that stand for letters
into the Latin letters they imitate, and leaves words with one space before and after each. The lexicon is
learned from labelled texts: stems (the first 4 to 10 letters of words) and whole words that make up a far
larger share of toxic texts than of clean ones, picked greedily by the log-likelihood they explain; what a
pick explains is taken away before the next, and picking ends when no piece is in enough unlike texts. A
piece's weight is its smoothed log odds. Word pairs around a hit that clean texts show again and again, and
toxic ones do not, become exception phrases: hits inside them do not count. A logistic curve over the total
weight and the weight per thousand characters turns this into a score, so that a stem which clean texts use
now and then tells by its density.

Fitting takes at most about `train_rows` labelled rows of each label (twice as many clean ones), picked by a
hash of the row. Defined results: a null or empty text scores as one without hits; no labelled rows: score 0
for all; null labels are not learned from; equal texts get equal scores. Input columns named `score` or
`n_hits` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.llm.common import map_batches, texts_of

# Letters of other scripts, digits and signs, each before the Latin letter it imitates.
LOOK_ALIKES = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl ԛq ԝw вb кk мm нh тt αa βb εe ιi κk νv οo ρp τt υu χx ɑa ɡg ı i 0o 1i 3e 4a 5s 7t @a $s"
_FOLD = {ord(p[0]): p[1] for p in LOOK_ALIKES.replace("ı i", "ıi").split()}
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of a stem.
STEM = range(4, 11)
#: A piece is picked only if so many toxic texts that are no copies of each other have it.
MIN_TEXTS = 5
#: Least log odds of a piece.
MIN_ODDS = 1.5


def fold(text: str) -> str:
    """The words of the text in Latin small letters, each between single spaces."""
    return f" {' '.join(_WORD.findall(text.lower().translate(_FOLD)))} "


def pieces_of(word: str) -> list[str]:
    return [f" {word[:n]}" for n in STEM if n <= len(word)] + ([f" {word} "] if len(word) > 1 else [])


def automaton(weights: dict[str, float], exceptions: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for piece, w in weights.items():
        out.add_word(piece, (len(piece), w))
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), None))
    if len(out):
        out.make_automaton()
    return out


def total(machine: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Weight and number of the hits; of overlapping ones the heaviest, none inside an exception phrase."""
    if not len(machine):
        return 0.0, 0
    hits, spared = [], []
    for end, (n, w) in machine.iter(folded):
        (spared if w is None else hits).append((end - n + 1, end + 1, w))
    weight, count, until, last = 0.0, 0, -1, 0.0
    for start, end, w in hits:
        if any(a <= start and end <= b for a, b, _ in spared):
            continue
        if start < until:
            if w > last:
                weight, last = weight + w - last, w
            until = max(until, end)
        else:
            weight, count, until, last = weight + w, count + 1, end, w
    return weight, count


def features(weight: float, length: int) -> list[float]:
    return [np.log1p(weight), np.log1p(1000.0 * weight / (length + 50.0)), 1.0]


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, -30.0)

    def score(self, weight: float, length: int) -> float:
        z = float(np.dot(features(weight, length), self.curve))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def families(texts: list[str]) -> list[int]:
    """A number for each text; texts that share a third of their sentences with an earlier one get its number."""
    owner: dict[str, int] = {}
    out = []
    for k, text in enumerate(texts):
        parts = {p for p in re.split(r"[.!?\n]+", text) if len(p) > 20} or {text}
        known = Counter(owner[p] for p in parts if p in owner).most_common(1)
        group = known[0][0] if known and known[0][1] * 3 >= len(parts) else k
        for p in parts:
            owner.setdefault(p, group)
        out.append(group)
    return out


def learn(texts: list[str], labels: list[int]) -> Model:
    folded = [fold(t) for t in texts]
    toxic = [t for t, y in zip(folded, labels, strict=True) if y]
    clean = [t for t, y in zip(folded, labels, strict=True) if not y]
    # a text counts by its share of words, so that a long one is no more than a short one
    share_t, share_c = shares(toxic), shares(clean)
    owner = families([t for t, y in zip(texts, labels, strict=True) if y])
    known: dict[str, set[int]] = {}
    for group, t in zip(owner, toxic, strict=True):
        for w in set(t.split()):
            if odds(share_t[w], len(toxic), share_c[w], len(clean)) > MIN_ODDS:
                for p in pieces_of(w):
                    known.setdefault(p, set()).add(group)
    known = {p: g for p, g in known.items() if len(g) >= MIN_TEXTS}
    words: dict[str, set[str]] = {p: set() for p in known}
    for w in share_t.keys() | share_c.keys():
        for p in pieces_of(w):
            if p in words:
                words[p].add(w)
    weights = pick(words, share_t, share_c, len(toxic), len(clean))
    model = Model(weights, exceptions(weights, toxic, clean))
    machine = automaton(model.weights, model.exceptions)
    x = np.array([features(total(machine, t)[0], len(t)) for t in folded])
    model.curve = tuple(logistic(x, np.array(labels, float)))
    return model


def shares(texts: list[str]) -> Counter:
    """Sum over texts of each word's share of the text."""
    out: Counter = Counter()
    for t in texts:
        words = Counter(t.split())
        n = sum(words.values())
        for w, k in words.items():
            out[w] += k / n
    return out


def odds(t: float, texts_t: int, c: float, texts_c: int) -> float:
    """Smoothed log ratio of the mean shares; half a thousandth of a text's words is added to each."""
    return float(np.log((t + 5e-4) / (texts_t + 1)) - np.log((c + 5e-4) / (texts_c + 1)))


def pick(words: dict[str, set[str]], share_t: Counter, share_c: Counter, texts_t: int, texts_c: int) -> dict[str, float]:
    """Pieces by the log-likelihood they explain, greedily; words that a piece has are gone for the next."""
    chosen: dict[str, float] = {}
    of: dict[str, set[str]] = {}
    for p, ws in words.items():
        for w in ws:
            of.setdefault(w, set()).add(p)
    t = {p: sum(share_t[w] for w in ws) for p, ws in words.items()}
    c = {p: sum(share_c[w] for w in ws) for p, ws in words.items()}
    gain = {p: t[p] * odds(t[p], texts_t, c[p], texts_c) for p in words}
    while gain:
        piece = max(gain, key=lambda p: (gain[p], len(p), p))
        weight = odds(t[piece], texts_t, c[piece], texts_c)
        if gain.pop(piece) <= 0:
            break
        if weight < MIN_ODDS:
            continue
        chosen[piece] = weight
        touched = set()
        for w in list(words[piece]):
            for p in of.pop(w, ()):
                t[p] -= share_t[w]
                c[p] -= share_c[w]
                words[p].discard(w)
                touched.add(p)
        for p in touched & gain.keys():
            t[p], c[p] = max(t[p], 0.0) if words[p] else 0.0, max(c[p], 0.0)
            gain[p] = t[p] * odds(t[p], texts_t, c[p], texts_c)
    return chosen


def exceptions(weights: dict[str, float], toxic: list[str], clean: list[str]) -> list[str]:
    """Pairs of neighbouring words with a hit that three clean texts have and no toxic one."""
    machine = automaton(weights, [])

    def phrases(text: str) -> set[str]:
        out = set()
        for end, (n, _) in machine.iter(text) if len(machine) else ():
            a, b = end - n + 1, text.find(" ", end if text[end] == " " else end + 1)
            before, after = text.rfind(" ", 0, a), text.find(" ", b + 1)
            out |= {text[before : b + 1]} if before >= 0 else set()
            out |= {text[a : after + 1]} if after >= 0 else set()
        return out

    good, bad = Counter(), Counter()
    for texts, n in ((clean, good), (toxic, bad)):
        for t in texts:
            n.update(phrases(t))
    return sorted(p for p, n in good.items() if n >= 3 and not bad[p])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 2000) -> Model | None:
    """Learn from labelled rows of `df` where `train` (over id_col) holds."""
    marks = labels.where(train & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, train_rows * (2 - y) / n))])
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    # about 3 * train_rows marks, so this side is small whatever the tables' sizes
    got = sorted(map(tuple, df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").select("text", "y").where("text is not null").collect()))
    return learn([g[0] for g in got], [g[1] for g in got]) if got else None


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and n_hits."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())]
    kept = [f for f in df.schema.fields if f.name not in {"score", "n_hits"}]
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        machine = automaton(model.weights, model.exceptions) if model else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, hits = [], []
            for text in texts_of(batch, text_col):
                folded = fold(text)
                weight, n = total(machine, folded) if model else (0.0, 0)
                scores.append(model.score(weight, len(folded)) if model else 0.0)
                hits.append(n)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=[f.name for f in kept + fields])

        return step

    return map_batches(df, make, T.StructType(kept + fields))
