"""Language ID and toxicity against plain versions: whole numbers and loops instead of arrays and an automaton."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from segmenta.llm import langid, toxicity
from segmenta.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


def plain_ngrams(text):
    """(bucket counts, letters) with Python's integers."""
    letters = sum(c.isalpha() for c in text.lower())
    if not letters:
        return Counter(), 0
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    row = " " + " ".join(w for w in words if w) + " "
    # white space at either end of the text stays one blank beside the edge's own
    if not text.lower()[-1].isalpha():
        row += " "
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(row) - n + 1):
            mixed = 0
            for c in row[i : i + n]:
                mixed = (mixed * 0x01000193 + ord(c) * 0x9E3779B1) & MASK
                mixed ^= mixed >> 15
            counts[(n - 1 << langid.BITS) + (mixed * 0x85EBCA6B & MASK) % (1 << 32) // (1 << 32 - langid.BITS)] += 1
    return counts, letters


def plain_label(model, text):
    counts, letters = plain_ngrams(text)
    if not letters:
        return "und", 0.0, 1.0, True
    vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in vector.values()))
    best = {}
    for centre, owner in zip(model.centres, model.owner, strict=True):
        cosine = sum(v * float(centre[k]) for k, v in vector.items()) / length
        best[owner] = max(best.get(owner, -2.0), cosine)
    top = max(best, key=lambda k: (best[k], -k))
    odds = sum(math.exp(langid.SHARPNESS * (b - best[top])) for b in best.values())
    return model.languages[top], 1 / odds, 1 - best[top], letters >= langid.MIN_LETTERS and best[top] < model.threshold


def test_ngram_counts_equal_plain_ones():
    r = random.Random(4)
    texts = ["a", "A b", " x", "é! ", "12", "", "İß", "日本 語", "𝒳y z"] + ["".join(r.choice("aB é1.\n日𝒳") for _ in range(r.randrange(30))) for _ in range(400)]
    for text in texts:
        counts, letters = langid.ngram_counts(text)
        want, n = plain_ngrams(text)
        assert letters == n and {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(want), text


def test_langid_equals_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, crc_mod("doc_id", 5) != 0)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !"), (-4, "日本語 の " * 30), (-5, "ab")], "doc_id long, text string")
    for r in langid.predict(docs.select("doc_id", "text").union(odd), model).collect():
        label, score, distance, rejected = plain_label(model, r["text"] or "")
        assert r["lang_pred"] == label and r["rejected"] == rejected
        assert r["score"] == pytest.approx(score, abs=2e-4) and r["distance"] == pytest.approx(distance, abs=1e-5)


def plain_total(weights, exceptions, folded):
    """Weight and number of hits by looking for every piece at every place."""
    places = lambda p: [i for i in range(len(folded) - len(p) + 1) if folded.startswith(p, i)]
    spared = [(i, i + len(p)) for p in exceptions for i in places(p)]
    hits = [(i + len(p), -len(p), i, w) for p, w in weights.items() if p not in exceptions for i in places(p)]
    weight = count = 0
    until, last = -1, 0.0
    for end, _, start, w in sorted(hits):
        if any(a <= start and end <= b for a, b in spared):
            continue
        if start >= until:
            weight, count, last, until = weight + w, count + 1, w, end
        else:
            weight, last, until = weight + max(0.0, w - last), max(w, last), max(until, end)
    return weight, count


def test_automaton_equals_a_plain_scan():
    r = random.Random(2)
    for _ in range(400):
        words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(6)]
        weights = {p: r.choice([1.5, 2.0, 4.25]) for w in words for p in (f" {w}", f" {w} ") if r.random() < 0.5}
        exceptions = [f" {r.choice(words)} {r.choice(words)} " for _ in range(r.randrange(3))]
        text = toxicity.fold(" ".join(r.choice(words) for _ in range(r.randrange(14))))
        got, want = toxicity.total(toxicity.automaton(weights, exceptions), text), plain_total(weights, exceptions, text)
        assert got[0] == pytest.approx(want[0]) and got[1] == want[1], (weights, exceptions, text)


def test_toxicity_scores_equal_a_plain_scan(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    assert model.weights
    rows = toxicity.score(docs.where("doc_id < 300").select("doc_id", "text"), model).collect()
    for r in rows:
        folded = toxicity.fold(r["text"] or "")
        weight, count = plain_total(model.weights, model.exceptions, folded)
        z = sum(a * b for a, b in zip((math.log1p(weight), math.log1p(1000.0 * weight / (len(folded) + 50.0)), 1.0), model.curve, strict=True))
        assert r["n_hits"] == count and r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)
    assert len(rows) == docs.where("doc_id < 300").count()
