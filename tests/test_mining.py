"""Terms counted by slices against plain sums over records, with repeated records, null ids and chapters counted in parts."""

import random
from collections import defaultdict

import pytest

from segmenta.operators import terms as T

COMMON = ["the", "of", "and"]
WORDS = "the The OF of and a A I wolf Wolf WOLF wOlf sea-gull Sea-Gull SEA-gull ΣΟΦΟΣ σοφος İx Ⅷ ǅ x² ten . , — \n “ 7".split(" ")


def plain(rows, longest):
    n, records, chapters, forms = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set)
    for doc, chapter, pos, source in rows:
        found = [(w, 1) for w in T.regex.findall(f"{T.LETTER}+", source or "")] + [(w, 1) for w in T.regex.findall(T.HYPHENATED, source or "")]
        found = [(w.lower(), T.bucket_of(w), w, k) for w, k in found] + [(low, b, s, k) for s, low, b, k in T.phrases_of(source or "", set(COMMON), longest)]
        for low, bucket, surface, k in found:
            i = low, bucket
            n[i] += k
            records[i].add((doc, pos))
            chapters[i].add((doc, chapter))
            forms[i].add(surface)
    return sorted((*i, n[i], len(records[i]), len(chapters[i]), min(forms[i])) for i in n)


@pytest.mark.parametrize(("seed", "longest", "slice_", "long_"), [(1, 4, 1 << 20, 1 << 22), (2, 4, 300, 600), (3, 3, 100, 150), (4, 2, 1, 1), (5, 5, 2000, 2500)])
def test_mined_against_plain_sums(spark, monkeypatch, seed, longest, slice_, long_):
    r = random.Random(seed)
    rows = []
    for doc in [None, None, *range(12), 3]:
        for pos in range(r.choice([0, 1, 45, 70])):
            rows.append((doc, pos // 20 + 1, pos, r.choice([None, ""]) if r.random() < 0.05 else " ".join(r.choices(WORDS, k=r.randrange(14)))))
    monkeypatch.setattr(T, "SLICE", slice_)
    monkeypatch.setattr(T, "LONG_CHAPTER", long_)
    got = T.mined(spark.createDataFrame(rows, "doc_id long, chapter_no long, record_pos long, source string"), COMMON, longest)
    assert sorted(tuple(x) for x in got.select("normalized", "bucket", "occurrences", "records", "chapters", "surface").collect()) == plain(rows, longest)


def test_ranks_of_many_words_are_no_longer_packed():
    a, b = T.np.array([0, 1 << 61, 5]), T.np.array([1, 0, 2])
    assert T._paired(a, b, 1 << 20).argsort().tolist() == [0, 2, 1]


def test_mining_shuffles_phrases_once(spark):
    rows = spark.createDataFrame([(1, 1, 0, "grey wolf")], "doc_id long, chapter_no long, record_pos long, source string")
    plan = T.mined(rows, COMMON)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(normalized") == 1 and "Join" not in plan


def test_phrases_travel_as_runs_of_words():
    one = T.np.zeros(1, T.np.int64)
    rows = list(T.tallied(["grey wolves ran home soon"], one, one, set(COMMON), 4, ("phrase",)))
    # a row for each first word, not for each phrase
    assert sum(len(r[0]) for r in rows) == 4


def test_sums_are_kept_apart_from_merging(spark):
    rows = spark.createDataFrame([(1, 1, 0, "grey wolf")], "doc_id long, chapter_no long, record_pos long, source string")
    assert "REPARTITION_BY_NUM" in T.mined(rows, COMMON)._jdf.queryExecution().executedPlan().toString()


def test_word_lists_are_walked_for_candidates_that_hold_a_listed_word(spark):
    rows = spark.createDataFrame([(w, "lower", "phrase", 2, 2, 2, w, w.split(" ")) for w in ("grey wolf", "the wolf", "wolf tion", "tion tion")], "normalized string, bucket string, kind string, occurrences long, records long, chapters long, surface string, tokens array<string>")
    made = T.scored(rows, COMMON, ["tion"], ["wh"])
    assert {r["normalized"]: r["genericity"] for r in made.collect()} == {"grey wolf": 0.0, "the wolf": 1.2, "wolf tion": 1.9, "tion tion": 2.5}
    assert "CASE WHEN listed" in made._jdf.queryExecution().executedPlan().toString()


def rows_of(seed):
    r = random.Random(seed)
    words = [*WORDS, "tion", "ing-the", "Onth", "xxi", "wh"]
    return [(doc, pos // 20 + 1, pos, " ".join(r.choices(words, k=r.randrange(14)))) for doc in [*range(9), 3] for pos in range(r.choice([1, 45, 70]))]


SCHEMA = "doc_id long, chapter_no long, record_pos long, source string"


@pytest.mark.parametrize(("seed", "longest", "batch", "long_"), [(6, 4, 1, 1 << 22), (7, 4, 3, 200), (8, 5, 7, 1), (9, 2, 2, 1 << 22), (10, 3, 10000, 150)])
def test_terms_whose_runs_come_in_several_batches_are_summed_once(spark, monkeypatch, seed, longest, batch, long_):
    rows = rows_of(seed)
    monkeypatch.setattr(T, "SLICE", min(300, long_))
    monkeypatch.setattr(T, "LONG_CHAPTER", long_)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = T.mined(spark.createDataFrame(rows, SCHEMA), COMMON, longest).select("normalized", "bucket", "occurrences", "records", "chapters", "surface").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == plain(rows, longest)


def test_sums_need_no_aggregate_over_texts(spark):
    plan = T.mined(spark.createDataFrame([(1, 1, 0, "grey wolf")], SCHEMA), COMMON)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_what_is_told_of_tokens_is_what_they_say(spark):
    rows, generic = spark.createDataFrame(rows_of(11), SCHEMA), ["tion", "ten", "sea", "the wolf", "and"]
    told, taken = T.mined(rows, COMMON, lists=(COMMON, generic)), T.mined(rows, COMMON)
    assert "tokens" not in told.columns
    a, b = ([tuple(x) for x in T.scored(x, COMMON, generic, ["wh", "fw", "nai"], "^Onth", "x+").collect()] for x in (told, taken))
    assert len(a) > 200 and sorted(a) == sorted(b)


def test_rounding_is_that_of_round(spark):
    r = random.Random(12)
    values = [0.0, 0.1234565, 1.0000005, 2.5000015, -0.0000005, -0.0000004, 24.499999499999, 123.4567895, *(r.uniform(-5, 40) for _ in range(2000)), *(r.randrange(10**8) / 1e7 for _ in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.select(T._round6(T.F.col("x")).alias("a"), T.F.round("x", 6).alias("b")).where("a <> b").collect() == []


def test_buckets_told_at_a_glance_are_those_of_each_letter():
    def slowly(word):
        letters = [c for c in word if c.isalpha()]
        capital = [T.unicodedata.category(c) == "Lu" for c in letters]
        return "upper" if letters and all(capital) else "title" if sum(capital) == 1 and capital[0] else "mixed" if any(capital) else "lower"

    words = [w for c in map(chr, [*range(0x3000), *range(0x1D400, 0x1D500)]) for w in (c, "a" + c, c + "a", "A" + c, c + "-b", "Ab" + c)]
    assert [w for w in words if T.bucket_of(w) != slowly(w)] == []
