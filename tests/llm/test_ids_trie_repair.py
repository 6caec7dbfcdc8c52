"""Token files against the tokenizers library, the prefix trie and conversation repair against brute force, odd rows of each."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from segmenta.llm import repair, token_files, trie  # noqa: E402
from segmenta.llm.common import running  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encode():
    with open(PATH, "rb") as file:
        return token_files.encoder(file.read())[0]


def test_running_totals_of_groups_in_many_parts(spark):
    rows = [(k, i, (i * 7) % 5) for k, n in ((None, 40), (1, 1), (2, 700), (3, 3)) for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = {(r["k"], r["i"]): (r["rank"], r["v"]) for r in running(df, ["k"], ["i"], ["v"]).collect()}
    assert got == {(k, i): (i + 1, sum((j * 7) % 5 for j in range(i + 1))) for k, i, _ in rows}


# --- token files ---------------------------------------------------------------------------------


def test_ids_equal_the_library_at_every_code_point(library, encode):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        texts = [f"a{c}a1{c}1!{c}! {c} \n{c}\n a  {c}x" for c in points[i : i + 50_000]]
        assert [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)] == [encode(t) for t in texts]


def test_ids_equal_the_library_on_random_texts(library, encode):
    r, bits = random.Random(5), ["a", "th", "ing", "é", "ß", "Σ", "12", "'s", "'LL", "\x1c", "\x85", "<|endoftext|>", "́", "日本", "😀", " ", "  ", "\n", "²", "_", "-", "<|", "　"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([3, 40, 800]))) for _ in range(200)] + ["ha" * 3000, "." * 900, " " * 700]
    assert [library.encode(t, add_special_tokens=False).ids for t in texts] == [encode(t) for t in texts]


ODD = [(1, None), (2, ""), (3, " \n "), (5, "Equal words."), (5, "Equal words."), (5, "Other words."), (None, "No id."), (None, None), (7, "long " * 30_000), (8, "x" * 60_000), (-4, "<|endoftext|> inside"), (9, "日本 é")]


def test_token_files_come_back_as_the_library_has_them(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(token_files, "BLOCK", 2)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, ids string, part int").repartition(3)
    token_files.write(docs, f"{tmp_path}/ids", PATH, end=0)
    got = sorted(token_files.read(spark, f"{tmp_path}/ids").collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"]) for r in got] == sorted([(i is not None, i) for i, _ in ODD], key=lambda x: (x[0], x[1] or 0))
    want = sorted((i is not None, i or 0, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in ODD)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    some = token_files.read(spark, f"{tmp_path}/ids", [5, 8, 77]).collect()
    assert sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in some) == sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in got if r["doc_id"] in (5, 8))


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", PATH)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_a_shard_keeps_to_its_dictionary_and_gives_one_document_alone():
    import zstandard

    samples = [token_files.packed([i % 700, 5, 6, 7] * 40, 2) for i in range(400)]
    dictionary = token_files.train(samples)
    machine = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    shard = token_files.Shard(machine, 2, hashlib.sha256(dictionary).digest())
    for i, raw in enumerate(samples):
        shard.add(i, raw, len(raw) // 2)
    content = shard.close(3, 1)
    reader = token_files.Reader(content, dictionary)
    assert reader.document(17).tobytes() == samples[17] and (reader.part, reader.number, reader.n) == (3, 1, 400)
    assert len(content) < sum(map(len, samples)) / 3
    with pytest.raises(ValueError):
        token_files.Reader(content, dictionary + b"x")
    assert token_files.train([]) == b"" and token_files.train([b"ab"]) == b"ab"


# --- prefix trie ---------------------------------------------------------------------------------


def plain_trie(rows):
    """Nodes by brute force; rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * (words(p[-1][1]) if p else 0) for p in below)
        children = sum(len(p) == len(path) + 1 for p in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    got = trie.trie(df).select(*COLUMNS).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_trie_equals_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(-45, 70), 400, 419, 1005]:
        rows += [(c, r.choice([None, i, i]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", None, " \n", "d e f"])) for i in range(r.choice([1, 1, 2, 4, 9]))]
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), *((7, 100 + i, "user", "w") for i in range(70))]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    # conversation 1 loses its only turn, and there is no conversation 0 to give it others
    assert zlib.crc32(b"1") % 4 > 0
    for rows in ([(1, 0, "user", "a")], [(40, 0, None, None)], [(None, 0, "user", "a")]):
        assert trie_of(spark, rows) == plain_trie(rows)
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ends_of_a_large_node_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACK", 50)
    ends = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("key"), (F.col("id") * 7 - 900).alias("conv_id"))
    got = {r["key"]: r["ends_sha256"] for r in trie.ends_hashed(ends).collect()}
    want = {k: hashlib.sha256(",".join(str(i * 7 - 900) for i in range(1000) if (i % 3 == 0) == (k == "x")).encode()).hexdigest() for k in "xy"}
    assert got == want


# --- repair --------------------------------------------------------------------------------------


def letter(role, fault):
    return next(c for c, x in repair.LETTERS.items() if x == (role, fault))


def every_edit(rows, most_inserts=4):
    """(cost, audit) of all edits of a few rows that give legal roles."""
    out = []

    def go(i, cost, audit, roles, left):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        if left:
            for x in "ua":
                go(i, cost + 5, audit + "I", roles + x, left - 1)
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", roles, left)
            if fault in ("ok", "truncated"):
                more = 5 * (fault == "truncated")
                go(i + 1, cost + more, audit + "K", roles + role, left)
                for x in "ua":
                    go(i + 1, cost + more + 1, audit + "R", roles + x, left)

    go(0, 0, "", "", most_inserts)
    return min(out)


def test_solve_equals_all_edits():
    kinds = list(repair.LETTERS.values())
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.solve("".join(letter(*x) for x in rows)) == every_edit(rows, 3), rows
    r = random.Random(4)
    for _ in range(60):
        rows = [r.choice(kinds[:9]) for _ in range(r.choice([3, 4]))]
        assert repair.solve("".join(letter(*x) for x in rows)) == every_edit(rows, 3), rows


def test_solve_is_the_same_whatever_the_windows(monkeypatch):
    r = random.Random(6)
    for n in (63, 64, 65, 3000):
        signature = "".join(r.choice(list(repair.LETTERS)) for _ in range(n))
        whole = repair.solve(signature)
        with monkeypatch.context() as m:
            m.setattr(repair, "STRIDE", 7)
            assert repair.solve(signature) == whole


def plain_repair(rows):
    """Everything by plain loops; rows: (conv_id, turn, role, text)."""
    convs = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * (kind and 1 + (kind == 3))
    out = set()
    for c, given in convs.items():
        given.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marks = set(), []
        for _, role, text in given:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok"
            seen.add((role, text))
            marks.append((role[:1] if role[:1] in ("s", "u", "a") and role else "?", fault))
        cost, audit = repair.solve("".join(letter(*m) for m in marks))
        kept, left = [], iter(given)
        for step in audit:
            if step != "I":
                _, role, text = next(left)
            before = [k[0][0] for k in kept]
            other = "assistant" if before and before[-1] == "u" else "user"
            if step != "D":
                kept.append((role, text) if step == "K" else (other, "" if step == "I" else text))
        assert re.fullmatch("(s?(ua)+)?", "".join(k[0][0] for k in kept)) and cost < 1 << 40
        turns = {t for t, *_ in given if t is not None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(given))
        n = [sum(f == x for _, f in marks) for x in ("blank", "duplicate", "truncated")]
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, pairs, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()))
    return out


def test_repair_equals_plain_loops(spark):
    r = random.Random(9)
    rows = [(c, r.choice([None, i, i, i + 3]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Whole. ", "cut", "", None, "Two!\n", "More?"])) for c in [*range(60), -3, None] for i in range(r.choice([1, 2, 5, 30]))]
    rows += [(500, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 9 else "cut " * 3000) for i in range(900)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "conv_id long, turn long, role string, text string, rank string, audit string").repartition(4)
    got = [tuple(x) for x in repair.repair(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repair(rows)


def test_repair_of_an_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_trie_and_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in trie.trie(df).select(*COLUMNS).collect()} == plain_trie(rows)
    assert {tuple(r) for r in repair.repair(df).collect()} == plain_repair(rows)
