"""Repair of conversations: the cheapest edits that give each the roles of `(s?(ua)+)?`, solved once for each distinct signature.

A row's letter tells its role's initial and its first fault; a conversation's signature is its letters in order. Few
signatures stand for many conversations, so each is solved once: memoised recursion over (row, state of the role
automaton), from the end in windows, so recursion and memory stay small however long the signature. Of equally cheap edits
the ASCII-least audit is taken letter by letter: two choices at one place never share their letter.

Positions come from ranges of sorted rows (`running`), signatures from pieces by range, so a long conversation is put
together from short strings (one byte a row). Texts are shuffled once more, behind their conversation's audit, and hashed
as they stream by. A signature that many conversations share is joined apart (`spread_join`).

Defined results: nulls of role and text are one space, null turns come first and count as one space in the damage's hash;
rows of equal turn stand in the order of role and text, equal rows as they come; a null conv_id is a conversation like
any other; an empty role has no initial and is never legal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import running, small_batches, spread_join, stored

#: Costs of keeping, giving another role, deleting, inserting, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAULTS = ("ok", "blank", "duplicate", "truncated")
ROLES = "sua?"
#: Letters of a signature: for each role's initial (or another one) the four faults.
LETTERS = {chr(ord("A") + 4 * r + f): (role, fault) for r, role in enumerate(ROLES) for f, fault in enumerate(FAULTS)}
#: The automaton of `(s?(ua)+)?`: from each state where a role leads. 0: nothing yet, 1: after s, 2: after u, 3: after ua.
GO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Rows of a window.
STRIDE = 64


#: What each state costs once the rows are at their end, and the edits that end it.
ENDS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}


class Window:
    """Rows of a signature, solved by memoised recursion towards known costs at their end."""

    def __init__(self, letters: str, ends: list[int]) -> None:
        self.rows, self.ends = [LETTERS[c] for c in letters], ends
        #: (row, state) to (cost, letter, next row, next state)
        self.memo: dict[tuple[int, int], tuple[int, str, int, int]] = {}

    def best(self, i: int, q: int, inserted: int = 0) -> tuple[int, str, int, int]:
        if i == len(self.rows):
            return self.ends[q], "", i, q
        if not inserted and (i, q) in self.memo:
            return self.memo[i, q]
        (role, fault), other = self.rows[i], next(to for r, to in GO[q].items() if r != "s")
        choices = [(DELETE + self.best(i + 1, q)[0], "D", i + 1, q)]
        if fault in ("ok", "truncated"):
            cut = CUT * (fault == "truncated")
            choices.append((REROLE + cut + self.best(i + 1, other)[0], "R", i + 1, other))
            if role in GO[q]:
                choices.append((KEEP + cut + self.best(i + 1, GO[q][role])[0], "K", i + 1, GO[q][role]))
        if inserted < 2:
            choices.append((INSERT + self.best(i, other, inserted + 1)[0], "I", i, other))
        out = min(choices)
        if not inserted:
            self.memo[i, q] = out
        return out

    def edits(self, q: int) -> tuple[str, int]:
        """The audit from a state on, and the state that it ends in."""
        audit, i = [], 0
        while i < len(self.rows):
            _, letter, i, q = self.best(i, q)
            audit.append(letter)
        return "".join(audit), q


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits: K keep, R other role, D delete, I insert.

    Windows of STRIDE rows are solved from the last one on; only costs at their borders are kept.
    """
    starts = range(0, len(signature), STRIDE)
    costs = [[ENDS[q][0] for q in range(4)]]
    for at in reversed(starts):
        window = Window(signature[at : at + STRIDE], costs[-1])
        costs.append([window.best(0, q)[0] for q in range(4)])
    audit, q = [], 0
    for k, at in enumerate(starts):
        piece, q = Window(signature[at : at + STRIDE], costs[-2 - k]).edits(q)
        audit.append(piece)
    return costs[-1][0], "".join(audit) + ENDS[q][1]


def counts(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal): the faults, and neighbours other than su, ua, au."""
    marks = [LETTERS[c] for c in signature]
    roles = "".join(r for r, _ in marks)
    return *(sum(f == fault for _, f in marks) for fault in FAULTS[1:]), sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after the damage that crc32(`conv_id:turn`) % 20 picks, repeated rows twice."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice)).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `rank`, their place in the conversation, and `letter`, their role and first fault; kept in the shared folder."""
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    at = stored(running(rows.withColumn("content", content), ["conv_id"], order, []))
    repeated = at.groupBy("conv_id", "content").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1")
    again = repeated.select(F.col("conv_id").alias("c"), F.col("content").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("content") == F.col("d"))
    visible = r"[^\x20\x09-\x0D]"
    fault = F.when(~F.col("text").rlike(visible), 1).when(F.col("rank") > F.col("first"), 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    role = F.instr(F.lit(ROLES[:3]), F.substring("role", 1, 1))
    place = F.when((role == 0) | (F.col("role") == ""), 3).otherwise(role - 1)
    letter = F.chr(F.lit(ord("A")) + 4 * place + fault)
    return stored(at.join(again, same, "left").select("conv_id", "turn", "role", "text", "rank", letter.alias("letter")))


def signatures(rows: DataFrame, piece: int = 4096) -> DataFrame:
    """(conv_id, signature, gaps) of placed rows: letters in order, put together in pieces."""
    part = F.floor((F.col("rank") - 1) / piece)
    pieces = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("rank", "letter"))).alias("l")).select("conv_id", "part", F.array_join("l.letter", "").alias("piece"))
    whole = pieces.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "piece")))["piece"], "").alias("signature"))
    # distinct turns are counted by way of (conversation, turn), which a long conversation's copies of a turn don't crowd
    by_turn = rows.where("turn IS NOT NULL").select("conv_id", "turn").distinct()
    gaps = by_turn.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    return whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "signature", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def solved(distinct: DataFrame) -> DataFrame:
    """(key, cost, audit, blank, duplicate, truncated, illegal) of (key, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*solve(s), *counts(s)) for s in batch.column(1).to_pylist()]
            types = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["key", "cost", "audit", "blank", "duplicate", "truncated", "illegal"])

    return distinct.mapInArrow(run, "key string, cost long, audit string, blank long, duplicate long, truncated long, illegal long")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the `role:text` lines that each conversation's audit leaves, as they stream by."""
    spark = rows.sparkSession
    lines = rows.select("conv_id", "rank", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).cast("long").alias("rank"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Replay | None = None
        for batch in batches:
            done = []
            for conv, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    done += [state.end()] if state else []
                    state = Replay(conv, audit)
                else:
                    state.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
        if state:
            conv, digest = state.end()
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest])], names=["conv_id", "repaired_sha256"])

    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = lines.unionByName(heads).repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "rank")
    return met.mapInArrow(run, "conv_id long, repaired_sha256 string")


class Replay:
    """One conversation's edits, applied to its rows as they come."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.state, self.hash, self.any = conv_id, audit, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str, initial: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any, self.state = True, GO[self.state][initial]

    def _other(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(role := self._other(), "", role[0])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, role[0])
        elif edit == "R":
            self._put(new := self._other(), text, new[0])

    def end(self) -> tuple[int | None, str]:
        self._inserts()
        return self.conv_id, self.hash.hexdigest()


def repair(df: DataFrame) -> DataFrame:
    """A row for each conv_id of df: gaps, faults, illegal neighbours, the cost and audit of the cheapest edits, and the repaired text's hash."""
    rows = placed(damaged(df.select("conv_id", "turn", "role", "text")))
    named = signatures(rows)
    convs = df.select(F.col("conv_id").alias("c")).distinct()
    whole = stored(convs.join(named, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(F.col("c").alias("conv_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.coalesce("signature", F.lit("")).alias("signature")).withColumn("key", F.sha2("signature", 256)))
    distinct = stored(whole.groupBy("key", "signature").agg(F.count("*").alias("n")))
    small_batches(df.sparkSession)
    answers = stored(solved(distinct.select("key", "signature"))).join(distinct.select("key", "n"), "key")
    audited = stored(spread_join(whole.select("conv_id", "gaps", "key"), answers, "key", "n", whole.count()).drop("key"))
    hashes = replayed(rows, audited.select("conv_id", "audit")).withColumnRenamed("conv_id", "h")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return audited.join(hashes, F.col("conv_id").eqNullSafe(F.col("h"))).select(*columns)
