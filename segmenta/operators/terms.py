"""Terms: glossary matching in one scan, and mining of words, compounds and phrases (GL1-GL6, V5-V7, DT0-DT3, DT6-DT11, TK1, TK7).

Every operator takes DataFrames and parameters. `records` has key columns (doc_id, record_pos, record_id), source
and, for rules, target; a glossary is a list of entries, small enough to travel with the plan.

Defined results: null sources and targets hold no term; an empty glossary or table gives no rows; repeated rows
each count; `lower` stands for case folding.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.plans.dialect import HYPHENATED, LETTER
from segmenta.sources.batches import pieces

KEYS = ["doc_id", "record_pos", "record_id"]


@dataclass(frozen=True)
class Entry:
    """A glossary entry; enforce is error, warn or off."""

    source: str
    variants: tuple[str, ...] = ()
    target: str = ""
    target_variants: tuple[str, ...] = ()
    require: bool = False
    forbidden: tuple[str, ...] = ()
    enforce: str = "error"
    case_sensitive: bool = False


def term_pattern(term: str, case_sensitive: bool) -> re.Pattern[str]:
    """The term between non-word characters, asserted only where the term itself ends in a word character."""
    left = r"(?<!\w)" if term[0].isalnum() or term[0] == "_" else ""
    right = r"(?!\w)" if term[-1].isalnum() or term[-1] == "_" else ""
    return re.compile(left + re.escape(term) + right, 0 if case_sensitive else re.IGNORECASE)


def terms_of(first: str, others: tuple[str, ...]) -> list[str]:
    """Trimmed, different, the primary one first."""
    return [t for t in dict.fromkeys(x.strip() for x in (first, *others)) if t]


class Matcher:
    """All entries' terms over a text; spans inside an earlier accepted one are shadowed."""

    def __init__(self, glossary: list[Entry]) -> None:
        self.terms = [(k, n, t, term_pattern(t, e.case_sensitive)) for k, e in enumerate(glossary) for n, t in enumerate(terms_of(e.source, e.variants))]
        self.approved = [[term_pattern(t, e.case_sensitive) for t in terms_of(e.target, e.target_variants)] for e in glossary]
        self.forbidden = [[(t, term_pattern(t, e.case_sensitive)) for t in terms_of("", e.forbidden)] for e in glossary]
        self.glossary = glossary

    def spans(self, text: str) -> list[tuple[int, str, int, int, bool]]:
        """(entry, term, start, end, shadowed), by start, the longest first."""
        found = sorted((m.start(), -(m.end() - m.start()), n > 0, k, t, m.end()) for k, n, t, p in self.terms for m in p.finditer(text))
        out, reach = [], -1
        for start, _, _, k, t, end in found:
            out.append((k, t, start, end, end <= reach))
            reach = max(reach, end)
        return out

    def rules(self, source: str, target: str | None) -> list[tuple[int, str, str, str]]:
        """(entry, severity, rule, term) for a pair."""
        if target is None:
            return []
        spans = self.spans(source)
        applies, dim = {s[0] for s in spans if not s[4]}, {s[0] for s in spans if s[4]}
        out = []
        for k in sorted(applies):
            entry = self.glossary[k]
            if entry.enforce == "off":
                continue
            severity = "error" if entry.enforce == "error" else "warn"
            for term, pattern in self.forbidden[k]:
                if pattern.search(target):
                    out.append((k, "warn", "glossary_alignment_ambiguous", term) if k in dim else (k, severity, "forbidden_term_used", term))
            if entry.require and self.approved[k] and not any(p.search(target) for p in self.approved[k]):
                out.append((k, severity, "glossary_target_missing", ""))
        return out


def _each(df: DataFrame, columns: list[str], schema: str, fields: list[str], rows_of, keep: tuple[str, ...] = ()) -> DataFrame:
    """One scan: rows_of(row's columns) gives the rows that follow its key columns and those to keep."""
    held = [*KEYS, *keep]
    schema = ", ".join([_KEY_SCHEMA, *(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), *schema.split(", ")[len(KEYS) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = rows_of()
        for batch in pieces(batches):
            keys, rest = batch.columns[: len(held)], [c.to_pylist() for c in batch.columns[len(held) :]]
            at, out = [], []
            for k, values in enumerate(zip(*rest, strict=True)):
                for row in work(*values):
                    at.append(k)
                    out.append(row)
            take = pa.array(at, pa.int64())
            made = [pa.array([r[i] for r in out], pa.type_for_alias(t)) for i, t in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in keys), *made], names=[n.split()[0] for n in schema.split(", ")])

    return df.select(*held, *columns).mapInArrow(run, schema)


_KEY_SCHEMA = "doc_id long, record_pos long, record_id string"


def term_spans(records: DataFrame, glossary: list[Entry], keep: tuple[str, ...] = ()) -> DataFrame:
    """GL1-GL3: every occurrence of every term (entry_index, term, start_at, end_at, shadowed), with the record's columns to keep."""

    def make():
        matcher = Matcher(glossary)
        return lambda source: matcher.spans(source or "")

    return _each(records, ["source"], f"{_KEY_SCHEMA}, entry_index long, term string, start_at long, end_at long, shadowed boolean", ["int64", "string", "int64", "int64", "bool"], make, keep)


def applicable(records: DataFrame, glossary: list[Entry], keep: tuple[str, ...] = ()) -> DataFrame:
    """GL4: the entries with an unshadowed span, record by record."""
    return term_spans(records, glossary, keep).where("not shadowed").select(*KEYS, *keep, "entry_index").distinct()


def glossary_findings(pairs: DataFrame, glossary: list[Entry]) -> DataFrame:
    """V5-V7: (entry_index, severity, rule, term) for each pair that breaks an entry."""

    def make():
        matcher = Matcher(glossary)
        return lambda source, target: matcher.rules(source or "", target)

    return _each(pairs, ["source", "target"], f"{_KEY_SCHEMA}, entry_index long, severity string, rule string, term string", ["int64", "string", "string", "string"], make)


def term_audit(pairs: DataFrame, glossary: list[Entry]) -> DataFrame:
    """GL5, GL6, GL8, GR14: for each entry, records with a target whose source has a term (shadowed or not), and how many of these
    hold a forbidden, an approved, neither form."""

    def make():
        matcher = Matcher(glossary)

        def rows(source: str | None, target: str | None) -> list[tuple]:
            if target is None:
                return []
            seen = sorted({s[0] for s in matcher.spans(source or "")})
            return [(k, any(p.search(target) for _, p in matcher.forbidden[k]), any(p.search(target) for p in matcher.approved[k])) for k in seen]

        return rows

    hits = _each(pairs, ["source", "target"], f"{_KEY_SCHEMA}, entry_index long, bad boolean, good boolean", ["int64", "bool", "bool"], make)
    return hits.groupBy("entry_index").agg(
        F.count("*").alias("records"), F.count_if("bad").alias("forbidden"), F.count_if("good").alias("approved"), F.count_if(F.expr("NOT good AND NOT bad")).alias("missing")
    )


# --- mining --------------------------------------------------------------------------------------

#: Marks beyond which a phrase does not reach.
_MARKS = frozenset(".,;:!?…—–\"“”‘’\n")
_HARD = regex.compile(rf"[{''.join(sorted(_MARKS))}]")
_PHRASE_TOKEN = regex.compile(rf"{LETTER}+(?:-{LETTER}+)+|{LETTER}+")


def case_bucket(surface: Column) -> Column:
    """DT0: lower, title (one capital, the first letter), upper, mixed."""
    capitals = F.regexp_count(surface, F.lit(r"\p{Lu}"))
    letters = F.regexp_count(surface, F.lit(r"\p{L}"))
    first = F.regexp_like(surface, F.lit(r"^[^\p{L}]*\p{Lu}"))
    # most words are plain: letters of ASCII need no pattern
    ascii_letters = F.octet_length(surface) == F.length(surface)
    plain = F.when(ascii_letters & (surface == F.lower(surface)), "lower").when(ascii_letters & (F.length(surface) > 1) & (surface == F.initcap(surface)) & ~surface.contains("-"), "title")
    return plain.when(letters == 0, "lower").when(capitals == letters, "upper").when((capitals == 1) & first, "title").when(capitals == 0, "lower").otherwise("mixed")


def candidate_id(language: Column, normalized: Column, tokens: Column, bucket: Column) -> Column:
    """DT6: CAND- and 16 digits of the canonical JSON's SHA-256; keys in order, no blanks."""
    payload = F.struct(bucket.alias("case_bucket"), F.lit("1").alias("identity_ruleset_version"), normalized.alias("normalized"), language.alias("source_language"), F.size(tokens).alias("token_count"), tokens.alias("tokens"))
    return F.concat(F.lit("CAND-"), F.upper(F.substring(F.sha2(F.to_json(payload), 256), 1, 16)))


def _counted(found: DataFrame, identity: list[str]) -> DataFrame:
    """Occurrences, records and chapters by identity, distinct counts by grouping in steps: no row is multiplied."""
    rows = found.groupBy(*identity, "doc_id", "chapter_no", "record_pos").agg(F.count("*").alias("n"))
    by_chapter = rows.groupBy(*identity, "doc_id", "chapter_no").agg(F.sum("n").alias("n"), F.count("*").alias("records"))
    return by_chapter.groupBy(*identity).agg(F.sum("n").alias("occurrences"), F.sum("records").alias("records"), F.count("*").alias("chapters"))


def words(records: DataFrame) -> DataFrame:
    """DT1, GR11: single words by (normalized, bucket)."""
    found = records.select("doc_id", "chapter_no", "record_pos", F.explode(F.regexp_extract_all("source", F.lit(f"{LETTER}+"), F.lit(0))).alias("surface"))
    found = found.select("*", F.lower("surface").alias("normalized"), case_bucket(F.col("surface")).alias("bucket"))
    kind = F.when(F.col("bucket") == "title", "proper_name").otherwise("word")
    return _counted(found, ["normalized", "bucket"]).select("*", kind.alias("kind"), F.array("normalized").alias("tokens"))


def histograms(records: DataFrame) -> DataFrame:
    """GR11: (normalized, bucket, surfaces, first_doc, first_pos): the forms of each word with their counts, the most frequent first, and where it stands first.

    Counted before they are gathered: a word has no more forms than ways to write it in capitals.
    """
    found = records.select("doc_id", "record_pos", F.explode(F.regexp_extract_all("source", F.lit(f"{LETTER}+"), F.lit(0))).alias("surface"))
    forms = found.groupBy("surface").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "record_pos")).alias("first"))
    forms = forms.select(F.lower("surface").alias("normalized"), case_bucket(F.col("surface")).alias("bucket"), "surface", "n", "first")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "surface")))
    shown = F.array_join(F.transform(listed, lambda x: F.concat(x["surface"], F.lit("="), (-x["k"]).cast("string"))), ",")
    return forms.groupBy("normalized", "bucket").agg(shown.alias("surfaces"), F.min("first").alias("f")).select("normalized", "bucket", "surfaces", F.col("f.doc_id").alias("first_doc"), F.col("f.record_pos").alias("first_pos"))


def compounds(records: DataFrame) -> DataFrame:
    """DT2: words joined by hyphens."""
    found = records.select("doc_id", "chapter_no", "record_pos", F.explode(F.regexp_extract_all("source", F.lit(HYPHENATED), F.lit(0))).alias("surface"))
    found = found.select("*", F.lower("surface").alias("normalized"), case_bucket(F.col("surface")).alias("bucket"))
    return _counted(found, ["normalized", "bucket"]).select("*", F.lit("hyphenated_term").alias("kind"), F.split("normalized", "-").alias("tokens"))


def bucket_of(surface: str) -> str:
    """DT0 for one word."""
    # most words: no need to look at each letter
    if surface.islower():
        return "lower"
    if surface.isascii() and surface.isalpha():
        return "upper" if surface.isupper() else "title" if surface[0].isupper() and surface[1:].islower() else "mixed"
    letters = [c for c in surface if c.isalpha()]
    capitals = sum(unicodedata.category(c) == "Lu" for c in letters)
    if letters and capitals == len(letters):
        return "upper"
    if capitals == 1 and unicodedata.category(letters[0]) == "Lu":
        return "title"
    return "mixed" if capitals else "lower"


class _Bits(dict):
    """1 for title and upper case, 2 for lower, 4 for mixed; forgets all once there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = bits = {"title": 1, "upper": 1, "lower": 2, "mixed": 4}[bucket_of(word)]
        return bits


_BITS = _Bits()


def phrases_of(source: str, common: set[str], longest: int) -> Iterator[tuple[str, str, str, int]]:
    """(surface, normalized, bucket, windows) of each run of words in a record that windows are trimmed to: the rule, one record at a time."""
    for unit in _HARD.split(source):
        words = _PHRASE_TOKEN.findall(unit)
        n = len(words)
        if n < 2:
            continue
        low = [w.lower() for w in words]
        edge = [w in common or len(w) <= 1 for w in low]
        for i in range(n - 1):
            if edge[i] or "-" in words[i]:
                continue
            # words trimmed off on the left and right of a run
            left = 0
            while left < longest - 2 and i > left and edge[i - left - 1]:
                left += 1
            bits = _BITS[words[i]]
            for j in range(i + 1, min(n, i + longest)):
                if edge[j] or "-" in words[j]:
                    break
                spare = longest - (j - i + 1)
                right = 0
                while right < spare and j + right + 1 < n and edge[j + right + 1]:
                    right += 1
                bits |= _BITS[words[j]]
                windows = sum(min(right, spare - k) + 1 for k in range(min(left, spare) + 1)) if left or right else 1
                yield " ".join(words[i : j + 1]), " ".join(low[i : j + 1]), "title" if bits == 1 else "lower" if bits == 2 else "mixed", windows


# --- counting by slices --------------------------------------------------------------------------

BUCKETS = ("lower", "mixed", "title", "upper")
_BUCKET_NAMES = pa.array(BUCKETS)
_BUCKET_OF_BITS = np.array([1, 2, 0, 1, 1, 1, 1, 1])
_TOKEN_OR_MARK = regex.compile(rf"{LETTER}+(?:-{LETTER}+)*|{_HARD.pattern}")
#: Bytes of text that are counted at once, and of one chapter's from which on it is counted in parts.
SLICE, LONG_CHAPTER = 1 << 20, 1 << 22


def _paired(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """One number for each pair (a, b), b below base, in the order of the pairs."""
    if len(a) and int(a.max()) >= (1 << 62) // base:
        a = np.unique(a, return_inverse=True)[1]
    return a * base + b


def _firsts(identity: np.ndarray, record: np.ndarray, chapter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 where a place is the first of its identity in its record, and in its chapter; places come in the order of records."""
    order = np.argsort(identity, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(identity[order]) != 0

    def first(numbers: np.ndarray) -> np.ndarray:
        found = new.copy()
        found[1:] |= np.diff(numbers[order]) != 0
        out = np.empty(len(order), np.int64)
        out[order] = found
        return out

    return first(record), first(chapter)


def tallied(sources: list[str], records: np.ndarray, chapters: np.ndarray, plain: set[str], longest: int, kinds: tuple[str, ...]) -> Iterator[tuple]:
    """(normalized, rest, surface, sums) as Arrow arrays: words, compounds and runs of words, one row a form.

    A run stands for all phrases that begin with its first word: of 2 words (normalized), 3 and so on to its end (rest). sums:
    place in BUCKETS, n, records and chapters for each of these in turn, null for small letters that stand once; surface is
    null where it equals the small letters. A phrase's records count with the run that first holds it there, so sums add up.
    records, chapters: their numbers, ascending. The rule for phrases is that of `phrases_of`.
    """
    found, lengths = [], []
    for source in sources:
        tokens = _TOKEN_OR_MARK.findall(source)
        found += tokens
        found.append("\n")
        lengths.append(len(tokens) + 1)
    coded = pa.array(found, pa.string()).dictionary_encode()
    met = coded.dictionary.to_pylist()
    vocabulary = sorted({p for w in met if "-" in w for p in w.split("-")} | set(met))
    place = {w: k for k, w in enumerate(vocabulary)}
    code = np.array([place[w] for w in met], np.int64)[coded.indices.to_numpy()]
    record, chapter = np.repeat(records, lengths), np.repeat(chapters, lengths)
    low = [w.lower() for w in vocabulary]
    lows = sorted(set(low))
    low_place = {w: k for k, w in enumerate(lows)}
    low_of = np.array([low_place[w] for w in low], np.int64)
    bucket_of_word = np.array([BUCKETS.index(bucket_of(w)) for w in vocabulary])
    joined_word = np.array(["-" in w for w in vocabulary])
    mark = np.array([w in _MARKS for w in vocabulary])
    small = np.array([w == v for w, v in zip(vocabulary, low, strict=True)], bool)
    forms, normals = pa.array(vocabulary, pa.string()), pa.array(lows, pa.string())

    def summed(identity: np.ndarray, bucket: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([bucket, n, *_firsts(_paired(identity, bucket, len(BUCKETS)), record[at], chapter[at])], axis=1)

    def made(words: list[np.ndarray], form: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
        """words: the codes of each run's words; form: one number for each different run; sums: four for each of its phrases."""
        if not len(form):
            return
        order = np.argsort(form, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = np.diff(form[order]) != 0
        starts = np.flatnonzero(new)
        kept = order[starts]
        total = np.add.reduceat(sums[order], starts, axis=0)
        total[:, ::4] = sums[kept, ::4]
        words = [w[kept] for w in words]

        def text(values: pa.Array, codes: list[np.ndarray], null: np.ndarray | None = None) -> pa.Array:
            return pc.binary_join_element_wise(*(values.take(pa.array(c, mask=null)) for c in codes), " ")

        lower = [low_of[w] for w in words]
        rest = text(normals, lower[2:]) if lower[2:] else pa.array([""] * len(kept), pa.string())
        told = (total != np.tile([0, 1, 1, 1], total.shape[1] // 4)).any(axis=1)
        ends = np.concatenate([[0], np.cumsum(told * total.shape[1])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(total[told].ravel().astype(np.int32)), mask=pa.array(~told))
        yield text(normals, lower[:2]), rest, text(forms, words, np.logical_and.reduce([small[w] for w in words])), listed

    joined = joined_word[code]
    if "word" in kinds:
        parts = [[place[p] for p in vocabulary[c].split("-")] for c in code[joined].tolist()]
        single, apart = np.flatnonzero(~joined & ~mark[code]), np.flatnonzero(joined)
        at = np.concatenate([single, np.repeat(apart, [len(p) for p in parts])]).astype(np.int64)
        word = np.concatenate([code[single], np.array([c for p in parts for c in p], np.int64)])
        order = np.argsort(at, kind="stable")
        at, word = at[order], word[order]
        yield from made([word], word, summed(low_of[word], bucket_of_word[word], at, np.ones(len(at), np.int64)))
    if "compound" in kinds:
        at = np.flatnonzero(joined)
        yield from made([code[at]], code[at], summed(low_of[code[at]], bucket_of_word[code[at]], at, np.ones(len(at), np.int64)))
    if "phrase" not in kinds:
        return
    edge_word = np.array([(w in plain or len(w) <= 1) for w in low]) & ~mark
    inner = (~edge_word & ~joined_word & ~mark)[code]
    # edges with room on either side for the words that may be trimmed off
    edge = np.concatenate([np.zeros(longest, bool), edge_word[code], np.zeros(longest, bool)])
    bits = np.array([2, 4, 1, 1])[bucket_of_word]
    at = np.flatnonzero(inner)
    form, normal, case = code[at], low_of[code[at]], bits[code[at]]
    sums = np.zeros((len(at), 0), np.int64)
    for size in range(2, longest + 1):
        # the last token is a mark, so a run never reaches beyond it
        on = inner[at + size - 1]
        if size > 2:
            yield from made([code[at[~on] + k] for k in range(size - 1)], form[~on], sums[~on])
        at, sums = at[on], sums[on]
        last = code[at + size - 1]
        form, normal, case = _paired(form[on], last, len(vocabulary)), _paired(normal[on], low_of[last], len(lows)), case[on] | bits[last]
        spare = longest - size
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        before, behind = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, spare + 1):
            before &= edge[longest + at - k]
            behind &= edge[longest + at + size - 1 + k]
            left += before
            right += behind
        n = np.zeros(len(at), np.int64)
        for k in range(spare + 1):
            n += np.where(left >= k, np.minimum(right, spare - k) + 1, 0)
        sums = np.concatenate([sums, summed(normal, _BUCKET_OF_BITS[case], at, n)], axis=1)
    yield from made([code[at + k] for k in range(longest)], form, sums)


_TALLIED = "normalized string, rest string, surface string, sums array<int>, cut string"


#: Columns without nulls: the score's code is short enough to be compiled.
_MERGED = "normalized string NOT NULL, bucket string NOT NULL, occurrences long NOT NULL, records long NOT NULL, chapters long NOT NULL, surface string NOT NULL, token_count int NOT NULL, dull_tokens int NOT NULL, is_common boolean NOT NULL, in_lemmas boolean NOT NULL, dull_any boolean NOT NULL, common_first boolean NOT NULL, dull_last boolean NOT NULL"
#: What `scored` asks of a candidate's tokens.
_ASKED = ("token_count", "dull_tokens", "is_common", "in_lemmas", "dull_any", "common_first", "dull_last")


@dataclass
class _Open:
    """A term whose runs may go on in the next batch; by place in BUCKETS: n, records and chapters, the least surface, the names of cut chapters."""

    term: str
    asked: tuple
    sums: dict[int, np.ndarray]
    surfaces: dict[int, str]
    cuts: dict[int, set[str]]

    def rows(self) -> list[tuple]:
        return [(self.term, BUCKETS[b], int(n), int(records), int(chapters) + len(self.cuts.get(b, ())), self.surfaces[b], *self.asked) for b, (n, records, chapters) in self.sums.items()]


def _merged(batches: Iterator[pa.RecordBatch], longest: int, common: frozenset[str], generic: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Rows of `tallied`, sorted by (normalized, rest), summed by term and bucket; of what has been read, only the last term of each length is held.

    Each term brings what is asked of its tokens: how many there are, and which of them stand in the lists.
    """
    common_list, generic_list = (pa.array(sorted(x), pa.string()) for x in (common, generic))
    names = [f.split()[0] for f in _MERGED.split(", ")]
    held: list[_Open | None] = [None] * longest

    def rows_of(terms: list[_Open]) -> Iterator[pa.RecordBatch]:
        rows = [r for t in terms for r in t.rows()]
        if rows:
            types = [pa.string()] * 2 + [pa.int64()] * 3 + [pa.string(), pa.int32(), pa.int32()] + [pa.bool_()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in pieces(batches, SLICE):
        if not batch.num_rows:
            continue
        normalized, rest, surface, sums, cut = batch.columns
        split = pc.split_pattern(rest, " ")
        told, more = sums.is_valid().to_numpy(False), split.value_lengths().to_numpy(False).astype(np.int64)
        starts = np.cumsum(more) - more
        more[pc.equal(rest, "").to_numpy(False)] = 0
        further = split.flatten().dictionary_encode()
        codes = further.indices.to_numpy(False)
        values = np.append(sums.flatten().to_numpy(False), np.zeros(4 * longest, np.int32)).astype(np.int64)
        lengths = sums.value_lengths().fill_null(0).to_numpy(False).astype(np.int64)
        value_at = np.cumsum(lengths) - lengths
        capital, parted = surface.is_valid().to_numpy(False), cut.is_valid().to_numpy(False)
        written = {int(r): s.split(" ") for r, s in zip(np.flatnonzero(capital), surface.drop_null().to_pylist(), strict=True)}
        begun = normalized.dictionary_encode()
        beginnings, begun = begun.dictionary, begun.indices.to_numpy(False)
        new = np.ones(len(more), bool)
        new[1:] = np.diff(begun) != 0
        # of each beginning's tokens: how many there are, and which stand in the lists
        parts = pc.split_pattern(pc.replace_substring(beginnings, "-", " "), " ")
        count = parts.value_lengths().to_numpy(False).astype(np.int64)
        ends = np.cumsum(count)
        common_part, generic_part = (pc.is_in(parts.flatten(), x).to_numpy(False) for x in (common_list, generic_list))
        in_common, in_generic, in_either = (np.add.reduceat(x.astype(np.int64), ends - count)[begun] for x in (common_part, generic_part, common_part | generic_part))
        first_common, last_generic, count = common_part[ends - count][begun], generic_part[ends - 1][begun], count[begun]
        is_common, is_generic = (pc.is_in(further.dictionary, x).to_numpy(False) for x in (common_list, generic_list))
        closed = []
        for k in range(max(longest - 1, 1)):
            on = more >= k
            if k:
                word = np.where(on, codes[starts + np.minimum(k, np.maximum(more, 1)) - 1], -1)
                new[1:] |= np.diff(word) != 0
                last_generic = is_generic[word]
                count, in_common, in_generic, in_either = count + 1, in_common + is_common[word], in_generic + last_generic, in_either + (is_common[word] | last_generic)
            first = new & on
            at = np.flatnonzero(on)
            opening = np.flatnonzero(first)
            # the texts of the terms, in order
            texts = beginnings.take(pa.array(begun[opening]))
            if k:
                texts = pc.binary_join_element_wise(texts, *(further.dictionary.take(pa.array(codes[starts[opening] + j])) for j in range(k)), " ")
            if held[k] and not (len(opening) and on[0] and texts[0].as_py() == held[k].term):
                closed.append(held[k])
                held[k] = None
            if not len(at):
                continue
            four = values[value_at[at, None] + 4 * k + np.arange(4)]
            four[~told[at]] = [0, 1, 1, 1]
            identity = (np.cumsum(first)[at] - 1) * len(BUCKETS) + four[:, 0]
            four[parted[at], 3] = 0
            size = len(opening) * len(BUCKETS)
            total = np.stack([np.bincount(identity, four[:, j], size).astype(np.int64) for j in (1, 2, 3)], axis=1)
            least: dict[int, str] = {}
            capitals = capital[at]
            for i, r in zip(identity[capitals].tolist(), at[capitals].tolist(), strict=True):
                form = " ".join(written[r][: k + 2])
                if i not in least or form < least[i]:
                    least[i] = form
            small = np.bincount(identity[~capitals], minlength=size) > 0
            cuts: dict[int, set[str]] = {}
            for i, r in zip(identity[parted[at]].tolist(), at[parted[at]].tolist(), strict=True):
                cuts.setdefault(i, set()).add(cut[r].as_py())
            if held[k]:
                for b, known in held[k].sums.items():
                    total[b] += known
                    least[b] = min(least.get(b, held[k].surfaces[b]), held[k].surfaces[b])
                    cuts.setdefault(b, set()).update(held[k].cuts.get(b, ()))
                held[k] = None
            for i, form in least.items():
                if small[i]:
                    least[i] = min(form, texts[i // len(BUCKETS)].as_py())
            whole_common, whole_generic = (pc.is_in(texts, x).to_numpy(False) for x in (common_list, generic_list))
            asked = [
                count[opening].astype(np.int32), in_either[opening].astype(np.int32), whole_common | (in_common == count)[opening], whole_common | whole_generic | (in_generic[opening] > 0),
                in_generic[opening] > 0, first_common[opening], last_generic[opening],
            ]
            out = np.flatnonzero(total[:, 0])
            if on[-1]:
                last = size - len(BUCKETS)
                term = texts[-1].as_py()
                mine = [int(i) for i in out[out >= last]]
                held[k] = _Open(term, tuple(x[-1].item() for x in asked), {i - last: total[i].copy() for i in mine}, {i - last: least.get(i, term) for i in mine}, {i - last: cuts[i] for i in mine if i in cuts})
                out = out[out < last]
            for i, names_of in cuts.items():
                total[i, 2] += len(names_of)
            term_of = out // len(BUCKETS)
            texts = texts.take(pa.array(term_of))
            formed = np.zeros(size, bool)
            formed[list(least)] = True
            formed = formed[out]
            surfaces = pc.replace_with_mask(texts, pa.array(formed), pa.array([least[i] for i in out[formed].tolist()], pa.string()))
            yield pa.RecordBatch.from_arrays([texts, _BUCKET_NAMES.take(pa.array(out % len(BUCKETS))), *(pa.array(total[out, j]) for j in range(3)), surfaces, *(pa.array(x[term_of]) for x in asked)], names=names)
        yield from rows_of(closed)
    yield from rows_of([t for t in held if t])


def mined(records: DataFrame, common: list[str], longest: int = 4, kinds: tuple[str, ...] = ("word", "compound", "phrase"), lists: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """DT1-DT3, WN15: words, compounds and phrases by (normalized, bucket) with occurrences, records, chapters and the least surface form.

    Phrases are windows of 2 to `longest` words between hard marks, common and one-letter words trimmed off their edges. A
    window counts for what it is trimmed to, so a phrase beside common words counts once for each window that ends
    in it; one with a common word or a compound left inside is none.

    Records are dealt by chapters, in order, and counted by slices of whole chapters; most phrases stand once, so they are
    shuffled once and summed there, not before: as runs of words, dealt by the first two, which hold all phrases that
    begin alike. There they are sorted, so a phrase's runs stand together and are summed as they pass. A chapter over
    LONG_CHAPTER bytes is counted in parts that end with a record; such rows carry its name in `cut`, which counts once.

    lists: the common and generic words of `scored`; what it asks of a candidate's tokens is then told word by word here,
    while they are codes, and no tokens follow.
    """
    plain = set(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: list[tuple], cut: str | None) -> Iterator[pa.RecordBatch]:
            whole = np.cumsum([0, *(x[:2] != y[:2] for x, y in itertools.pairwise(rows))])
            single = np.cumsum([0, *(x[:3] != y[:3] for x, y in itertools.pairwise(rows))])
            for arrays in tallied([r[3] or "" for r in rows], single, whole, plain, longest, kinds) if rows else ():
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([cut] * len(arrays[0]), pa.string())], names=[f.split()[0] for f in _TALLIED.split(", ")])

        def settled(rows: list[tuple], going: tuple | None) -> Iterator[pa.RecordBatch]:
            """Chapters that end here; going: the chapter of which parts have been counted already."""
            own = next((k for k, r in enumerate(rows) if r[:2] != going), len(rows)) if going else 0
            yield from counted(rows[:own], str(going))
            yield from counted(rows[own:], None)

        held: list[tuple] = []
        size, going = 0, None
        for piece in pieces(batches):
            held += zip(*(c.to_pylist() for c in piece.columns), strict=True)
            size += piece.nbytes
            if size < SLICE:
                continue
            keys = held[-1][:2]
            start = next((k for k in range(len(held) - 1, -1, -1) if held[k][:2] != keys), -1) + 1
            if start:
                yield from settled(held[:start], going)
                held, going = held[start:], None
            elif size >= LONG_CHAPTER and (start := next((k for k in range(len(held) - 1, -1, -1) if held[k][:3] != held[-1][:3]), -1) + 1):
                yield from counted(held[:start], str(keys))
                held, going = held[start:], keys
            size = size if not start else sum(len(r[3] or "") for r in held)
        yield from settled(held, going)

    rows = records.select("doc_id", F.col("chapter_no").cast("long"), "record_pos", "source")
    rows = rows.repartition("doc_id", "chapter_no").sortWithinPartitions("doc_id", "chapter_no", "record_pos")
    # a given number: merged into a task for each core, they would be sorted on disk
    found = rows.mapInArrow(run, _TALLIED).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "normalized")
    # numbers first: most pairs of runs are told apart without their texts
    found = found.sortWithinPartitions(F.xxhash64("normalized"), "normalized", "rest")
    given, generic = map(frozenset, lists or ((), ()))
    out = found.mapInArrow(lambda batches: _merged(batches, longest, given, generic), _MERGED)
    title = F.col("bucket") == "title"
    kind = F.when(F.contains("normalized", F.lit(" ")), F.when(title, "title_candidate").otherwise("phrase")).when(F.contains("normalized", F.lit("-")), "hyphenated_term").when(title, "proper_name").otherwise("word")
    out = out.select("*", kind.alias("kind"))
    if lists:
        return out
    # at one character, which needs no regular expression a row
    return out.drop(*_ASKED).select("*", F.split(F.replace("normalized", F.lit("-"), F.lit(" ")), " ").alias("tokens"))


def _matches(text: Column, pattern: str | None) -> Column:
    """regexp_like; patterns that are plain text, at the start or anywhere, need no regular expression a row."""
    if not pattern:
        return F.lit(False)
    literal = pattern.removeprefix("^")
    if re.fullmatch(r"[\w -]+", literal):
        return text.startswith(literal) if literal != pattern else text.contains(literal)
    return F.regexp_like(text, F.lit(pattern))


def _round6(x: Column) -> Column:
    """round(x, 6), which goes by way of decimal text, for numbers below 1e9; other than near halves, where that decides, by arithmetic."""
    scaled = x * 1e6
    return F.when(F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3, F.round(x, 6)).otherwise(F.floor(scaled + 0.5) / F.lit(1e6))


# What features add to a candidate's genericity, and the rarity of so many occurrences at most.
GENERICITY = {"common": 1.0, "lemma": 1.2, "lemma_in_phrase": 0.5, "dull": 0.8, "dull_each": 0.6, "dull_most": 1.4, "common_first": 0.6, "dull_last": 0.8, "plain_word": 0.4}
RARITY, COMMONPLACE = {1: 1.6, 2: 1.4, 4: 1.0, 8: 0.7}, 0.3
# Priorities of kinds, and what form, naming and termhood count.
PRIORITY = {"hyphenated": 1.6, "world": 1.4, "name": 1.2, "phrase": 0.6, "other": 0.2}
FORM = {"hyphen": 1.4, "world": 1.2, "included": 1.0, "mixed": 0.8, "title": 0.6}
NAMING = {"name": 1.6, "title": 0.8}
TERMHOOD = {"any": 0.4, "phrase": 0.6, "kind": 0.5}
# The features' weights in the risk, the score's factors, and from what genericity on candidates are dropped.
RISK = {"priority": 4.0, "rarity": 2.5, "form": 2.0, "naming": 2.0, "termhood": 1.5, "often_most": 2.0, "chapters": 0.5, "chapters_most": 3, "genericity": 3.0, "fragment": 2.0}
SCORE = {"common": 0.2, "kind": 1.5}
GENERIC_FROM, DULL_FROM = 1.0, 1.2


def scored(candidates: DataFrame, common: list[str], generic: list[str], morphemes: list[str], include: str | None = None, exclude: str | None = None, min_count: int = 2, min_risk: float = 3.0, singletons: bool = True) -> DataFrame:
    """DT7-DT11: features, compatibility score, genericity, rarity, risk and review bucket of each candidate.

    Candidates that were mined with these `lists` bring what is asked of their tokens; others are taken apart here.
    """
    plain, dull = F.array(*[F.lit(w) for w in common]), F.array(*[F.lit(w) for w in generic])
    none = F.lit(False)
    c = F.col
    kind, bucket, n = c("kind"), c("bucket"), c("occurrences")
    df = candidates
    if "tokens" in candidates.columns:
        token = c("tokens")
        # most candidates hold no listed word: lists are walked for the others alone
        listed = F.exists(token, lambda t: t.isin([*common, *generic])) | c("normalized").isin([*common, *generic]) | (F.size(token) == 0)
        df = df.select("*", F.size(token).alias("token_count"), listed.alias("listed"))
        asked = {
            "dull_tokens": F.size(F.filter(token, lambda t: F.array_contains(plain, t) | F.array_contains(dull, t))),
            "is_common": F.array_contains(plain, c("normalized")) | F.forall(token, lambda t: F.array_contains(plain, t)),
            "in_lemmas": F.array_contains(plain, c("normalized")) | F.array_contains(dull, c("normalized")) | F.arrays_overlap(token, dull),
            "dull_any": F.arrays_overlap(token, dull), "common_first": F.array_contains(plain, F.try_element_at(token, F.lit(1))), "dull_last": F.array_contains(dull, F.try_element_at(token, F.lit(-1))),
        }
        df = df.select("*", *(F.when(c("listed"), value).otherwise(0 if name == "dull_tokens" else False).alias(name) for name, value in asked.items()))
    single = c("token_count") == 1
    # a part inside a token is inside the joined text too
    df = df.withColumn("bare", F.replace(F.replace("normalized", F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    world = functools.reduce(lambda a, b: a | b, [c("bare").contains(m) for m in morphemes], none)
    df = df.select("*", (c("surface").contains("-") | c("normalized").contains("-")).alias("has_hyphen"), world.alias("world"), _matches(c("surface"), include).alias("included"), _matches(c("surface"), exclude).alias("excluded"), kind.isin("proper_name", "place_name", "title_candidate").alias("name"))
    name = c("name")

    def points(*parts: tuple[Column, object]) -> Column:
        out = F.lit(0.0)
        for when, value in parts:
            out = out + F.when(when, value if isinstance(value, Column) else F.lit(value)).otherwise(0.0)
        return out

    g = GENERICITY
    genericity = points(
        (c("is_common"), g["common"]), (c("in_lemmas"), F.when(single, g["lemma"]).otherwise(g["lemma_in_phrase"])),
        (c("dull_tokens") > 0, F.when(single, g["dull"]).otherwise(F.least(F.lit(g["dull_most"]), g["dull_each"] * c("dull_tokens")))),
        (~single & c("common_first"), g["common_first"]), (~single & c("dull_last"), g["dull_last"]), (single & (kind == "word"), g["plain_word"]),
    )
    rarity = F.lit(COMMONPLACE)
    for most, value in sorted(RARITY.items(), reverse=True):
        rarity = F.when(n <= most, value).otherwise(rarity)
    priority = F.when(kind == "hyphenated_term", PRIORITY["hyphenated"]).when(c("included") | c("world"), PRIORITY["world"]).when(name, PRIORITY["name"]).when(kind == "phrase", PRIORITY["phrase"]).otherwise(PRIORITY["other"])
    form = points((c("has_hyphen"), FORM["hyphen"]), (c("world"), FORM["world"]), (c("included"), FORM["included"]), (bucket == "mixed", FORM["mixed"]), (bucket == "title", FORM["title"]))
    naming = points((name, NAMING["name"]), (bucket == "title", NAMING["title"]))
    termhood = F.lit(TERMHOOD["any"]) + points((~single, TERMHOOD["phrase"]), (kind.isin("hyphenated_term", "title_candidate"), TERMHOOD["kind"]))
    fragment = single & (F.length("normalized") <= 1)
    often, spread = F.least(F.log1p(n), F.lit(RISK["often_most"])), F.least(c("chapters"), F.lit(RISK["chapters_most"])) / float(RISK["chapters_most"])
    risk = RISK["priority"] * priority + RISK["rarity"] * rarity + RISK["form"] * form + RISK["naming"] * naming + RISK["termhood"] * termhood + often + RISK["chapters"] * spread - RISK["genericity"] * c("genericity") - RISK["fragment"] * F.when(fragment, 1.0).otherwise(0.0)
    bonus = F.when(kind.isin("phrase", "title_candidate", "hyphenated_term"), SCORE["kind"]).otherwise(1.0)
    score = F.log1p(n) * (1 + F.log1p("chapters")) * F.when(c("is_common"), SCORE["common"]).otherwise(1.0) * bonus
    df = df.withColumn("genericity", genericity)
    lone = (kind == "hyphenated_term") | (kind.isin("proper_name", "place_name") & ~c("in_lemmas")) | ((kind == "title_candidate") & (c("genericity") < GENERIC_FROM) & (c("token_count") <= 2)) | c("world") | c("included") | ((bucket == "mixed") & single)
    df = df.select("*", rarity.alias("rarity"), risk.alias("risk"), score.alias("score"), (F.lit(singletons) & (n == 1) & (kind != "phrase") & lone).alias("lone"))
    spared = c("world") | c("included")
    no = F.lit("no_action")
    at_first = (
        F.when(c("excluded") | fragment | (single & c("in_lemmas") & ~spared), no).when(kind == "hyphenated_term", "binding_glossary")
        .when(name & ~(single & c("in_lemmas")), "name_policy").when(c("included") | c("lone"), "invented_or_rare")
        .when((kind == "phrase") & ~single & (c("genericity") < GENERIC_FROM), "domain_phrase")
        .when((kind == "phrase") & (c("token_count") <= 2) & c("dull_any") & ~spared, no)
        .when((kind == "phrase") & (c("token_count") <= 3) & (c("genericity") >= DULL_FROM), no)
        .when((c("genericity") >= GENERIC_FROM) & single, no).otherwise("maybe")
    )
    df = df.withColumn("review_bucket", at_first)
    df = df.withColumn("review_bucket", F.when((n < min_count) & ~c("lone"), no).otherwise(c("review_bucket")))
    df = df.withColumn("review_bucket", F.when(c("review_bucket").isin("domain_phrase", "maybe") & (c("risk") < min_risk), no).otherwise(c("review_bucket")))
    return df.select("normalized", "bucket", "kind", "token_count", "occurrences", "records", "chapters", _round6(c("genericity")).alias("genericity"), "rarity", _round6(c("risk")).alias("risk"), _round6(c("score")).alias("score"), "lone", "review_bucket")
