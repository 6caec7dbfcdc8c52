"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge at one place can hinder a merge to its left only through rules of lower and lower rank, each
reaching at most the length of its right part further. The longest such chain, taken over the merge
list, is the *sufficient lookahead*: a token boundary with so many symbols behind it cannot change
whatever follows. The transducer keeps that many symbols, plus a small block, emits the tokens that
lie before them and forgets these; no merge crosses a final boundary, so the rest goes on alone.
Every word, short or long, goes through the same transducer; the end of a word makes all of it final.

Defined results: a null or empty text has no tokens and decodes to the empty text; an id that is not
in the vocabulary decodes to nothing; equal rows give equal results; other columns pass untouched
(columns of the input named like an output column are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmenta.llm.common import map_batches

#: Entries a worker remembers of each kind; a full memory is emptied.
MEMORY_ENTRIES = 400_000
#: Symbols beyond the lookahead that the transducer gathers before it merges.
BLOCK = 256
# Capitals that the tokenizer knows and Python's do not: first, last, first small letter.
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0x16EA0, 0x16EB8, 0x16EBB), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70)]
# Code points that the regex package counts as letters or digits and the tokenizer's tables do not: first, last.
NO_LETTERS = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
#: White space as the tokenizer's regular expressions know it.
SPACES = "\t-\r \x85\xa0  -     　"
_SPACE_SPLIT = re.compile(f"[{SPACES}]+")
#: Counted as white space by str.split, not by the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SHIFT = 20
_ID = (1 << _SHIFT) - 1
_NEVER = 1 << 62


_SMALL = {c: small + c - first for first, last, small in CAPITALS for c in range(first, last + 1)}
_NEW = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def known_classes(pattern: str) -> regex.Pattern:
    """The tokenizer's splitting pattern with letters as its own tables have them."""
    strange = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NO_LETTERS) + "]"
    split = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--{strange}]").replace(r"[\p{N}]", rf"[\p{{N}}--{strange}]")
    return regex.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{strange}]"), regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """Vocabulary, merge ranks and sufficient lookahead of one tokenizer file's content."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.literal = spec.get("decoder") is None
        self.pattern = known_classes(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        #: A pair of ids to the rule's rank, then the merged id in the low bits.
        self.merges: dict[int, int] = {}
        self.lookahead = self._learn([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.of_byte = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(self.of_byte)}
        self.inner = [self.vocab.get(c) for c in self.of_byte]
        self.last = [self.vocab.get(c + self.suffix) for c in self.of_byte]

    def _width(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _learn(self, merges: list[tuple[str, str]]) -> int:
        made: dict[str, list[str]] = {}
        reach: dict[str, int] = {}
        longest = 1
        for rank, (left, right) in enumerate(merges):
            self.merges[self.vocab[left] << _SHIFT | self.vocab[right]] = rank << _SHIFT | self.vocab[left + right]
            spine, todo = set(), [right]
            while todo:
                t = todo.pop()
                if t not in spine:
                    spine.add(t)
                    todo += made.get(t, [])
            chain = self._width(right) + max((reach.get(t, 0) for t in spine), default=0)
            reach[left] = max(reach.get(left, 0), chain)
            longest = max(longest, chain)
            made.setdefault(left + right, []).append(right)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """Tokens of a whole symbol sequence: lowest rank first, leftmost first."""
        find, none = self.merges.get, _NEVER
        ranks = [find(a << _SHIFT | b, none) for a, b in itertools.pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            at, new = ranks.index(best), best & _ID
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = find(ids[at - 1] << _SHIFT | new, none)
            if at < len(ranks):
                ranks[at] = find(new << _SHIFT | ids[at + 1], none)
        return ids


class Transducer:
    """Takes the bytes of words piece by piece, gives tokens once they are stable; never keeps more than `limit` symbols."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.kept = table, []
        self.limit = table.lookahead + BLOCK
        #: How many tokens were emitted before their word's end.
        self.early = 0

    def feed(self, piece: bytes) -> list[int]:
        inner, kept = self.table.inner, self.kept
        if len(kept) + len(piece) <= self.limit:
            kept += [i for b in piece if (i := inner[b]) is not None]
            return []
        out: list[int] = []
        for start in range(0, len(piece), BLOCK):
            self.kept += [i for b in piece[start : start + BLOCK] if (i := inner[b]) is not None]
            if len(self.kept) > self.table.lookahead:
                out += self._settle()
        self.early += len(out)
        return out

    def _settle(self) -> list[int]:
        table, out, used = self.table, [], 0
        stable = len(self.kept) - table.lookahead
        for token in table.merge(self.kept[:]):
            w = table._width(table.tokens[token])
            if used + w > stable:
                break
            used += w
            out.append(token)
        self.kept = self.kept[used:]
        return out

    def finish(self, last: int) -> list[int]:
        """The rest, closed by the word's last byte."""
        ids = self.kept + ([i] if (i := self.table.last[last]) is not None else [])
        self.kept = []
        return self.table.merge(ids)


class Encoder:
    """Whole texts to packed 32-bit ids; remembers words, never more than MEMORY_ENTRIES of a kind."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.machine = table, Transducer(table)
        self.words: dict[str, bytes] = {}
        encoder = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                packed = encoder._chunk(chunk)
                if len(chunk) <= 64:
                    if len(self) >= MEMORY_ENTRIES:
                        self.clear()
                    self[chunk] = packed
                return packed

        self.chunks = Chunks()

    def _chunk(self, chunk: str) -> bytes:
        low = (chunk.replace("Σ", "σ") if "Σ" in chunk else chunk).lower()
        if _NEW.search(low):
            low = low.translate(_SMALL)
        if low.isalpha():
            return self._word(low)
        if low[:-1].isalpha() and low[-1] in ".,":
            return self._word(low[:-1]) + self._word(low[-1])
        return b"".join(map(self._word, self.table.pattern.findall(low)))

    def _word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            raw = word.encode()
            packed = array("i", self.machine.feed(raw[:-1]) + self.machine.finish(raw[-1])).tobytes()
            if len(word) <= 64:
                if len(self.words) >= MEMORY_ENTRIES:
                    self.words.clear()
                self.words[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        chunks = [c for c in _SPACE_SPLIT.split(text) if c] if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def packed(self, text: str) -> bytes:
        split = self.table.special_split
        if split is None or "<" not in text or not split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in split.finditer(text):
            out += [self._plain(text[at : m.start()]), array("i", [self.table.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def ids(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Decoder:
    """Ids to text, a block at a time. State: whether anything was emitted, and a begun character's bytes.

    A tokenizer without a decoder of its own decodes to its tokens' strings joined by one space; `as_bytes`
    gives the text that the tokens spell: bytes back from their symbols, word ends as spaces, wrong UTF-8
    as U+FFFD.
    """

    def __init__(self, table: MergeTable, as_bytes: bool | None = None) -> None:
        self.table, self.begun, self.open = table, False, b""
        self.as_bytes = (not table.literal) if as_bytes is None else as_bytes

    def feed(self, ids: Iterable[int]) -> str:
        tokens, n = self.table.tokens, len(self.table.tokens)
        if not self.as_bytes:
            out = " ".join([tokens[i] for i in ids if 0 <= i < n])
            out, self.begun = (" " + out if self.begun and out else out), self.begun or bool(out)
            return out
        raw = bytearray(self.open)
        for i in ids:
            token = tokens[i] if 0 <= i < n else ""
            ends = bool(self.table.suffix) and token.endswith(self.table.suffix)
            for c in token[: len(token) - len(self.table.suffix)] if ends else token:
                raw += bytes([self.table.byte_of[c]]) if c in self.table.byte_of else c.encode()
            raw += b" " * ends
        cut = len(raw) - _unfinished(raw)
        self.open = bytes(raw[cut:])
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


def _unfinished(raw: bytes | bytearray) -> int:
    """How many bytes at the end may begin a character that goes on."""
    for back in range(1, min(4, len(raw) + 1)):
        lead = raw[-back]
        if lead >= 0xC0:
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return back if need > back else 0
        if lead < 0x80:
            return 0
    return 0


_TABLES: dict[str, tuple[MergeTable, Encoder]] = {}


def worker_tables(content: bytes) -> tuple[MergeTable, Encoder]:
    """One table and encoder for a tokenizer's content in each Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        table = MergeTable(content)
        _TABLES[key] = table, Encoder(table)
    return _TABLES[key]


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add `out`, the token ids of each whole text. The file (a few MB) is read once and broadcast."""
    return _run(df, tokenizer_path, text_col, None, out, None)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded", as_bytes: bool | None = None) -> DataFrame:
    """Add `out`, the text that each row's ids decode to (null ids: empty)."""
    return _run(df, tokenizer_path, None, ids_col, None, out, as_bytes)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", as_bytes: bool | None = None) -> DataFrame:
    """encode and decode in one pass over the rows."""
    return _run(df, tokenizer_path, text_col, None, ids, decoded, as_bytes)


def _run(df: DataFrame, path: str, text_col: str | None, ids_col: str | None, ids_out: str | None, text_out: str | None, as_bytes: bool | None = None) -> DataFrame:
    with open(path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    fields = [T.StructField(ids_out, T.ArrayType(T.IntegerType(), False))] if ids_out else []
    fields += [T.StructField(text_out, T.StringType())] if text_out else []
    schema = _with(df, *fields)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]

    def make():
        table, encoder = worker_tables(content.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            if text_col is not None:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                rows = [np.frombuffer(encoder.packed(x), np.int32) if x else np.empty(0, np.int32) for x in texts]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            else:
                rows = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            if text_out:
                decoded = []
                for r in rows:
                    machine = Decoder(table, as_bytes)
                    decoded.append("".join([machine.feed(r[i : i + 4096].tolist()) for i in range(0, len(r), 4096)]) + machine.finish())
                columns.append(pa.array(decoded, pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

        return step

    return map_batches(df, make, schema)
