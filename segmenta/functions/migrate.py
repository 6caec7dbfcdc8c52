"""Targets that lost a source's only element get it back where that is safe; names protected in text nodes alone (SK18, PR2, PR4).

Fragments are read as parts with offsets, so what is put in stands between characters and nothing else moves. Defined
results: nulls are empty; a target that breaks no rule is left alone; a name that is found nowhere has no token.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from segmenta.functions.fragments import issues
from segmenta.sources.batches import pieces
from segmenta.sources.xhtml import parts


def _errors(source: str, target: str) -> bool:
    return any(severity == "error" for severity, _ in issues(source, target))


def _only_element(source: str) -> tuple[int, int, int, int] | None:
    """Where the opening and the closing tag of a source's only element lie."""
    marks = [p for p in parts(source) if p[0] != "text"]
    if [m[0] for m in marks] != ["open", "close"] or marks[0][1] != marks[1][1] or source[marks[0][3] - 2] == "/":
        return None
    return marks[0][2], marks[0][3], marks[1][2], marks[1][3]


def migrated(source: str, target: str) -> str | None:
    """SK18: the target with the source's element around all of it, if the source has nothing outside, or else around its only occurrence of the element's text."""
    found = _only_element(source)
    if found is None:
        return None
    start, inner, close, end = found
    opening, closing = source[start:inner], source[close:end]
    tries = []
    if not (source[:start] + source[end:]).strip() and "<" not in target and ">" not in target:
        tries.append(opening + target + closing)
    phrase = html.unescape(source[inner:close]).strip()
    if phrase:
        raw = html.escape(phrase, quote=False)
        # in text nodes alone: what stands in a tag is no text
        places = [m.start() + a for kind, _, a, b in parts(target) if kind == "text" for m in re.finditer(re.escape(raw), target[a:b])]
        if len(places) == 1:
            tries.append(target[: places[0]] + opening + raw + closing + target[places[0] + len(raw) :])
    return next((t for t in tries if not _errors(source, t)), None)


def migrations(pairs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(keys, new_target, action) of the pairs (source, target) that break a rule: `mapped`, or `review` where it is not safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, new = [], []
            for k, (source, target) in enumerate(zip(*(batch.column(len(keys) + i).to_pylist() for i in range(2)), strict=True)):
                if _errors(source or "", target or ""):
                    at.append(k)
                    new.append(migrated(source or "", target or ""))
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(new, pa.string()), pa.array(["review" if n is None else "mapped" for n in new], pa.string())], names=[*keys, "new_target", "action"])

    schema = ", ".join(f"{n} {t}" for n, t in [*keys.items(), ("new_target", "string"), ("action", "string")])
    return pairs.select(*keys, "source", "target").mapInArrow(run, schema)


def protect_names(text: str, names: list[str], first: int = 1) -> tuple[str, list[tuple[str, str]]]:
    """PR2: names as tokens, numbered by where they appear first, of two at one place the longer; with (token, name) of each.

    Where names lie in each other the longest is taken; each name found has its token, whether or not it stands alone.
    """
    found = sorted((text.find(n), -len(n), n) for n in dict.fromkeys(names) if n and n in text)
    token = {n: f"__NAME_{first + k:03d}__" for k, (_, _, n) in enumerate(found)}
    if not token:
        return text, []
    either = re.compile("|".join(re.escape(n) for n in sorted(token, key=len, reverse=True)))
    return either.sub(lambda m: token[m[0]], text), [(t, n) for n, t in token.items()]


def protect_names_in_text(fragment: str, names: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """PR4: names in text nodes, never in tags, numbered node by node."""
    out, tokens = [], []
    for kind, _, a, b in parts(fragment):
        piece = fragment[a:b]
        if kind == "text":
            piece, made = protect_names(piece, names, 1 + len(tokens))
            tokens += made
        out.append(piece)
    return "".join(out), tokens
