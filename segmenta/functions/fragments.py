"""Inline-XHTML fragments: one event pass gives a fragment's skeleton, opaque parts and visible text.

A fragment that is null counts as empty; one that does not parse has no shape, and only that is reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from segmenta.sources.batches import pieces

# Elements that no inline fragment may hold, and those kept as they are.
FORBIDDEN = set("p div section article body html table tr td ul ol li blockquote h1 h2 h3 h4 h5 h6 script style".split())
OPAQUE = set("code kbd samp var tt math svg img audio video object iframe".split())


@dataclass
class Shape:
    events: list[tuple] = field(default_factory=list)
    skeleton: list[tuple] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(e[1] for e in self.events if e[0] == "text")

    def elements(self) -> Iterator[tuple[str, tuple]]:
        return ((e[1], tuple(sorted(e[2]))) for e in self.events if e[0] == "start")

    def opaque(self) -> list[tuple]:
        """Events of each opaque element, up to its end and the text that follows it."""
        out, depth = [], 0
        open_at: list[tuple[int, int]] = []
        ends: dict[int, int] = {}
        for k, e in enumerate(self.events):
            if e[0] == "start":
                open_at.append((k, depth))
                depth += 1
            elif e[0] == "end":
                depth -= 1
                ends[open_at.pop()[0]] = k
        for k, e in enumerate(self.events):
            if e[0] == "start" and e[1] in OPAQUE:
                stop = ends[k] + 1
                stop += stop < len(self.events) and self.events[stop][0] == "text"
                out.append(tuple(self.events[k:stop]))
        return out


def shape(fragment: str | None) -> Shape | None:
    fragment = fragment or ""
    if "<!--" in fragment or "<?" in fragment:
        return None
    out, bare, depth = Shape(), [], 0
    parser = expat.ParserCreate(namespace_separator="}")
    parser.ordered_attributes = True

    def start(name: str, flat: list[str]) -> None:
        nonlocal depth
        depth += 1
        if depth == 1:
            return
        if bare:
            bare[-1] = None
        tag, attrs = name.rpartition("}")[2], tuple(zip(flat[::2], flat[1::2], strict=True))
        out.events.append(("start", tag, attrs))
        bare.append(len(out.skeleton))
        out.skeleton.append(("start", tag, tuple(sorted(attrs))))

    def end(name: str) -> None:
        nonlocal depth
        depth -= 1
        if not depth:
            return
        tag, at = name.rpartition("}")[2], bare.pop()
        out.events.append(("end", tag))
        if at is None:
            out.skeleton.append(("end", tag))
        else:
            out.skeleton[at] = ("empty", *out.skeleton[at][1:])

    def text(data: str) -> None:
        if bare:
            bare[-1] = None
        if out.events and out.events[-1][0] == "text":
            data = out.events.pop()[1] + data
        out.events.append(("text", data))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(f"<fragment>{fragment}</fragment>", True)
    except expat.ExpatError:
        return None
    return out


def issues(source: str | None, target: str | None) -> Counter[tuple[str, str]]:
    """(severity, rule) of each breach of a target fragment, with its number."""
    found: Counter[tuple[str, str]] = Counter()
    before = shape(source)
    after = before if target == source else shape(target)
    found["error", "inline_xhtml_parseable"] = (before is None) + (after is None)
    if before is not None and after is not None:
        allowed = set(before.elements())
        tags = {tag for tag, _ in allowed}
        for tag, attrs in after.elements():
            found["error", "inline_xhtml_no_block_tags"] += tag in FORBIDDEN
            found["error", "inline_xhtml_preserved"] += tag not in tags
            handlers = sum(name.lower().startswith("on") for name, _ in attrs)
            found["error", "inline_xhtml_no_new_attributes"] += ((tag, attrs) not in allowed) + handlers
        found["error", "inline_xhtml_preserved"] += before.skeleton != after.skeleton
        found["error", "inline_xhtml_opaque_preserved"] += before.opaque() != after.opaque()
        found["error", "inline_xhtml_visible_text_not_empty"] += not after.text.strip()
        found["warn", "dash_semantic_cue_missing"] += any(c in (source or "") for c in "–—") and not any(c in (target or "") for c in "–—")
    return +found


def fragment_findings(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, severity, rule, n for each pair (source, target); no shuffle."""
    kept = df.select(*keys, "source", "target")
    schema = ", ".join([*[f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys], "severity string", "rule string", "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sources, targets = (batch.column(len(keys) + i).to_pylist() for i in range(2))
            rows = [(k, *rule, n) for k, pair in enumerate(zip(sources, targets, strict=True)) for rule, n in issues(*pair).items()]
            at, severity, rule, n = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(severity, pa.string()), pa.array(rule, pa.string()), pa.array(n, pa.int64())], names=[*keys, "severity", "rule", "n"])

    return kept.mapInArrow(run, schema)
