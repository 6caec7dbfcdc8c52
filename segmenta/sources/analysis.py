"""Text for analysis: names restored, tags gone, and an account of which places are protected or opaque (PR16, DT8).

Tokens of inline tags vanish; a token that stands for a whole element leaves the element's visible text behind, as an
opaque place; a name's token leaves the name, as a protected place. Words that touch an opaque place are not mined, those in
a protected one are marked. Places are sorted, so a word is looked up by bisection.

Defined results: unknown tokens stay as they are; an empty block has no words.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter

from pyspark.sql import DataFrame

from segmenta.sources import texts, xhtml

_TOKEN = re.compile(r"__(?:TAG|NAME)_\d+__")
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
Places = list[tuple[int, int]]


def prepared(block: str, tokens: list[str], originals: list[str]) -> tuple[str, Places, Places]:
    """(text, opaque places, protected places) of a block."""
    known = dict(zip(tokens, originals, strict=True))
    out: list[str] = []
    opaque: Places = []
    protected: Places = []
    at = length = 0

    def put(piece: str, places: Places | None = None) -> None:
        nonlocal length
        if places is not None and piece:
            places.append((length, length + len(piece)))
        out.append(piece)
        length += len(piece)

    for m in _TOKEN.finditer(block):
        if m[0] in known:
            put(block[at : m.start()])
            original = known[m[0]]
            if "_NAME_" in m[0]:
                put(original, protected)
            elif original.count("<") > 1 and not original.startswith("<!"):
                put(html.unescape(re.sub(r"<[^>]*>", "", original)), opaque)
            at = m.end()
    put(block[at:])
    return "".join(out), opaque, protected


def touches(places: Places, start: int, end: int) -> bool:
    """Whether a place of a sorted list without overlaps shares a character with [start, end)."""
    k = bisect.bisect_left(places, (end,))
    return k > 0 and places[k - 1][1] > start


def words(block: str, tokens: list[str], originals: list[str]) -> list[tuple[str, int, bool]]:
    """(word, place, protected) of a block's words outside opaque places."""
    text, opaque, protected = prepared(block, tokens, originals)
    return [(m[0], m.start(), touches(protected, *m.span())) for m in _WORD.finditer(text) if not touches(opaque, *m.span())]


def mined(spans: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(keys, pos, word, place, protected) of the spans of `texts.xhtml_spans`."""
    return texts.explode_texts(spans.where("block IS NOT NULL"), keys, ["block", "tokens", "tags"], {"word": "string", "place": "long", "protected": "boolean"}, lambda b, t, o: words(b, t or [], o or []))


def counted(pages: DataFrame, keys: dict[str, str], column: str) -> DataFrame:
    """(keys, word, n): how often each word of a page's spans is mined; neither spans nor single words leave the worker."""

    def work(page: str) -> list[tuple[str, int]]:
        found: Counter[str] = Counter()
        for _, _, _, text, tokens, tags, _ in xhtml.spans(page):
            found.update(w for w, _, _ in words(text, tokens, tags))
        return list(found.items())

    return texts.explode_texts(pages, keys, [column], {"word": "string", "n": "long"}, work).drop("pos")
