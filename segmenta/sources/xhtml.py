"""SC4, PR12: pages as spans of their leaf blocks, and back.

A page is read as a row of tags, references and texts, each with its place. A run of inline content between two block
tags is a span: its tags become tokens `__TAG_nnn__` in order, an opaque element is one token with everything in it, white
space is folded and character references are decoded. What was folded or decoded is remembered in order, character by
character, so an unchanged span goes back to the same bytes, and a translated one keeps as many of these as it still has.

Defined results: what stands in head, scripts, styles and `pre`, in comments and declarations, is no text; runs without
text give no span; unclosed elements end with the page; an empty page gives no span.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# Elements whose runs are blocks of their own, and inline elements kept whole.
BLOCKS = set(
    "p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd figcaption caption div section article aside header footer main body nav html ul ol dl table thead tbody tfoot tr figure form fieldset details summary address hr search menu option select center".split()
)
OPAQUE = set("code kbd samp var tt math svg img audio video object iframe picture canvas button textarea".split())
VOID = set("br hr img wbr input meta link area base col embed source track param".split())
#: No text in them.
SKIPPED = set("head script style pre template noscript title".split())
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[?!][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][\w:.-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)
# A blank that stands alone is plain; a match is short, since the expression keeps its way through it.
_UNIT = re.compile(r"(?P<space>[\x20\t\n\f\r]{2,}|[\t\n\f\r])|(?P<reference>&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)|(?P<plain>(?:[^\x20\t\n\f\r&]+|\x20(?![\x20\t\n\f\r])){1,99}|&)", re.S)
_TOKEN = re.compile(r"__TAG_\d+__")
_PLAIN = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def parts(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, element, start, end) of texts, tags ("open", "close") and "other" marks, in order; scripts and styles are one "other"."""
    at = 0
    while m := _PART.search(page, at):
        if m.start() > at:
            yield "text", "", at, m.start()
        name, end = (m["name"] or "").lower(), m.end()
        if name in ("script", "style") and not m["close"] and not m[0].endswith("/>"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            end = stop.end() if stop else len(page)
            yield "other", "", m.start(), end
        else:
            yield ("close" if m["close"] else "open" if name else "other"), name, m.start(), end
        at = end
    if at < len(page):
        yield "text", "", at, len(page)


def _runs(page: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(element, pieces) of each run of inline content: pieces are ("text" or "tag", start, end)."""
    stack: list[str] = []
    run: list[tuple[str, int, int]] = []
    skipped, depth = "", 0
    for kind, name, start, end in parts(page):
        alone = name in VOID or page[end - 2 : end] == "/>"
        if skipped:
            if name == skipped and not alone:
                depth += 1 if kind == "open" else -1
            if depth == 0:
                if skipped in OPAQUE:
                    run[-1] = ("tag", run[-1][1], end)
                skipped = ""
        elif kind == "text":
            run.append(("text", start, end))
        elif kind == "other":
            run.append(("tag", start, end))
        elif name in SKIPPED or name in BLOCKS:
            yield (stack[-1] if stack else ""), run
            run = []
            if name in SKIPPED:
                skipped, depth = ("", 0) if kind == "close" or alone else (name, 1)
            elif kind == "open" and not alone:
                stack.append(name)
            elif kind == "close" and name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        else:
            run.append(("tag", start, end))
            if name in OPAQUE and kind == "open" and not alone:
                skipped, depth = name, 1
    yield (stack[-1] if stack else ""), run


def _span(page: str, run: list[tuple[str, int, int]]) -> tuple[str, list[str], dict[str, list[str]]]:
    """(text, tags, forms) of a run; forms: how each character that is not written plainly was written, by occurrence."""
    out: list[str] = []
    tags: list[str] = []
    written: list[tuple[str, str | None]] = []
    odd: set[str] = set()
    inside = {m[0] for kind, a, b in run if kind == "text" for m in _TOKEN.finditer(page, a, b)}
    number = 0
    for kind, a, b in run:
        if kind == "tag":
            number += 1
            while f"__TAG_{number:03d}__" in inside:
                number += 1
            tags.append(page[a:b])
            out.append(f"__TAG_{number:03d}__")
            continue
        for m in _UNIT.finditer(page, a, b):
            if m["space"]:
                out.append(" ")
                written.append((" ", m[0]))
                odd.add(" ")
            elif m["reference"] and len(c := html.unescape(m[0])) == 1 and c not in " \t\n\f\r":
                out.append(c)
                written.append((c, m[0]))
                odd |= {c} if _PLAIN.get(c) != m[0] else set()
            else:
                out.append(m[0])
                written.append((m[0], None))
                odd |= {c for c in _PLAIN if c in m[0]}
    forms: dict[str, list[str]] = {}
    for plain, raw in written if odd else ():
        for c in (plain,) if raw is not None else odd:
            if c in odd and (n := plain.count(c)):
                forms.setdefault(c, []).extend([c if raw is None else raw] * n)
    return "".join(out), tags, forms


def refill(block: str, tokens: list[str], tags: list[str], forms: dict[str, list[str]]) -> str:
    """The raw content of a block: tokens as their tags, characters as they were written, by occurrence."""
    raw = dict(zip(tokens, tags, strict=True))
    seen: Counter[str] = Counter()
    out, at = [], 0
    other = re.compile(f"[&<>{re.escape(''.join(forms))}]") if forms else None

    def form(m: re.Match) -> str:
        if (c := m[0]) not in forms:
            return _PLAIN[c]
        seen[c] += 1
        return forms[c][min(seen[c], len(forms[c])) - 1]

    def text(piece: str) -> None:
        out.append(other.sub(form, piece) if other else html.escape(piece, quote=False))

    for m in _TOKEN.finditer(block):
        if m[0] in raw:
            text(block[at : m.start()])
            out.append(raw[m[0]])
            at = m.end()
    text(block[at:])
    return "".join(out)


def spans(page: str) -> Iterator[tuple[str, int, int, str, list[str], list[str], dict[str, list[str]]]]:
    """(element, start, end, text, tokens, tags, forms) of each block with text, without the white space around it."""
    for element, run in _runs(page):
        while run and run[0][0] == "text" and not page[run[0][1] : run[0][2]].strip(" \t\n\f\r"):
            run = run[1:]
        while run and run[-1][0] == "text" and not page[run[-1][1] : run[-1][2]].strip(" \t\n\f\r"):
            run = run[:-1]
        if not any(kind == "text" and page[a:b].strip(" \t\n\f\r") for kind, a, b in run):
            continue
        kind, a, b = run[0]
        if kind == "text":
            run = [(kind, a + len(page[a:b]) - len(page[a:b].lstrip(" \t\n\f\r")), b), *run[1:]]
        kind, a, b = run[-1]
        if kind == "text":
            run = [*run[:-1], (kind, a, a + len(page[a:b].rstrip(" \t\n\f\r")))]
        text, tags, forms = _span(page, run)
        own = {m[0] for kind, a, b in run if kind == "text" for m in _TOKEN.finditer(page, a, b)}
        tokens = [t for t in _TOKEN.findall(text) if t not in own]
        yield element, run[0][1], run[-1][2], text, tokens, tags, forms


def rows(page: str) -> list[tuple[str, str | None, str, list[str], list[str], str]]:
    """(element, block, before, tokens, tags, content) of each span, and a row of kind "tail" with what stands behind the last."""
    out, at = [], 0
    for element, start, end, text, tokens, tags, forms in spans(page):
        out.append((element, text, page[at:start], tokens, tags, refill(text, tokens, tags, forms)))
        at = end
    return [*out, ("tail", None, page[at:], [], [], "")]


def with_forms(page: str) -> list[tuple[str | None, str, list[str], list[str], dict[str, list[str]]]]:
    """(block, before, tokens, tags, forms) of each span, for `refill` with another text; at the end a row without block."""
    out, at = [], 0
    for _, start, end, text, tokens, tags, forms in spans(page):
        out.append((text, page[at:start], tokens, tags, forms))
        at = end
    return [*out, (None, page[at:], [], [], {})]
