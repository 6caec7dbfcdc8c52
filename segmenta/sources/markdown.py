"""SC2, SC3, PR11, SK2: Markdown as prose spans with source offsets, and back.

A line is read against a stack of open containers (block quotes and list items); what is left of it opens new
containers or belongs to a leaf: prose, or code, HTML and rules, which are no prose. Every span keeps where its lines
lie in the text, so the rest of the text is the template: putting the same lines back gives the same text, byte for byte.

Defined results: front matter, code, HTML blocks, link definitions and empty cells give no span; an empty text gives none.
A span that comes back with more lines than it had repeats its last line's prefix; one with fewer leaves prefixes out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FRONT = re.compile(r"\A---\r?\n(.*?\r?\n)---\r?\n?", re.S)
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_BULLET, _NUMBER = re.compile(r"[-*+](?=[ \t]|$)"), re.compile(r"(\d{1,9})[.)](?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
_BAR = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"\[(?:[^\]\\]|\\.)+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
# HTML elements that begin a block on their own.
BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
#: How an HTML block begins, and what ends it; None: a blank line.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile("<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile("<![A-Za-z]"), re.compile(">")),
    (re.compile(r"<!\[CDATA\["), re.compile("]]>")),
    (re.compile(rf"</?(?:{'|'.join(BLOCK_NAMES.split())})(?:[\s/>]|$)", re.I), None),
]
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_LONE_TAG = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


def front_matter(text: str) -> tuple[str, str]:
    """SC2: the leading block between lines of three dashes, with them, and the rest."""
    m = FRONT.match(text)
    return (m[0], text[m.end() :]) if m else ("", text)


@dataclass
class Span:
    kind: str
    #: Where the span's lines lie in the text.
    lines: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class _Open:
    """An open container: a quote, or an item whose content stands `indent` columns in."""

    kind: str
    indent: int = 0


class _Line:
    """What is left of a line: how far it has been read, in characters and columns."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.at, self.end, self.column = text, start, end, 0

    def indent(self) -> int:
        """Columns of white space that come next."""
        k, column = self.at, self.column
        while k < self.end and self.text[k] in " \t":
            column += 1 if self.text[k] == " " else 4 - column % 4
            k += 1
        return column - self.column

    def skip(self, columns: int | None = None) -> None:
        """Pass over so many columns of white space, or all."""
        goal = None if columns is None else self.column + columns
        while self.at < self.end and self.text[self.at] in " \t" and (goal is None or self.column < goal):
            self.column += 1 if self.text[self.at] == " " else 4 - self.column % 4
            self.at += 1

    def take(self, n: int) -> None:
        self.at, self.column = self.at + n, self.column + n

    @property
    def rest(self) -> str:
        return self.text[self.at : self.end]

    @property
    def blank(self) -> bool:
        return not self.rest.strip()


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self.stack: list[_Open] = []
        self.prose: Span | None = None
        #: A table's number of columns, the mark that ends a fence, and what ends an HTML block ("" for a blank line).
        self.columns, self.fence, self.html, self.code = 0, "", None, False

    def kind(self) -> str:
        return self.stack[-1].kind if self.stack else "paragraph"

    def close(self) -> None:
        """End the leaf; link definitions that a paragraph begins with are no prose."""
        if self.prose:
            lines = [(a, b) for a, b in self.prose.lines]
            while lines and _DEFINITION.match(self.text[slice(*lines[0])]):
                lines.pop(0)
            if lines:
                self.spans.append(Span(self.prose.kind, lines))
        self.prose, self.columns, self.fence, self.html, self.code = None, 0, "", None, False

    def read(self, start: int) -> list[Span]:
        at = start
        bounds = []
        for m in re.finditer(r"[^\r\n]*(?:\r\n|\n|\r|\Z)", self.text[start:]):
            if m[0]:
                bounds.append((at, at + len(m[0].rstrip("\r\n"))))
                at += len(m[0])
        for k, (a, b) in enumerate(bounds):
            self.line(_Line(self.text, a, b), _Line(self.text, *bounds[k + 1]) if k + 1 < len(bounds) else None)
        self.close()
        return self.spans

    def line(self, line: _Line, after: _Line | None) -> None:
        kept = 0
        for c in self.stack:
            if c.kind == "quote":
                if line.indent() > 3 or not line.rest.lstrip(" \t").startswith(">"):
                    break
                line.skip()
                line.take(1)
                line.skip(min(1, line.indent()))
            elif line.blank:
                pass
            elif line.indent() >= c.indent:
                line.skip(c.indent)
            else:
                break
            kept += 1
        whole = kept == len(self.stack)
        if whole and self.fence:
            rest = line.rest.strip()
            if line.indent() <= 3 and rest.startswith(self.fence) and not rest.strip(self.fence[0]):
                self.close()
            return
        if whole and self.html is not None:
            if self.html and self.html.search(line.rest) or not self.html and line.blank:
                self.close()
            return
        if not whole and not (self.prose and not self.columns and not line.blank and self.goes_on(line)):
            self.close()
            del self.stack[kept:]
        elif not whole:
            self.add(line)
            return
        self.containers(line)
        self.leaf(line, after)

    def goes_on(self, line: _Line) -> bool:
        """Whether a paragraph takes a line that lacks its containers' marks: what would begin nothing else."""
        rest = line.rest.lstrip(" \t")
        return line.indent() > 3 or not (rest.startswith(">") or _BULLET.match(rest) or _NUMBER.match(rest) or _ATX.match(rest) or _FENCE.match(rest) or _RULE.match(rest) or any(begin.match(rest) for begin, _ in _HTML))

    def containers(self, line: _Line) -> None:
        while line.indent() <= 3 and not line.blank:
            rest = line.rest.lstrip(" \t")
            bullet, number = _BULLET.match(rest), _NUMBER.match(rest)
            if rest.startswith(">"):
                self.close()
                line.skip()
                line.take(1)
                line.skip(min(1, line.indent()))
                self.stack.append(_Open("quote"))
            elif (bullet or number) and not _RULE.match(rest):
                mark = (bullet or number)[0]
                empty = not rest[len(mark) :].strip()
                if self.prose and not self.columns and (empty or number and int(number[1]) != 1) and not (self.stack and self.stack[-1].kind == "item"):
                    return
                self.close()
                before = line.indent()
                line.skip()
                line.take(len(mark))
                gap = line.indent()
                wide = 1 if empty or gap > 4 else gap
                line.skip(min(wide, gap))
                self.stack.append(_Open("item", before + len(mark) + wide))
            else:
                return

    def leaf(self, line: _Line, after: _Line | None) -> None:
        if line.blank:
            if not self.code:
                self.close()
            return
        deep = line.indent() > 3
        if self.code:
            if deep:
                return
            self.close()
        if deep and not self.prose and not self.columns:
            self.code = True
            return
        rest = line.rest.lstrip(" \t")
        if not deep:
            if m := _FENCE.match(rest):
                self.close()
                self.fence = m[1] or m[2]
                return
            if m := _ATX.match(rest):
                self.close()
                self.heading(line, m.end())
                return
            for begin, end in _HTML:
                if begin.match(rest):
                    self.close()
                    if end is None or not end.search(rest):
                        self.html = end or ""
                    return
            if not self.prose and _LONE_TAG.match(rest):
                self.html = ""
                return
            if self.prose and not self.columns and _UNDERLINE.match(rest):
                self.prose.kind = "heading"
                self.close()
                return
            if _RULE.match(rest):
                self.close()
                return
        if self.columns or after and "|" in rest and not self.prose and "|" in after.rest and self.bar(after) == len(self.cells(line)):
            first = not self.columns
            self.columns = self.columns or len(self.cells(line))
            if first or not _BAR.match(rest):
                self.spans += [Span("cell", [c]) for c in self.cells(line) if c[0] < c[1]]
            return
        self.add(line)

    def bar(self, line: _Line) -> int:
        """Columns of a table's second line, which may stand behind containers' marks; 0: no such line."""
        rest = line.rest.lstrip(" \t>")
        return len(rest.strip().strip("|").split("|")) if _BAR.match(rest) else 0

    def cells(self, line: _Line) -> list[tuple[int, int]]:
        line_start = line.at + len(line.rest) - len(line.rest.lstrip(" \t"))
        stop = line.at + len(line.rest.rstrip())
        marks = [m.start() for m in re.finditer(r"(?<!\\)\|", self.text[line_start:stop])]
        edges = [-1, *marks, stop - line_start]
        if marks and marks[0] == 0:
            edges.pop(0)
        if marks and marks[-1] == stop - line_start - 1:
            edges.pop()
        return [self.trimmed(line_start + a + 1, line_start + b) for a, b in zip(edges, edges[1:], strict=False)]

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        piece = self.text[a:b]
        return (a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())) if piece.strip() else (a, a)

    def heading(self, line: _Line, mark: int) -> None:
        start = line.at + len(line.rest) - len(line.rest.lstrip(" \t")) + mark
        a, b = self.trimmed(start, line.end)
        closing = re.search(r"(?:^|[ \t]+)#+$", self.text[a:b])
        a, b = self.trimmed(a, a + closing.start()) if closing else (a, b)
        if a < b:
            self.spans.append(Span("heading", [(a, b)]))

    def add(self, line: _Line) -> None:
        self.prose = self.prose or Span(self.kind())
        self.prose.lines.append(self.trimmed(line.at, line.end))


def spans(text: str) -> list[Span]:
    """SC3: the text's prose in order."""
    return _Reader(text).read(len(front_matter(text)[0]))


def rows(text: str) -> list[tuple[str, str | None, str, list[str]]]:
    """(kind, block, before, joints) of each span, and a row of kind "tail" with what stands behind the last.

    before is the text since the span before, joints what stands between the span's lines.
    """
    out, at = [], 0
    for s in spans(text):
        joints = [text[s.lines[i][1] : s.lines[i + 1][0]] for i in range(len(s.lines) - 1)]
        out.append((s.kind, "\n".join(text[a:b] for a, b in s.lines), text[at : s.lines[0][0]], joints))
        at = s.lines[-1][1]
    return [*out, ("tail", None, text[at:], [])]
