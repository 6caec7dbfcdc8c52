"""Main text of web pages by nearest-URL page differencing.

Pages become lines: one for each block element, white space folded, references decoded, markup, scripts
and styles gone. Elements whose name, role or class says menu, header, footer, sidebar, notice, advert,
form or reader comment are dropped with their content, and where a page marks its article (article, main or
role=main), its lines are the ones inside. Every page is then paired with the page of the same host whose URL
path is nearest in sorted order (the longer common path wins, then the earlier page), both pages' lines are
aligned by a longest common subsequence, and the lines they share are deleted - but for lines that the
page vouches for: paragraphs, headings, list items, cells and the like inside its marked article, which may
well be quoted by the next page. Where nearly the whole of a page is shared, the pair are perhaps copies: then a
line goes only if the page's other neighbour shares it too.

Neighbours are found in ranges of (host, path), so a host with a third of all pages is split over tasks;
only the ranges' border rows are looked at together. Between ranges only line hashes travel.

Defined results: null or empty html, or a page without text, gives the empty text; null URLs form one host
with an empty path; equal rows each get a row; tags left open at the end are closed there.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import durable, map_batches, stored

# Element names, and words in class, id or role, by what they mean for the main text.
DROPPED = set("nav footer aside form script style noscript template select button iframe svg menu dialog head object canvas textarea fieldset".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg")
BLOCKS = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose lines a marked article vouches for.
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond discussion disqus related recommended breadcrumb breadcrumbs menu menubar nav navbar navigation footer masthead pagination pager toolbar search widget skip complementary contentinfo".split()
)
#: Where a pair shares more than this part of a page's characters, the other neighbour is asked too.
COPY = 0.8
#: Pages that lose lines are broadcast up to this number; beyond, they and the texts meet by a shuffle.
BROADCAST_ROWS = 500_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def marked(attributes: str) -> bool:
    return any(set(re.split(r"[^a-z]+", next(filter(None, m.groups()[1:]), "").lower())) & MARKS for m in _NAMES.finditer(attributes))


def is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(re.search(r"""\brole\s*=\s*["']?(main|article)\b""", attributes, re.I))


def lines_of(page: str) -> tuple[bool, list[str], list[str], list[bool]]:
    """(has a marked article, its lines, lines outside it, for each line inside: whether prose elements hold it)."""
    inside: list[str] = []
    outside: list[str] = []
    prose: list[bool] = []
    has, buffer, block = False, [], ""
    # an element being dropped, or the article being read: its name and how many of that name are open
    drop = main = None
    drop_depth = main_depth = 0
    keep_raw = False

    def close() -> None:
        if buffer:
            line = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if line and main:
                inside.append(line)
                prose.append(block in PROSE)
            elif line:
                outside.append(line)

    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = n if stop < 0 else stop
            if drop is None:
                buffer.append(page[at:stop])
            at = stop
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0] == "<" and drop is None:
                buffer.append(m[0])
            continue
        name, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not ends and name in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if drop is not None:
            if name == drop:
                drop_depth += -1 if ends else 0 if attributes.endswith("/") else 1
            if drop_depth <= 0:
                drop, drop_depth = None, 0
            elif not ends and is_main(name, attributes) and not marked(attributes) and not has and not keep_raw:
                # a container left open must not swallow the article
                drop, drop_depth = None, 0
            else:
                continue
            if ends:
                continue
        if name in BLOCKS:
            close()
            if name != "br":
                block = "" if ends else name
        if ends:
            if main == name:
                main_depth -= 1
                if main_depth <= 0:
                    main = None
            continue
        header = name == "header" and main is None
        if name not in VOID and not attributes.endswith("/") and (name in DROPPED or header or (name not in ("html", "body") and marked(attributes) and not (main is None and is_main(name, attributes)))):
            close()
            drop, drop_depth = name, 1
            keep_raw = bool(re.search(r"comment|respond|discussion", attributes, re.I))
            continue
        if main is None and is_main(name, attributes):
            main, main_depth, has = name, 1, True
        elif main == name:
            main_depth += 1
    close()
    return has, inside, outside, prose


def _reach(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of `a` and each prefix of `b`, with b's places as the bits of one number."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of a longest common subsequence of both.

    Halves of `a` are met with the parts of `b` where their lengths add up to most (Hirschberg), lengths are found bit-parallel,
    so repeated lines cost no more than others: memory is linear, time a 64th of the product of what both share.
    """
    shared = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in shared]
    out: list[int] = []
    todo = [(0, [a[i] for i in places], [x for x in b if x in shared])]
    while todo:
        at, x, y = todo.pop()
        start = 0
        while start < min(len(x), len(y)) and x[start] == y[start]:
            start += 1
        end = 0
        while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
            end += 1
        out += [*range(at, at + start), *range(at + len(x) - end, at + len(x))]
        at, x, y = at + start, x[start : len(x) - end], y[start : len(y) - end]
        if len(x) == 1:
            out += [at] if x[0] in y else []
        elif x and y:
            half = len(x) // 2
            k = int(np.argmax(_reach(x[:half], y) + _reach(x[half:][::-1], y[::-1])[::-1]))
            todo += [(at, x[:half], y[:k]), (at + half, x[half:], y[k:])]
    return [places[i] for i in sorted(out)]


def address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), re.sub(r"\.[a-z]{2,5}$", "", parts.path.rstrip("/"))
    except ValueError:
        return "", url or ""


def shared_prefix(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def parse(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row, id, url, host, path, lines, hashes, sizes): lines of the article, or all if none is marked; sizes, a
    line's characters, are negative for lines that the page vouches for."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, ids, urls, pages = (c for c in batch.columns)
            host, path, lines, hashes, sizes = [], [], [], [], []
            for url, page in zip(urls.to_pylist(), pages.to_pylist(), strict=True):
                h, p = address(url)
                has, inside, outside, prose = lines_of(page or "")
                host.append(h)
                path.append(p)
                lines.append(inside if has else outside)
                hashes.append([xxhash.xxh64_intdigest(x) >> 1 for x in lines[-1]])
                sizes.append([-len(x) if sure else len(x) for x, sure in zip(inside, prose, strict=True)] if has else [len(x) for x in outside])
            return pa.RecordBatch.from_arrays(
                [rows, ids, urls, pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                names=["row", "id", "url", "host", "path", "lines", "hashes", "sizes"],
            )

        return step

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, make, "row long, id long, url string, host string, path string, lines array<string>, hashes array<long>, sizes array<int>")


def neighbours(keys: DataFrame) -> DataFrame:
    """Keys with before and after: the pages next to each in order of host, path and row; of another host: null."""
    spark = keys.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = durable(keys.repartitionByRange(n, "host", "path", "row").withColumn("part", F.spark_partition_id()))
    here = F.struct("host", "path", "row", "hashes")
    order = Window.partitionBy("part").orderBy("host", "path", "row")
    # one row for each range: its first and last page
    ends = dealt.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    parts = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(parts).alias("left"), F.lead("first").over(parts).alias("right"))
    near = dealt.select("*", F.lag(here).over(order).alias("b"), F.lead(here).over(order).alias("a")).join(F.broadcast(ends), "part")
    before, after = F.coalesce("b", "left"), F.coalesce("a", "right")
    return near.select("row", "path", "hashes", "sizes", F.when(before["host"] == F.col("host"), before).alias("before"), F.when(after["host"] == F.col("host"), after).alias("after"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_deleted) for each page: the lines that differencing deleted are counted."""
    parsed = stored(parse(df, id_col, url_col, html_col))
    near = neighbours(parsed.select("row", "host", "path", "hashes", "sizes"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            gone = [difference(r["path"], r["hashes"], r["sizes"], r["before"], r["after"])[1] for r in batch.to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])

        return step

    # only pages that lose lines have a row here; texts are shuffled for them only if they are many
    gone = stored(map_batches(near, make, "row long, gone array<int>").where(F.size("gone") > 0))
    both = parsed.select("row", "id", "url", "lines").join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row", "left")
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.array_join(F.when(F.col("gone").isNotNull(), left).otherwise(F.col("lines")), "\n")
    deleted = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long")
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), deleted.alias("n_deleted"))


def difference(path: str, hashes: list[int], sizes: list[int], before: dict | None, after: dict | None) -> tuple[int, list[int]]:
    """How many lines the page shares with its nearer neighbour, and the positions of those to be deleted."""
    pair = sorted((x for x in (before, after) if x), key=lambda x: -shared_prefix(path, x["path"]))
    if not pair:
        return 0, []
    shared = common(hashes, pair[0]["hashes"])
    gone = [i for i in shared if sizes[i] > 0]
    if sum(abs(sizes[i]) for i in shared) > COPY * sum(map(abs, sizes)):
        other = set(common(hashes, pair[1]["hashes"])) if len(pair) > 1 else set()
        other = set() if len(other) == len(hashes) else other
        gone = [i for i in gone if i in other]
    return len(shared), gone
