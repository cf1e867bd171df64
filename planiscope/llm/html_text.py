"""Main text of web pages by differencing against the pages of nearest URL.

Pages are sorted by host and path over the cluster. A run of pages that are copies of each other (half of their text,
lines weighed by their squared lengths, is shared) is compared as a whole with the page before it and the page after it
on its host, so that copies get like texts. All text lines are aligned by longest common subsequence; what a page shares
with the one of nearest URL is the site's, not the article's, and goes. Inside an element that says it is the article
(article, main) one pair does not prove that: articles quote the same passages. There a line goes if both neighbours
have it, or if it is mostly links and one has it. Of the lines that differencing leaves, those go that stand in elements
that say they are something else: by tag, role, or a whole class name or id (nav, footer, form, "comments" and so on).
"""

from __future__ import annotations

import bisect
import html as _html
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

# What elements and their names say.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "map"}
SILENT = RAW | {"head", "button", "noscript", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "map"}
CONTAINERS = {"article", "main"}
BLOCKS = {
    *("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form"),
    *("h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "option", "caption", "legend"),
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMES = {
    *("ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus"),
    *("footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond"),
    *("share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I | re.S) for t in RAW}


@dataclass
class Line:
    text: str
    inside: bool  # of an element that says it is the article
    links: float  # share of its characters that are link text
    other: bool = False  # in an element that says it is not the article


@dataclass
class Page:
    page_id: int | None
    url: str | None
    host: str
    path: str
    lines: list[Line]
    packed: bytes = b""

    @classmethod
    def of(cls, page_id: int | None, url: str | None, host: str, path: str, html: str | None) -> Page:
        return cls(page_id, url, host, path, lines_of(html or ""))

    @classmethod
    def unpacked(cls, page_id: int | None, url: str | None, host: str, path: str, packed: bytes) -> Page:
        return cls(page_id, url, host, path, [Line(*x) for x in json.loads(zstandard.decompress(packed))], packed)

    @property
    def main(self) -> list[int]:
        """The lines that no element rules out."""
        contained = any(x.inside and not x.other for x in self.lines)
        return [i for i, x in enumerate(self.lines) if not x.other and (x.inside or not contained)]


def packed_lines(html: str | None) -> bytes:
    """The lines of a page, compressed: what is shuffled and stored instead of the page."""
    rows = [(x.text, x.inside, x.links, x.other) for x in lines_of(html or "")]
    return zstandard.compress(json.dumps(rows, ensure_ascii=False).encode(), 3)


def _says_other(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name = (m[1] or m[5] or "").lower()
        value = next((v for v in m.group(2, 3, 4) if v is not None), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(w in NAMES for w in value.split()) and tag not in CONTAINERS:
            return True
    return False


def lines_of(source: str) -> list[Line]:
    """Text lines of a page in order, without those of elements that hold no text for readers (head, scripts, forms' fields)."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, container, silent
    dropped = inside = in_link = silent = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, inside > 0, min(1.0, linked / len(text)), dropped > 0))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if not silent:
            parts.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    at = 0
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            take(source[at:])
            break
        if lt > at:
            take(source[at:lt])
        m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
        if m is None:
            take("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attrs = m[1] == "/", m[2].lower(), m[3]
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            take(" ")
        if closing:
            if tag == "a":
                in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, d, c, q in stack[k:]:
                        dropped -= d
                        inside -= c
                        silent -= q
                    del stack[k:]
                    break
            continue
        if tag == "a":
            in_link = 1
        if tag in VOID:
            continue
        other = _says_other(tag, attrs, inside > 0)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        container = tag in CONTAINERS
        if other or container or tag in ("div", "section", "ul", "ol", "header", "table", "span", "p", "body", "dl", "figure", "blockquote"):
            if tag == "p":  # a paragraph ends where the next begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        for _, d, c, q in stack[k:]:
                            dropped -= d
                            inside -= c
                            silent -= q
                        del stack[k:]
                        break
                    if stack[k][0] != "span":
                        break
            quiet = tag in SILENT or (other and tag not in BLOCKS)  # within a line such text goes at once
            stack.append((tag, other, container, quiet))
            dropped += other
            inside += container
            silent += quiet
    flush()
    return lines


#: Bits of rows that are kept for the walk back; more lines than that are split first.
ROW_BITS = 1 << 31


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indices of `a` in one longest common subsequence with `b`, by bit-parallel rows and a walk back.

    Rows take len(a) * len(b) bits; beyond ROW_BITS the lines of `a` are halved and those of `b` cut where the lengths of
    both sides add up to the longest (Hirschberg), again and again, so that the result is exact at every size.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    common = set(x) & set(y)
    xi = [i for i, v in enumerate(x) if v in common]
    y = [v for v in y if v in common]
    if not xi:
        return out
    if len(xi) > 1 and len(xi) * len(y) > ROW_BITS:
        half = len(xi) // 2
        left, right = [x[i] for i in xi[:half]], [x[i] for i in xi[half:]]
        cut = _cut(left, right, y)
        out |= {head + xi[i] for i in shared(left, y[:cut])}
        return out | {head + xi[half + i] for i in shared(right, y[cut:])}
    rows = list(_rows(x, xi, y))
    j = len(y) - 1
    for k in range(len(xi) - 1, -1, -1):  # a zero bit of row k at j: the length grows there
        while j >= 0 and rows[k] >> j & 1:
            j -= 1
        if j < 0:
            break
        if k and not rows[k - 1] >> j & 1:
            continue
        out.add(head + xi[k])
        j -= 1
    return out


def _rows(x: list[str], xi: Iterable[int], y: list[str]) -> Iterator[int]:
    """For every index of `x` in turn, the row whose zero bits say where in `y` the length grows."""
    places: dict[str, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | (1 << j)
    row = full = (1 << len(y)) - 1
    for i in xi:
        u = row & places.get(x[i], 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _cut(left: list[str], right: list[str], y: list[str]) -> int:
    """Where to cut `y` so that its parts have the most lines in common order with `left` and with `right`."""

    def grows(x: list[str], y: list[str]) -> list[bool]:
        row = (1 << len(y)) - 1
        for row in _rows(x, range(len(x)), y):
            pass
        return [v == "0" for v in format(row, f"0{len(y)}b")[::-1]]

    before, after = grows(left, y), grows(right[::-1], y[::-1])
    best = now = sum(after)
    at = 0
    for j in range(len(y)):
        now += before[j] - after[len(y) - 1 - j]
        if now > best:
            best, at = now, j + 1
    return at


def _nearness(a: Page, b: Page) -> tuple[int, int]:
    x, y = a.path.split("/"), b.path.split("/")
    whole = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    chars = next((i for i, (p, q) in enumerate(zip(a.path, b.path, strict=False)) if p != q), min(len(a.path), len(b.path)))
    return whole, chars


def copies(a: Page, b: Page) -> bool:
    """Whether half of the main text of either page, lines weighed by their squared lengths, is in common order in both."""
    x, y = ([p.lines[i].text for i in p.main] for p in (a, b))
    least = min(sum(len(t) ** 2 for t in x), sum(len(t) ** 2 for t in y))
    return least > 0 and 2 * sum(len(x[i]) ** 2 for i in shared(x, y)) >= least


def main_text(page: Page, before: Page | None, after: Page | None) -> str:
    """Kept lines joined by two line feeds; before and after are the pages beside the page's run in the order of URLs."""
    near = [p for p in (before, after) if p is not None and p.host == page.host]
    near.sort(key=lambda p: _nearness(page, p), reverse=True)
    own = [x.text for x in page.lines]
    gone = [shared(own, [x.text for x in p.lines]) for p in near]
    keep = []
    for i in page.main:
        x = page.lines[i]
        linky = x.links >= 0.5
        if x.inside:
            drop = len(gone) == 2 and i in gone[0] and i in gone[1] or linky and any(i in g for g in gone)
        else:
            drop = i in gone[0] if gone else linky
        if not drop:
            keep.append(x.text)
    return "\n\n".join(keep)


# --------------------------------------------------------------------------- runs of copies in the order of URLs


#: Sampled pages for each splitter.
SAMPLED = 10


def _place(host: str, path: str, page_id: int | None, url: str | None) -> tuple:
    """What pages are sorted by, nulls first, as the engine's own order of these columns."""
    return (host, path, page_id is not None, page_id or 0, url is not None, url or "")


def _splitters(keys: DataFrame, parts: int) -> list[tuple]:
    """Where to cut the order of URLs (host, path, page_id, url) into `parts`, by a sample that a hash draws: some SAMPLED
    short rows for each part reach the driver. The pages themselves are not read for it."""
    n = keys.count()
    share = min(1.0, SAMPLED * parts / max(1, n))
    drawn = keys.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    order = sorted(_place(*r) for r in drawn)
    return sorted({order[len(order) * k // parts] for k in range(1, parts)}) if order else []


def _parse(batches: Iterator[pa.RecordBatch], splitters: list[tuple]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            *keys, html = (c.to_pylist() for c in part.columns)
            lines = pa.array([packed_lines(x) for x in html], pa.binary())
            shard = pa.array([bisect.bisect_right(splitters, _place(host, path, page_id, url)) for page_id, url, host, path in zip(*keys, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], lines, shard], names=["page_id", "url", "host", "path", "lines", "shard"])


#: Pages of one run that are held; of a longer run the pages wait in the shared folder for the page after it.
HELD = 1000

_PAGE = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())]
_WALK = [("part", pa.int32()), ("run", pa.int32()), ("kind", pa.int8()), ("text", pa.string()), *_PAGE]
_DONE, _WAITS, _BEFORE, _AFTER, _FIRST, _LAST = range(6)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the inner runs of a sorted partition; pages of its first and last run wait for the pages beyond its ends.

    A page that a run is compared with is given as a row of its own (_BEFORE, _AFTER); _FIRST and _LAST are the
    partition's first and last page.
    """
    part, run = TaskContext.get().partitionId(), 0
    out: list[tuple] = []
    held: list[Page] = []
    last: Page | None = None  # the page that was read before
    before: Page | None = None  # the page before the run
    waits = True

    def row(kind: int, p: Page, text: str | None = None) -> tuple:
        return (part, run, kind, text, p.page_id, p.url, p.host, p.path, None if kind == _DONE else p.packed)

    def end(after: Page | None) -> None:
        nonlocal held
        if waits:
            out.extend(row(_WAITS, p) for p in held)
            out.extend(row(k, p) for k, p in ((_BEFORE, before), (_AFTER, after)) if p is not None)
        else:
            out.extend(row(_DONE, p, main_text(p, before, after)) for p in held)
        held = []

    for b in batches:
        for fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
            page = Page.unpacked(*fields)
            if last is None:
                out.append(row(_FIRST, page))
            elif last.packed != page.packed and not (last.host == page.host and copies(last, page)) or last.host != page.host:
                end(page)
                before, run, waits = last, run + 1, False
            held.append(page)
            last = page
            if len(held) >= HELD:  # the rest of the run waits with them
                waits = True
                out.extend(row(_WAITS, p) for p in held)
                held = []
            if len(out) >= 500:
                yield _batch(out, _WALK)
                out = []
    if last is not None:
        waits = True
        end(None)
        out.append(row(_LAST, last))
    yield _batch(out, _WALK)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each boundary between partitions whether a run goes on over it, from the pages beside it, sorted by boundary."""
    edge, last = None, None
    for b in batches:
        out = []
        for at, *fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
            page = Page.unpacked(*fields)
            if at == edge:
                out.append((at, last.host == page.host and (last.packed == page.packed or copies(last, page))))
            edge, last = at, page
        yield _batch(out, [("edge", pa.int32()), ("same", pa.bool_())])


def _beyond(parts: list[tuple[int, int]], same: dict[int, bool]) -> list[tuple[int, int, int, int, int, int]]:
    """Which page lies beyond the first and the last run of each partition: (part, run, kind) of the run and what it lacks,
    and where that page is given. A run that goes on over a boundary is followed to where it ends.

    parts: every partition with rows and its last run's number; same: whether a run goes on after a partition.
    """
    out = []
    for way, kind, edge_kind, inner_kind in ((1, _BEFORE, _LAST, _BEFORE), (-1, _AFTER, _FIRST, _AFTER)):
        order = parts[::way]
        found: tuple[int, int, int] | None = None
        for k, (part, last) in enumerate(order):
            own = (0 if way > 0 else last)  # the run that is seen first in this direction
            far = last if way > 0 else 0
            if k:
                before, before_far = order[k - 1][0], order[k - 1][1] if way > 0 else 0
                place = k - 1 if way > 0 else len(parts) - 1 - k
                if not same.get(place, False):
                    found = (before, before_far, edge_kind)
                elif order[k - 1][1] > 0:
                    found = (before, before_far, inner_kind)
                if found:
                    out.append((part, own, kind, *found))
            if far != own:
                found = None
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of waiting pages, with the pages before and after their run in the same row."""
    for b in batches:
        rows = []
        for page_id, url, host, path, lines, before, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            page = Page.unpacked(page_id, url, host, path, lines)
            beside = [Page.unpacked(None, None, x["host"], x["path"], x["lines"]) if x else None for x in (before, after)]
            rows.append((page_id, url, main_text(page, *beside)))
        yield _batch(rows, [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: its main text, empty if there is none.

    Null html is empty. Rows without a URL, or whose URL has no host, are compared among themselves as one host.
    Repeated rows are copies of each other and get equal texts. Ties in nearness go to the page that sorts first. An
    empty table gives none; other columns are left out. A page is held in memory whole, with two neighbours.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"(\.html?|/)$", "").alias("path"),
        F.col(html_col).cast("string").alias("html"),
    )
    spark, parts = pages.sparkSession, partitions(pages)
    sent = spark.sparkContext.broadcast(_splitters(rows.select("host", "path", "page_id", "url"), parts))
    order = ["host", "path", "page_id", "url"]
    page = "page_id long, url string, host string, path string, lines binary"
    walk = f"part int, run int, kind byte, text string, {page}"
    dealt = rows.mapInArrow(lambda it: _parse(it, sent.value), f"{page}, shard int").repartitionById(parts, F.col("shard")).drop("shard")
    found = stored(dealt.sortWithinPartitions(*order).mapInArrow(_walk, walk), "pages")
    sent.destroy()
    # a number or two for each partition: the runs' pages stay where they are
    columns = ["page_id", "url", "host", "path", "lines"]
    parts = sorted((r["part"], r["run"]) for r in found.filter(F.col("kind") == _LAST).select("part", "run").collect())
    places = spark.createDataFrame([(p, k) for k, (p, _) in enumerate(parts)], "part int, place int")
    edge = F.when(F.col("kind") == _LAST, F.col("place")).otherwise(F.col("place") - 1)
    ends = found.filter(F.col("kind").isin(_FIRST, _LAST)).join(places, "part").select(edge.alias("edge"), "part", "kind", *columns)
    dealt = ends.repartition(partitions(pages), "edge").sortWithinPartitions("edge", "part", "kind")
    same = {r["edge"]: r["same"] for r in dealt.select("edge", *columns).mapInArrow(_meet, "edge int, same boolean").collect()}
    lacking = spark.createDataFrame(_beyond(parts, same), "part int, run int, kind int, from_part int, from_run int, from_kind int")
    given = found.filter(F.col("kind").isin(_BEFORE, _AFTER, _FIRST, _LAST)).select(F.col("part").alias("from_part"), F.col("run").alias("from_run"), F.col("kind").cast("int").alias("from_kind"), *columns)
    beyond = lacking.join(given, ["from_part", "from_run", "from_kind"]).select("part", "run", "kind", *columns)
    known = found.filter(F.col("kind").isin(_BEFORE, _AFTER)).select("part", "run", F.col("kind").cast("int").alias("kind"), *columns).unionByName(beyond)
    beside = F.struct("host", "path", "lines")
    known = known.groupBy("part", "run").agg(*[F.first(F.when(F.col("kind") == k, beside), ignorenulls=True).alias(n) for k, n in ((_BEFORE, "before"), (_AFTER, "after"))])
    known = stored(known, "neighbours")
    waits = found.filter(F.col("kind") == _WAITS).select("part", "run", *columns)
    rest = waits.join(known, ["part", "run"], "left").select(*columns, "before", "after").mapInArrow(_settle, "page_id long, url string, text string")
    return found.filter(F.col("kind") == _DONE).select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))
