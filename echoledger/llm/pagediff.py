"""HTML extraction by nearest-URL page differencing.

Pages become lines, one for each block. Pages of one host are sorted by URL path; each is paired with the
nearer of its two neighbours (most common leading path segments, then longest common start, then the earlier one),
their lines are aligned by a longest common subsequence, and lines that both have are deleted.

Differencing alone cannot give right results where menus and footers are written anew for every page, or where an
article stands under two addresses. Two guards therefore come from the markup: lines in named boilerplate
(navigation, adverts, forms and so on) go without comparison, and lines inside `article` or `main` stay although a
neighbour has them too. Where a page has such an element, its lines alone are its main text; where it has none,
differencing decides on all that is not named boilerplate.

Pages of one host with equal lines are one page of the pairing, so that a copy never deletes its original and all copies
get the same text. What moves for the pairing is a 64-bit hash for each line, in range partitions that split a host
of any size; the last page of a range meets the first of the next in a join of one row for each range. The
texts move once, to meet the list of deleted lines.

Defined cases. Null or empty html gives the empty text; a null or malformed url is a host of its own with
an empty path, so that such pages are paired with one another. Repeated rows and equal page_ids each get their own
result row. Ties of path are ordered by the lines' digest. Unclosed, misnested and unfinished markup is read as
browsers read it where that matters here: an unclosed element ends with its parent, an unclosed comment or script at the
end of the page, a `<` that starts no tag is text. Long pages: time grows with the number of lines two pages have in common,
in words of 64, memory with the lines. An empty table gives an empty table; further columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import Tables, documents_of, parts, steps, text_buffer

# Elements and names as HTML and common page templates use them.
BLOCKS = frozenset("""
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select
    summary svg table tbody td template tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("""
    address article aside blockquote button center details dialog div dl fieldset figure footer form head header hgroup main menu
    nav ol search section select svg table template ul""".split())
BOILERPLATE = frozenset("aside button dialog footer form head header menu nav search select svg template".split())
BOILERPLATE_ROLES = frozenset("""
    alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar""".split())
BOILERPLATE_NAMES = frozenset("""
    ad ads adsense advert adverts advertisement advertisements banner breadcrumb breadcrumbs consent cookie cookies footer gdpr
    header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related
    share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
#: A name after one of these says what a page has, not what the element is.
ABOUT = frozenset("has no with without".split())
#: Elements whose end tags do not reach over a list or a table.
ITEMS = frozenset("dd dt li p td th tr".split())
BARRIERS = frozenset("article dl main menu ol table ul".split())

_ATTRIBUTES = r"""(?:[^>"']++|(?<==)"[^"]*+"|(?<==)'[^']*+'|["'])*+"""
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    rf"|<(script|style|textarea|title|xmp|iframe|noembed|noframes|noscript)(?=[\s/>]){_ATTRIBUTES}>(?:.*?</\1(?=[\s/>])[^>]*>|.*)"
    rf"|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})>"
    r"|<[!?][^>]*>|</[^>a-z][^>]*>", re.I | re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_URL = re.compile(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", re.I)

_NONE, _HARD, _SOFT, _MAIN = range(4)
#: Places of a line: outside and inside an article.
OUTSIDE, INSIDE = 0, 1


@lru_cache(8192)
def _kind(tag: str, attributes: str) -> int:
    """What an element says of its content: boilerplate for certain, unless an article is in it, main text, or nothing."""
    kind = _HARD if tag in BOILERPLATE else _MAIN if tag in ("article", "main") else _NONE
    for name, value in _NAMED.findall(attributes):
        words = re.findall(r"[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
        if name.lower() == "role":
            if not BOILERPLATE_ROLES.isdisjoint(words):
                return _HARD
            if kind == _NONE and ("main" in words or "article" in words):
                kind = _MAIN
            continue
        for before, word in zip(["", *words], words):
            if before in ABOUT:
                continue
            if word in COMMENT_NAMES:
                return _HARD
            if word in BOILERPLATE_NAMES and kind == _NONE:
                kind = _SOFT
    return kind


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """(lines, places) of a page without its named boilerplate."""
    lines: list[str] = []
    places: list[int] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element; in it: boilerplate for certain, left out, main text
    hard = out = main = False
    at = 0

    def close() -> None:
        line = " ".join("".join(pieces).split())
        pieces.clear()
        if line:
            lines.append(line)
            places.append(INSIDE if main else OUTSIDE)

    for m in _TOKEN.finditer(html):
        start, end = m.span()
        if start > at and not out:
            text = html[at:start]
            pieces.append(unescape(text) if "&" in text else text)
        at = end
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            if pieces:
                close()
        elif tag == "br":
            pieces.append(" ")
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    hard, out, main = stack[-1][1:] if stack else (False, False, False)
                    break
                if tag in ITEMS and stack[k][0] in BARRIERS:
                    break
            continue
        if stack and (stack[-1][0] == "p" and tag in BLOCKS or stack[-1][0] == tag and tag in ITEMS):
            stack.pop()
            hard, out, main = stack[-1][1:] if stack else (False, False, False)
        attributes = m.group(4)
        kind = _NONE if hard else _kind(tag, attributes if "=" in attributes and _NAMED.search(attributes) else "")
        if kind and (tag in ("img", "input", "hr", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr")):
            continue
        if kind or tag in CONTAINERS:
            if kind == _HARD:
                hard = out = True
            elif kind == _SOFT:
                out = True
            elif kind == _MAIN:
                out, main = False, True
            stack.append((tag, hard, out, main))
    if at < len(html) and not out:
        pieces.append(unescape(html[at:]))
    close()
    return lines, places


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; the path's separators are the lowest character, so that it sorts by segments."""
    m = _URL.match(url or "")
    return (m.group(1).lower(), m.group(2).strip("/").replace("/", "\x01")) if m else ("", "")


def _vectors(a: list, masks: dict, ones: int) -> Iterator[int]:
    """After each element of a: zero bits where the common subsequence with b grows by one."""
    v = ones
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & ones
        yield v


def _masks(b: list) -> dict:
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out = {}
    for x, js in places.items():
        raw = bytearray(js[-1] // 8 + 1)
        for j in js:
            raw[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(raw, "little")
    return out


def _lengths(v: int, m: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


#: Bits of the vectors kept for one walk back; a larger table is halved first.
TABLE_BITS = 1 << 24


def common_lines(a: list, b: list, table_bits: int = TABLE_BITS) -> list[int]:
    """Places in a of a longest common subsequence of a and b, ascending; bit-parallel, in memory linear in both."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    out = list(range(low))
    both = set(a[low : n - high]) & set(b[low : m - high])
    places = [i for i in range(low, n - high) if a[i] in both]
    x, y = [a[i] for i in places], [t for t in b[low : m - high] if t in both]
    if x:
        out += [places[i] for i in _aligned(x, y, table_bits)]
    return out + list(range(n - high, n))


def _aligned(x: list, y: list, table_bits: int) -> list[int]:
    n, m = len(x), len(y)
    if not n or not m:
        return []
    ones = (1 << m) - 1
    if n == 1:
        return [0] if x[0] in y else []
    if n * m > table_bits:
        half = n // 2
        for first in _vectors(x[:half], _masks(y), ones):
            pass
        for second in _vectors(x[:half - 1:-1], _masks(y[::-1]), ones):
            pass
        cut = int(np.argmax(_lengths(first, m) + _lengths(second, m)[::-1]))
        return _aligned(x[:half], y[:cut], table_bits) + [half + i for i in _aligned(x[half:], y[cut:], table_bits)]
    rows = list(_vectors(x, _masks(y), ones))
    out, i, j = [], n, m
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i == 0 or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append(i)
    return out[::-1]


def nearness(path: str, other: str) -> tuple[int, int]:
    """Common leading segments, then common leading characters."""
    segments = 0
    for p, q in zip(path.split("\x01"), other.split("\x01")):
        if p != q:
            break
        segments += 1
    same = next((k for k, (p, q) in enumerate(zip(path, other)) if p != q), min(len(path), len(other)))
    return segments, same


def _shared(page: tuple, before: tuple | None, after: tuple | None) -> list[int]:
    """Lines of a page (host, path, signature, hashes) that the nearer of its neighbours on the host has too."""
    near = [(nearness(page[1], q[1]), -k, q) for k, q in enumerate((before, after)) if q and q[0] == page[0]]
    return common_lines(page[3], max(near, key=lambda x: x[:2])[2][3]) if near else []


LINES = "page_id bigint, url string, host string, path string, signature binary, lines array<string>, places array<byte>, hashes array<bigint>"


def lines_of(pages: DataFrame) -> DataFrame:
    """Lines of every page, where they stand, their hashes, and host, path and signature of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()))
        names = [f.split()[0] for f in LINES.split(", ")]
        for b in batches:
            for i, j in steps(text_buffer(b.column(2))[0]):  # some hundred pages at a time, or one long one
                out = []
                for page_id, url, html in zip(*(c.slice(i, j - i).to_pylist() for c in b.columns)):
                    lines, places = page_lines(html or "")
                    digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in lines]
                    out.append((page_id, url, *place_of(url), hashlib.blake2b(b"".join(digests), digest_size=16).digest(), lines, places,
                                np.frombuffer(b"".join(digests), "<i8").tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return documents_of(pages, "page_id", "url", "html").mapInArrow(run, LINES)


PAIRED = "kind int, part int, host string, path string, signature binary, hashes array<bigint>, near array<bigint>, near_path string, shared array<int>"
_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int32()))


def shared_lines(lines: DataFrame) -> DataFrame:
    """host, signature, shared: the lines (from 0) that each page's nearest page has too; one row for each distinct page of a host."""
    spark = lines.sparkSession
    tables = Tables(spark, "pagediff")
    distinct = lines.groupBy("host", "signature").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    order = ["host", "path", "signature"]
    ranged = distinct.select("host", "path", "signature", "hashes").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: paired. 1: first page of a range. 2: last one, with its earlier neighbour; 3: first one that awaits the range before."""
        part, out = TaskContext.get().partitionId(), []
        before = page = first = None

        def row(kind, p, near=None, shared=()):
            own = near if near and near[0] == p[0] else None
            out.append((kind, part, *p, own and own[3], own and own[1], shared))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], [f.split()[0] for f in PAIRED.split(", ")])
            out.clear()
            return batch

        for b in batches:
            for after in zip(*(c.to_pylist() for c in b.columns)):
                if page is None:
                    first = after
                elif before is not None:
                    row(0, page, None, _shared(page, before, after))
                else:
                    row(3, page, after)
                before, page = page, after
                if len(out) == 512:
                    yield flush()
        if page is not None:
            row(1, first)
            if page is not first:
                row(2, page, before)
            else:
                row(4, page)  # alone in its range: both neighbours are elsewhere
        if out:
            yield flush()

    made = tables.keep(ranged.mapInArrow(run, PAIRED), "ranges")
    used = sorted(r["part"] for r in made.where("kind = 1").select("part").collect())  # one number for each range
    ends = made.where("kind IN (2, 4)").select("part", "host", "path", "hashes")
    heads = made.where("kind = 1").select("part", "host", "path", "hashes")
    follow = spark.createDataFrame(list(zip(used, used[1:])), "part int, then int")
    lead = spark.createDataFrame(list(zip(used[1:], used)), "part int, then int")
    nexts = heads.select(*[F.col(c).alias(f"after_{c}") for c in heads.columns]).join(F.broadcast(follow), F.col("after_part") == F.col("then"))
    lasts = ends.select(*[F.col(c).alias(f"before_{c}") for c in ends.columns]).join(F.broadcast(lead), F.col("before_part") == F.col("then"))
    open_pages = made.where("kind IN (2, 3, 4)")
    met = open_pages.join(nexts.drop("then"), "part", "left").join(lasts.drop("then"), "part", "left")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                page = (r["host"], r["path"], r["signature"], r["hashes"])
                own = (r["host"], r["near_path"], None, r["near"]) if r["near"] is not None else None
                before = (r["before_host"], r["before_path"], None, r["before_hashes"]) if r["before_host"] is not None else None
                after = (r["after_host"], r["after_path"], None, r["after_hashes"]) if r["after_host"] is not None else None
                out.append((*page[:1], page[2], _shared(page, own if r["kind"] == 2 else before, own if r["kind"] == 3 else after)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.list_(pa.int32())))],
                                                 ["host", "signature", "shared"])

    edges = met.mapInArrow(close, "host string, signature binary, shared array<int>")
    return made.where("kind = 0").select("host", "signature", "shared").unionByName(edges)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text, its length in code points, lines of the page, and how many its nearest page shares and were deleted."""
    lines = lines_of(pages)
    shared = shared_lines(lines.select("host", "path", "signature", "hashes"))
    whole = F.exists("places", lambda p: p == INSIDE)
    # Inside an article every line stays; a page without one keeps what its nearest page does not have.
    others = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "shared")
    kept = F.when(whole, F.filter("lines", lambda t, i: F.get("places", i) == INSIDE)).when(
        (F.size("shared") > 0) & (F.size("lines") > 0), F.transform(others, lambda i: F.get("lines", i))).otherwise(F.col("lines"))
    return (
        lines.select("page_id", "url", "host", "signature", "lines", "places").join(shared, ["host", "signature"], "left")
        .select("page_id", "url", F.array_join(kept, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"),
                F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"), (F.size("lines") - F.size(kept)).cast("long").alias("n_deleted"))
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_deleted")
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).select("page_id", "url", "text", "n_chars")
