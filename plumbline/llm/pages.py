"""Main text of web pages by nearest-URL page differencing, guarded by structure.

A page is cut into text lines, one for each block, each marked with where it stands: in a region that is never main
text (menus, footers, adverts, forms, ...), in an article, or elsewhere. Pages are paired by URL: sorted by path
within each host, a page's partner is the nearest page before or after it whose lines differ, the one with the longer
common start of the path (on ties the one before). The two pages' lines are aligned by a longest common subsequence,
and lines that both share are deleted: they belong to the site. Lines inside an article are exempt, since copies and
quotations share them too. Of what is left, lines in regions that are never main text go; where a page has an
article, its lines are the result, else the lines that stand elsewhere. ``n_shared`` says how many lines differencing
deleted.

Differencing alone cannot give right results on the tables at hand: of 19,123 lines in menus, adverts and the like on
2,500 pages, the nearest page shares 462 only (each page has its own), while it shares 317 lines of articles.

Pairing sorts by range over (host, path): a host of any size spreads over many tasks, and only lines are moved, not
pages. A task holds the lines of two pages at a time, and the ids of a run of pages with equal lines. Runs at a task's
edges, whose partner may be another task's, are settled from the line hashes of each task's first and last two runs,
which are all that the driver sees. So the result does not depend on how the pages were dealt. A page with no other
on its host that differs loses no lines to differencing.

Defined results: a null page is an empty one with an empty text; a null or broken URL has an empty host and path;
pages that repeat an id are extracted each by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, ship

# Element names, and words in class, id and role attributes, by what they say about their contents.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video select datalist option button title head textarea input map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_MAIN = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promotions sidebar widget widgets nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond login "
    "search searchbox pagination pager toolbar tagcloud skip".split()
)
HEADER_WORDS = frozenset("header heading banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(?=[!?/a-zA-Z])[^<]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

SITE, ELSEWHERE, ARTICLE = 0, 1, 2


def _of_site(name: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is never main text, and whether it is hidden."""
    if name == "header" and not in_main:
        return True, False
    if name in NEVER_MAIN:
        return True, False
    if not attrs or name in MAIN or name in ("html", "body"):
        return False, False
    words, hidden = set(), False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words |= {w.lower() for w in _SPLIT.split(value)}
        elif key == "role" and value.strip().lower() in ROLES:
            return True, False
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    if name in INLINE:  # a marked word within a sentence is no region
        words &= {"ad", "ads", "advert"}
    return bool(words & SITE_WORDS) or (not in_main and bool(words & HEADER_WORDS)), hidden


def lines(page: str) -> list[tuple[int, str]]:
    """(place, text) of every block with text, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, place, dropped
    place, dropped = ELSEWHERE, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((place, text))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at and not dropped:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        flush()
                    elif stack[k][2] or stack[k][1] == SITE:
                        flush()
                    del stack[k:]
                    place, dropped = (stack[-1][1], stack[-1][2]) if stack else (ELSEWHERE, False)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p" or name == "li":
            # an open paragraph ends where the next begins; items end likewise within their list
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    place, dropped = (stack[-1][1], stack[-1][2]) if stack else (ELSEWHERE, False)
                    break
                if stack[k][0] in ("ul", "ol", "div", "article", "main", "section", "td", "body") or stack[k][0] in NEVER_MAIN:
                    break
        elif name == "body":
            while stack and stack[-1][0] != "html":
                stack.pop()
            place, dropped = (stack[-1][1], stack[-1][2]) if stack else (ELSEWHERE, False)
        site, hidden = _of_site(name, m[3], place == ARTICLE)
        here = SITE if site or place == SITE else ARTICLE if name in MAIN or place == ARTICLE else ELSEWHERE
        gone = dropped or hidden or name in DROPPED
        if name in INLINE and (gone != dropped or here != place):
            flush()
        stack.append((name, here, gone))
        place, dropped = here, gone
    if at < n and not dropped:
        parts.append(page[at:])
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` on a longest common subsequence with ``b`` (matches taken by falling place, then chained).

    What both begin and end with is on one, so it is taken first.
    """
    lo, hi, n = 0, 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where: dict = {}
    for k in range(lo, len(b) - hi):
        where.setdefault(b[k], []).append(k)
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for i in range(lo, len(a) - hi):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = {*range(lo), *range(len(a) - hi, len(a))}, links[-1] if links else None
    while link is not None:
        out.add(link[0])
        link = link[1]
    return out


def marks(own: list[tuple[int, str]]) -> list[int]:
    """A 64-bit hash of each line's text."""
    return [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()) for _, t in own]


def main_text(own: list[tuple[int, str]], other: list[int] | None) -> tuple[str, int]:
    """The main text of a page, given the line hashes of its partner, and the number of lines that both share."""
    common = shared(marks(own), other) if other else set()
    left = [(p, t) for k, (p, t) in enumerate(own) if p == ARTICLE or k not in common]
    best = ARTICLE if any(p == ARTICLE for p, _ in left) else ELSEWHERE
    return "\n\n".join(t for p, t in left if p == best), len(own) - len(left)


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path (with query) of a URL."""
    try:
        u = urlsplit(url or "")
        return (u.netloc or "").lower(), u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return "", url or ""


def _partner(path0: str, path1: str, before: tuple | None, after: tuple | None) -> list[int] | None:
    """Line hashes of the partner of a run of pages from path0 to path1; neighbours are (first path, last path, hashes)."""
    if not (before and after):
        return (before or after or (None,) * 3)[2]
    near = len(os.path.commonprefix([before[1], path0])), len(os.path.commonprefix([path1, after[0]]))
    return before[2] if near[0] >= near[1] else after[2]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                url = [url_key(x) for x in part.column(1).to_pylist()]
                text = [_packed(lines(x.as_py() or "")) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([x[0] for x in url], pa.string()), pa.array([x[1] for x in url], pa.string()), pa.array(text, pa.binary())],
                    ["page_id", "url", "host", "path", "lines"],
                )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edge: list[list] = []  # (host, first path, last path, hashes) of the first two runs and the last two
        n = 0
        rows: list[tuple] = []  # of the current run
        packed = None  # its lines
        before = None  # the run before

        def settled(after) -> list[tuple]:
            at = edge[-1]
            same = [x and x[0] == at[0] and tuple(x[1:]) or None for x in (before, after)]
            text, gone = main_text(_placed(_shown(packed)), _partner(at[1], at[2], *same))
            return [(i, u, text, gone, None, None) for i, u in rows]

        for batch in batches:
            done: list[tuple] = []
            for k in range(batch.num_rows):
                page_id, url, host, path, text = (c[k].as_py() for c in batch.columns)
                if n and (host, text) == (edge[-1][0], packed):
                    edge[-1][2] = path
                else:
                    new = [host, path, path, marks(_placed(_shown(text)))]
                    if n == 1:
                        done += [(i, u, _shown(packed), None, f"{part} first", None) for i, u in rows]
                    elif n:
                        done += settled(new)
                    before = edge[-1] if n else None
                    edge = [*edge[:2], *edge[2:][-1:], new] if n >= 3 else [*edge, new]
                    n, rows, packed = n + 1, [], text
                rows.append((page_id, url))
            yield _rows(done, batch.schema.field(0).type)
        if n:
            name = f"{part} {'first' if n == 1 else 'last'}"
            last = [(i, u, _shown(packed), None, name, None) for i, u in rows]
            yield _rows([*last, (None, None, None, None, None, json.dumps({"part": part, "runs": edge, "n": n}))], batch.schema.field(0).type)

    cuts = pages.select("page_id", "url", "html").mapInArrow(cut, f"page_id {kind}, url string, host string, path string, lines binary")
    ordered = cuts.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    out = materialise(ordered.mapInArrow(kernel, f"page_id {kind}, url string, text string, n_shared long, open string, edge string"), "pages")
    partners = _settle_edges([json.loads(r["edge"]) for r in out.where("edge is not null").select("edge").collect()])
    found = pages.sparkSession.sparkContext.broadcast(partners)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, o in enumerate(batch.column(4).to_pylist()):
                if o is not None:
                    text[k], gone[k] = main_text(_placed(text[k]), found.value[o])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_shared"])

    whole = out.where("edge is null").select("page_id", "url", "text", "n_shared", "open").mapInArrow(settle, f"page_id {kind}, url string, text string, n_shared long")
    return whole.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def _packed(own: list[tuple[int, str]]) -> bytes:
    """Lines with their places, compressed: this is what is moved and kept of a page."""
    return zlib.compress("\n".join(f"{p}{t}" for p, t in own).encode("utf-8", "surrogatepass"), 6)


def _shown(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def _placed(text: str) -> list[tuple[int, str]]:
    return [(int(x[0]), x[1:]) for x in text.split("\n")] if text else []


def _settle_edges(edges: list[dict]) -> dict[str, list[int] | None]:
    """The partner's line hashes of each run that its task left open: its first and its last.

    A task gives its first two and last two runs. Neighbouring runs differ, so these hold the nearest runs that
    differ, before and after, of every open run; a run that goes on in the next task is one.
    """
    seq: list[list] = []
    places: list[tuple[str, int]] = []
    for e in sorted(edges, key=lambda e: e["part"]):
        for k, run in enumerate(e["runs"]):
            if not k and seq and (seq[-1][0], seq[-1][3]) == (run[0], run[3]):
                seq[-1][2] = run[2]
            else:
                seq.append(run)
            if not k:
                places.append((f"{e['part']} first", len(seq) - 1))
        if e["n"] > 1:
            places.append((f"{e['part']} last", len(seq) - 1))
    out = {}
    for name, at in places:
        host, first, last, _ = seq[at]
        before, after = (tuple(seq[k][1:]) if 0 <= k < len(seq) and seq[k][0] == host else None for k in (at - 1, at + 1))
        out[name] = _partner(first, last, before, after)
    return out


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ["page_id", "url", "text", "n_shared", "open", "edge"]
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)
