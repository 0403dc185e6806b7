"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path; a page is compared with the neighbour of its host whose path shares more
leading segments.  The text lines (blocks) of both are aligned by their longest common subsequence, and shared
lines are deleted: what a site repeats from page to page is its frame.

Mark-up says which lines are in question.  Elements that name their purpose (menus, headers, footers, sidebars,
forms), adverts and reader comments are frame, whatever the neighbour has.  So are lines beside the article under a
class or id that is such a name.  A line of an <article> or <main> with no such class or id is the page's own, even
if the neighbour's article has it too, because articles quote shared passages.  All other lines are decided by
the comparison: those beside the article, or of a page without one, and those in an article whose class or id is
the only evidence against them.  A page without an article whose lines are all shared (a copy of its neighbour)
keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_index, map_rows, written

#: What a page's mark-up says of a line: frame by its element; frame by its class or id, outside an article; nothing, or only
#: a class or id inside an article; article.
FRAME, NAMED, ASKED, CONTENT = 0, 1, 2, 3
#: Bits of a table that is kept to read an alignment back; larger ones are halved first.
TABLE_BITS = 1 << 28

_RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAME_TAGS = frozenset("nav footer aside form head menu dialog button select label fieldset".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_MATH = "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
_INLINE = frozenset(f"{_MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br".split())
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Class names and ids, as wholes.
_FRAME_NAMES = frozenset(
    "sponsor promo promotion nav navbar navigation main-nav site-nav menu main-menu menubar breadcrumb breadcrumbs "
    "sidebar side-bar footer site-footer page-footer header site-header page-header masthead banner cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices alert popup modal "
    "overlay newsletter newsletter-signup subscribe subscription signup login share sharing share-buttons social social-share social-links related related-posts related-articles recommended pagination "
    "pager toolbar widget search search-form search-box hidden".split()
)
_ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement ad-banner ad-container ad-slot sponsored".split())
_COMMENT_NAMES = frozenset("comment comments comment-list comments-area comments-section comment-section reply replies disqus disqus_thread respond".split())
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_LOOSE_TAG = re.compile(r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _evidence(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is part of the frame by itself, by its class or id, an advert, and reader comments."""
    frame, named, advert, comments = name in _FRAME_TAGS or name == "header", False, False, False
    if attrs and not attrs.isspace():
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), unescape("".join(values)).lower()
            if key in ("class", "id"):
                names = value.split()
                comments = comments or not _COMMENT_NAMES.isdisjoint(names)
                advert = advert or not _ADVERT_NAMES.isdisjoint(names)
                named = named or advert or not _FRAME_NAMES.isdisjoint(names)
            elif key == "role":
                frame = frame or value.strip() in _FRAME_ROLES
            elif key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                frame = True
    return frame, named, advert, comments


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block of a page that has text, in page order."""
    html = html or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name; kind, in an article, in comments before it
    kind, article, comments = ASKED, False, False

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    at = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            parts.append(html[at:])
            break
        if lt > at:
            parts.append(html[at:lt])
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not m:  # a bare sign
            parts.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        name = m.group("name")
        if name is None:
            if cdata := m.groupdict().get("cdata"):
                parts.append(cdata.replace("&", "&amp;"))
            continue
        name = name.lower()
        if name in _RAW and not m.group("close"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if name in _INLINE and name != "br" and name not in ("a", "span"):
            continue
        if name == "br":
            parts.append(" ")
            continue
        inline = name in ("a", "span")
        if not inline:
            end_block()
        if m.group("close"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline and stack[k][1] != kind:
                        end_block()
                    kind, article, comments = stack[k][1:]
                    del stack[k:]
                    break
            continue
        if name in _VOID or m.group("attrs").rstrip().endswith("/") and inline:
            continue
        if name == "p" or name == "li":  # they close a paragraph left open
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name:
                    kind, article, comments = stack[k][1:]
                    del stack[k:]
                    break
                if stack[k][0] not in ("a", "span"):
                    break
        frame, named, advert, own_comments = _evidence(name, m.group("attrs"))
        if name == "header" and article and not own_comments:
            frame = False
        new, inside = kind, article
        if name in _CONTENT_TAGS and not (frame or named or comments or own_comments):
            new, inside = CONTENT, True  # also in a frame element that was never closed
        elif (frame or own_comments or advert and article) and name not in ("body", "html"):
            new = FRAME
        elif named and kind != FRAME and name not in ("body", "html"):
            new = ASKED if article else NAMED
        if inline and new != kind:
            end_block()
        stack.append((name, kind, article, comments))
        kind, article, comments = new, inside, comments or own_comments
    end_block()
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each beginning of ``a``, the numbers j, as zero bits, at which b[j] makes its common subsequence with b longer."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence, in order.

    Rows of the table of lengths are bits of one number each, so the time is len(a) * len(b) / 64 whatever repeats,
    and memory is bounded by halving ``a`` until a table fits.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    middle = [(x[i], y[j]) for i, j in _aligned([a[i] for i in x], [b[j] for j in y])]
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + middle + ends


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def deleted_lines(kinds: list[int], lines: list[int], near_kinds: list[int], near_lines: list[int]) -> list[int]:
    """Places of the lines that the comparison with a neighbour deletes."""
    shared = [i for i, _ in common_lines(lines, near_lines) if kinds[i] in (NAMED, ASKED)]
    if CONTENT not in kinds and len([i for i in shared if kinds[i] == ASKED]) == kinds.count(ASKED):
        return []  # a copy
    return shared


def _segments(path: str) -> list[str]:
    return re.split(r"(?<=[/?&#._-])", path)


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(_segments(a), _segments(b)):
        if x != y:
            break
        n += 1
    return n


def shared_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(key, shared array<int>): for each different page, the places of its lines that the comparison deletes.

    Only hashes of lines are sorted and joined.  Pages get their places in a global order of host, path and id,
    so that a host with a large share of all pages is spread over many tasks, and neighbours meet by place.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    key = _key(id_col, url_col, html_col)

    def hashed(batch: pa.RecordBatch) -> Iterator[dict]:
        lines, kinds = [], []
        for html in batch.column(3).to_pylist():
            own = lines_of(html)
            lines.append([line_hash(t) for _, t in own])
            kinds.append([k for k, _ in own])
        yield {"key": batch.column(0), "host": batch.column(1), "path": batch.column(2), "lines": lines, "kinds": kinds}

    rows = map_rows(pages.select(key.alias("key"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").alias("html")), hashed, "key long, host string, path string, lines array<long>, kinds array<tinyint>")
    placed = global_index(rows.dropDuplicates(["key"]), F.col("host"), F.col("path"), F.col("key"), name="place")
    # only pages with lines in question have something to decide
    asking = placed.where(F.exists("kinds", lambda x: (x == NAMED) | (x == ASKED)))
    beside = placed.select(F.col("place").alias("p"), F.struct("host", "path", "lines", "kinds").alias("q"))
    met = asking.select("*", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("p")).join(beside, "p").where("q.host = host")
    met = met.groupBy("key").agg(F.first("path").alias("path"), F.first("lines").alias("lines"), F.first("kinds").alias("kinds"), F.collect_list(F.struct("p", "q.path", "q.lines", "q.kinds")).alias("near"))  # two at most

    def compared(batch: pa.RecordBatch) -> Iterator[dict]:
        keys, out = [], []
        for key, path, lines, kinds, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            best = max(sorted(near, key=lambda q: q["p"]), key=lambda q: (q["lines"] != lines, _nearness(path, q["path"])))
            keys.append(key)
            out.append(deleted_lines(kinds, lines, best["kinds"], best["lines"]))
        yield {"key": keys, "shared": out}

    return map_rows(met.select("key", "path", "lines", "kinds", "near"), compared, "key long, shared array<int>").where(F.size("shared") > 0)


def _key(id_col: str, url_col: str, html_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared, n_frame of every row of ``pages``.

    text: the blocks that stay, each with its white space (also between inline elements, br included) turned into
    single spaces, joined by a newline; empty for null or empty html.  n_lines counts all blocks; n_shared those
    that the comparison deleted, n_frame those that only mark-up did.  Null urls are pages of one host without a
    name.  Repeated rows count as one page for the comparison and get the same text.  An empty table gives none.
    """
    deleted = written(shared_lines(pages, url_col, html_col, id_col))
    rows = pages.select(_key(id_col, url_col, html_col).alias("key"), F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    # shuffled only if the deletions are many: Spark compares the table's size with its broadcast limit
    rows = rows.join(deleted, "key", "left").select("page_id", "url", "html", "shared")

    def kept(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, counts = [], []
        for html, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            gone, lines = set(shared or ()), lines_of(html)
            stay = [t for i, (k, t) in enumerate(lines) if k >= ASKED and i not in gone]
            texts.append("\n".join(stay))
            counts.append((len(lines), len(gone), len(lines) - len(gone) - len(stay)))
        n_lines, n_shared, n_frame = ([c[k] for c in counts] for k in range(3))
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_lines": n_lines, "n_shared": n_shared, "n_frame": n_frame}

    return map_rows(rows, kept, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_frame long")
