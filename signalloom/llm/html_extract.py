"""Main text of web pages, with boilerplate found as runs that a host's pages repeat.

A page is read once into blocks.  Marked structure decides what it can: an article's (or
main's) blocks are the text, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are not, wherever they stand.  Marks are names of elements and of classes, outside articles
also parts of them and of ids; inside an article only whole names of classes and roles.  What stands outside the article, or on a page
without one, has no mark to go by.  The token streams of these blocks are concatenated
per host.  Every place of a stream is known by the hash of its first six tokens in place of its suffix, so
equal places are found by grouping instead of sorting: a longer run that repeats is a chain of
such places, and no order or common-prefix length is needed.  A place that enough of the host's distinct pages share,
by number and by share, is boilerplate with its six tokens.  On a page without an article the covered tokens go
and the unique ones stay; on a page with one, open blocks are not part of the text, and their covered tokens are counted only.
A text inside an article is never dropped because it repeats elsewhere.

Pages with the same stream are one page to this count, so that copies of a page do not
erase each other.  Null html is empty and gives an empty text; a null url is a host of its
own.  Repeated rows and page ids are separate pages.  Very long pages are read whole.
Other columns, whatever their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import mix, text_bytes, word_hashes
from signalloom.session import written

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<(?![A-Za-z/!?]))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# ---- fixed values: names of elements and usual marks -----------------------------------
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "td", "th", "label",
}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
_MAIN = {"article", "main"}
_MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert",
    "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "comment", "comments", "respond", "reply", "replies", "disqus", "widget", "toolbar", "pagination", "pager", "skip", "search",
    "contentinfo", "complementary", "copyright", "legal", "disclaimer", "form",
}


_TALK = {"comment", "comments", "respond", "reply", "replies", "disqus"}


def _marked(tag: str, rest: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is not text of the page; ``inside`` an article only whole names of classes and roles do."""
    marks = _TALK if tag in _MAIN else _MARKS
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "role") or name == "id" and not inside:
            if any(w in marks for w in (value.split() if inside else re.split(r"[^a-z0-9]+", value))):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; zones: main, chrome, open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements that hold blocks, with the zone before them
    zone, words = "open", []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((zone, text))

    at, n = 0, len(page)
    while at < n:
        m = _PIECE.match(page, at)
        if m is None:  # an attribute's quote never closes: take the tag as ending at the next bracket
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        at = m.end()
        if m["text"] is not None:
            words.append(m["text"])
        elif m["cdata"] is not None:
            words.append(m["cdata"])
        elif m["tag"]:
            tag, rest = m["tag"].lower(), m["rest"]
            if m["close"]:
                if tag in _INLINE:
                    words.append(" " if tag in ("td", "th") else "")
                    while stack and stack[-1][0] == tag:  # an inline element that was marked
                        end_block()
                        zone = stack.pop()[1]
                        break
                    continue
                end_block()
                if any(t == tag for t, _ in stack):
                    while True:
                        t, zone = stack.pop()
                        if t == tag:
                            break
                continue
            if tag in _RAW and not rest.endswith("/"):
                close = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
                words.append(" " if tag in ("button", "select", "object") else "")
                continue
            if tag in _VOID or rest.endswith("/"):
                if tag in ("br", "hr"):
                    words.append(" ")
                    if tag == "hr":
                        end_block()
                continue
            marked = tag in _CHROME or zone != "chrome" and _marked(tag, rest, zone == "main") and tag not in ("body", "html")
            if tag in _INLINE and not marked:
                words.append(" " if tag in ("td", "th") else "")
                continue
            end_block()
            if tag in ("p", "li", "tr", "dt", "dd", "option") and not marked:
                while stack and stack[-1][0] == tag:  # its end may be left out
                    zone = stack.pop()[1]
            stack.append((tag, zone))
            if marked:
                zone = "chrome"
            elif tag in _MAIN and zone == "open":
                zone = "main"
    end_block()
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mains, opens, chromes = [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            mains.append("\n".join(t for z, t in found if z == "main"))
            opens.append([t for z, t in found if z == "open"])
            chromes.append([t for z, t in found if z == "chrome"])
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("uid", "page_id", "url")), pa.array(mains, pa.string()), pa.array(opens, strings), pa.array(chromes, strings)],
            names=["uid", "page_id", "url", "main", "open", "chrome"],
        )


def _suffixes(length: int):
    """Per page, its stream's places as one number each: the host and their first ``length`` tokens (shorter blocks: the whole block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            rows = zip(*(batch.column(c).to_pylist() for c in ("uid", "page", "host", "stream", "n_open")))
            for uid, page, host, texts, n_open in rows:
                # blocks have single spaces between words, so words and the places counted here agree
                hashed, begin = word_hashes(*text_bytes(pa.array(texts, pa.string())))
                salt = np.array([host], np.int64).view(np.uint64)
                for i in range(len(texts)):  # runs do not cross blocks
                    h = hashed[begin[i] : begin[i + 1]]
                    step = min(length, len(h))
                    if not step:
                        continue
                    key = np.repeat(mix(salt + np.uint64(step)), len(h) - step + 1)
                    for j in range(step):
                        key = mix(key + h[j : len(h) - step + 1 + j])
                    n = len(key)
                    found = (np.full(n, uid), np.full(n, page), np.full(n, host), key.view(np.int64), (np.arange(n) + begin[i]).astype(np.int32), np.full(n, i < n_open))
                    for column, values in zip(columns, found):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["uid", "page", "host", "key", "at", "is_open"])

    return run


def extract(pages: DataFrame, length: int = 6, least: int = 3, share: float = 0.2) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, text, n_chars, n_boilerplate`` (words of unmarked blocks that repeated runs cover).

    A run is boilerplate on ``least`` distinct pages of a host, and on that ``share`` of them.
    Texts of articles are not shuffled.
    """
    ids, urls = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    given = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "html")
    parsed = written(given.mapInArrow(_parse, f"uid long, page_id {ids}, url {urls}, main string, open array<string>, chrome array<string>"), "pages-parsed")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    stream = F.concat("open", "chrome")  # open blocks first: their tokens have the low places
    streams = parsed.select("uid", F.xxhash64(host).alias("host"), stream.alias("stream"), F.size("open").alias("n_open"), F.xxhash64(F.array_join(stream, "\n"), "main").alias("page"))
    placed = written(streams.mapInArrow(_suffixes(length), "uid long, page long, host long, key long, at int, is_open boolean"), "pages-suffixes")
    sizes = placed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    spread = placed.select("host", "key", "page").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    intervals = spread.join(sizes, "host").where(F.col("n") >= share * F.col("n_pages")).select("key")
    hit = placed.where("is_open").select("uid", "key", "at").join(intervals, "key").groupBy("uid").agg(F.array_sort(F.collect_set("at")).alias("hits"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for main, opened, hits in zip(*(batch.column(c).to_pylist() for c in ("main", "open", "hits"))):
                sizes = [len(t.split()) for t in opened]
                begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                hits = np.array(hits or [], np.int64)
                cover = np.zeros(begin[-1] + 1, np.int64)
                for i, size in enumerate(sizes):
                    for at in hits[np.searchsorted(hits, begin[i]) : np.searchsorted(hits, begin[i + 1])]:
                        cover[at] += 1
                        cover[at + min(length, size)] -= 1
                cover = np.cumsum(cover[:-1]) > 0
                counts.append(int(cover.sum()))
                if main:
                    texts.append(main)
                    continue
                kept = [" ".join(w for w, c in zip(t.split(), cover[begin[i] : begin[i + 1]]) if not c) for i, t in enumerate(opened)]
                texts.append("\n".join(t for t in kept if t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=["page_id", "url", "text", "n_boilerplate"],
            )

    columns = f"page_id {ids}, url {urls}, text string, n_boilerplate long"
    # pages without open blocks, or without a repeated run in them, need no places: their rows stay where they are
    bare = parsed.where("size(open) = 0").select("page_id", "url", F.col("main").alias("text"), F.lit(0).cast("long").alias("n_boilerplate"))
    decided = parsed.where("size(open) > 0").join(hit, "uid", "left").select("page_id", "url", "main", "open", "hits")
    out = bare.unionByName(decided.mapInArrow(assemble, columns))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_boilerplate")
