"""Operator 7: the main text of web pages, with a suffix array per host against boilerplate.

A page is read into blocks (text between block-level tags, character references decoded,
white space collapsed), each in a zone: article, marked (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, hidden parts: told by element, role or class),
suspect (in an article, and only a part of a longer class or id hints at chrome, as in ``social-policy``), or
open (none of these). The words of all blocks but plain article text are the page's token stream. The
host's suffix array over the streams of its distinct pages gives the substrings of at least
``DEPTH`` words that two or more distinct pages share, and suspect blocks of fewer words that they share whole. On every page, the words that these
cover are removed first, whatever the markup says of them, and the unique runs between them
are kept. So the array decides open and suspect text: what a host repeats is boilerplate, the rest is text.
Markup decides about marked blocks that the array leaves: a menu or advert that occurs once is
no main text either. Plain article text is never removed for being repeated: pages quote and copy
each other's articles, and the contract's text is the article's.

The array is cut at depth DEPTH, all that coverage needs: a longer repeat is covered by its
substrings of that length, and two suffixes share DEPTH words if and only if their 128-bit
keys of host and prefix agree. So sorting and comparing neighbours is an aggregate over
prefixes, a partial one (do their pages differ?), and neither a host with a third of all
pages nor a footer on every page comes together in one task. Positions meet repeated
prefixes in a join that AQE can split.

Defined cases: null or empty html gives the empty text; malformed markup, unclosed elements
and cut-off pages are read as far as they go, in one pass; a null or unparsable url belongs
to the host ""; equal pages count as one; repeated rows get equal results; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table, text_or_empty

DEPTH = 6
ARTICLE, OPEN, MARKED, SUSPECT = 0, 1, 2, 3

#: Fixed values of HTML: block-level elements, elements without an end, elements whose text isn't markup.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements and roles that are never main text, and words of class or id that mark them.
CHROME_TAGS = frozenset("nav footer aside form head menu dialog button select option search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_WORDS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar widget related share social footer masthead cookie cookies consent notice notices alert banner popup modal newsletter subscribe signup login search skip copyright comment comments respond disqus discussion".split())
#: Of these, the words that begin or end the class or id of a container of adverts or reader comments inside an article.
READER_WORDS = frozenset("ad ads advert advertisement adverts sponsored comment comments respond disqus discussion".split())
CONTAINERS = frozenset("div section ul ol table dl aside".split())
PAGE_WORDS = CHROME_WORDS | {"header", "topbar"}
#: Of these, the words that mark an article itself, whose class often names what goes with it.
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsor sponsored sidebar widget related comment comments".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Text, or a tag that is closed before the next ``<``: what well-formed pages consist of. Nothing in it is tried twice.
PLAIN = re.compile(r"[^<]++|<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"']*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^<>\"']*+)*+)>")
RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[\s_-]+")


def _marked(attributes: str, words: frozenset = CHROME_WORDS) -> bool:
    """Whether an element's attributes say that it is chrome or hidden."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not words.isdisjoint(SPLIT.split(value)) or _unseen(name, value):
            return True
    return False


def _unseen(name: str, value: str) -> bool:
    """Whether an attribute hides its element or gives it a role of chrome."""
    if name == "role":
        return value.strip() in CHROME_ROLES
    return name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")


def _inside(element: str, attributes: str) -> int:
    """What the attributes of an element in an article say: 2 for chrome, 1 for a hint in part of a class or id, else 0.

    A whole class or id must be a word of chrome; containers are also known by one that begins or ends with a word for adverts or comments.
    """
    hint = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if _unseen(name, value):
            return 2
        for token in value.split() if name in ("class", "id") else ():
            parts = SPLIT.split(token)
            if token in CHROME_WORDS or element in CONTAINERS and (parts[0] in READER_WORDS or parts[-1] in READER_WORDS):
                return 2
            if not CHROME_WORDS.isdisjoint(parts):
                hint = 1
    return hint


class Scan:
    """A search for each of some strings whose positions only grow, so a string that doesn't come any more is looked for once."""

    def __init__(self, text: str):
        self.text, self.next = text, {}

    def find(self, wanted: str, at: int) -> int:
        """The first place from ``at`` on, or the end of the text."""
        known = self.next.get(wanted, -1)
        if known < at:
            found = self.text.find(wanted, at)
            known = self.next[wanted] = len(self.text) if found < 0 else found
        return known


def _tag_end(html: str, scan: Scan, at: int) -> int:
    """The place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1 if it isn't closed. Quoted values may hold a ``>``."""
    while True:
        end = scan.find(">", at)
        if end == len(html):
            return -1
        double, single = scan.find('"', at), scan.find("'", at)
        quote = min(double, single)
        if quote > end:
            return end
        close = scan.find(html[quote], quote + 1)
        if close == len(html):  # a quote that is never closed is no quote
            return end
        at = close + 1


def tokens(html: str) -> Iterator[tuple[str, str, bool, int]]:
    """``(text, "", False, end)`` for text and ``(attributes, name, closing, end)`` for tags, in one pass. Comments and declarations are left out.

    The consumer may send back the place from which to go on. A ``<`` that begins no tag is text, as is a tag that isn't closed.
    """
    scan, at, n = Scan(html), 0, len(html)
    while at < n:
        if m := PLAIN.match(html, at):
            at = m.end()
            if m[2] is None:
                yield m[0], "", False, at
            else:
                at = (yield m[3], m[2].lower(), m[1] == "/", at) or at
            continue
        if html.startswith("<!--", at):
            at = min(n, scan.find("-->", at + 4) + 3)
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            at = min(n, scan.find(">", at) + 1)
            continue
        closing = html[at + 1 : at + 2] == "/"
        name = NAME.match(html, at + 1 + closing)
        end = _tag_end(html, scan, name.end()) if name else -1
        if end < 0:
            if not name and closing:  # an end tag without a name is a comment
                at = min(n, scan.find(">", at) + 1)
                continue
            after = scan.find("<", at + 1)
            yield html[at:after], "", False, after
            at = after
            continue
        at = (yield html[name.end() : end], name[0].lower(), closing, end + 1) or end + 1


def blocks(html: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of the page's non-empty blocks, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether article, whether marked (2) or suspect (1)
    opened: Counter = Counter()
    foreign = 0  # open drawings and formulas, whose elements may close themselves

    def end_block() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                _, article, marked = stack[-1] if stack else ("", False, 0)
                out.append((MARKED if marked == 2 else SUSPECT if marked else ARTICLE if article else OPEN, text))

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    reader = tokens(html)
    go_on = None
    while True:
        try:
            text, name, closing, at = reader.send(go_on)
        except StopIteration:
            break
        go_on = None
        if not name:
            held.append(text)
            continue
        if name in RAW and not closing:
            if name in BLOCK:
                end_block()
            if not (foreign and text.endswith("/")):
                end = RAW_END[name].search(html, at)
                last = html.find(">", end.end()) if end else -1
                go_on = len(html) if last < 0 else last + 1
            continue
        if name in ("svg", "math"):
            foreign = max(0, foreign - 1) if closing else foreign + (not text.endswith("/"))
        if name not in BLOCK and name not in CHROME_TAGS:
            if not closing and "hidden" not in text and "none" not in text:
                continue
            if not closing or not opened[name]:
                if closing or name in VOID or not _marked(text):
                    continue
        end_block()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
        else:
            if name in ("p", "li") and stack and stack[-1][0] == name:  # their end may be left out
                pop()
            _, article, marked = stack[-1] if stack else ("", False, 0)
            begins = name in ("article", "main")
            if name in CHROME_TAGS or name == "header" and not article:
                marked = 2
            elif name not in ("body", "html"):
                own = _inside(name, text) if article and not begins else 2 * _marked(text, ARTICLE_WORDS if begins else PAGE_WORDS)
                marked = max(marked, own)
            stack.append((name, article or begins, marked))
            opened[name] += 1
    end_block()
    return out


def suffixes(host: str, page: list[tuple[int, str]], depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """``(position, key high, key low)`` of each suffix of the page's stream that has ``depth`` words before article text intervenes.

    A suspect block of fewer words has a key of its own, at position -1 - p. The key is of the host and the words, so keys agree within one host only.
    """
    out, run, base = [], [], 0

    def keyed(at: int, *words: str) -> None:
        key = xxhash.xxh3_128_intdigest("\0".join([host, *words]).encode("utf-8", "surrogatepass"))
        out.append((at, key >> 64, key & 0xFFFFFFFFFFFFFFFF))

    for zone, text in [*page, (ARTICLE, "")]:
        if zone != ARTICLE:
            words = text.split(" ")
            if zone == SUSPECT and len(words) < depth:
                keyed(-1 - base - len(run), *words, "")
            run += words
            continue
        for p in range(len(run) - depth + 1):
            keyed(base + p, *run[p : p + depth])
        base += len(run)
        run = []
    return out


def assemble(page: list[tuple[int, str]], starts: list[int], depth: int = DEPTH) -> tuple[str, int, int]:
    """The main text, given the positions in the page's stream where shared substrings of ``depth`` words begin, or (-1 - p) shared short blocks.

    Also the number of words that the array removed, and that markup removed of the rest.
    """
    total = sum(len(text.split(" ")) for zone, text in page if zone != ARTICLE)
    covered = np.zeros(total + depth + 1, dtype=np.int64)
    short = {-1 - s for s in starts if s < 0}
    for s in starts:
        if s >= 0:
            covered[s] += 1
            covered[s + depth] -= 1
    covered = np.cumsum(covered) > 0
    kept, at, marked = [], 0, 0
    for zone, text in page:
        if zone == ARTICLE:
            kept.append(text)
            continue
        words = text.split(" ")
        if at in short:
            covered[at : at + len(words)] = True
        unique = [w for k, w in enumerate(words) if not covered[at + k]]
        at += len(words)
        if zone == MARKED:
            marked += len(unique)
        elif unique:
            kept.append(" ".join(unique))
    return " ".join(kept), int(covered.sum()), marked


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
    for b in batches:
        for i in range(0, b.num_rows, 512):
            rows = []
            for page, host, html in zip(*(b.slice(i, 512).column(c).to_pylist() for c in ("_page", "host", "_html"))):
                whole = blocks(html)
                content = xxhash.xxh64_intdigest("\0".join(f"{z}{t}" for z, t in whole).encode("utf-8", "surrogatepass"))
                rows += [(page, content, *s) for s in suffixes(host, whole)]
            if rows:
                page, content, at, high, low = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), signed(content), pa.array(at, pa.int32()), signed(high), signed(low)], names=["_page", "content", "at", "high", "low"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            made = [assemble(blocks(h), at or []) for h, at in zip(part.column("_html").to_pylist(), part.column("starts").to_pylist())]
            texts, repeated, marked = zip(*made)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(repeated, pa.int64()), pa.array(marked, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_repeated, n_marked)`` of every page: its main text, and the words removed as repeated over the host and as marked.

    Pages are parsed twice, which costs less than keeping them parsed.
    """
    page, url = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    html = text_or_empty("html")
    given = pages.select(F.xxhash64(F.col("page_id"), F.col("url"), html).alias("_page"), "page_id", "url", host.alias("host"), html.alias("_html"))
    array = materialize(given.select("_page", "host", "_html").mapInArrow(_suffixes, "_page long, content long, at int, high long, low long"))
    shared = array.groupBy("high", "low").agg(F.min("content").alias("_a"), F.max("content").alias("_b")).filter("_a < _b")
    shared = materialize(shared.select("high", "low"))
    hits = array.join(maybe_broadcast(shared), ["high", "low"], "left_semi")
    starts = materialize(hits.groupBy("_page").agg(F.collect_set("at").alias("starts")))
    joined = given.join(maybe_broadcast(starts), "_page", "left").select("page_id", "url", "_html", "starts")
    return joined.mapInArrow(_assembled, f"page_id {page}, url {url}, text string, n_chars long, n_repeated long, n_marked long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
