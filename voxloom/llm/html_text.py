"""Main text of web pages: page structure tells what can be content, repeats among the pages of a host what of it is boilerplate."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, input_bytes, written

#: Tokens from which a repeated substring counts as boilerplate.
LEAST_TOKENS = 10
#: Tokens from which a repeated stretch that is more than half of a page is an article that another page has too.
ARTICLE_TOKENS = 25
#: Bytes of evidence for each bucket whose suffixes are sorted together.
BUCKET_BYTES = 4 << 20

# a quote counts only after "="; a tag that the page's end cuts off is markup too
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")

#: Elements whose text never is content.
_HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select option textarea dialog menu".split())
#: Elements whose content is text up to their end tag.
_RAW = frozenset("script style noscript template iframe textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a block of text.
_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold prose; their text within an article is the article's whatever other pages have.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary address".split())
#: Words in class, id, role or label that mark a part of a page as none of its article.
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead header share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget widgets contentinfo complementary".split()
)
#: Words that mark what readers wrote.
_COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion".split())
#: Words beside those above that leave a name's meaning as it is ("site-header", "ad-container"); others change it ("banner-free").
_PLAIN = frozenset(
    "site page post entry article main top bottom left right global primary secondary container wrapper wrap box area list block section inner outer bar panel row col column item items links link buttons button icons unit slot "
    "form thread body text content posts message messages dialog the my js".split()
)
#: Elements that hold the article and so aren't judged by their names.
_ROOTS = frozenset(("html", "body"))

KEEP, OPEN, CHROME = 0, 1, 2


class Block(NamedTuple):
    """A block of text: ``KEEP`` is prose of the article, ``OPEN`` is content unless the host repeats it, ``CHROME`` is none."""

    text: str
    kind: int


def _marks(attributes: str, main: bool = False) -> int:
    """What an element's class, id, role and label say of it: 0 nothing, 1 chrome, 2 readers' comments; within a main part a header is content."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = set(_NAME_PARTS.findall(name))
            if not parts <= _CHROME | _COMMENTS | _PLAIN:
                continue
            if parts & _COMMENTS:
                return 2
            if parts & _CHROME and not (main and parts & _CHROME == {"header"}):
                found = 1
    return found


def _is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ("main", "article") for m in _ATTRIBUTE.finditer(attributes))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order.

    Tags need not be balanced: an end tag closes the nearest open element of
    its name and what is open inside it; others are passed over.  Scripts and
    the like have no text.  Chrome are menus, headers, footers, asides, forms
    and what is named so; an article or main element is never judged by its
    name unless that tells of comments, and an element that is named as chrome
    but holds more than half of the main part's words is its layout.  On a
    page with an article or main element prose within it is kept, other text
    in it is open and all outside of it is chrome; on any other page all text
    that isn't chrome is open.
    """
    out: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = []  # text, main, chrome, prose, named elements around it
    text: list[str] = []
    stack: list[tuple] = []  # name, then the state outside of it
    main = chrome = prose = False
    named: tuple[int, ...] = ()
    elements = 0
    open_names: dict[str, int] = {}

    def flush():
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                out.append((joined, main, chrome, prose, named))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if open_names.get(name):
                if name in _BLOCK or name in _HIDDEN:
                    flush()
                while stack:
                    last, main, chrome, prose, named = stack.pop()
                    open_names[last] -= 1
                    if last == name:
                        break
            elif name in _BLOCK:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        attributes = m[3]
        if name in _BLOCK or name in _HIDDEN:
            flush()
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK and name not in _HIDDEN:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
            last, main, chrome, prose, named = stack.pop()
            open_names[last] -= 1
        stack.append((name, main, chrome, prose, named))
        open_names[name] = open_names.get(name, 0) + 1
        if name in _BLOCK:
            prose = name in _PROSE
        is_main = _is_main(name, attributes)
        marks = _marks(attributes, main) if attributes and name not in _ROOTS else 0
        if name in _HIDDEN or name == "header" and not main or marks == 2:
            chrome = True
        elif is_main:
            main = main or not (chrome or named)
        elif marks:
            elements += 1
            named += (elements,)
    flush()
    words = [len(t.split(" ")) for t, *_ in out]
    has_main = any(m and not c for _, m, c, _, _ in out)
    held: dict[int, int] = {}
    total = 0
    for n, (_, m, c, _, inside) in zip(words, out):
        if not c and (m or not has_main):
            total += n
            for e in inside:
                held[e] = held.get(e, 0) + n
    layout = {e for e, n in held.items() if has_main and 2 * n > total}
    found = []
    for t, m, c, p, inside in out:
        content = (m or not has_main) and not c and layout.issuperset(inside)
        found.append(Block(t, CHROME if not content else KEEP if m and p else OPEN))
    return found


def host_of(url: str | None) -> str:
    """The host of a URL, lower-cased, without user or port; empty if there is none."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() if m else ""


# -- repeats among the pages of a host --------------------------------------------------------------------------


def _number(host: str, found: list[Block]) -> int:
    """A page of a host as a number: 64 bits of MD5 of its blocks, by which pages are told apart."""
    return int.from_bytes(hashlib.md5("\n".join((host, *(b.text for b in found))).encode("utf-8", "replace")).digest()[:8], "little", signed=True)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def anchors(host: str, tokens: list[str], least: int) -> np.ndarray:
    """For the window of ``least`` tokens at each place the least hash of the half-as-long runs inside it, salted by host: equal windows have equal anchors."""
    if len(tokens) < least:
        return np.empty(0, np.int64)
    short = max(1, least // 2)
    token = _mixed(np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) for t in tokens), np.uint64, len(tokens)))
    run = np.zeros(len(tokens) - short + 1, np.uint64)
    for k in range(short):
        run = run * _ODD + token[k : k + len(run)]
    low = np.lib.stride_tricks.sliding_window_view(_mixed(run), least - short + 1).min(axis=1)
    return _mixed(low ^ np.uint64(zlib.crc32(host.encode("utf-8", "replace")))).view(np.int64)


def evidence(host: str, found: list[Block], least: int) -> list[tuple[int, str, int]]:
    """(anchor, tokens joined by spaces, place of the first) of the pieces of a page in which repeats are searched.

    The page's tokens, those of kept prose aside, are one stream, parted where
    kept prose lies.  A piece holds the windows of ``least`` tokens in a row
    that have the same anchor, so any window and its copies, whatever pieces
    they lie in, come under one anchor.
    """
    out: list[tuple[int, str, int]] = []
    tokens: list[str] = []
    first = at = 0

    def cut():
        a = anchors(host, tokens, least)
        if len(a):
            edge = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            out.extend((int(a[x]), " ".join(tokens[x : y + least - 1]), first + x) for x, y in zip(edge, edge[1:]))

    for text, kind in found:
        own = text.split(" ")
        if kind == KEEP:
            cut()
            tokens = []
        else:
            if not tokens:
                first = at
            tokens = [*tokens, *own] if not tokens else tokens + own
        at += len(own)
    cut()
    return out


_EVIDENCE = "ka long, kb long, host string, number long, asks boolean, pieces array<struct<anchor:long,piece:string,at:int>>"


def _evidence(least: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("anchor", pa.int64()), ("piece", pa.string()), ("at", pa.int32())]))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ka, kb, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                found, host = blocks(page or ""), host_of(url)
                pieces = [{"anchor": a, "piece": t, "at": at} for a, t, at in evidence(host, found, least)]
                out.append((ka, kb, host, _number(host, found), any(b.kind == OPEN for b in found), pieces))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["ka", "kb", "host", "number", "asks", "pieces"])

    return rows


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``ids`` in the order of their suffixes, and for each but the first whether it shares ``least`` ids with the one before.

    By prefix doubling: the rank of a suffix by its first 2n ids follows from
    the ranks by n of it and of the one n further on.  Positions are sorted,
    no suffix is copied.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    by_length = {1: rank}
    length = 1
    while length < least or len(by_length[length]) and by_length[length].max() < n:
        further = np.zeros(n, np.int64)
        further[: max(0, n - length)] = by_length[length][length:]
        rank = np.unique(by_length[length] * (n + 1) + further, return_inverse=True)[1].astype(np.int64) + 1
        length *= 2
        by_length[length] = rank
    order = np.argsort(by_length[length], kind="stable")
    same = np.ones(max(0, n - 1), bool)
    at, left = np.zeros(n, np.int64), least  # least as a sum of powers of two
    for size in sorted(by_length, reverse=True):
        if size <= left:
            place = np.minimum(order + at, n)
            names = np.append(by_length[size], 0)[place]
            same &= (names[1:] == names[:-1]) & (names[1:] > 0)
            at += size
            left -= size
    return order, same


def _repeats(least: int):
    def repeats(table: pa.Table) -> pa.Table:
        """Of a bucket's distinct pieces those with windows that two pages of the host have, and where in the piece these start."""
        hosts, pieces = table.column("host").to_pylist(), table.column("piece").to_pylist()
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        names: dict[tuple[str, str], int] = {}
        ids: list[int] = []
        first = []
        for host, piece in zip(hosts, pieces):
            first.append(len(ids))
            ids += [names.setdefault((host, t), len(names)) for t in piece.split(" ")]
            ids.append(-len(first))  # an end that no other piece has
        order, same = suffix_array(np.array(ids, np.int64), least)
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        owner = np.searchsorted(np.array(first), order, "right") - 1
        twice = np.minimum.reduceat(low[owner], begin) != np.maximum.reduceat(high[owner], begin)
        length = np.append(np.array(first[1:]) - 1, len(ids) - 1)[owner] - order
        taken = np.repeat(twice, np.diff(np.append(begin, len(order)))) & (length >= least)
        starts: dict[int, list[int]] = {}
        for o, k in zip(owner[taken].tolist(), order[taken].tolist()):
            starts.setdefault(o, []).append(k - first[o])
        rows = sorted(starts)
        return pa.table(
            {
                "anchor": table.column("anchor").take(pa.array(rows, pa.int64())),
                "host": pa.array([hosts[k] for k in rows], pa.string()),
                "piece": pa.array([pieces[k] for k in rows], pa.string()),
                "starts": pa.array([sorted(starts[k]) for k in rows], pa.list_(pa.int32())),
            }
        )

    return repeats


def repeated_runs(rows: DataFrame, *, least: int = LEAST_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(ka, kb, starts): where on the pages that have open text ``least`` tokens begin that another page of the host has too; written.

    A token lies in a repeated substring of ``least`` tokens or more just if
    it lies in one of exactly ``least``.  All pages give evidence, whole: the
    pieces of :func:`evidence`.  Equal pieces of a host are one row before
    they are shuffled, with the least and the greatest page that has them, so
    a footer of a million pages is a row a task.  Pieces are dealt into
    buckets by anchor, not by host, and each bucket sorts the suffixes of its
    pieces: neighbours that share ``least`` tokens and come from two pages are
    repeats.  Texts are compared, not hashes of them.
    """
    buckets = min(max(1, -(-input_bytes(rows) // bucket_bytes)), 1 << 16)
    told = written(rows.select("ka", "kb", "url", "html").mapInArrow(_evidence(least), _EVIDENCE), "page-evidence")
    every = told.select("host", "number", F.explode("pieces").alias("p")).select("p.anchor", "host", "p.piece", "number")
    distinct = every.groupBy("anchor", "host", "piece").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    dealt = distinct.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    repeats = written(dealt.groupBy("bucket").applyInArrow(_repeats(least), "anchor long, host string, piece string, starts array<int>"), "page-repeats")
    asked = told.filter("asks").select("ka", "kb", "host", F.explode("pieces").alias("p")).select("ka", "kb", "host", "p.anchor", "p.piece", "p.at")
    found = asked.join(repeats, ["anchor", "host", "piece"]).select("ka", "kb", F.transform("starts", lambda s: s + F.col("at")).alias("starts"))
    covered = written(found.groupBy("ka", "kb").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "page-runs")
    discard(told, repeats)
    return covered


def unique_text(found: list[Block], starts: list[int], least: int) -> str:
    """The text of a page: its kept blocks, and its open ones without the runs of ``least`` tokens that begin at ``starts`` of its stream.

    Of open blocks go whole blocks and stretches of ``least`` tokens; a few
    words beside a run that go on differently are the block's own.  A
    repeated stretch of ``ARTICLE_TOKENS`` or more that is over half of the
    page's content is an article that another page has too, and stays.
    """
    if not starts:
        return "\n\n".join(b.text for b in found if b.kind != CHROME)
    split = [b.text.split(" ") for b in found]
    kinds = np.repeat([b.kind for b in found], [len(t) for t in split])
    depth = np.zeros(len(kinds) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.array(starts) + least, -1)
    covered = (np.cumsum(depth)[:-1] > 0) & (kinds == OPEN)
    content = np.flatnonzero(kinds != CHROME)
    run = covered[content]  # a stretch goes on over chrome in its midst
    edge = np.flatnonzero(np.diff(np.concatenate(([False], run, [False])).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= ARTICLE_TOKENS and 2 * (b - a) > len(content):
            covered[content[a:b]] = False
    out, at = [], 0
    for block, tokens in zip(found, split):
        gone = covered[at : at + len(tokens)]
        at += len(tokens)
        if block.kind == CHROME:
            continue
        if not gone.any():
            out.append(block.text)
            continue
        kept, first = [], 0
        while first < len(tokens):
            last = first + 1
            while last < len(tokens) and gone[last] == gone[first]:
                last += 1
            if not gone[first] or last - first < min(least, len(tokens)):
                kept += tokens[first:last]
            first = last
        if kept:
            out.append(" ".join(kept))
    return "\n\n".join(out)


def _texts(least: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [unique_text(blocks(page or ""), starts or [], least) for page, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=["page_id", "url", "text"])

    return texts


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The main text of every page.

    Structure tells what can be content (:func:`blocks`): prose in an article
    or main element is, whatever other pages have; chrome isn't; the rest is
    open.  Of the open text, substrings of ``least_tokens`` tokens or more
    that occur on two distinct pages of the host, in open text or chrome and
    across blocks, are boilerplate and go (:func:`repeated_runs`,
    :func:`unique_text`).  Pages with equal blocks count as one page, so
    copies of a page don't erase each other.

    Character references are decoded, white space within a block becomes one
    space, blocks are trimmed and joined by an empty line.  Returns one row
    per input row: ``id_col``, ``url``, ``text`` (empty if none).  Null html
    is empty; null urls form one host; repeated rows, equal ids and null ids
    are kept; very long texts are handled whole, in time and memory that grow
    with their length; an empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.select("page_id", "url", "html", F.xxhash64("url", "html").alias("ka"), F.xxhash64("html", F.lit(1), "url").alias("kb"))
    covered = repeated_runs(rows, least=least_tokens)
    told = rows.join(covered, ["ka", "kb"], "left").select("page_id", "url", "html", "starts")
    return told.mapInArrow(_texts(least_tokens), "page_id long, url string, text string").withColumnRenamed("page_id", id_col)
