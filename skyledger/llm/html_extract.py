"""Main text by template deduction over the pages of a host.

Each page is cut into blocks of text with the path of containers around them
(tag and class words). Its template tokens are those containers and, in each
path, its words, told apart by their neighbours: a token is a pair of words in
a row, or a word at the start or end of a block. Tokens of a host with the same
occurrence vector (the same pages, the same count on each) form an
equivalence class; classes of two or more tokens that ``SUPPORT`` pages and half of
the host's have, in one order on all pages and each in one gap of the class around it,
are valid. Tokens of no class get a role for each gap of a valid class that they are
in, and are counted again, until no more are found: the host's template. Words in two or more valid tokens in
a row are template text; the slots between them, of all paths, are the page's text.
Article and main elements are one slot each: whatever the pages of a host share inside
them, and however many pages there are, every sentence stays.
A page of template text only keeps it (copies of one page are no evidence).
Scripts, styles, comments and the head never become blocks.
Menus, headers, footers, sidebars, notices, adverts and forms are marked by element
and class words, and an article or main element inside one ends the mark. A marked
container is left out only if the template has it (it is on two pages of the host,
or the host has one page) and the main text is elsewhere: it holds at most half of
the host's text, or the page has an article or main element outside. A page of
which nothing is left, and that has no such element, gives all its blocks.

Scale. Pages are parsed once, in place, and written. A first pass counts in how many
pages of a host each of ``BUCKETS`` hash classes of words is: never fewer than any
word of it, so only pairs of words whose classes reach the support are counted
exactly, and no valid one is lost. All counts are combined in a task's batch
ahead of each shuffle. Occurrence vectors are folded into order-free sums. Order and
nesting are checked in place, as a page is whole in a row; only ranks, pairs of
classes and gaps are shuffled. A round is two passes over the pages of the hosts that
the last one found something for. The template (one row per host) is written and joined to the parsed pages: broadcast
while it is below the planner's threshold, else by host, where AQE splits a hot one.

A null or empty html has an empty text; a null url belongs to the host "";
equal rows are extracted each; other columns are ignored; empty tables give no
rows. ``<br>`` counts as white space inside its block.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import store, tokens

#: Elements of HTML by what they mean for the main text.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
MARKED = frozenset("nav footer aside form button dialog menu".split())
CONTAINERS = frozenset("html body head main article section div nav header footer aside form ul ol dl table tbody thead tr td th figure blockquote details fieldset button dialog menu center".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd hr pre address figcaption caption summary legend option".split()) | CONTAINERS
#: Class and id words of what surrounds an article, and of articles.
AROUND = frozenset("""ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu sidebar
cookie cookies consent notice notices gdpr popup modal overlay comment comments disqus respond replies share sharing social related
recommended breadcrumb breadcrumbs newsletter subscribe signup login search pagination pager widget toolbar masthead""".split())
EDGES = frozenset("header footer".split())  # marked around an article, kept inside it
MAIN = frozenset("article main content post entry story".split())

SUPPORT = 8  # pages that must have a template token, at least
BUCKETS = 1 << 12  # hash classes of words of a host
DEPTH = 64  # containers nested deeper share the path of the one at this depth

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?=>)|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"[^A-Za-z]+")
_IN_ARTICLE = re.compile(r"/(?:article|main)(?:[./]|$)")


class Page(NamedTuple):
    """The blocks (path, text, paths of the marked containers around it) in order, its containers (path, number of blocks before it) in order, and whether an article or main element stands unmarked."""

    blocks: list[tuple[str, str, tuple[str, ...]]]
    tokens: list[tuple[str, int]]
    article: bool


def parse(source: str) -> Page:
    """A page cut into blocks and containers."""
    blocks: list[tuple[str, str, tuple[str, ...]]] = []
    seen: list[tuple[str, int]] = []
    article = False
    stack: list[tuple[str, str, bool, bool, tuple[str, ...]]] = [("", "", False, False, ())]  # tag, path, in the head, inside an article, marked containers
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                blocks.append((stack[-1][1], whole, stack[-1][4]))

    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if not stack[-1][2]:
            text.append(source[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "br":
            text.append(" ")
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
            continue
        if tag not in BREAKS:
            continue
        flush()
        if tag not in CONTAINERS or m[3].endswith("/"):
            continue
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            del stack[depth or len(stack) :]
            continue
        ends = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, ())
        while stack[-1][0] in ends:  # these need no end tag
            stack.pop()
        named = [(v[1] or v[2] or v[3]) for v in (a.groups() for a in _ATTRIBUTE.finditer(m[3]))] if m[3] else []
        words = {w.lower() for name in named for w in _WORDS.split(name) if w}
        _, above, hidden, inside, marks = stack[-1]
        path = f"{above}/{'.'.join([tag, *sorted(words)])}" if len(stack) <= DEPTH else above
        whole = tag in ("html", "body", "article", "main")
        hidden = tag == "head" or (hidden and not whole)
        if tag in ("article", "main") and marks and words & AROUND:
            marks = (*marks, path)  # a comment, say, among comments
        elif whole:
            marks = ()
            article = article or tag in ("article", "main")
        elif tag in MARKED or words & AROUND or (not inside and (tag == "header" or words & EDGES)):
            marks = (*marks, path)
        seen.append((path, len(blocks)))
        stack.append((tag, path, hidden, inside or tag in ("article", "main") or (not whole and bool(words & MAIN)), marks))
    flush()
    return Page(blocks, seen, article)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks, containers and whether there is an article, of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("marks", pa.list_(pa.string()))]))
        token = pa.list_(pa.struct([("token", pa.string()), ("at", pa.int32())]))
        for b in tokens.slices(batches, "html", 1 << 20):
            found = [parse(h or "") for h in b.column("html").to_pylist()]
            out = [b.column("page_id"), b.column("url"), pa.array([[{"path": p, "text": t, "marks": m} for p, t, m in f.blocks] for f in found], block),
                   pa.array([[{"token": k, "at": n} for k, n in f.tokens] for f in found], token), pa.array([f.article for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "blocks", "tokens", "article"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"page_id {kind}, url string, blocks array<struct<path:string,text:string,marks:array<string>>>, tokens array<struct<token:string,at:int>>, article boolean")
    return out.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)))


class Words(NamedTuple):
    """The words of a batch of parsed pages: page of each block, its first word, and by word and by pair (one more than the words of a block) the block and a hash."""

    page: np.ndarray
    starts: np.ndarray
    word_key: np.ndarray
    pair_block: np.ndarray
    pair_key: np.ndarray


def _hashes(values: pa.Array) -> np.ndarray:
    coded = pc.dictionary_encode(pc.fill_null(values, ""))
    return np.concatenate([tokens.byte_hashes(coded.dictionary), np.zeros(1, np.uint64)])[coded.indices.to_numpy(zero_copy_only=False)]


def _batches(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    tokens.frugal()
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _words(b: pa.RecordBatch) -> Words:
    blocks = b.column("blocks")
    flat = blocks.flatten()
    page = np.repeat(np.arange(b.num_rows), np.diff(blocks.offsets.to_numpy()))
    t = tokens.tokenise(pc.struct_field(flat, "text"), tokens.white_table(lower=False))
    word = tokens.byte_hashes(t.words)[t.codes] if len(t.codes) else np.zeros(0, np.uint64)
    n, starts = len(flat), t.starts
    place = tokens.mixed(_hashes(b.column("host"))[page] + _PLACE * _hashes(pc.struct_field(flat, "path")))
    left, right = (np.full(len(word) + n, edge, np.uint64) for edge in (1, 2))
    keep = np.ones(len(left), bool)
    keep[starts[:-1] + np.arange(n)] = False
    left[keep] = word
    keep[:] = True
    keep[starts[1:] + np.arange(n)] = False
    right[keep] = word
    block = np.repeat(np.arange(n), np.diff(starts) + 1)
    pair = tokens.mixed(tokens.mixed(place[block] + left) * _PLACE + right)
    return Words(page, starts, tokens.mixed(np.repeat(place, np.diff(starts)) ^ word), block, pair)


def frequent(pages: DataFrame) -> DataFrame:
    """host, need (the pages that a template token must have) and the hash classes of words, as bits, that so many pages have; hosts of ``SUPPORT`` pages or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            w = _words(b)
            hosts = pc.dictionary_encode(b.column("host"))
            code = hosts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(w.page, np.diff(w.starts))
            once = np.unique(owner * BUCKETS + (w.word_key % np.uint64(BUCKETS)).astype(np.int64))
            cell, n = np.unique(code[once // BUCKETS] * BUCKETS + once % BUCKETS, return_counts=True)
            ends, total, rows = np.searchsorted(cell // BUCKETS, np.arange(len(hosts.dictionary) + 1)), np.bincount(code, minlength=len(hosts.dictionary)), []
            for k in range(len(hosts.dictionary)):
                own = np.zeros(BUCKETS + 1, np.uint32)
                own[cell[ends[k] : ends[k + 1]] % BUCKETS] = n[ends[k] : ends[k + 1]]
                own[BUCKETS] = total[k]
                rows.append(zlib.compress(own.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([hosts.dictionary, pa.array(rows, pa.binary())], names=["host", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(host: str, n: np.ndarray) -> pa.RecordBatch:
            need = max(SUPPORT, -(-int(n[BUCKETS]) // 2))
            return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([need]), pa.array([np.packbits(n[:BUCKETS] >= need).tobytes()], pa.binary())], names=["host", "need", "bits"])

        at, n = None, None
        for b in batches:  # sorted by host
            for host, data in zip(b.column("host").to_pylist(), b.column("data").to_pylist()):
                if host != at:
                    if n is not None and n[BUCKETS] >= SUPPORT:
                        yield told(at, n)
                    at, n = host, np.zeros(BUCKETS + 1, np.int64)
                n += np.frombuffer(zlib.decompress(data), np.uint32)
        if n is not None and n[BUCKETS] >= SUPPORT:
            yield told(at, n)

    counted = pages.select("host", "blocks").mapInArrow(count, "host string, data binary")
    return counted.repartition("host").sortWithinPartitions("host").mapInArrow(merge, "host string, need long, bits binary")


class Events(NamedTuple):
    """Template tokens of a batch of parsed pages in page order: page, role and the place among the pairs of words (-1: a container)."""

    page: np.ndarray
    role: np.ndarray
    pair: np.ndarray


def _events(b: pa.RecordBatch, w: Words, some: np.ndarray | None = None) -> Events:
    """The containers and (those of) the pairs of words as tokens."""
    held = b.column("tokens")
    page = np.repeat(np.arange(b.num_rows), np.diff(held.offsets.to_numpy()))
    flat = held.flatten()
    role = tokens.mixed(_hashes(b.column("host"))[page] ^ _hashes(pc.struct_field(flat, "token")))
    before = (b.column("blocks").offsets.to_numpy()[:-1] - b.column("blocks").offsets.to_numpy()[0])[page] + pc.struct_field(flat, "at").to_numpy()
    pair = np.arange(len(w.pair_key)) if some is None else np.flatnonzero(some)
    page = np.concatenate([page, w.page[w.pair_block[pair]]])
    place = np.concatenate([2 * (w.starts[before] + before), 2 * pair + 1])
    order = np.lexsort((place, page))
    return Events(page[order], np.concatenate([role, w.pair_key[pair]])[order], np.concatenate([np.full(len(before), -1), pair])[order])


class Known(NamedTuple):
    """The classes of the hosts of a batch: roles in order, with the number of their class and the round in which they were found, and the classes' names."""

    role: np.ndarray
    kind: np.ndarray
    since: np.ndarray
    names: np.ndarray

    def look(self, role: np.ndarray, rounds: int) -> np.ndarray:
        """The place of each role among those of the first rounds, or -1."""
        if not len(self.role):
            return np.full(len(role), -1)
        at = np.minimum(np.searchsorted(self.role, role), len(self.role) - 1)
        return np.where((self.role[at] == role) & (self.since[at] <= rounds), at, -1)

    def sizes(self, rounds: int) -> np.ndarray:
        return np.bincount(self.kind[self.since <= rounds], minlength=len(self.names))


def _known(b: pa.RecordBatch) -> Known:
    _, row = np.unique(pc.dictionary_encode(b.column("host")).indices.to_numpy(zero_copy_only=False), return_index=True)
    own = [b.column(c).take(pa.array(row)).flatten().to_numpy(zero_copy_only=False) for c in ("roles", "classes", "rounds")]
    role = own[0].astype(np.int64).view(np.uint64)
    names, kind = np.unique(own[1].astype(np.int64), return_inverse=True)
    order = np.argsort(role)
    return Known(role[order], kind[order], own[2].astype(np.int64)[order], names)


def _sweep(page: np.ndarray, kind: np.ndarray, role: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[tuple[int, int]], dict[tuple[int, int], tuple[int, int]]]:
    """Of the tokens of classes, in page order: the rank in the turn of the class, the gap that follows (that of a role, 0 outside all), the classes that cross each other, and by class and the one around it (or -1) the least and the last gap."""
    n = len(page)
    order = np.lexsort((kind, page))
    p, c = page[order], kind[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(first, n))
    start = np.repeat(first, length)
    nth = np.arange(n) - start
    rank, turn = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order], turn[order] = nth % sizes[c], start + nth // sizes[c] * sizes[c]
    gap = tokens.mixed(role + _PLACE)
    crossed: set[tuple[int, int]] = set()
    nested: dict[tuple[int, int], tuple[int, int]] = {}
    at = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])) if n else first
    last = np.append(at[1:], n) - 1 if n else at
    after = []
    stack: list[list[int]] = []  # turn, class, gap of the open ones
    now = -1
    for on, mine, own, inside, closed in zip(page[at].tolist(), turn[at].tolist(), kind[at].tolist(), gap[last].tolist(), (rank[last] == sizes[kind[last]] - 1).tolist()):
        if on != now:
            now = on
            stack.clear()
        if not stack or stack[-1][0] != mine:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == mine), None)
            if depth is None:
                around, hole = (stack[-1][1], stack[-1][2]) if stack else (-1, 0)
                least, most = nested.get((own, around), (hole, hole))
                nested[own, around] = min(least, hole), max(most, hole)
                stack.append([mine, own, 0])
            else:
                crossed.update((min(own, x[1]), max(own, x[1])) for x in stack[depth + 1 :] if x[1] != own)
                del stack[depth + 1 :]
        if closed:
            stack.pop()
        else:
            stack[-1][2] = inside
        after.append(stack[-1][2] if stack else 0)
    gap[last] = np.array(after, np.uint64)
    return rank, gap, crossed, nested


def _replayed(e: Events, known: Known, rounds: int) -> tuple[Events, np.ndarray]:
    """The tokens with their roles after so many rounds, and the places of their classes: one of no class has a role for each gap it is in."""
    role, entry = e.role, np.full(len(e.role), -1)
    for k in range(1, rounds + 1):
        entry = known.look(role, k)
        held = np.flatnonzero(entry >= 0)
        if not len(held):
            break
        _, gap, _, _ = _sweep(e.page[held], known.kind[entry[held]], role[held], known.sizes(k))
        before = np.searchsorted(held, np.arange(len(role)), side="right") - 1
        around = np.where((before >= 0) & (e.page[held[before]] == e.page), gap[before], np.uint64(0))
        role = np.where((entry < 0) & (around != 0), tokens.mixed(role + _PLACE * around), role)
    return e._replace(role=role), entry


def _often(b: pa.RecordBatch, w: Words) -> np.ndarray:
    """Whether the words of each pair are on as many pages as a template token must have, by their hash classes."""
    bits = np.unpackbits(np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8)).reshape(-1, BUCKETS)
    owner = np.repeat(w.page, np.diff(w.starts))
    often = bits[owner, (w.word_key % np.uint64(BUCKETS)).astype(np.int64)].astype(bool)
    n = len(w.starts) - 1
    both, keep = np.ones(len(w.pair_key), bool), np.ones(len(w.pair_key), bool)
    keep[w.starts[:-1] + np.arange(n)] = False
    both[keep] &= often
    keep[:] = True
    keep[w.starts[1:] + np.arange(n)] = False
    both[keep] &= often
    return both


MOVED, CROSSED, NESTED = range(3)  # faults of classes
_LISTS = "roles array<long>, classes array<long>, rounds array<int>"


def _counted(pages: DataFrame, rounds: int) -> DataFrame:
    """host and found: the roles of no class after so many rounds that enough pages have, with the name of their occurrence vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            w = _words(b)
            e, entry = _replayed(_events(b, w, _often(b, w)), _known(b), rounds)
            key, page = e.role[entry < 0], e.page[entry < 0]
            if not len(key):
                continue
            order = np.lexsort((page, key))
            key, page = key[order], page[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (page[1:] != page[:-1])]))
            times, key, page = np.diff(np.append(first, len(key))), key[first], page[first]
            mark = tokens.mixed(tokens.mixed(b.column("uid").to_numpy().view(np.uint64)[page]) + _PLACE * times.astype(np.uint64))
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = (mark & np.uint64(0xFFFFFFFF)).astype(np.int64), (mark >> np.uint64(32)).astype(np.int64)
            out = [b.column("host").take(pa.array(page[at])), pa.array(key[at].view(np.int64)), b.column("need").take(pa.array(page[at])),
                   pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(low, at)), pa.array(np.add.reduceat(high, at))]
            yield pa.RecordBatch.from_arrays(out, names=["host", "role", "need", "pages", "low", "high"])

    counted = pages.mapInArrow(run, "host string, role long, need long, pages long, low long, high long")
    role = (counted.groupBy("host", "role", "need").agg(F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"))
            .where("pages >= need").withColumn("class", F.xxhash64("host", "pages", "low", "high")))
    return role.groupBy("host").agg(F.collect_list(F.struct("role", "class")).alias("found"))


def _joined(hosts: DataFrame, rounds: int) -> DataFrame:
    """The classes with the roles found in the next round: those of a known class, and classes of two or more; hosts that have such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                old = set(row["classes"])
                size: dict[int, int] = {}
                for x in row["found"]:
                    size[x["class"]] = size.get(x["class"], 0) + 1
                more = [(x["role"], x["class"]) for x in row["found"] if x["class"] in old or size[x["class"]] > 1]
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array([row["host"]]), pa.array([row["need"]]), pa.array([row["bits"]], pa.binary()), pa.array([[*row["roles"], *[x[0] for x in more]]], pa.list_(pa.int64())),
                                                      pa.array([[*row["classes"], *[x[1] for x in more]]], pa.list_(pa.int64())), pa.array([[*row["rounds"], *[rounds + 1] * len(more)]], pa.list_(pa.int32()))],
                                                     names=["host", "need", "bits", "roles", "classes", "rounds"])

    return hosts.mapInArrow(run, f"host string, need long, bits binary, {_LISTS}")


def _faults(pages: DataFrame, rounds: int) -> DataFrame:
    """host, moved (roles of no fixed rank in their class on all pages), crossed (classes that overlap) and nested (classes with those around them, ``loose`` if not in one gap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            w, known = _words(b), _known(b)
            e, _ = _replayed(_events(b, w, _often(b, w)), known, rounds)
            entry = known.look(e.role, rounds + 1)
            held = np.flatnonzero(entry >= 0)
            if not len(held):
                continue
            entry = entry[held]
            rank, _, crossed, nested = _sweep(e.page[held], known.kind[entry], e.role[held], known.sizes(rounds + 1))
            order = np.argsort(entry, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(entry[order]) != 0]))
            host_of = np.zeros(len(known.names), np.int64)
            host_of[known.kind[entry]] = e.page[held]
            one = known.kind[entry[order][first]]
            rows = [(MOVED, int(p), int(r), None, int(x), int(y)) for p, r, x, y in zip(host_of[one], known.role[entry[order][first]].view(np.int64), np.minimum.reduceat(rank[order], first), np.maximum.reduceat(rank[order], first))]
            rows += [(CROSSED, int(host_of[x]), int(known.names[x]), int(known.names[y]), 0, 1) for x, y in crossed]
            rows += [(NESTED, int(host_of[x]), int(known.names[x]), int(known.names[y]) if y >= 0 else None, least - (1 << 63), most - (1 << 63)) for (x, y), (least, most) in nested.items()]
            out = [pa.array([r[0] for r in rows], pa.int32()), b.column("host").take(pa.array([r[1] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 6))]
            yield pa.RecordBatch.from_arrays(out, names=["what", "host", "one", "other", "least", "most"])

    seen = pages.mapInArrow(run, "what int, host string, one long, other long, least long, most long")
    seen = seen.groupBy("what", "host", "one", "other").agg(F.min("least").alias("least"), F.max("most").alias("most")).where(F.expr(f"what = {NESTED} OR least < most"))
    pair = F.struct("one", "other", (F.col("least") < F.col("most")).alias("loose"))
    return seen.groupBy("host").agg(*[F.collect_list(F.when(F.col("what") == k, x)).alias(n) for k, x, n in ((MOVED, F.col("one"), "moved"), (CROSSED, pair, "crossed"), (NESTED, pair, "nested"))])


def _handled(hosts: DataFrame, rounds: int) -> DataFrame:
    """The valid classes: ordered, nested and of two tokens or more; ``more`` tells whether the round found any."""

    def valid(row: dict) -> list[tuple[int, int, int]]:
        new, moved = rounds + 1, set(row["moved"] or [])
        own: dict[int, list[tuple[int, int, int]]] = {}
        for x in zip(row["roles"], row["classes"], row["rounds"]):
            own.setdefault(x[1], []).append(x)
        for c, held in own.items():
            if any(x[0] in moved for x in held):  # what is valid stays; of a new class those in order do, else what joined goes
                known = [x for x in held if x[2] < new]
                own[c] = [x for x in held if x[2] < new or x[0] not in moved] if not any(x[0] in moved for x in known) else known
        weight = {c: (min((x[2] for x in held), default=new) < new, len(held), c) for c, held in own.items()}
        around: dict[int, list[dict]] = {}
        for x in row["nested"] or []:
            around.setdefault(x["one"], []).append(x)
        apart = [x for held in around.values() if len(held) > 1 or held[0]["loose"] for x in held if x["other"] is not None]
        for x in sorted([*(row["crossed"] or []), *apart], key=lambda x: (x["one"], x["other"])):
            a, z = sorted((x["one"], x["other"]), key=lambda c: weight[c])
            if own[a] and own[z] and a != z:
                own[a] = [x for x in own[a] if x[2] < new]
                if own[a]:  # both were valid before: what joined made them cross
                    own[z] = [x for x in own[z] if x[2] < new]
        return [x for held in own.values() if len(held) > 1 for x in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                kept = valid(row)
                yield pa.RecordBatch.from_arrays([pa.array([row["host"]]), pa.array([row["need"]]), pa.array([row["bits"]], pa.binary()),
                                                  *(pa.array([[x[k] for x in kept]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))), pa.array([any(x[2] > rounds for x in kept)])],
                                                 names=["host", "need", "bits", "roles", "classes", "rounds", "more"])

    return hosts.mapInArrow(run, f"host string, need long, bits binary, {_LISTS}, more boolean")


def templates(pages: DataFrame) -> tuple[DataFrame, int]:
    """The valid classes of each host's template (host, roles, classes and the rounds in which they were found), from parsed pages, and the number of rounds.

    A round counts the roles of no class, forms classes of equal occurrence vectors,
    takes out what is not in order or not nested, and splits the roles left by the
    gaps of the classes; a host is done when a round finds no more.
    """
    none = [F.array().cast(k).alias(n) for n, k in (("roles", "array<long>"), ("classes", "array<long>"), ("rounds", "array<int>"))]
    own = pages.select("host", F.xxhash64("page_id", "url").alias("uid"), "blocks", "tokens")
    hosts = store.written(frequent(pages).select("host", "need", "bits", *none), "frequent")
    done, rounds = hosts.select("host", "roles", "classes", "rounds").limit(0), 0
    while True:
        found = _counted(own.join(hosts, "host"), rounds)
        joined = store.written(_joined(hosts.join(found, "host"), rounds), "joined")
        bad = _faults(own.join(joined, "host"), rounds)
        handled = store.written(_handled(joined.join(bad, "host", "left"), rounds), "classes")
        active = handled.where("more")
        kept = hosts.join(active.select("host"), "host", "left_anti").select("host", "roles", "classes", "rounds")
        done = done.unionByName(kept)
        if active.isEmpty():
            return done, rounds
        hosts, rounds = active.drop("more"), rounds + 1


def slots(pages: DataFrame, rounds: int) -> DataFrame:
    """page_id, url and text: what the template (``roles``, ``classes``, ``rounds``) leaves of the ``left`` blocks of each page; all of an article's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            w = _words(b)
            e, entry = _replayed(_events(b, w), _known(b), rounds)
            valid = np.zeros(len(w.pair_key), bool)
            valid[e.pair[(entry >= 0) & (e.pair >= 0)]] = True
            same = w.pair_block[1:] == w.pair_block[:-1]
            next_to = valid[1:] & valid[:-1] & same
            run_of = np.zeros(len(valid), bool)
            run_of[1:] |= next_to
            run_of[:-1] |= next_to
            texts, paths = (pc.struct_field(b.column("blocks").flatten(), c).to_pylist() for c in ("text", "path"))
            left = list(texts)
            for k in np.unique(w.pair_block[run_of]).tolist():
                if _IN_ARTICLE.search(paths[k]):
                    continue
                own = run_of[w.starts[k] + k : w.starts[k + 1] + k + 1]
                left[k] = " ".join(x for x, gone in zip(texts[k].split(" "), (own[1:] | own[:-1]).tolist()) if not gone)
            stays = b.column("left").flatten().to_pylist()
            ends, out = np.searchsorted(w.page, np.arange(b.num_rows + 1)).tolist(), []
            for a, z, article in zip(ends[:-1], ends[1:], b.column("article").to_pylist()):
                every = [k for k in range(a, z) if stays[k]]
                if not every and not article:
                    every = list(range(a, z))
                some = [left[k] for k in every if left[k]]
                out.append("\n".join(some or [texts[k] for k in every]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "host", "blocks", "tokens", "left", "article", "roles", "classes", "rounds").mapInArrow(run, f"page_id {kind}, url string, text string")


def chrome(pages: DataFrame, most: float = 0.5) -> DataFrame:
    """host, left (marked containers that its template has) and small (those of them with at most ``most`` of its text), from parsed pages."""
    found = pages.select("host", "page_id", "url", F.explode("blocks").alias("b"))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))
    every = pages.groupBy("host", "page_id", "url").agg(F.sum(size).alias("chars")).groupBy("host").agg(F.count("*").alias("all_pages"), F.sum("chars").alias("every"))
    held = (found.select("host", "page_id", "url", F.char_length("b.text").cast("long").alias("chars"), F.explode(F.array_distinct("b.marks")).alias("path"))
            .groupBy("host", "path", "page_id", "url").agg(F.sum("chars").alias("chars"))
            .groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("chars").alias("held")))
    told = held.join(every, "host").where("pages > 1 OR all_pages = 1")
    return told.groupBy("host").agg(F.collect_list("path").alias("left"), F.collect_list(F.when(F.col("held") <= most * F.col("every"), F.col("path"))).alias("small"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    cut = store.written(parsed(pages), "pages")
    # written, so its size is known when the join is planned: small, it is broadcast and no text is shuffled
    found, rounds = templates(cut)
    found = found.join(chrome(cut).withColumnRenamed("left", "marked"), "host", "full")
    told = cut.select("page_id", "url", "host", "blocks", "tokens", "article").join(store.written(found, "templates"), "host", "left")
    out = F.when(F.col("article"), F.col("marked")).otherwise(F.col("small"))
    told = told.withColumn("left", F.transform("blocks", lambda b: out.isNull() | ~F.arrays_overlap(b["marks"], out)))
    return slots(told, rounds).withColumn("n_chars", F.char_length("text").cast("long"))
