"""Language-model scores by online logistic context mixing.

A token (a word, or the end of the text) is a series of binary decisions: the
path in a Huffman tree of the ``2**BOOK`` most frequent training words (seen twice at least), or the
escape leaf and then the word's bytes, each a path in a tree of bytes. Every
decision is predicted from ``ORDERS`` hashed contexts (tree node with nothing,
the last common word, the previous word, the previous two; inside a spelled word
with one, two or three bytes or all bytes before; a word's node with nothing has
the odds of the book's own counts). Each context's counts give a log-odds; a weight set, gated by how much each context has seen,
mixes them; an adaptive table refines the mixed probability. The logarithms of
all decisions add up to the text's, from which bits per byte follow.

Training is online: a task runs through its documents, predicts each decision with
what it had seen at the last renewal of its odds, counts it, and corrects the
weights by the errors of each block. The odds are renewed whenever the counts have
grown by a quarter. The tasks' counts are summed, their weights averaged by decisions seen.

Scale. Token counts are combined per block of text ahead of the shuffle. The
context tables have a fixed number of slots (``1 << SLOTS`` for each order), so a
task sends some MB however much it reads; the sums are made in a stream, block by
block, and the finished tables (8 MB) and the book are what is broadcast. Every
training document is counted; words outside the book keep exact counts in the
token table and are joined to it.

Null and empty texts are one end token; equal rows are scored each; a null
doc_id is in no fold, so it is training; without training text every decision
is even. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import store, tokens
from skyledger.llm.quality_classifier import remainder

END = " "  # no word holds a space
BOOK, SLOTS, BLOCK, ORDERS = 17, 20, 12, 4
COMMON = 256  # words of the book that tell the language
LONGEST = 64  # bytes of a word in the book
LEVELS = 2 << 2 * (ORDERS - 1)  # two bits for each order above 0, and the kind of decision
BUCKETS = 33
_CHUNK = 1 << 17  # decisions that are predicted with the same weights
_STEP = 1 << 14  # decisions handled at once: their arrays stay in a core's cache
_BLOCK = 1 << 15  # tokens whose contexts are held at once (one text at least)
_BIT = 60  # of a node in a path: where the path's bit is, above the hashes
_DEEP = 3  # levels of a tree whose slots lie side by side
_FINE = np.float32(1 << 10)  # a cell's value of log-odds 1
_MIX = np.uint64(0x9E3779B1)
_EVEN = 0.4  # added to counts


class Tree(NamedTuple):
    """Huffman paths: leaf ``i`` has ``nodes`` and ``bits`` from ``first[i]`` to ``first[i + 1]``; ``odds``: log-odds of bit 1 by node."""

    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: np.ndarray


def huffman(weights: list[float]) -> Tree:
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, n, odds = {}, len(weights), []
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        odds.append(np.log((b + _EVEN) / (a + _EVEN)))
        up[i], up[j] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n))
        n += 1
    first, nodes, bits = [0], [], []
    for leaf in range(len(weights)):
        path, at = [], leaf
        while at in up:
            at, bit = up[at]
            path.append((at - len(weights), bit))
        nodes += [p[0] for p in reversed(path)]
        bits += [p[1] for p in reversed(path)]
        first.append(len(nodes))
    return Tree(np.array(first), np.array(nodes, np.int32), np.array(bits, np.uint8), np.array(odds, np.float32))


class Book(NamedTuple):
    """The frequent words (the end first) with their counts, their tree (escape last) and the tree of bytes (end of word last)."""

    words: pa.Array
    counts: np.ndarray
    tree: Tree
    spell: Tree


class Model(NamedTuple):
    """``odds`` and ``level`` by order and slot, or both in cells (then ``level`` is None); ``weights`` by gate and order; ``refined`` by gate and bucket."""

    odds: np.ndarray
    level: np.ndarray | None
    weights: np.ndarray
    refined: np.ndarray


def book(counts: DataFrame) -> Book:
    """The book of a token table (token, n): at most ``2**BOOK`` rows and 256 sums reach the driver."""
    short = counts.where((F.octet_length("token") <= LONGEST) & (F.col("token") != END) & (F.col("n") > 1))  # words seen once teach how new words are spelled
    # the least count that can be in the book, from sums over a few hundred size classes
    size = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(short.groupBy(size.alias("size")).count().collect(), reverse=True):
        held += r["count"]
        if held >= 1 << BOOK:
            least = r["size"]
            break
    likely = short.where(size >= least)
    rows = likely.orderBy(F.desc("n"), "token").limit(1 << BOOK).collect()
    end = counts.where(F.col("token") == END).agg(F.sum("n")).first()[0] or 0
    words, held = [END, *[r["token"] for r in rows]], np.array([end, *[r["n"] for r in rows]], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257)
        for b in batches:
            data, offsets = tokens.raw(b.column("token"))
            n = b.column("n").to_numpy().astype(float)
            total[:256] += np.bincount(data, np.repeat(n, np.diff(offsets)), 256)
            total[256] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    spelled = counts.join(F.broadcast(likely.orderBy(F.desc("n"), "token").limit(1 << BOOK).select("token")), "token", "left_anti").where(F.col("token") != END)
    sums = dict(spelled.mapInArrow(run, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect())
    rest = sums.get(256, 0.0)
    return Book(pa.array(words, pa.large_string()), held, huffman([*(held + 0.5).tolist(), rest + 0.5]), huffman([sums.get(b, 0.0) + 0.5 for b in range(257)]))


def _placed(tree: Tree, salt: int) -> np.ndarray:
    """For each node of the paths a hash of ``SLOTS`` bits by order above 0, packed, and the path's bit; nodes of ``_DEEP`` levels differ in the lowest bits only."""
    depth = np.arange(len(tree.nodes)) - np.repeat(tree.first[:-1], np.diff(tree.first))
    at = np.zeros(len(tree.odds), np.int64)
    at[tree.nodes] = np.arange(len(tree.nodes))  # one path through each node
    below = depth[at] % _DEEP
    top = at - below
    group, local = tree.nodes[top].astype(np.uint64), np.ones(len(at), np.int64)
    for k in range(_DEEP - 1):
        local = np.where(below > k, local * 2 + tree.bits[np.minimum(top + k, at)], local)
    out = np.zeros(len(at), np.int64)
    for k in range(ORDERS - 1):
        own = tokens.mixed(group * np.uint64(ORDERS) + np.uint64(k + (salt << 32))) >> np.uint64(64 + _DEEP - SLOTS)
        out |= (own.astype(np.int64) << _DEEP | local) << k * SLOTS
    return out[tree.nodes] | tree.bits.astype(np.int64) << _BIT


def _packed(contexts: list[np.ndarray]) -> np.ndarray:
    """Hashes of orders above 0, ``SLOTS`` bits of each, in one number."""
    out = np.zeros(len(contexts[0]), np.int64)
    for k, x in enumerate(contexts):
        out |= (x >> np.uint64(64 - SLOTS)).astype(np.int64) << k * SLOTS
    return out


class Coder:
    """Cuts texts into decisions under a book.

    A slot is the hash of the node xor that of the context (simple tabulation).
    Order 0 of a word's node is no slot but its place in the tree's paths: the
    book's own counts are its odds.
    """

    def __init__(self, own: Book):
        self.book = own
        self.words = own.words if isinstance(own.words, pa.Array) else pa.array(own.words, pa.large_string())
        self.nodes, self.spell = _placed(own.tree, 1), _placed(own.spell, 2)
        self.even = tokens.mixed(own.spell.nodes.astype(np.uint64) + np.uint64(3 << 32)) >> np.uint64(64 - SLOTS)
        self.even = self.even.astype(np.int64)
        self.plain = _cells(own.tree.odds, np.int8(0))[own.tree.nodes]

    def _spelled(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """For words outside the book: first symbol (a byte or the end) of each; symbols; of each its contexts inside the word, of order 0 and of those above."""
        data, offsets = tokens.raw(words)
        size = np.diff(offsets)
        ends = offsets[1:] + np.arange(len(words))  # a word's bytes and its end, 256
        symbols = np.full(len(data) + len(words), 256, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends] = False
        symbols[inner] = data
        starts = offsets[:-1] + np.arange(len(words))
        back = np.arange(len(symbols)) - np.repeat(starts, size + 1)  # bytes before in the word
        seen = []
        chain = np.zeros(len(symbols), np.uint64)
        for k in range(1, ORDERS):
            before = np.full(len(symbols), 300, np.int64)
            before[k:] = symbols[: max(0, len(symbols) - k)]
            before[back < k] = 300
            chain = tokens.mixed(chain * _MIX + before.astype(np.uint64) + np.uint64(k))
            seen.append(chain)
        seen.append(tokens.prefix_hashes(symbols, back))  # all bytes before
        return np.append(starts, len(symbols)), symbols, (seen[0] >> np.uint64(64 - SLOTS)).astype(np.int64), _packed(seen[1:])

    def decisions(self, t: tokens.Tokens) -> tuple[np.ndarray, Iterator[tuple]]:
        """The place of each token, and steps of decisions, in blocks of texts those of words before those of bytes: token numbers, bits, kinds (1: a byte's; one kind in a step) and slots by order."""
        place = pc.fill_null(pc.index_in(t.words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hashed = np.concatenate([tokens.byte_hashes(t.words), [np.uint64(0)]])

        def steps() -> Iterator[tuple]:
            a = 0
            while a < len(t.starts) - 1:
                z = max(a + 1, int(np.searchsorted(t.starts, t.starts[a] + _BLOCK, side="right")) - 1)
                yield from self._steps(t, place, hashed, a, z)
                a = z

        return place, steps()

    def _contexts(self, codes: np.ndarray, starts: np.ndarray, at: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The contexts of each token of some texts, packed."""
        now = hashed[codes]
        prev = np.concatenate([[np.uint64(0)], now[:-1]])
        prev[starts[:-1]] = 0  # every text has its end
        second = np.concatenate([[np.uint64(0)], prev[:-1]])
        second[starts[:-1]] = 0
        begin = np.repeat(starts[:-1], np.diff(starts))
        last = np.maximum.accumulate(np.where((at > 0) & (at <= COMMON), np.arange(len(at)), -1))
        last = np.concatenate([[-1], last[:-1]])
        common = np.where(last >= begin, now[np.maximum(last, 0)], np.uint64(0))
        return _packed([tokens.mixed(x) for x in (common, prev + np.uint64(7), prev * np.uint64(3) + second)])

    def _steps(self, t: tokens.Tokens, place: np.ndarray, hashed: np.ndarray, low: int, high: int) -> Iterator[tuple]:
        """Steps of decisions of the texts from ``low`` to ``high``."""
        tree, spell, mask = self.book.tree, self.book.spell, np.int64((1 << SLOTS) - 1)
        starts, base = t.starts[low : high + 1] - t.starts[low], t.starts[low]
        codes = t.codes[base : t.starts[high]]
        at = place[codes]
        context = self._contexts(codes, starts, at, hashed)

        def cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
            upto = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(sizes):
                z = max(a + 1, int(np.searchsorted(upto, upto[a] + _STEP, side="right")) - 1)
                yield a, z
                a = z

        def slots(zero: np.ndarray, above: np.ndarray) -> np.ndarray:
            out = np.empty((ORDERS, len(zero)), np.int64)
            out[0] = zero
            for k in range(1, ORDERS):
                np.right_shift(above, (k - 1) * SLOTS, out=out[k])
                out[k] &= mask
            return out

        leaf = np.where(at < 0, len(self.words), at)
        begins = tree.first[leaf]
        sizes = tree.first[leaf + 1] - begins
        for a, z in cut(sizes):
            own, path = _spread(begins[a:z], sizes[a:z])
            node = self.nodes.take(path)
            bit = (node >> _BIT).astype(np.uint8)
            node ^= context[a:z].take(own)
            own += base + a
            yield own, bit, np.broadcast_to(False, len(own)), slots(path, node)
        # the bytes of words outside the book
        odd = np.flatnonzero(at < 0)
        first, symbols, zero, above = self._spelled(t.words.take(pa.array(codes[odd])))
        above ^= np.repeat(context[odd] & mask, np.diff(first))  # the language also tells the letters
        lengths = np.diff(spell.first)[symbols]
        upto = np.concatenate([[0], np.cumsum(lengths)])[first]
        token = np.repeat(odd + base, np.diff(first))
        for a, z in cut(np.diff(upto)):
            a, z = first[a], first[z]
            own, path = _spread(spell.first[symbols[a:z]], lengths[a:z])
            node = self.spell.take(path)
            bit = (node >> _BIT).astype(np.uint8)
            node ^= above[a:z].take(own)
            yield token[a:z].take(own), bit, np.broadcast_to(True, len(own)), slots(self.even.take(path) ^ zero[a:z].take(own), node)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges that begin at ``begins``: the number of the range of each element, and the element."""
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    each = (begins - (ends - sizes)).take(own)
    each += np.arange(len(own))
    return own, each


def text_tokens(texts: pa.Array) -> tokens.Tokens:
    """The tokens of the texts, each text with its end."""
    t = tokens.tokenise(texts, tokens.white_table())
    n = len(t.starts) - 1
    codes = np.full(len(t.codes) + n, len(t.words), np.int32)
    keep = np.ones(len(codes), bool)
    keep[t.starts[1:] + np.arange(n)] = False
    codes[keep] = t.codes
    return tokens.Tokens(codes, pa.concat_arrays([t.words.cast(pa.large_string()), pa.array([END], pa.large_string())]), t.starts + np.arange(n + 1))


def _looked(cells: np.ndarray, plain: np.ndarray, kind: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by order (``_FINE`` is 1) and gate, of those of the kind, of decisions of one kind."""
    found = np.empty(slots.shape, np.int16)
    for k in range(ORDERS):  # every slot is in its table: clip only lets ``out`` be written at once
        (cells[k] if k or kind else plain).take(slots[k], out=found[k], mode="clip")
    gate = found[1] & 3
    for k in range(2, ORDERS):
        gate <<= 2
        gate |= found[k] & 3
    found &= -4
    return found.astype(np.float32), gate.astype(np.int64)


def _mixed(odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed log-odds and bucket of decisions; weights by gate and order."""
    rows = np.ascontiguousarray(weights / _FINE).view(np.dtype((np.void, 4 * ORDERS))).ravel()
    own = rows.take(gate).view(np.float32).reshape(-1, ORDERS)
    z = own[:, 0] * odds[0]
    for k in range(1, ORDERS):
        z += own[:, k] * odds[k]
    np.clip(z, -11, 11, out=z)
    return z, ((z + np.float32(11)) * np.float32((BUCKETS - 1) / 22)).astype(np.int64)


def _odds(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of counts, and how much was seen: 0, 1 (below 8) or 2."""
    n = n0 + n1
    ratio = n1.astype(np.float32)
    ratio += np.float32(_EVEN)
    ratio /= n0 + np.float32(_EVEN)
    return np.log(ratio, out=ratio), (n > 0).view(np.int8) + (n >= 8).view(np.int8)


def _cells(odds: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log-odds in steps of 1/256 with the level in the two lowest bits; counts up to 10^13 fit."""
    out = np.rint(odds.astype(np.float32) * (_FINE / 4)).astype(np.int16) << 2
    out |= level
    return out


def _lined(values: np.ndarray) -> np.ndarray:
    """A copy that begins at a cache line, as the slots of ``_DEEP`` levels then do."""
    room = np.zeros(values.nbytes + 64, np.uint8)
    skip = -room.ctypes.data % 64
    out = room[skip : skip + values.nbytes].view(values.dtype).reshape(values.shape)
    if values.any():
        out[:] = values
    return out


class Learner:
    """One task's counts, weights and refinement, learned online.

    Decisions are counted at once. What they are predicted with, ``cells``, is
    made anew from the counts whenever these have grown by a quarter.
    """

    def __init__(self, coder: Coder):
        self.coder = coder
        self.table = _lined(np.zeros((ORDERS, 2 << SLOTS), np.uint32))
        self.cells = _lined(np.zeros((ORDERS, 1 << SLOTS), np.int16))
        self.weights = np.full((LEVELS, ORDERS), 0.3, np.float32)
        self.seen = np.zeros(LEVELS)
        self.refine = np.zeros((2, LEVELS * BUCKETS))
        self.counted = self.fresh = 0

    def refresh(self) -> None:
        size = min(_STEP, 1 << SLOTS)
        for table, cells in zip(self.table.reshape(-1, 2 * size), self.cells.reshape(-1, size)):
            if table.any():
                cells[:] = _cells(*_odds(table[0::2].astype(np.float32), table[1::2].astype(np.float32)))
        self.fresh = self.counted

    def learn(self, t: tokens.Tokens, rate: float = 0.2) -> None:
        half = LEVELS // 2  # gates of a kind
        ones, lane = np.ones(_STEP, np.uint32), np.arange(_STEP) & 7

        def fresh() -> tuple:
            return 0, np.zeros((2, half)), np.zeros((2, ORDERS, half)), self.weights.copy()

        def correct() -> None:
            self.weights += (rate / float(_FINE) * np.hstack(list(slope)) / np.maximum(n.ravel(), 64)).T.astype(np.float32)
            self.seen += n.ravel()
            if self.counted - self.fresh >= max(_CHUNK, self.fresh / 4):
                self.refresh()

        size, n, slope, weights = fresh()
        for _, bit, kind, slots in self.coder.decisions(t)[1]:
            if size and size + len(bit) > _CHUNK:
                correct()
                size, n, slope, weights = fresh()
            of = int(kind[0])
            odds, gate = _looked(self.cells, self.coder.plain, of, slots)
            z, bucket = _mixed(odds, gate, weights[of * half : (of + 1) * half])
            error = bit - 1 / (1 + np.exp(-z))
            odds *= error
            bucket += gate * BUCKETS
            gate <<= 3  # sums in eight lanes: additions to one cell would wait for each other
            gate |= lane[: len(gate)] if len(gate) <= len(lane) else 0
            for k in range(ORDERS):
                slope[of, k] += np.bincount(gate, odds[k], half << 3).reshape(half, 8).sum(1)
            bucket <<= 1
            bucket |= bit
            cells = np.bincount(bucket, minlength=2 * half * BUCKETS).reshape(-1, 2)
            self.refine[:, of * half * BUCKETS : (of + 1) * half * BUCKETS] += cells.T
            n[of] += cells.reshape(half, -1).sum(1)
            slots <<= 1
            slots |= bit
            for k in range(0 if of else 1, ORDERS):
                np.add.at(self.table[k], slots[k], ones[: len(bit)] if len(bit) <= len(ones) else np.uint32(1))
            size += len(bit)
            self.counted += len(bit)
        if size:
            correct()

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """What the task has learned, in blocks that can be summed."""
        blocks = self.table.reshape(-1, 2 << BLOCK)
        for k, block in enumerate(blocks):
            if block.any():
                yield k, zlib.compress(block.tobytes(), 1)
        yield -1, zlib.compress(np.concatenate([self.seen, (self.weights * self.seen[:, None]).ravel(), self.refine.ravel()]).tobytes(), 1)


def _parts(rows: Iterator[tuple[int, bytes]], size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], names=["part", "data"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], names=["part", "data"])


def trained(texts: DataFrame, own: Book) -> Model:
    """The model of all ``texts`` (column text)."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(own)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for b in tokens.slices(batches, "text"):
            learner = learner or Learner(Coder(shared.value))
            learner.learn(text_tokens(b.column("text")))
        if learner:
            yield from _parts(learner.parts())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64) if part >= 0 else np.frombuffer(zlib.decompress(data))
                sums[part] = sums[part] + x if part in sums else x
        out = []
        for part, x in sums.items():
            if part >= 0:
                out.append((part, _cells(*_odds(x[0::2].astype(np.float32), x[1::2].astype(np.float32))).tobytes()))
            else:
                out.append((part, x.tobytes()))
        yield from _parts(iter(out))

    learned = store.written(texts.select("text").mapInArrow(learn, "part int, data binary"), "parts")
    blocks = (ORDERS << SLOTS) >> BLOCK
    merged = learned.repartition(max(2, min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").mapInArrow(merge, "part int, data binary").collect()
    cells = np.zeros((blocks, 1 << BLOCK), np.int16)
    sums = np.zeros(LEVELS * (1 + ORDERS + 2 * BUCKETS))
    for r in merged:
        if r["part"] >= 0:
            cells[r["part"]] = np.frombuffer(r["data"], np.int16)
        else:
            sums = np.frombuffer(r["data"])
    seen, rest = sums[:LEVELS, None], sums[LEVELS:]
    weights = np.where(seen > 0, rest[: LEVELS * ORDERS].reshape(LEVELS, ORDERS) / np.maximum(seen, 1), 0.3)
    none, one = rest[LEVELS * ORDERS :].reshape(2, LEVELS, BUCKETS)
    centre = 1 / (1 + np.exp(-((np.arange(BUCKETS) + 0.5) * 22 / (BUCKETS - 1) - 11)))
    refined = (one + 20 * centre) / (none + one + 20)
    return Model(cells.reshape(ORDERS, -1), None, weights.astype(np.float32), refined.astype(np.float32))


def log10_scores(model: Model, coder: Coder, t: tokens.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The place of each token and the log10 probability of each text."""
    cells = model.odds if model.level is None else _cells(model.odds, model.level)
    by_token = np.zeros(len(t.codes))
    place, blocks = coder.decisions(t)
    weights = np.split(model.weights, 2)
    refined = np.float32(0.5) * model.refined.reshape(2, -1)
    for token, bit, kind, slots in blocks:
        of = int(kind[0])
        odds, gate = _looked(cells, coder.plain, of, slots)
        z, bucket = _mixed(odds, gate, weights[of])
        bucket += gate * BUCKETS
        p = np.float32(0.5) / (1 + np.exp(-z)) + refined[of].take(bucket)
        p -= 1 - bit  # of bit 0 the probability is 1 - p
        ends = np.flatnonzero(token[1:] != token[:-1]) + 1
        sums = np.add.reduceat(np.log(np.abs(p, out=p), out=p), np.append(0, ends))
        by_token[token[np.append(0, ends)]] += sums
    return place, np.add.reduceat(by_token, t.starts[:-1]) / np.log(10)


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Base and model scores of all texts, learned from those outside the held-out fold."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out")).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text", 16 << 20):
            t = text_tokens(b.column("text"))
            yield pa.RecordBatch.from_arrays([t.words.cast(pa.string()), pa.array(np.bincount(t.codes, minlength=len(t.words)))], names=["token", "n"])

    counts = store.written(training.mapInArrow(count, "token string, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    v, n = counts.agg(F.count("*"), F.sum("n")).first()
    n = n or 0
    own = book(counts)
    model = spark.sparkContext.broadcast(trained(training, own))
    shared = spark.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        coder = own_model = None
        for b in tokens.slices(batches, "text"):
            coder = coder or Coder(shared.value)
            own_model = own_model or model.value._replace(odds=_lined(model.value.odds))
            t = text_tokens(b.column("text"))
            place, total = log10_scores(own_model, coder, t)
            held = np.concatenate([shared.value.counts, [0]])[place]  # by distinct word; 0 if not in the book
            c = held[t.codes]
            doc = np.repeat(np.arange(b.num_rows), np.diff(t.starts))
            known = np.bincount(doc, c > 0, b.num_rows).astype(np.int64)
            base = np.bincount(doc, np.where(c > 0, np.log10(c + 0.5), 0.0), b.num_rows)
            odd = np.flatnonzero(place[t.codes] < 0)
            pair, times = np.unique(doc[odd] * len(t.words) + t.codes[odd], return_counts=True)
            ends = np.searchsorted(pair // max(1, len(t.words)), np.arange(b.num_rows + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([t.words.take(pa.array(pair % max(1, len(t.words)))).cast(pa.string()), pa.array(times.astype(np.int64))], ["token", "n"]))
            size = np.diff(tokens.raw(b.column("text"))[1])
            key = [xxhash.xxh3_128_digest(f"{d}:{x or ''}".encode()) for d, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            missed = np.bincount(doc, c == 0, b.num_rows) - (np.bincount(doc[odd], minlength=b.num_rows))
            out = [b.column("doc_id"), b.column("held_out"), pa.array(np.diff(t.starts)), pa.array(known), pa.array(base + missed * np.log10(0.5)),
                   pa.array(total), pa.array(size), pa.array(key, pa.binary()), rare]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "key", "rare"])

    scored = store.written(docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, key binary, rare array<struct<token:string,n:long>>"), "scored")
    rare = scored.where(F.size("rare") > 0).select("key", "rare").dropDuplicates(["key"]).select("key", F.explode("rare").alias("r")).select("key", "r.token", F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    found = (rare.join(counts, "token", "left").groupBy("key")
             .agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_base")))
    out = scored.drop("rare").join(found, "key", "left")
    each = float(np.log10(n + 0.5 * ((v or 0) + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
                      (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
