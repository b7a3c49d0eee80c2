"""Language-model scoring by online logistic mixing of hashed-context bit predictors, beside a unigram base."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import give_back, held_out, lower_words, rolling
from runqc.session import written

FOLDS = 10
#: Bits of the tables of the three contexts: two bytes, four bytes, the word so far. Their size is fixed, so they can be
#: broadcast; what fills them is counted over all learning documents.
SLOT_BITS = (16, 20, 20)
#: Two bytes before get a code tree of their own from this count on, if they are also one in so many of all symbols.
OWN_TREE, TREE_SHARE = 200, 20_000
#: Slots in a row of the summed counts, and bits of a log-odds that the weights are fitted on.
BLOCK, FIT_BITS = 4096, 5
#: The commonest words, whose counts every task has at hand. The others are joined; the result is the same.
COMMON_WORDS = 200_000
END, GATES, RATE, REFINE, SHRINK = 256, 12, 0.02, 0.5, 0.3
PIECE, CONTEXT = 1 << 19, 256
#: Block of each place in a piece: 256 symbols each at first, then eight blocks for each doubling.
PLACES = np.arange(PIECE + 1)
BLOCKS = np.where(PLACES < 2048, PLACES // 256, 8 + 8 * np.log2(np.maximum(PLACES, 1) / 2048)).astype(np.uint8)
SCALE = 16
#: Bytes that are counted at once, and symbols whose bits are predicted at once: what they need stays in a processor's
#: cache. A batch of texts that are scored together is larger, as its blocks come one after another.
BATCH, STRETCH, TOGETHER = 1 << 18, 1 << 16, 1 << 18
MULTIPLY = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
NODE = np.uint32(0x9E3779B1)


def _huffman(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths and codes for symbol counts; a floor under the counts bounds the depth to under 30."""
    n = n + (n.sum() + 1) * 2.0**-16
    heap = [(float(x), s, None) for s, x in enumerate(n)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a, b)))
        made += 1
    lengths, codes, stack = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32), [(heap[0], 0, 0)]
    while stack:
        (_, symbol, children), depth, code = stack.pop()
        if children is None:
            lengths[symbol], codes[symbol] = depth, code
        else:
            stack += [(children[0], depth + 1, code << 1), (children[1], depth + 1, code << 1 | 1)]
    return lengths, codes


class Trees:
    """Huffman codes of the next symbol, one tree after each byte and one after each frequent pair of bytes.

    A symbol is predicted as the bits of its code, so a likely symbol takes few predictions.
    """

    def __init__(self, texts: list[str | None]):
        pairs = [np.zeros(0, np.int64)]
        for pieces in _batched(iter(texts)):
            symbols = Symbols(pieces)
            pairs.append(symbols.two * 257 + symbols.symbol)
        seen, n = np.unique(np.concatenate(pairs), return_counts=True)
        self._grow(seen // 257, seen % 257, n)

    @classmethod
    def counted(cls, seen: np.ndarray, n: np.ndarray) -> Trees:
        """Trees from counts ``n`` of ``seen``: the two bytes before times 257 and the symbol."""
        trees = cls.__new__(cls)
        trees._grow(seen // 257, seen % 257, n)
        return trees

    def _grow(self, two: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros((256, 257))
        np.add.at(counts, (two & 255, symbol), n)
        overall = counts.sum(0) + 1
        counts += overall / overall.sum()
        frequent = np.flatnonzero(np.bincount(two, n, 65536) >= max(OWN_TREE, n.sum() / TREE_SHARE))
        self.row = (np.arange(65536) & 255).astype(np.int32)
        self.row[frequent] = 256 + np.arange(len(frequent))
        own = 20 * counts[frequent & 255] / counts[frequent & 255].sum(1, keepdims=True)
        at = self.row[two] >= 256
        np.add.at(own, (self.row[two[at]] - 256, symbol[at]), n[at])
        made = [_huffman(c) for c in (*counts, *own)]
        self.length, self.code = np.array([x for x, _ in made]).ravel(), np.array([x for _, x in made]).ravel()


def pieces_of(text: str | None) -> list[tuple[bytes, bytes, bool]]:
    """(bytes before, bytes, whether the text ends) of the lower-cased words in a row, in pieces of bounded size."""
    data = b" ".join(lower_words(text))
    return [(data[max(0, at - CONTEXT):at], data[at:at + PIECE], at + PIECE >= len(data)) for at in range(0, max(1, len(data)), PIECE)]


class Symbols:
    """The symbols of a batch of pieces: lane, place in the piece, the symbol and the two bytes before it."""

    def __init__(self, pieces: list[tuple[bytes, bytes, bool]]):
        parts = [p for before, body, end in pieces for p in ((b"    " + before)[-CONTEXT:], body + b"\0" * end)]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.heads = (np.cumsum(sizes) - sizes)[::2]
        starts = self.heads + sizes[::2]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.flatnonzero(np.repeat(np.tile([False, True], len(pieces)), sizes))
        bodies = sizes[1::2]
        self.lane = np.repeat(np.arange(len(pieces), dtype=np.int32), bodies)
        self.place = np.arange(len(self.at), dtype=np.int32) - np.repeat((np.cumsum(bodies) - bodies).astype(np.int32), bodies)
        self.symbol = self.data[self.at].astype(np.int32)
        ends = [s + n - 1 for (_, _, end), s, n in zip(pieces, starts, sizes[1::2]) if end]
        self.symbol[np.searchsorted(self.at, ends)] = END
        self.two = self.data[self.at - 1] | self.data[self.at - 2].astype(np.int32) << 8

    def codes(self, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths and codes."""
        at = trees.row.take(self.two).astype(np.intp) * 257 + self.symbol
        return trees.length.take(at), trees.code.take(at)

    def contexts(self) -> list[np.ndarray]:
        """32-bit hashes of the two bytes before, of the four before, and of the word so far."""
        wide, at, n = self.data.astype(np.uint32), self.at, len(self.data)
        two = wide[1:] << np.uint32(8) | wide[:-1]  # the pair that ends at i + 1
        four = two[2:] << np.uint32(16) | two[:-2]
        power, inverse = rolling(n)  # their low halves are powers of a root modulo 2^32
        total = np.zeros(n + 1, np.uint32)
        np.cumsum((wide + np.uint32(1)) * power[:n].astype(np.uint32), dtype=np.uint32, out=total[1:])
        first = np.zeros(n + 1, bool)  # where words begin
        first[1:], first[self.heads] = self.data == 32, True
        begin = np.flatnonzero(first[:n])
        long = np.diff(begin, append=n)
        word = (total[:n] - np.repeat(total[begin], long)) * np.repeat(inverse[begin].astype(np.uint32), long)
        return [_hashed(two, MULTIPLY[0])[at - 2], _hashed(four, MULTIPLY[1])[at - 4], _hashed(word, MULTIPLY[2])[at]]


def _hashed(x: np.ndarray, factor: np.uint32) -> np.ndarray:
    """32-bit numbers with all their bits in the low ones, where slots are read."""
    x = (x ^ x >> np.uint32(15)) + np.uint32(1)
    x *= factor
    x ^= x >> np.uint32(13)
    x *= NODE
    x ^= x >> np.uint32(16)
    return x


def levels(left: np.ndarray, code: np.ndarray, contexts: list[np.ndarray], lane: np.ndarray | None = None) -> Iterator[tuple]:
    """Level by level of the trees: depth, lanes, bits, and slots in each table of those symbols whose codes reach it."""
    depth = 0
    while len(left):
        rest = code >> (left - 1)
        node = ((rest >> 1) | np.int32(1 << depth)).astype(np.uint32)
        node *= NODE
        node ^= node >> np.uint32(15)
        yield depth, lane, rest & 1, [((c ^ node) & np.uint32((1 << b) - 1)).astype(np.intp) for c, b in zip(contexts, SLOT_BITS)]
        keep = np.flatnonzero(left > 1)
        left, code, contexts, depth = left[keep] - 1, code[keep], [c[keep] for c in contexts], depth + 1
        lane = None if lane is None else lane[keep]


class Mixer:
    """Bit predictors, the weights that combine them, and a refinement that follows each text.

    Each context's table gives a log-odds for the next bit. They are summed with weights chosen by the depth in the
    tree (the gate), fitted on counts over all learning texts, or learnt online over given ones. While a text is scored, each gate's sum is refined by a
    factor that moves along its mean gradient after every block of symbols, so every bit is predicted from earlier
    blocks only, the probabilities of all texts sum to one, and a text's score depends on nothing but itself.
    """

    def __init__(self, trees: Trees, tables: list[np.ndarray]):
        self.trees, self.tables = trees, tables
        self.weights = np.tile(np.float32([0.3, 0.4, 0.4, 0.0]), (GATES, 1))

    def score(self, pieces: list[tuple[bytes, bytes, bool]], factors: np.ndarray | None = None, learn: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability per piece and the factors it ends with; ``learn`` moves the weights as well."""
        symbols = Symbols(pieces)
        factors = np.ones((len(pieces), GATES), np.float32) if factors is None else factors
        total = np.zeros(len(pieces))
        block = BLOCKS[symbols.place]
        order = np.argsort(block, kind="stable")
        lane, contexts = symbols.lane[order], [c[order] for c in symbols.contexts()]
        length, code = (c[order] for c in symbols.codes(self.trees))
        bits = np.r_[0, np.cumsum(length, dtype=np.int64)]  # where each symbol's begin
        mixed = None if learn else self._mixed(length, code, contexts)
        cuts = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            seen = None
            if learn:
                some, seen = self._mixed(length[a:b], code[a:b], [c[a:b] for c in contexts], parts=True)
            else:
                some = mixed[bits[a]:bits[b]]
            at, n = bits[a:b] - bits[a], length[a:b]
            gate = np.arange(len(some)) - np.repeat(at, n)  # the depth of each bit
            np.minimum(gate, GATES - 1, out=gate)
            gate += np.repeat(lane[a:b].astype(np.intp) * GATES, n)
            z = factors.take(gate)
            z *= some
            np.minimum(z, 30, out=z)
            np.exp(z, out=z)  # odds against the bit that came
            z += 1
            begin = np.r_[0, np.flatnonzero(lane[a + 1:b] != lane[a:b - 1]) + 1]
            total[lane[a + begin]] -= np.add.reduceat(np.log(z), at[begin], dtype=np.float64)
            error = 1 / z - 1
            size = len(pieces) * GATES
            step, times = np.bincount(gate, error * some, size), np.bincount(gate, minlength=size)
            factors = (factors + (REFINE * step / (256 + times)).reshape(-1, GATES)).astype(np.float32)
            if learn:
                gate %= GATES
                times = np.maximum(np.bincount(gate, minlength=GATES), 1)
                self.weights = (self.weights + learn * np.stack([np.bincount(gate, error * v, GATES) / times for v in seen], 1)).astype(np.float32)
        return total, factors

    def _mixed(self, length: np.ndarray, code: np.ndarray, contexts: list[np.ndarray], parts: bool = False):
        """The weighted sum of log-odds against each bit of the symbols in a row; with ``parts`` also what was summed."""
        bits = np.r_[0, np.cumsum(length, dtype=np.int64)]
        out, seen = np.empty(bits[-1], np.float32), np.empty((4, bits[-1] if parts else 0), np.float32)
        weights = self.weights / np.float32([SCALE, SCALE, SCALE, 1])
        for a in range(0, len(length), STRETCH):
            cut = slice(a, a + STRETCH)
            for depth, at, bit, slots in levels(length[cut], code[cut], [c[cut] for c in contexts], bits[:-1][cut]):
                w = weights[min(depth, GATES - 1)]
                x = [t.take(s).astype(np.float32) for t, s in zip(self.tables, slots)]
                mixed = x[0] * w[0]
                mixed += x[1] * w[1]
                mixed += x[2] * w[2]
                mixed += w[3]
                sign = (1 - 2 * bit).astype(np.float32)
                mixed *= sign
                out[at + depth] = mixed
                if parts:
                    for row, v in zip(seen, (*x, np.float32(SCALE))):
                        row[at + depth] = v * sign / SCALE
        return (out, seen) if parts else out

    def fitted(self, texts: list[str]) -> Mixer:
        """Learns the weights online over these texts, four times over at a falling rate."""
        batches = [p for t in texts for p in pieces_of(t)]
        for turn in range(4 if batches else 0):
            for at in range(0, len(batches), 20):
                self.score(batches[at:at + 20], learn=RATE / (1 + turn))
        return self

    def log10_many(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """log10 probability of each text's words in a row and its end; the number of their bytes."""
        out = [0.0] * len(texts)
        pieces = [pieces_of(t) for t in texts]
        waiting: list[int] = []
        for i in sorted(range(len(texts)), key=lambda i: len(pieces[i][0][1])):  # texts of like lengths go together
            if len(pieces[i]) > 1:
                factors = None
                for piece in pieces[i]:
                    x, factors = self.score([piece], factors)
                    out[i] += float(x[0]) / math.log(10)
            else:
                waiting.append(i)
            if waiting and len(pieces[waiting[-1]][0][1]) * len(waiting) >= TOGETHER:
                self._flush(waiting, pieces, out)
        self._flush(waiting, pieces, out)
        return out, [sum(len(body) for _, body, _ in p) for p in pieces]

    def _flush(self, waiting: list[int], pieces: list, out: list[float]) -> None:
        if waiting:
            for i, x in zip(waiting, self.score([pieces[i][0] for i in waiting])[0]):
                out[i] = float(x) / math.log(10)
            waiting.clear()


def _batched(texts: Iterator[str | None]) -> Iterator[list[tuple[bytes, bytes, bool]]]:
    waiting, size = [], 0
    for text in texts:
        for piece in pieces_of(text):
            waiting.append(piece)
            size += len(piece[1])
            if size >= BATCH:
                yield waiting
                waiting, size = [], 0
    if waiting:
        yield waiting


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for batch in batches:
        for t in batch.column(0):
            yield t.as_py()


def word_lists(texts: pa.Array) -> pa.Array:
    """Words of each text with A-Z lowered; there may be empty strings at the ends of a list."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word; with word NULL the number of texts."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.column(0).slice(at, 2000)
                words = word_lists(some).flatten()
                counted = words.filter(pc.not_equal(words, "")).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.binary()), counted.field("counts").cast(pa.int64())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([len(some)], pa.int64())], schema=schema)
        give_back()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def looked_up(texts: pa.Array, common: pa.Array, log10_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Per text: words, those among ``common``, the sum of their ``log10_of``, and the others with their counts."""
    lists = word_lists(texts)
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    some = pc.not_equal(words, "")
    text, encoded = text[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    word = encoded.indices.to_numpy()
    place = pc.fill_null(pc.index_in(encoded.dictionary.cast(pa.binary()), value_set=common), -1).to_numpy()[word]
    known = place >= 0
    total = np.bincount(text[known], log10_of[place[known]], len(lists))
    kinds = max(1, len(encoded.dictionary))
    rare, n = np.unique(text[~known] * kinds + word[~known], return_counts=True)
    rows = pa.StructArray.from_arrays([encoded.dictionary.cast(pa.binary()).take(pa.array(rare % kinds)), pa.array(n.astype(np.int64))], ["word", "n"])
    cuts = np.searchsorted(rare // kinds, np.arange(len(lists) + 1)).astype(np.int32)
    return np.bincount(text, minlength=len(lists)), np.bincount(text[known], minlength=len(lists)), total, pa.ListArray.from_arrays(cuts, rows)


def tree_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes before and symbol, as one number, and how often they occur in all ``texts``."""
    schema = pa.schema([("seen", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((65536, 257), np.int32)
        for pieces in _batched(_texts(batches)):
            symbols = Symbols(pieces)
            for at in range(0, len(symbols.two), 1 << 18):  # few pairs of bytes occur in a stretch, and they are counted in a small table
                two, number = symbols.two[at:at + (1 << 18)], np.zeros(65536, np.int32)
                pairs = np.flatnonzero(np.bincount(two, minlength=65536))
                number[pairs] = np.arange(len(pairs), dtype=np.int32)
                n = np.bincount(number[two] * np.int32(257) + symbols.symbol[at:at + (1 << 18)], minlength=len(pairs) * 257)
                counts[pairs] += n.reshape(-1, 257).astype(np.int32)
        counts = counts.ravel()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], schema=schema)
        del counts
        give_back()

    got = texts.mapInArrow(run, "seen int, n long").groupBy("seen").agg(F.sum("n").alias("n")).orderBy("seen").toArrow()
    return got.column("seen").to_numpy().astype(np.int64), got.column("n").to_numpy()


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.round(SCALE * np.log((ones + SHRINK) / (zeros + SHRINK))), -127, 127).astype(np.int8)


def slot_log_odds(texts: DataFrame, trees: Trees) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The predictors' tables from counts over all ``texts``, in sixteenths: per slot the log-odds of a 1, and per slot
    and bit (2 * slot + bit) what they are without one occurrence of that bit."""
    shared = texts.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    offsets = np.cumsum([0, *(1 << b for b in SLOT_BITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * offsets[-1], np.int64)
        for pieces in _batched(_texts(batches)):
            symbols = Symbols(pieces)
            for _, _, bits, slots in levels(*symbols.codes(shared.value), symbols.contexts()):
                for s, a in zip(slots, offsets):
                    np.add.at(counts, (s << 1 | bits) + 2 * a, 1)
        counts = counts.reshape(-1, 2 * BLOCK)
        for at in np.flatnonzero(counts.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts[at].tobytes()], pa.binary())], schema=schema)
        del counts
        give_back()

    def summed(of: pa.Table) -> pa.Table:
        counts = np.zeros(2 * BLOCK, np.int64)
        for c in of.column("counts"):
            counts += np.frombuffer(c.as_buffer(), np.int64)
        zeros, ones = counts[::2], counts[1::2]
        less = np.stack([_odds(ones, np.maximum(zeros - 1, 0)), _odds(np.maximum(ones - 1, 0), zeros)], 1)
        return pa.table({"block": pa.array([of.column("block")[0].as_py()], pa.int32()), "odds": pa.array([_odds(ones, zeros).tobytes()], pa.binary()), "less": pa.array([less.tobytes()], pa.binary())})

    got = texts.mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(summed, "block int, odds binary, less binary").toArrow()
    table, without = np.zeros((offsets[-1] // BLOCK, BLOCK), np.int8), np.zeros((offsets[-1] // BLOCK, 2 * BLOCK), np.int8)
    for at, odds, less in zip(*(got.column(c).to_pylist() for c in ("block", "odds", "less"))):
        table[at], without[at] = np.frombuffer(odds, np.int8), np.frombuffer(less, np.int8)
    table, without = table.ravel(), without.ravel()
    return [table[a:b] for a, b in zip(offsets, offsets[1:])], [without[2 * a:2 * b] for a, b in zip(offsets, offsets[1:])]


def mixed_counts(texts: DataFrame, trees: Trees, without: list[np.ndarray]) -> np.ndarray:
    """(gate, log-odds of each table in cells, bit): how often they meet in all ``texts``, each bit itself left out.

    A table that has counted a text looks better on it than it is, so a bit is looked up without its own occurrence.
    """
    shared = texts.sparkSession.sparkContext.broadcast((trees, [((t.astype(np.int32) + 128) >> (8 - FIT_BITS)).astype(np.uint8) for t in without]))
    size = GATES << (3 * FIT_BITS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        trees, cells = shared.value
        for pieces in _batched(_texts(batches)):
            symbols = Symbols(pieces)
            for depth, _, bits, slots in levels(*symbols.codes(trees), symbols.contexts()):
                at = min(depth, GATES - 1)
                for c, s in zip(cells, slots):
                    at = at << FIT_BITS | c.take(s << 1 | bits).astype(np.intp)
                np.add.at(counts, at << 1 | bits, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])
        give_back()

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts.reshape(GATES, -1, 2)


def fitted_weights(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of each gate that make the counted bits likeliest, by Newton steps from ``start``, which counts as one bit."""
    step = 1 << (8 - FIT_BITS)
    middle = (np.arange(1 << FIT_BITS) * step - 128 + (step - 1) / 2) / SCALE
    x = np.stack([*(m.ravel() for m in np.meshgrid(middle, middle, middle, indexing="ij")), np.ones(1 << 3 * FIT_BITS)], 1)
    out = start.astype(np.float64)
    for gate, n in enumerate(counts):
        some = np.flatnonzero(n.sum(1))
        a, zeros, ones = x[some], n[some, 0], n[some, 1]
        loss = lambda w: (zeros * np.logaddexp(0, a @ w) + ones * np.logaddexp(0, -(a @ w))).sum() + ((w - start[gate]) ** 2).sum() / 2
        w = out[gate]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = a.T @ ((zeros + ones) * p - ones) + w - start[gate]
            move = np.linalg.solve((a * ((zeros + ones) * p * (1 - p))[:, None]).T @ a + np.eye(4), slope)
            share = 1.0
            while share > 1e-6 and loss(w - share * move) > loss(w):
                share /= 2
            if share <= 1e-6 or np.abs(share * move).max() < 1e-9:
                break
            w = w - share * move
        out[gate] = w
    return out.astype(np.float32)


def scores(docs: DataFrame, folds: int = FOLDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``bits_per_byte`` for every row.

    Learns from the documents outside the held-out fold. Base: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the
    words and one end. Score: log10 probability of the lower-cased words in a row and the end under the context mixer, whose
    code trees, tables and weights all come from counts over all learning documents.
    Word counts are aggregated over the whole corpus; common words are looked up, all others joined, per document and
    word. NULL is an empty text: one end. Repeated rows count and are scored each; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), F.col(text).cast("string").alias("text"))
    learning = rows.where(~F.col("held_out"))
    counts = written(word_counts(learning.select("text")), "lm-counts")
    words = counts.where("word is not null")
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train, n_types = n_words + n_ends, n_distinct + (n_ends > 0)
    texts = learning.select("text")
    trees = Trees.counted(*tree_counts(texts))
    tables, without = slot_log_odds(texts, trees)
    mixer = Mixer(trees, tables)
    mixer.weights = fitted_weights(mixed_counts(texts, trees, without), mixer.weights)
    common = words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).toArrow()
    known = (common.column("word").combine_chunks().cast(pa.binary()), np.log10(common.column("n").to_numpy() + 0.1))
    shared = spark.sparkContext.broadcast((mixer, *known))
    spread, end = math.log10(n_train + 0.1 * (n_types + 1)), math.log10(n_ends + 0.1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, words_at_hand, log10_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                n, n_known, base, rare = looked_up(some.column(2), words_at_hand, log10_of)
                score, n_bytes = mixer.log10_many(some.column(2).to_pylist())
                columns = (n + 1, n_known + int(n_ends > 0), base + end - (n + 1) * spread, score, n_bytes)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:])], rare.cast(schema.field("rare").type)], schema=schema)
                give_back()

    types = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<struct<word: binary, n: long>>"
    scored = written(rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, types).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.inline("rare")).join(words.select("word", F.col("n").alias("c")), "word", "left")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
