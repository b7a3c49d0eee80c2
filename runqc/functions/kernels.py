"""Alignment kernels Spark has no expression for. Small numpy helpers behind Arrow UDFs.

One query is aligned against many targets at once: each step of the recurrence is one vector
operation over a padded block of targets, so Python cost is per query base, not per cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

from runqc.functions.lanes import Nearest

MAX_CELLS = 4_000_000
#: Words of one step that are worked on at once: few enough for the cache, enough to hide the cost of a call.
PANEL_WORDS = 8192
#: References nearer in length than this share of a sequence's, and this many of the nearest, are tried first.
NEAR_SHARE, NEAR_REFS = 0.3, 16
#: Bases of sequences and references, and letters, up to which 64 pairs are worked on as the bits of a word.
SHORT, SHORT_REF, FEW_LETTERS = 1 << 15, 2048, 32
#: Bases of a long target that are searched at once, beside the overlap.
PIECE = 512
PAD = 0xFFFFFFFF
ONE, TOP = np.uint64(1), np.uint64(63)


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    block = np.full((len(texts), max(int(lengths.max(initial=0)), 1)), PAD, dtype=np.uint32)
    block[np.arange(block.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return block, lengths


def _final_row(query: str, block: np.ndarray, free_start: bool) -> np.ndarray:
    """Distance of the whole query to every target prefix (or infix end when ``free_start``)."""
    rows, width = block.shape
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((rows, width + 1), np.int32) if free_start else np.tile(steps, (rows, 1))
    for i, c in enumerate(np.frombuffer(query.encode("utf-32-le"), dtype=np.uint32), start=1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + (block != c), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row


def _blocks(texts: Sequence[str]) -> Iterator[list[int]]:
    """Indices of texts of similar length, grouped so that a padded block stays small."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    block: list[int] = []
    for i in order:
        if block and (len(texts[i]) + 1) * (len(block) + 1) > MAX_CELLS:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def locate_ends(query: str, targets: Sequence[str], mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(distance, last target position used) of ``query`` in each target; the first best end.

    NW aligns both ends, SHW leaves the target's tail free, HW leaves both its ends free.
    """
    distance = np.zeros(len(targets), np.int32)
    end = np.zeros(len(targets), np.int32)
    for some in _blocks(targets):
        block, lengths = _codes([targets[i] for i in some])
        row = _final_row(query, block, free_start=mode == "HW")
        if mode == "NW":
            stop = lengths
        else:
            beyond = np.arange(row.shape[1]) > lengths[:, None]
            stop = np.where(beyond, np.iinfo(np.int32).max, row).argmin(axis=1)
        distance[some] = row[np.arange(len(some)), stop]
        end[some] = stop - 1
    return distance, end


def locate(query: str, targets: Sequence[str], mode: str) -> np.ndarray:
    """Rows of (distance, start, end), 0-based and inclusive.

    An infix starts at the earliest position that reaches its end at the same distance; it is
    found by aligning the reversed query to the reversed head of the target.
    """
    distance, end = locate_ends(query, targets, mode)
    start = np.zeros(len(targets), np.int32)
    if mode == "HW":
        heads = [t[: e + 1][::-1] for t, e in zip(targets, end)]
        for some in _blocks(heads):
            block, lengths = _codes([heads[i] for i in some])
            row = _final_row(query[::-1], block, free_start=False)
            beyond = np.arange(row.shape[1]) > lengths[:, None]
            row = np.where(beyond, np.iinfo(np.int32).max, row)
            used = row.shape[1] - 1 - row[:, ::-1].argmin(axis=1)
            start[some] = lengths - used
    return np.stack([distance, start, end], axis=1)


def letters(block: np.ndarray) -> np.ndarray:
    """The distinct codes of a padded block, in order."""
    found = np.unique(block)
    return found[found != PAD]


def coded(alphabet: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Places of codes in an alphabet; one beyond its end for all others."""
    at = np.searchsorted(alphabet, block)
    return np.where(np.append(alphabet, np.uint32(PAD))[at] == block, at, len(alphabet)).clip(max=len(alphabet))


def masks(codes: np.ndarray, alphabet: int, words: int) -> np.ndarray:
    """(words, alphabet + 1, rows): bit i of a row's words is set where its code i is the letter; no bit for others."""
    out = np.zeros((words, alphabet + 1, len(codes)), np.uint64)
    rows = np.arange(len(codes))
    for i in range(codes.shape[1]):
        out[i // 64, codes[:, i], rows] |= ONE << np.uint64(i % 64)
    out[:, alphabet] = 0
    return out


def step(
    eqs: Iterator[np.ndarray], up: Sequence[np.ndarray], down: Sequence[np.ndarray], free_start: bool,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One text base against all pattern words (Myers 1999, Hyyro 2003); ``up`` and ``down`` are replaced in place.

    Yields for each word, before the words move on, the bits of cells: equal to their diagonal neighbour; not one more
    than their left neighbour; one less than it; and the pattern's matches.
    """
    lower = fall = None
    final = len(up) - 1
    for w, (eq, p, m) in enumerate(zip(eqs, up, down)):
        x = eq if fall is None else eq | fall
        d = x & p
        d += p
        d ^= p
        d |= x
        d |= m
        h = d | p
        h ^= m
        less = d & p
        yield d, h, less, eq
        last_lower, last_fall = lower, fall
        if w < final:
            lower, fall = h >> TOP, less >> TOP
        # A sum is a faster shift.
        h += h
        less += less
        if last_lower is not None:
            h |= last_lower
            less |= last_fall
        elif free_start:
            h |= ONE
        u = d | h
        np.bitwise_xor(u, h, out=m)
        np.bitwise_xor(u, d, out=p)
        p |= less


class Panel:
    """References prepared for bit-parallel distances (Myers 1999, in 64-row words).

    One bit per reference base holds the difference of neighbouring cells, so a step of a whole
    block of reads against all references is a handful of integer operations.
    """

    def __init__(self, refs: Sequence[str]):
        self.size = len(refs)
        block, self.lengths = _codes(refs)
        self.alphabet = letters(block)
        self.groups = []
        words = np.maximum((self.lengths + 63) // 64, 1)
        for w in np.unique(words):
            members = np.flatnonzero(words == w)
            members = members[np.argsort(self.lengths[members], kind="stable")]
            codes = coded(self.alphabet, block[members, :int(self.lengths[members].max())])
            self.groups.append((members, masks(codes, len(self.alphabet), int(w))))
        self.short = np.flatnonzero(self.lengths <= SHORT_REF)
        if not len(self.short) or len(self.alphabet) > FEW_LETTERS:
            self.nearest = None
        else:
            n = self.lengths[self.short]
            self.nearest = Nearest(coded(self.alphabet, block[self.short, :max(int(n.max()), 1)]).astype(np.uint8), n, len(self.alphabet))

    def _parts(self, low: int, high: int, apart: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, masks) of references with ``low`` to ``high`` bases, without those inside ``apart``."""
        for members, peq in self.groups:
            n = self.lengths[members]
            take = (n >= low) & (n <= high)
            if apart is not None:
                take &= (n < apart[0]) | (n > apart[1])
            if take.all():
                yield members, peq
            elif take.any():
                yield members[take], np.ascontiguousarray(peq[:, :, take])

    def _table(self, codes: np.ndarray, lengths: np.ndarray, members: np.ndarray, peq: np.ndarray) -> np.ndarray:
        """Global distances of reads, the longest first, to the members."""
        shape = (len(lengths), len(members))
        up = [np.full(shape, ~np.uint64(0)) for _ in peq]
        down = [np.zeros(shape, np.uint64) for _ in peq]
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), side="right")
        for j, a in enumerate(active.tolist()):
            at = codes[:a, j]
            for _ in step((e.take(at, axis=0) for e in peq), [x[:a] for x in up], [x[:a] for x in down], False):
                pass
        # Down the last column from its top, which is the read's length.
        out = np.repeat(lengths[:, None], len(members), axis=1)
        for w, (p, m) in enumerate(zip(up, down)):
            rest = np.clip(self.lengths[members] - 64 * w, 0, 64)
            mask = np.where(rest == 64, ~np.uint64(0), (ONE << (rest % 64).astype(np.uint64)) - ONE)
            out += np.bitwise_count(p & mask)
            out -= np.bitwise_count(m & mask)
        return out

    def distances(self, reads: Sequence[str]) -> np.ndarray:
        """Matrix of global distances; ``reads`` must be sorted by length."""
        block, lengths = _codes(reads)
        codes, out = coded(self.alphabet, block)[::-1], np.zeros((len(reads), self.size), int)
        for members, peq in self.groups:
            out[:, members] = self._table(codes, lengths[::-1], members, peq)[::-1]
        return out

    def closest(self, reads: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(reference index, distance) of the nearest reference, the first one on ties.

        A distance is at least the difference in length: references of similar length go first, and of the others only
        those are tried whose lengths could still give a distance as small.
        """
        best = np.zeros(len(reads), np.int64)
        lengths = np.fromiter(map(len, reads), np.int64, len(reads))
        order, ordered = np.argsort(-lengths, kind="stable"), np.sort(self.lengths)
        if self.nearest is not None:
            few = np.searchsorted(-lengths[order], -SHORT)
            self._closest_short(reads, lengths, order[few:][::-1], best)
            order = order[:few]
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            low, high = self._near(longest, ordered)
            size = max(1, PANEL_WORDS // max(1, np.searchsorted(ordered, high, "right") - np.searchsorted(ordered, low)))
            some = order[at: at + min(size, max(1, MAX_CELLS // (longest + 1)))]
            # Reads of one block are of similar length, or longer than all references, which are chosen for all of them.
            some = some[lengths[some] >= (longest - longest // 16 if longest < 2 * ordered[-1] else 2 * ordered[-1])]
            at += len(some)
            n = lengths[some]
            low = min(low, self._near(int(n[-1]), ordered)[0])
            codes = coded(self.alphabet, _codes([reads[i] for i in some])[0])
            found = self._least(codes, n, low, high, None)
            d = found // self.size
            inside = np.searchsorted(ordered, [low, high + 1])
            below = n - (ordered[inside[0] - 1] if inside[0] else -self.size - longest * 2)
            above = (ordered[inside[1]] if inside[1] < self.size else longest * 2 + d.max() + 1) - n
            more = np.flatnonzero((below <= d) | (above <= d))
            if len(more):
                wide = self._least(codes[more], n[more], int((n - d)[more].min()), int((n + d)[more].max()), (low, high))
                found[more] = np.minimum(found[more], wide)
            best[some] = found
        return best % max(self.size, 1), best // max(self.size, 1)

    def _closest_short(self, reads: Sequence[str], lengths: np.ndarray, order: np.ndarray, best: np.ndarray) -> None:
        """Fills in ``best``, distance * size + reference, for short reads, the shortest first."""
        rest, ordered = self.lengths[self.lengths > SHORT_REF], lengths[order]
        at = 0
        while at < len(order):
            n = int(ordered[at])
            # Reads of one block are of similar length, or longer than all references.
            more = max(2, n // 12) if n < 2 * self.nearest.lengths[-1] else n
            some = order[at: min(at + max(64, MAX_CELLS // (n + more + 1)), int(np.searchsorted(ordered, n + more, "right")))]
            at += len(some)
            codes = coded(self.alphabet, _codes([reads[i] for i in some])[0])
            found = self.nearest.closest(codes.astype(np.uint8), lengths[some])
            d, which = found // len(self.short), self.short[found % len(self.short)]
            best[some] = d * self.size + which
            far = some[d >= rest.min(initial=np.iinfo(np.int64).max) - lengths[some]][::-1]
            if len(far):
                codes = coded(self.alphabet, _codes([reads[i] for i in far])[0])
                best[far] = np.minimum(best[far], self._least(codes, lengths[far], SHORT_REF + 1, int(rest.max()), None))

    def _near(self, n: int, ordered: np.ndarray) -> tuple[int, int]:
        """Reference lengths within NEAR_SHARE of n, and those of the NEAR_REFS nearest below and above."""
        at = int(np.searchsorted(ordered, n))
        low = min(n - int(NEAR_SHARE * n), int(ordered[max(at - NEAR_REFS // 2, 0)]) if at else n)
        return min(low, int(ordered[-1])), max(n + int(NEAR_SHARE * n), int(ordered[min(at + NEAR_REFS // 2, self.size - 1)]))

    def _least(self, codes: np.ndarray, n: np.ndarray, low: int, high: int, apart: tuple[int, int] | None) -> np.ndarray:
        """Least distance * size + reference of every read, the longest first, among references of the given lengths."""
        least = np.full(len(n), np.iinfo(np.int64).max)
        for members, peq in self._parts(low, high, apart):
            for lo in range(0, len(n), size := max(1, PANEL_WORDS // len(members))):
                table = self._table(codes[lo: lo + size], n[lo: lo + size], members, peq)
                least[lo: lo + size] = np.minimum(least[lo: lo + size], (table * self.size + members).min(axis=1))
        return least

    def infixes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Matrices (distance, last position used) of every reference as an infix of every text; the first best end."""
        distance, end = np.zeros((len(texts), self.size), np.int32), np.zeros((len(texts), self.size), np.int32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order, at = np.argsort(-lengths, kind="stable"), 0
        while at < len(order):
            some = order[at: at + max(1, min(PANEL_WORDS // max(self.size, 1), MAX_CELLS // int(lengths[order[at]] + 1)))]
            at += len(some)
            codes = coded(self.alphabet, _codes([texts[i] for i in some])[0])
            for members, peq in self.groups:
                eqs = lambda j, a: (e.take(codes[:a, j], axis=0) for e in peq)
                distance[np.ix_(some, members)], end[np.ix_(some, members)] = _run(
                    eqs, len(peq), np.tile(self.lengths[members], (len(some), 1)), lengths[some], True, False)
        return distance, end


def _run(eqs, words: int, m: np.ndarray, n: np.ndarray, free_start: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distance, last text position used) where patterns of ``m`` bases end best in texts of ``n``, the longest first.

    ``eqs(j, a)`` gives the matches of text base j, word by word, for the first ``a`` texts. Of equal ends the first one
    counts, or the last.
    """
    up = [np.full(m.shape, ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(m.shape, np.uint64) for _ in range(words)]
    score = m.astype(np.int32)
    best, at = score.copy(), np.full(m.shape, -1, np.int32)
    bit = ((m - 1) % 64).astype(np.uint64)
    active = len(n) - np.searchsorted(n[::-1], np.arange(int(n.max(initial=0))), side="right")
    for j, a in enumerate(active.tolist()):
        for _, h, less, _ in step(eqs(j, a), [x[:a] for x in up], [x[:a] for x in down], free_start):
            pass_h, pass_less = h >> bit[:a], less >> bit[:a]
        s = score[:a]
        s += 1
        s -= ((pass_h & ONE) + (pass_less & ONE)).astype(np.int32)
        better = s <= best[:a] if last else s < best[:a]
        np.copyto(best[:a], s, where=better)
        np.copyto(at[:a], j, where=better)
    empty = m == 0
    best[empty] = 0
    at[empty] = -1
    return best, at


def _pair_ends(queries: Sequence[str], targets: Sequence[str], free_start: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distance, last target position used) of each query in its own target, many pairs at once."""
    m = np.fromiter(map(len, queries), np.int64, len(queries))
    n = np.fromiter(map(len, targets), np.int64, len(targets))
    distance, end = np.zeros(len(m), np.int32), np.full(len(m), -1, np.int32)
    words = np.maximum((m + 63) // 64, 1)
    order = np.lexsort((-n, words))
    size = len(set("".join(set(queries)))) + 1
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        some = order[at: at + max(1, min(PANEL_WORDS, MAX_CELLS // int(n[order[at]] + 1), MAX_CELLS // (size * w)))]
        some = some[words[some] == w]
        at += len(some)
        block, _ = _codes([queries[i] for i in some])
        alphabet = letters(block)
        peq = masks(coded(alphabet, block), len(alphabet), w)
        place = np.ascontiguousarray((coded(alphabet, _codes([targets[i] for i in some])[0]) * len(some) + np.arange(len(some))[:, None]).T)
        flat = peq.reshape(w, -1)
        eqs = lambda j, a: (f.take(place[j, :a]) for f in flat)
        distance[some], end[some] = _run(eqs, w, m[some], n[some], free_start, last)
    return distance, end


def locate_pairs(queries: pd.Series, targets: pd.Series, mode: str) -> pd.DataFrame:
    """``locate`` over aligned columns, all pairs of a batch at once."""
    q, t = queries.tolist(), targets.tolist()
    if mode == "NW":
        found = [locate(a, [b], mode)[0] for a, b in zip(q, t)]
        return pd.DataFrame(np.reshape(found, (-1, 3)), columns=["distance", "start", "end"])
    if mode == "SHW":
        distance, end = _pair_ends(q, t, False, False)
        return pd.DataFrame({"distance": distance, "start": np.zeros(len(q), np.int32), "end": end})
    # An infix has twice the query's bases at most, so a long target is searched as pieces that overlap by as many.
    pair, at, pieces = [], [], []
    for i, (a, b) in enumerate(zip(q, t)):
        for lo in range(0, max(len(b) - 2 * len(a), 1), PIECE):
            pair.append(i)
            at.append(lo)
            pieces.append(b[lo: lo + PIECE + 2 * len(a)])
    pair = np.array(pair, np.int64)
    d, e = _pair_ends([q[i] for i in pair], pieces, True, False)
    e = np.where(e < 0, -1, e + np.array(at, np.int64))
    order = np.lexsort((e, d, pair))
    first = order[np.r_[True, np.diff(pair[order]) > 0]] if len(order) else order
    distance, end = d[first].astype(np.int32), e[first].astype(np.int32)
    # From the end backwards; of equal starts the earliest, that is the longest head.
    heads = [b[max(0, k + 1 - 2 * len(a)): k + 1][::-1] for a, b, k in zip(q, t, end.tolist())]
    back = _pair_ends([a[::-1] for a in q], heads, False, True)[1]
    return pd.DataFrame({"distance": distance, "start": end - back, "end": end})
