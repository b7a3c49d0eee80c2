"""Global distances of many short sequences to references: a bit stands for a pair, a word for a cell of 64 pairs.

Cells are filled by antidiagonals, all their rows, references and sequences in one vector operation, and only those whose
diagonals a path of the asked number of edits can reach (Ukkonen 1985; differences of cells as in Myers 1999).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of one step that are worked on at once.
STEP_WORDS = 12288
#: Words of sequences that are packed together, at most, and of their letters.
WORDS, TABLE_WORDS = 16, 1 << 21
#: References of similar length that are tried first, and bases by which those of one step may differ at any rate.
FIRST, SPAN = 32, 4


def _sums(rows: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit, for (rows, words): full adders of whole words, then the bits of each place."""
    planes = []
    while len(rows):
        carries = []
        while len(rows) > 2:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k:2 * k], rows[2 * k:3 * k]
            odd, both = a ^ b, a & b
            both |= odd & c
            odd ^= c
            carries.append(both)
            rows = np.concatenate([odd, rows[3 * k:]]) if len(rows) > 3 * k else odd
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        planes.append(np.unpackbits(rows[0].view(np.uint8), bitorder="little"))
        rows = np.concatenate(carries) if carries else rows[:0]
    out = np.zeros(len(planes[0]), np.uint8 if len(planes) <= 8 else np.uint32)
    for plane in reversed(planes):
        out += out
        out += plane
    return out


class Lanes:
    """Sequences of similar length, the shortest first, as bits of words: ``codes`` are places in an alphabet, beyond it for no letter."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, alphabet: int):
        self.lengths, self.alphabet = lengths, alphabet
        count, width = codes.shape
        self.words = (count + 63) // 64
        self.table = np.zeros((width, alphabet + 1, self.words), np.uint64)
        bits = np.zeros((width, 64 * self.words), bool)
        for a in range(alphabet):
            np.equal(codes.T, a, out=bits[:, :count])
            self.table[:, a] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.table = self.table.reshape(width * (alphabet + 1), self.words)
        # A word's sequences of one length end on the same diagonal.
        word = np.arange(count) // 64
        first = np.r_[True, (np.diff(word) > 0) | (np.diff(lengths) > 0)]
        self.group = np.cumsum(first) - 1
        self.word, self.n = word[first], lengths[first]

    def distances(self, refs: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
        """(references, sequences): distances up to ``k``, and what is no less than the distance where that is more.

        ``refs`` has the references' codes, padded by the place beyond the alphabet, and ``m`` their lengths.
        """
        high, wide, count, words = int(m.max(initial=0)), int(self.n.max(initial=0)), len(m), self.words
        end = self.n - m[:, None]
        low, top = min((int(end.min()) - k) // 2, int(end.min()), 0), max(-((-int(end.max()) - k) // 2), int(end.max()), 0)
        shape = (count, words)
        rows = min((top - low) // 2 + 1, high, wide)
        # Differences to the left and upper neighbour. Even antidiagonals write "not one more" and read "one more", odd ones reverse.
        left, up = ([(np.full((size, *shape), fill), np.zeros((size, *shape), np.uint64)) for fill in (np.uint64(0), ~np.uint64(0))] for size in (high, wide))
        same, rest = (np.empty((rows, *shape), np.uint64) for _ in range(2))
        letter = np.ascontiguousarray(refs[:, :high].T).astype(np.int64) - (np.arange(high)[:, None] + 1) * (self.alphabet + 1)
        # Steps along the diagonals on which the pairs end: which are free.
        plane = count * words
        ends = [np.nonzero(end % 2 == q) for q in (0, 1)]
        half = [(end[e] - q) // 2 for q, e in enumerate(ends)]
        place = [r * words + self.word[g] - h * plane for (r, g), h in zip(ends, half)]
        steps = (high + wide) // 2 + 1
        free = [np.zeros((steps, len(h)), np.uint64) for h in half]
        letters, either, other, both = self.alphabet + 1, np.bitwise_or, np.bitwise_xor, np.bitwise_and
        for s in range(2, high + wide + 1):
            a, b = max(1, s - wide, -((top - s) // 2)), min(high, s - 1, (s - low) // 2)
            if a > b:
                continue
            q, y, z = s % 2, wide - s + a, wide - s + b + 1
            x = same[:b - a + 1]
            (p, g), (to_p, to_g), (o, h), (to_o, to_h) = left[1 - q], left[q], up[1 - q], up[q]
            p, g, to_p, to_g = p[a - 1:b], g[a - 1:b], to_p[a - 1:b], to_g[a - 1:b]
            o, h, to_o, to_h = o[y:z], h[y:z], to_o[y:z], to_h[y:z]
            self.table.take(letter[a - 1:b] + (s - 1) * letters, axis=0, out=x, mode="clip")
            either(x, g, out=x)
            either(x, h, out=x)
            if q:
                t = rest[:b - a + 1]
                either(x, o, out=t)
                other(t, o, out=to_g)
                other(t, x, out=t)
                either(t, h, out=to_p)
                either(x, p, out=t)
                other(t, p, out=to_h)
                other(t, x, out=t)
                either(t, g, out=to_o)
            else:
                either(x, o, out=to_p)
                other(to_p, h, out=to_p)
                either(x, p, out=to_o)
                other(to_o, g, out=to_o)
                both(x, o, out=to_g)
                both(x, p, out=to_h)
            x.ravel().take(place[q] + (s // 2 - a) * plane, out=free[q][s // 2], mode="clip")
        found = np.zeros((count, len(self.n), 64), np.int32)
        for (r, g), h, bits in zip(ends, half, free):
            if len(r):
                # Row i of a pair's diagonal is step i + h; outside the table nothing counts.
                step = np.arange(steps, dtype=np.int32)[:, None] - h.astype(np.int32)
                inside = (step > np.maximum(m[r] - self.n[g], 0)) & (step <= m[r])
                bits &= np.negative(inside.view(np.int8), dtype=np.int64).view(np.uint64)
                found[r, g] = _sums(bits).reshape(-1, 64)
        np.subtract(np.maximum(m[:, None], self.n)[:, :, None], found, out=found, casting="unsafe")
        return found.reshape(count, -1)[:, self.group * 64 + np.arange(len(self.lengths)) % 64]


class Nearest:
    """References, as places in an alphabet padded by the place beyond it, of which the nearest is asked for many sequences."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, alphabet: int):
        self.order = np.argsort(lengths, kind="stable")
        self.codes, self.lengths, self.alphabet = codes[self.order], lengths[self.order], alphabet

    def closest(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Least distance * references + reference of sequences of similar length; the first reference on ties.

        References of similar length are tried first, with room for somewhat less than half of the bases changed; sequences
        farther from them are tried again with more. Then sequences with similar distances so far go together, as only
        smaller or equal ones are of interest.
        """
        best = np.empty(len(lengths), np.int64)
        low, high = int(lengths.min()), int(lengths.max())
        at = int(np.searchsorted(self.lengths, (low + high) // 2))
        a, b = max(0, min(at, len(self.lengths) - 1) - FIRST // 2), min(len(self.lengths), at + FIRST // 2)
        least, most = int(self.lengths[a]), int(self.lengths[b - 1])
        apart, both, far = max(high - most, least - low, 0), min(high, most), np.argsort(lengths, kind="stable")
        room = max(apart // 2 + both * 46 // 100, apart + both // 8) + 2
        while len(far):
            for some in self._blocks(far, high):
                best[some] = self._least(Lanes(codes[some], lengths[some], self.alphabet), a, b, room)
            far, room = far[best[far] // len(self.lengths) > room], 2 * room
        for some in self._blocks(np.argsort(best // len(self.lengths), kind="stable"), high):
            some = some[np.argsort(lengths[some], kind="stable")]
            best[some] = self._outward(Lanes(codes[some], lengths[some], self.alphabet), a, b, best[some])
        return best

    def _blocks(self, order: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        size = 64 * max(1, min(WORDS, TABLE_WORDS // ((longest + 1) * (self.alphabet + 1))))
        return (order[i:i + size] for i in range(0, len(order), size))

    def _least(self, lanes: Lanes, a: int, b: int, k: int) -> np.ndarray:
        """Least distance * references + reference among references a to b - 1 in order of length."""
        best = np.full(len(lanes.lengths), np.iinfo(np.int64).max)
        while a < b:
            to = self._step(lanes, a, b, k, 1)
            d = lanes.distances(self.codes[a:to], self.lengths[a:to], k)
            np.minimum(best, self._keys(d, a, to), out=best)
            a = to
        return best

    def _keys(self, d: np.ndarray, a: int, b: int) -> np.ndarray:
        size = len(self.lengths)
        kind = np.int32 if (int(d.max(initial=0)) + 1) * size < 1 << 31 else np.int64
        keys = d.astype(kind, copy=False) * kind(size)
        keys += self.order[a:b, None].astype(kind)
        return keys.min(axis=0)

    def _step(self, lanes: Lanes, a: int, b: int, k: int, way: int) -> int:
        """Where a step over references of similar length ends that goes up from a, or down from b."""
        m, n = int(self.lengths[a if way > 0 else b - 1]), int(lanes.lengths[-1])
        take = max(1, min(STEP_WORDS // max(1, min(m, n, k // 2 + 1)), TABLE_WORDS // max(m, n, 1)) // lanes.words)
        span = max(SPAN, k // 4)
        if way > 0:
            return min(b, a + take, int(np.searchsorted(self.lengths, m + span, "right")))
        return max(a, b - take, int(np.searchsorted(self.lengths, m - span)))

    def _outward(self, lanes: Lanes, a: int, b: int, best: np.ndarray) -> np.ndarray:
        """``best`` with the references outside a to b - 1, the most similar in length first, as far as they may be as near."""
        size, n = len(self.lengths), lanes.lengths
        middle = int(n[len(n) // 2])
        while True:
            d = best // size
            k, low, high = int(d.max()), int((n - d).min()), int((n + d).max())
            below = middle - int(self.lengths[a - 1]) if a and self.lengths[a - 1] >= low else None
            above = int(self.lengths[b]) - middle if b < size and self.lengths[b] <= high else None
            if below is None and above is None:
                return best
            if above is None or (below is not None and below <= above):
                to = self._step(lanes, 0, a, k, -1)
                some, a = slice(to, a), to
            else:
                to = self._step(lanes, b, size, k, 1)
                some, b = slice(b, to), to
            best = np.minimum(best, self._keys(lanes.distances(self.codes[some], self.lengths[some], k), some.start, some.stop))
