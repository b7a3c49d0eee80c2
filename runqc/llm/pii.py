"""Personal data: pattern spans, and a character BiLSTM with CRF transitions trained on them in numpy."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import give_back

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that fails from its start fails from every later start too, so only run starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Documents that the network is trained on (least hash of the id first) and windows of each. Documented bounds.
SAMPLE_DOCS, WINDOWS_PER_DOC, TRAIN_LENGTH = 2_000, 6, 96
HIDDEN, STEPS, BATCH, RATE = 6, 500, 96, 0.02
#: ASCII characters are themselves, all others one class; 0 also separates texts.
CHARACTERS = 129
#: B- and I- of each kind, after O.
TAGS = 1 + 2 * len(KINDS)
WINDOW, MARGIN, LANES = 512, 32, 2_048


def luhn(digits: str) -> bool:
    doubled = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return doubled % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether what a pattern matched is kept."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = NOT_DIGIT.sub("", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @: what stands before it back to the last match."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            spans.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    spans = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return spans


def encode(text: str) -> np.ndarray:
    """Character classes of a text."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), CHARACTERS - 1).astype(np.uint8)


def tags_of(spans: list[tuple[str, int, int]], length: int) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for kind, a, b in sorted(spans, key=lambda s: s[1] - s[2]):  # long spans first, short ones over them
        b_tag = 1 + 2 * KINDS.index(kind)
        tags[a:b], tags[a] = b_tag + 1, b_tag
    return tags


def squash(z: np.ndarray) -> np.ndarray:
    """Softsign, this network's tanh: a few cheap operations per gate, and gates cost most of a scan."""
    return z / (1 + np.abs(z))


class Network:
    """Parameters and their gradients. Each direction: ``x`` (gates, characters), ``u`` (gates, hidden); gates i, f, o, g."""

    def __init__(self, seed: int = 0):
        rng, h = np.random.default_rng(seed), HIDDEN
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1] if shape[-1] < 64 else h)).astype(np.float32)
        self.p = {k + d: v for d in "fb" for k, v in (("x", f(4 * h, CHARACTERS) * 0.5), ("u", f(4 * h, h)))}
        for d in "fb":
            self.p["x" + d][h:2 * h] += 1.0
        self.p |= {"w": f(TAGS, 2 * h), "b": np.zeros((TAGS, 1), np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}

    def states(self, codes: np.ndarray, d: str) -> dict[str, np.ndarray]:
        """All gates and states of one direction, in order of processing; ``codes``: (time, lanes)."""
        t, lanes = codes.shape
        h, c = np.zeros((HIDDEN, lanes), np.float32), np.zeros((HIDDEN, lanes), np.float32)
        gates, cs, hs = np.empty((t, 4 * HIDDEN, lanes), np.float32), np.empty((t, HIDDEN, lanes), np.float32), np.empty((t, HIDDEN, lanes), np.float32)
        for s in range(t):
            z = squash(self.p["u" + d] @ h + self.p["x" + d][:, codes[s]])
            z[:3 * HIDDEN] = 0.5 + 0.5 * z[:3 * HIDDEN]
            i, f, o, g = np.split(z, 4)
            c = f * c + i * g
            h = o * squash(c)
            gates[s], cs[s], hs[s] = z, c, h
        return {"gates": gates, "c": cs, "h": hs, "codes": codes}

    def back(self, run: dict[str, np.ndarray], dh_out: np.ndarray, d: str, grad: dict[str, np.ndarray]) -> None:
        """Adds the gradients of one direction; ``dh_out`` in order of processing."""
        t, _, lanes = dh_out.shape
        dh, dc, dzs = np.zeros((HIDDEN, lanes), np.float32), np.zeros((HIDDEN, lanes), np.float32), np.empty((t, 4 * HIDDEN, lanes), np.float32)
        for s in range(t - 1, -1, -1):
            i, f, o, g = np.split(run["gates"][s], 4)
            before, squashed = run["c"][s - 1] if s else 0.0, squash(run["c"][s])
            dh = dh + dh_out[s]
            dc = dc + dh * o * (1 - np.abs(squashed)) ** 2
            slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            dz = np.concatenate([dc * g * slope(i), dc * before * slope(f), dh * squashed * slope(o), dc * i * (1 - np.abs(g)) ** 2])
            if s:
                grad["u" + d] += dz @ run["h"][s - 1].T
            dzs[s], dh, dc = dz, self.p["u" + d].T @ dz, dc * f
        flat, codes = dzs.transpose(1, 0, 2).reshape(4 * HIDDEN, -1), run["codes"].ravel()
        grad["x" + d] += np.stack([np.bincount(codes, row, CHARACTERS) for row in flat]).astype(np.float32)

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags under the CRF, and gradients; both arrays (time, lanes)."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        forward, backward = self.states(codes, "f"), self.states(codes[::-1], "b")
        h = np.concatenate([forward["h"], backward["h"][::-1]], 1)
        e = np.einsum("kh,thl->tkl", self.p["w"], h) + self.p["b"]
        t, _, lanes = e.shape
        a, at = self.p["a"], np.arange(lanes)
        log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, t):
            alpha[s] = log_sum(alpha[s - 1][:, None] + a[:, :, None], 0) + e[s]
        for s in range(t - 2, -1, -1):
            beta[s] = log_sum(a[:, :, None] + (e[s + 1] + beta[s + 1])[None], 1)
        z = log_sum(alpha[-1], 0)
        de = np.exp(alpha + beta - z)
        score = np.take_along_axis(e, tags[:, None].astype(int), 1).sum((0, 1)) + a[tags[:-1], tags[1:]].sum(0)
        for s in range(t):
            de[s, tags[s], at] -= 1
        for s in range(1, t):
            grad["a"] += np.exp(alpha[s - 1][:, None] + a[:, :, None] + (e[s] + beta[s])[None] - z).sum(2)
        np.subtract.at(grad["a"], (tags[:-1].ravel(), tags[1:].ravel()), 1)
        de /= lanes
        grad["a"] /= lanes
        grad["w"] += np.einsum("tkl,thl->kh", de, h)
        grad["b"] += de.sum((0, 2))[:, None]
        dh = np.einsum("kh,tkl->thl", self.p["w"], de)
        self.back(forward, dh[:, :HIDDEN], "f", grad)
        self.back(backward, dh[::-1, HIDDEN:], "b", grad)
        return float((z - score).mean()), grad


def train(codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """Adam over batches of labelled windows, (windows, time)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = rng.integers(0, len(codes), min(BATCH, len(codes)))
        _, grad = net.loss(codes[some].T.astype(np.int64), tags[some].T.astype(np.int64))
        size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            net.p[k] -= np.float32(RATE * (1 - 0.9 * step / steps)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Tagger:
    """Decodes whole texts with a trained network."""

    def __init__(self, net: Network):
        self.x, self.u = ({d: np.ascontiguousarray(net.p[k + d]) for d in "fb"} for k in "xu")
        self.w, self.b, self.a = net.p["w"], net.p["b"], net.p["a"]
        #: If O leads every other tag by twice the best that transitions can add, no path leaves O.
        self.lead = 2 * max(0.0, float(self.a.max() - self.a[0, 0]))

    def _run(self, codes: np.ndarray, d: str) -> Iterator[np.ndarray]:
        """The hidden states of one direction, step by step; the buffer is reused."""
        t, lanes = codes.shape
        n = 3 * HIDDEN
        h, c, z, x, g = (np.zeros((k, lanes), np.float32) for k in (HIDDEN, HIDDEN, 4 * HIDDEN, 4 * HIDDEN, HIDDEN))
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(self.x[d], codes[s], axis=1, out=x, mode="clip")
            np.matmul(self.u[d], h, out=z)
            z += x
            np.abs(z, out=x)
            x += 1
            z /= x
            z[:n] *= 0.5
            z[:n] += 0.5
            c *= z[HIDDEN:2 * HIDDEN]
            np.multiply(z[:HIDDEN], z[n:], out=g)
            c += g
            np.abs(c, out=h)
            h += 1
            np.divide(c, h, out=h)
            h *= z[2 * HIDDEN:n]
            yield h

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, tags, lanes), and the lanes in which a tag other than O is possible."""
        t, lanes = codes.shape
        e, open_ = np.empty((t, TAGS, lanes), np.float32), np.zeros(lanes, bool)
        for s, h in zip(range(t - 1, -1, -1), self._run(codes, "b")):
            np.matmul(self.w[:, HIDDEN:], h, out=e[s])
            e[s] += self.b
        for s, h in enumerate(self._run(codes, "f")):
            e[s] += self.w[:, :HIDDEN] @ h
            open_ |= e[s, 1:].max(0) > e[s, 0] - self.lead
        return e, np.flatnonzero(open_)

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags per lane by Viterbi, and each position's score over O."""
        t, _, lanes = e.shape
        best, came = e[0], np.zeros((t, TAGS, lanes), np.uint8)
        for s in range(1, t):
            now = best[0] + self.a[0][:, None]
            for k in range(1, TAGS):
                path = best[k] + self.a[k][:, None]
                better = path > now
                came[s][better] = k
                np.maximum(now, path, out=now)
            best = now + e[s]
        tags = np.empty((t, lanes), np.int64)
        tags[-1] = best.argmax(0)
        for s in range(t - 1, 0, -1):
            tags[s - 1] = np.take_along_axis(came[s], tags[s][None], 0)[0]
        return tags, np.take_along_axis(e, tags[:, None], 1)[:, 0] - e[:, 0]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Model spans per text. All texts go in one stream, cut into windows that overlap by twice the margin.

        Every window is decoded; of the spans that windows propose, those of greater score are kept first, and what
        overlaps a kept one goes. So a span that one window cuts off loses to the whole one of its neighbour.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = MARGIN + np.cumsum(sizes + MARGIN) - (sizes + MARGIN)
        step = WINDOW - 2 * MARGIN
        windows = max(1, -(-int(sizes.sum() + MARGIN * (len(texts) + 1)) // step))
        stream = np.zeros(windows * step + 2 * MARGIN, np.uint8)
        for text, at in zip(texts, offsets):
            stream[at:at + len(text)] = encode(text)
        proposed = []
        for first in range(0, windows, LANES):
            starts = np.arange(first, min(windows, first + LANES)) * step
            e, lanes = self.emissions(stream[starts[None] + np.arange(WINDOW)[:, None]].astype(np.int64))
            if len(lanes):
                tags, score = self.decode(e[:, :, lanes])
                proposed += self._proposed(tags, score, starts[lanes])
        kept, found = [], [[] for _ in texts]
        taken = np.zeros(len(stream), bool)
        for score, kind, a, b in sorted(set(proposed), reverse=True):
            if not taken[a:b].any():
                taken[a:b] = True
                kept.append((kind, a, b))
        for kind, a, b in sorted(kept, key=lambda s: s[1]):
            i = int(np.searchsorted(offsets, a, "right")) - 1
            if i >= 0 and b <= offsets[i] + sizes[i]:
                found[i].append((kind, int(a - offsets[i]), int(b - offsets[i])))
        return found

    @staticmethod
    def _proposed(tags: np.ndarray, score: np.ndarray, starts: np.ndarray) -> list[tuple[float, str, int, int]]:
        kind = (tags + 1) // 2
        begins = (kind > 0) & np.vstack([np.ones((1, tags.shape[1]), bool), (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)])
        sums = np.vstack([np.zeros((1, tags.shape[1])), np.cumsum(score, 0)])
        out = []
        for lane, s in np.argwhere(begins.T):
            rest = np.flatnonzero((kind[s + 1:, lane] != kind[s, lane]) | begins[s + 1:, lane])
            end = s + 1 + (int(rest[0]) if len(rest) else len(tags) - s - 1)
            out.append((round(float(sums[end, lane] - sums[s, lane]), 3), KINDS[kind[s, lane] - 1], int(starts[lane] + s), int(starts[lane] + end)))
        return out


PATTERNS = {"ip": IP, "card": CARD, "phone": PHONE}


def whole(kind: str, found: str) -> bool:
    """Whether a span by itself is one of its kind."""
    return emails(found) == [(0, len(found))] if kind == "email" else bool(PATTERNS[kind].fullmatch(found)) and valid(kind, found)


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """Per text: base spans, and base with those the model adds. Added spans are whole by themselves and touch no base span."""
    modelled = tagger.spans(texts) if tagger else [[]] * len(texts)
    result = []
    for text, model in zip(texts, modelled):
        base = base_spans(text)
        added = [(k, a, b) for k, a, b in model if not any(a < y and x < b for _, x, y in base) and whole(k, text[a:b])]
        result.append((base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return result


def labelled_windows(docs: DataFrame, doc_id: str, text: str, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Windows with the tags of their base spans, of a bounded sample of documents that hold an @ or a digit."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null").where(F.col("text").rlike("[@0-9]"))
    chosen = rows.select("id").distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select("id")
    schema = pa.schema([("id", pa.int64()), ("codes", pa.binary()), ("tags", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                rng, spans = np.random.default_rng(abs(i)), base_spans(t)
                picks = [spans[j] for j in rng.permutation(len(spans))[:WINDOWS_PER_DOC - 2]]
                digits = [m.start() for m in re.finditer(r"[0-9]+", t)][:1000]
                starts = [a - int(rng.integers(0, TRAIN_LENGTH - min(TRAIN_LENGTH - 1, b - a))) for _, a, b in picks] + [int(rng.integers(0, len(t)))]
                starts += [digits[int(rng.integers(0, len(digits)))] - int(rng.integers(0, TRAIN_LENGTH // 2))] if digits else []
                codes, tags = np.zeros(len(t) + 2 * TRAIN_LENGTH, np.uint8), np.zeros(len(t) + 2 * TRAIN_LENGTH, np.uint8)
                codes[TRAIN_LENGTH:-TRAIN_LENGTH], tags[TRAIN_LENGTH:-TRAIN_LENGTH] = encode(t), tags_of(spans, len(t))
                out += [(i, codes[s + TRAIN_LENGTH:][:TRAIN_LENGTH].tobytes(), tags[s + TRAIN_LENGTH:][:TRAIN_LENGTH].tobytes()) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), ()), schema)], schema=schema)

    got = rows.join(chosen, "id", "left_semi").mapInArrow(run, "id long, codes binary, tags binary").orderBy("id", "codes", "tags").limit(sample * WINDOWS_PER_DOC).toArrow()
    read = lambda c: np.array([np.frombuffer(b, np.uint8) for b in got.column(c).to_pylist()], np.uint8).reshape(-1, TRAIN_LENGTH)
    return read("codes"), read("tags")


def trained_tagger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """None where no document holds a span to learn from."""
    codes, tags = labelled_windows(docs, doc_id, text)
    return Tagger(train(codes, tags)) if tags.any() else None


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base_sha256`` and ``spans`` (all) for every row.

    Whole texts are read; NULL is an empty text. Repeated rows are repeated, other columns ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                found = all_spans([t or "" for t in some.column(1).to_pylist()], shared.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([some.column(0), *counts, pa.array(digest), pa.array([joined(s) for _, s in found])], schema=schema)
                give_back()

    types = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, types)
