"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import give_back, held_out

FOLDS = 5
#: Texts that the classifiers are fitted on, least hash of the id first. Documented bounds; the prior is of all labels.
POSITIVES, UNLABELLED = 3_000, 6_000
#: Letter five-grams are hashed to so many values; this many of them, the most telling, are features.
TABLE_BITS, FEATURES = 20, 1_024
#: A feature's share among positives exceeds that among negatives by so many standard errors.
SURE = 2.5
CLASSIFIERS, STEPS, BATCH, RATE, DECAY = 3, 600, 512, 0.02, 1e-4
NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Hashes of the five-byte sequences of the lower-cased letters; runs of other characters are one blank."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    if len(b) < 5:
        return np.zeros(0, np.int64)
    joined = b[:-4] | b[1:-3] << np.uint64(8) | b[2:-2] << np.uint64(16) | b[3:-1] << np.uint64(24) | b[4:] << np.uint64(32)
    return ((joined * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of one logistic classifier on 0/1 features, by Adam on the non-negative risk estimator.

    risk = prior E+[l(z)] + max(0, Eu[l(-z)] - prior E+[l(-z)]) with the logistic loss l. Where the second term, the
    risk on negatives, would fall below 0, it stops teaching, so that unlabelled positives are not learnt as negatives.
    """
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(positive.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(BATCH, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(BATCH, len(unlabelled)))]
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)  # gradients of l(-z)
        cp, cu = prior * (_sigmoid(zp) - 1) / len(zp), np.zeros(len(zu))
        if negative > 0:
            cp, cu = cp - prior * gp, gu
        gradient = np.r_[cp @ p + cu @ u + DECAY * w[:-1], cp.sum() + cu.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= RATE * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class Classifiers:
    """The mean logit of several classifiers, as one weight per hashed sequence."""

    def __init__(self, chosen: np.ndarray, fitted: list[tuple[np.ndarray, float]], constant: float = 0.0):
        self.weight = np.zeros(1 << TABLE_BITS, np.float32)
        self.bias = constant
        if fitted:
            self.weight[chosen] = np.mean([w for w, _ in fitted], 0)
            self.bias = float(np.mean([b for _, b in fitted]))
        self.used = self.weight != 0

    def score(self, text: str | None) -> float:
        found = grams(text)
        found = np.unique(found[self.used[found]])
        return float(_sigmoid(np.float64(self.weight[found].sum(dtype=np.float64) + self.bias)))


def _frequencies(sample: DataFrame) -> DataFrame:
    """(gram, positive): texts that hold a gram; one row per task and gram before the sum."""
    schema = pa.schema([("positive", pa.bool_()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << TABLE_BITS), np.int32)
        for batch in batches:
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[int(positive), np.unique(grams(text.as_py()))] += 1
        for kind in (0, 1):
            at = np.flatnonzero(seen[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bool(kind))), pa.array(at), pa.array(seen[kind][at].astype(np.int64))], schema=schema)

    counted = sample.select("positive", "text").mapInArrow(run, "positive boolean, gram long, n long")
    return counted.groupBy("gram").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("u"))


def _features(sample: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows of the positive and the unlabelled texts; packed to bits for the way to the driver."""
    place = np.full(1 << TABLE_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = sample.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("positive", pa.bool_()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                row = np.zeros(len(chosen), bool)
                at = shared.value[grams(text.as_py())]
                row[at[at >= 0]] = True
                rows.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema=schema)

    got = sample.select("positive", "text").mapInArrow(run, "positive boolean, bits binary").toArrow()
    bits = np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=len(chosen)) for b in got.column("bits").to_pylist()], np.float32).reshape(-1, len(chosen))
    positive = np.array(got.column("positive").to_pylist(), bool)
    return bits[positive], bits[~positive]


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifiers:
    """Fits on confirmed toxic texts and on unlabelled ones, both of the learning folds.

    Only positive labels teach; all other documents, labelled or not, are unlabelled text. The class prior is the share
    of positives among all labels of the learning folds. Without a positive or an unlabelled text, or with a prior of
    0 or 1, the score is constant: the prior.
    """
    learn = ~held_out(F.col("id"), folds)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull()).where(learn)
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(learn)
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    nothing = Classifiers(np.zeros(0, np.int64), [], float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not 0 < prior < 1:
        return nothing
    least = lambda ids, n: ids.distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(n).select("id")
    confirmed = marks.where("label = 1").select("id").distinct()
    positives = least(rows.select("id").join(confirmed, "id", "left_semi"), POSITIVES).withColumn("positive", F.lit(True))
    # Unlabelled text stands for the whole corpus, so it is drawn from all documents, confirmed ones among them.
    mixed = least(rows.select("id"), UNLABELLED).withColumn("positive", F.lit(False))
    sample = rows.join(positives.unionAll(mixed), "id").select("positive", "text")
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return nothing
    p, u = F.col("p") / sizes[True], F.col("u") / sizes[False]
    rest = F.greatest((u - prior * p) / (1 - prior), F.lit(0.0))
    error = F.sqrt(p * (1 - p) / sizes[True] + u * (1 - u) / sizes[False]) + 1 / sizes[True]
    telling = _frequencies(sample).where(p - rest > SURE * error).withColumn("gain", (p - rest) * (p - rest) / (p + rest))
    chosen = np.array(sorted(r.gram for r in telling.orderBy(F.desc("gain"), "gram").limit(FEATURES).collect()), np.int64)
    if not len(chosen):
        return nothing
    positive, unlabelled = _features(sample, chosen)
    return Classifiers(chosen, [fit_nnpu(positive, unlabelled, prior, seed) for seed in range(CLASSIFIERS)])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row: score in 0..1 of the whole text, predicted 1 from 0.5 on.

    NULL and empty texts hold no sequence and get the score of the bias alone. Repeated rows are scored each; other
    columns are never looked at. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, doc_id, text, label))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array([model.value.score(t.as_py()) for t in texts], pa.float64())
        give_back()
        return found

    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
