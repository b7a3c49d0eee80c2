import numpy as np
import pytest
from pyspark.sql import functions as F

from runqc.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id long, score long, key string, anchor_id long, kind int, v int"


def plain(rows, positives=5, negatives=3):
    """All scores of every anchor, sorted. ``rows``: (vec_id, vector, label)."""
    good = [(N.NO_ID if i is None else i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    named = lambda i: None if i == N.NO_ID else i
    out = []
    for n, (i, v, y) in enumerate(good):
        if i == N.NO_ID or i % 10:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j, k, z) for k, (j, w, z) in enumerate(good) if k != n)
        for p, j, _, _ in [r for r in ranked if r[3] == y][:positives]:
            hard = [r for r in ranked if r[3] != y and 50 * -p <= 100 * -r[0] <= 95 * -p][:negatives]
            out += [(i, named(j), at + 1, named(h[1]), -p, -h[0]) for at, h in enumerate(hard)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([r + (None,) * 7 for r in rows], SCHEMA)
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("width, spread", [(16, 0.5), (3, 4.0)])
def test_against_all_scores(spark, monkeypatch, width, spread):
    """Many small chunks and blocks; one label and one vector have a third of the rows, ids repeat, values are odd."""
    monkeypatch.setattr(N, "BLOCK", 60)
    monkeypatch.setattr(N, "CHUNK", 7)
    monkeypatch.setattr(N, "TILE", 3)
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((5, width))
    rows = [(i, (centres[i % 5] + spread * rng.standard_normal(width)).tolist(), int(rng.integers(0, 5))) for i in range(240)]
    rows += [(300 + i, centres[0].tolist(), 7) for i in range(90)] + [rows[20]] * 4 + [(10, centres[1].tolist(), 2)]
    rows += [(500, None, 1), (510, [1.0] * width, None), (520, [], 1), (530, [0.5], 2), (540, [float("nan")] * width, 1), (550, [1.0, None], 2), (560, [float("inf")], 1)]
    rows += [(None, centres[2].tolist(), 1), (570, [0.0] * width, 3), (571, [0.0] * width, 3), (572, [0.0] * width, 4), (3, [0.0] * width, 4)]
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_large_components_are_exact(spark):
    """Beyond doubles scores are exact up to 64 bits; above, they are held at the limit, where none is hard."""
    rows = [(i, [float(2**40 + 977 * i % 11), -float(2**20 * (i % 3))], i % 2) for i in range(30)]
    assert mined(spark, rows) == []
    rows = [(i, [float(2**18 + 977 * i % 11), -float(2**20 * (i % 3))], i % 2) for i in range(30)]
    assert mined(spark, rows) == plain(rows)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (3, [0.25], 2)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_windows_of_zero_open_late():
    """Negatives of score 0 that come before a positive of score 0 are its window too."""
    key = lambda other, score: N.KEY.pack(4, N.TOP - score, other + 2**63)
    pairs = [(key(1, 0), (0, 40)), (key(2, 0), (1, 40)), (key(3, 0), (0, 40))]
    assert list(N._open_windows(3, 50, 95)(iter(pairs))) == [(40, 2, 1, 1, 0, 0), (40, 2, 2, 3, 0, 0)]
