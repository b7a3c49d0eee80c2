import numpy as np
import pytest

from runqc.llm import hamming as H


def plain(rows, k, every):
    codes = {i: np.array(v) > 0 for i, v in rows if i is not None and v is not None and None not in v and len(v)}
    out = []
    for q in (i for i in codes if i % every == 0):
        near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if len(c) == len(codes[q]))
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("width", [64, 20, 130])
def test_against_all_distances(spark, monkeypatch, width):
    monkeypatch.setattr(H, "BLOCK_CODES", 90)
    monkeypatch.setattr(H, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((6, width))
    rows = [(i, (centres[i % 6] + rng.standard_normal(width) * (i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]
    rows += [(2000, None), (2050, [0.5] * 7), (2051, [0.5] * 7), (2052, [1.0, None]), (None, rows[0][1]), (2100, []), (2150, [float("nan")] * width)]
    got = sorted(map(tuple, H.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=10).collect()))
    assert got == plain(rows, 10, 10)


def test_stops_only_when_covered():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 256, (4000, 8), dtype=np.uint8), axis=0)
    index, order = H.SegmentTables(codes), np.arange(len(codes))
    for query in rng.integers(0, 256, (20, 8), dtype=np.uint8):
        d = np.bitwise_count(codes ^ query).sum(1, dtype=np.int64)
        at, found = index.nearest(query, 5, order)
        best = np.lexsort((order, d))[:5]
        assert at.tolist() == best.tolist() and found.tolist() == d[best].tolist()


def test_empty(spark):
    assert H.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
