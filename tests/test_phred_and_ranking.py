import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions.common import fixed1
from runqc.operators import ranking


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("qs, low, high", [([10, 30], 12.96, 12.98), ([30, 30, 30, 30, 10], 0, 20)])
def test_phred_mean(rows, qs, low, high):
    value = one(rows([(float(q),) for q in qs], "q double").agg(phred.mean_q("q")))
    assert low < value < high


def test_phred_edges(rows):
    assert one(rows([], "q double").agg(phred.mean_q("q"))) == 0.0
    assert one(rows([], "q double, w double").agg(phred.weighted_mean_q("q", "w"))) == 0.0
    data = rows([(10.0, 1.0, 100.0), (30.0, 100.0, 1.0)], "q double, up double, down double")
    assert one(data.agg(phred.weighted_mean_q("q", "up"))) > 25
    assert one(data.agg(phred.weighted_mean_q("q", "down"))) < 12
    p = rows([(0.0,), (1e-9,), (0.001,)], "p double").select(phred.to_qscore("p").alias("q")).collect()
    assert [round(r.q, 6) for r in p] == [60.0, 60.0, 30.0]


def test_string_quality(rows):
    got = rows([("5?",), ("",), (None,)], "qual string").select(phred.string_mean_q("qual").alias("q")).collect()
    assert got[0].q == pytest.approx(-10 * math.log10((10**-2.0 + 10**-3.0) / 2))
    assert got[1].q == 0.0


def test_edit_quality(rows):
    got = rows([(0, 100), (50, 100), (200, 100), (1, 0)], "ed int, n int").select(phred.edit_quality("ed", "n").alias("q")).collect()
    assert [round(r.q, 4) for r in got] == [40.0, 3.0103, 0.0, 0.0]


def test_fixed1_prints_like_printf(rows):
    values = [15.25, 14.85, 0.05, 0.15, 99.95, 100.0, 0.0, 40.35, 2.5, 12.75]
    got = rows([(x,) for x in values], "x double").select(fixed1("x").alias("t")).collect()
    assert [r.t for r in got] == [f"{x:.1f}" for x in values]


def test_nx_and_medians_by_hand(rows):
    df = rows([("a", x) for x in (2, 3, 4, 5, 6)] + [("b", x) for x in (1, 2, 3, 4)], "k string, length bigint")
    nx = {r.k: r for r in ranking.nx(df, ["k"], fractions={"n50": 0.5, "n90": 0.9}, width=2).collect()}
    assert (nx["a"].n50, nx["a"].n90) == (5, 3)
    med = {r.k: r for r in ranking.medians(df, ["k"], "length", 2).collect()}
    assert (med["b"].upper_median, med["b"].lower_median, med["b"].median) == (3, 2, 2.5)


def test_quantiles_match_numpy(rows):
    rng = np.random.default_rng(3)
    data = {"a": rng.integers(1, 5000, 501), "b": rng.integers(1, 50, 300)}
    df = rows([(k, int(x)) for k, xs in data.items() for x in xs], "k string, length bigint")
    for r in ranking.quantiles(df, ["k"], "length", {"p": 0.37, "q": 0.995}, 100).collect():
        assert r.p == pytest.approx(np.quantile(data[r.k], 0.37))
        assert r.q == pytest.approx(np.quantile(data[r.k], 0.995))


def hot_rows(rows):
    """A third of all rows share one time and one group holds most of them."""
    random.seed(5)
    data = [("hot" if i % 10 else "cold", f"r{i}", 60.0 if i % 3 == 0 else float(random.randint(0, 400)), random.randint(1, 9))
            for i in range(3000)]
    return data, rows(data, "k string, read_id string, t double, length bigint")


def test_running_totals_over_a_hot_value(rows):
    import hashlib

    data, df = hot_rows(rows)
    got = {r.read_id: (r.rank, r.s) for r in ranking.ordered_totals(df, ["k"], "t", "read_id", {"s": "length"}, 100).collect()}
    assert len(got) == len(data)
    for k in ("hot", "cold"):
        total = 0
        ordered = sorted((x for x in data if x[0] == k), key=lambda x: (x[2], hashlib.md5(x[1].encode()).hexdigest()))
        for i, x in enumerate(ordered, 1):
            total += x[3]
            assert got[x[1]] == (i, total)


def test_rolling_means_match_convolution(rows):
    data, df = hot_rows(rows)
    ranked = ranking.ordered_totals(df, ["k"], "t", "read_id", {"s": "length"}, 100)
    got = ranking.rolling_means(ranked, ["k"], "t", {"s": "m"}, 25).where("k = 'hot'").orderBy("window").collect()
    series = [r.length for r in ranked.where("k = 'hot'").orderBy("rank").collect()]
    want = np.convolve(series, np.ones(25) / 25, mode="valid")
    assert np.allclose([r.m for r in got], want) and [r.window for r in got] == list(range(1, len(want) + 1))
    times = [r.t for r in ranked.where("k = 'hot'").orderBy("rank").collect()]
    assert [r.t for r in got] == times[12: 12 + len(want)]


def test_hash_sample_is_exact_and_stable(rows):
    _, df = hot_rows(rows)
    quota = rows([("hot", 500), ("cold", 10_000)], "k string, n_keep int")
    first = ranking.hash_sample(df, ["k"], quota, "read_id", digits=2)
    again = ranking.hash_sample(df.repartition(7), ["k"], quota, "read_id", digits=1)
    assert {r["k"]: r["count"] for r in first.groupBy("k").count().collect()} == {"hot": 500, "cold": df.where("k='cold'").count()}
    assert {r.read_id for r in first.collect()} == {r.read_id for r in again.collect()}


def test_approximate_quantiles(rows):
    df = rows([("a", i) for i in range(1, 1001)], "k string, length bigint")
    assert abs(one(ranking.quantiles(df, [], "length", {"m": 0.5}, 10, approx=True)) - 500) <= 2


def test_nothing_in_nothing_out(rows):
    empty = rows([], "k string, length bigint")
    assert ranking.nx(empty, ["k"]).count() == 0
    assert empty.agg(F.count("*")).first()[0] == 0


def test_string_quality_of_odd_strings(rows):
    """Sums are added up in order; other characters than the 94 give NULL, as before; long strings cost a table look-up a base."""
    texts = ["+" * n for n in (1, 3, 7)] + ["5?" * 40, "5 ", "5é", "~"]
    got = [r.q for r in rows([(t,) for t in texts], "qual string").coalesce(1).select(phred.string_mean_q("qual", 100.0).alias("q")).collect()]
    for t, q in zip(texts[:4] + texts[-1:], got[:4] + got[-1:]):
        total = 0.0
        for c in t:
            total += 10.0 ** (-(ord(c) - 33) / 10.0)
        assert q == pytest.approx(-10 * math.log10(total / len(t)), abs=1e-12)
    assert got[4:6] == [None, None]
    assert "transform" not in str(phred.string_mean_q("qual")) and "aggregate" not in str(phred.string_mean_q("qual"))


def test_a_sample_meets_its_groups_in_parts(spark, rows):
    """Three groups, no broadcast: no task holds a whole group, and the rows are the ones with the smallest hashes."""
    data = rows([(i % 3, f"r{i}") for i in range(9000)], "g int, id string")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, x in plain.items():
            spark.conf.set(k, x)
        joined = ranking._beside(data, rows([(0, 5), (1, 6), (2, 7)], "g int, n int"), ["g"], "id")
        share = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        got = ranking.hash_sample(data, ["g"], rows([(0, 5), (1, 6), (2, 7)], "g int, n_keep int"), "id").collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sum(share) == 9000 and max(share) < 9000 / 6
    for g, n in ((0, 5), (1, 6), (2, 7)):
        order = sorted((hashlib.md5(f"r{i}42".encode()).hexdigest(), f"r{i}") for i in range(g, 9000, 3))
        assert sorted(r.id for r in got if r.g == g) == sorted(i for _, i in order[:n])
