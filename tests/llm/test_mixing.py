import __spark_entry__ as contract
import oracle

from runqc.llm import mixing as M


def reshared(sizes, weights):
    """Targets as the rule reads: share by weight, stop at three times the size, reshare the excess, and again."""
    total, capped, left = sum(sizes), set(), None
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if share[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_follow_the_rule(spark):
    for sizes in ([100, 5, 1000, 2, 50, 7, 0], [10, 10, 10], [1, 0, 0], [0, 0], [1, 1000]):
        rows = [(None if i == len(sizes) - 1 else f"s{i}", n) for i, n in enumerate(sizes)]
        got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]) if sum(sizes) else [0] * len(sizes)
        for (source, _), t in zip(rows, want):
            assert abs(got[source] - t) < 1e-6


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + pmod(id * 7919, 40) as int)) as text", "concat('s', pmod(id, 7) * pmod(id, 2)) as source")
    got = M.mix(docs.repartition(6)).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        t = by.setdefault((r.doc_id % 7) * (r.doc_id % 2), [0, 0, r.target])
        t[0] += r.taken
        t[1] = max(t[1], r.size)
    assert all(abs(taken - target) <= 2 * largest for taken, largest, target in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(docs.repartition(3)).collect()))


def test_odd_documents(odd_docs, no_docs):
    got = M.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.size == 0 for r in got if r.doc_id in (100, 101, 102))
    rows = M.mixed_rows(odd_docs)
    assert rows.columns == odd_docs.columns and rows.count() == sum(r.copies for r in got)
    assert M.mix(no_docs).collect() == [] and M.mixed_rows(no_docs).count() == 0


def test_no_python_on_the_way(odd_docs):
    assert "Python" not in M.mix(odd_docs)._jdf.queryExecution().toString()


def test_query_is_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(contract.queries()["op6_mixing"](spark, sf), oracle.connect(sf), contract.oracle_sql()["op6_mixing"]) == []
