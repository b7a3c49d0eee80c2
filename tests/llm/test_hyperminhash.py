import random

import numpy as np
import pytest

from runqc.llm import hyperminhash as H
from runqc.llm.common import components
from runqc.llm.common import lower_words


def plain(rows, similar=(85, 100)):
    """{row number: (n, component)} by comparing all pairs of sets. ``rows``: (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = lower_words(text)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    classes = list({s for s in sets if s})
    root = {s: s for s in classes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(classes):
        for b in classes[:i]:
            both = len(a & b)
            if similar[1] * both >= similar[0] * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s:
            least[find(s)] = min(least.get(find(s), H.NO_ID), H.NO_ID if doc_id is None else doc_id)
    named = lambda i: None if i == H.NO_ID else i
    out = []
    for (doc_id, _), s in zip(rows, sets):
        component = named(least[find(s)]) if s else doc_id
        out.append((doc_id, len(s), component, doc_id is not None and doc_id == component))
    return sorted(out, key=str)


def found(docs):
    got = H.near_copies(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert found(odd_docs) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert found(no_docs) == []


@pytest.mark.parametrize("most", [3, 12])
def test_large_group_of_near_copies(spark, most):
    """700 copies of one text with up to ``most`` words changed, dense or sparse around the bound, among other texts."""
    rng = random.Random(most)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    rows += [(2000 + i, " ".join(base[i:i + 100])) for i in range(60)]
    rows += [(3000 + i, rows[i % 5][1]) for i in range(300)]
    want = plain(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_short_sets_around_the_bound(spark):
    """Sets of 6 to 12 shingles, where one word decides."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(10, 17))]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base + ["more"])), (3 * i + 2, " ".join(["two", "more"] + base))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("n, overlap", [(3000, 0.85), (400, 0.6), (100, 0.9), (20_000, 0.0)])
def test_estimates_are_corrected(n, overlap):
    """The mean over many pairs is within a hundredth, and collisions are as often as said."""
    rng, near, equal = np.random.default_rng(n), [], []
    both = round(2 * n * overlap / (1 + overlap))
    for _ in range(60):
        h = np.unique(rng.integers(0, 2**64, 2 * n - both, np.uint64))
        a, b = np.sort(rng.permutation(h)[:n]), None
        b = np.sort(np.r_[rng.permutation(a)[:both], np.setdiff1d(h, a)])
        one, two = H.registers(a), H.registers(b)
        near.append(H.estimated(one[None], two[None], np.array([n]), np.array([len(b)]))[0])
        equal.append((one == two).mean())
    assert abs(np.mean(near) - overlap) < 0.01
    if not overlap:
        assert abs(np.mean(equal) - H.collision(n, n)) < 0.002


def test_sketch_of_one_hash():
    one = H.registers(np.array([2**63 + 12345], np.uint64))
    assert len(set(one.tolist())) == 1
    assert (H.registers(np.array([0], np.uint64)) >> H.MANTISSA == 56).all()


def test_groups_that_leaders_connect_are_not_enumerated(spark, monkeypatch):
    """Shingles are listed only for crowded keys that are of several components after the first round; each pair is one row."""
    made, written = {}, H.written

    def kept(df, name):
        out = written(df, name)
        made.setdefault(name, out)
        return out

    monkeypatch.setattr(H, "written", kept)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i in range(80) for k in [rng.randrange(300)]]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert made["hyperminhash-shingles"].count() == 0
    pairs = made["hyperminhash-candidates"]
    assert 0 < pairs.count() == pairs.distinct().count() < 80 * 79 // 2 and pairs.where("a >= b").count() == 0


def test_rounds_shuffle_only_the_sets_of_their_pairs(spark, monkeypatch):
    """Sketches and sets of nodes without a pair are left out before the shuffles, so rounds with few pairs move little."""
    plans, written = {}, H.written

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(H, "written", kept)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:7 * i] + [f"x{i}"] + base[7 * i + 1:])) for i in range(8)] + [(50 + i, f"other {i} words of its own") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for sent, few in ((H.SENT, True), (0, False)):
        monkeypatch.setattr(H, "SENT", sent)
        plans.clear()
        assert found(docs) == want
        for name, sides in (("hyperminhash-pairs", 2), ("hyperminhash-links", 2), ("hyperminhash-wanted", 1)):
            assert all((p.count("LeftSemi, ") == sides and p.count("strategy=broadcast") == sides) == few for p in plans[name]), plans[name][0]


def test_rounds_leave_files_by_their_rows(spark, monkeypatch):
    """Links of a few texts are worked out in a few tasks, however many partitions a shuffle has."""
    files, written = {}, H.written

    def kept(df, name):
        out = written(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(H, "written", kept)
    monkeypatch.setattr(H, "CROWDED", 2)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] * i + base[k + 1:])) for i in range(24) for k in [rng.randrange(200)]]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("16", "false")):
            spark.conf.set(k, v)
        roots = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
        assert roots.where("root = 0").count() == 40 and roots.rdd.getNumPartitions() <= 2
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rounds = {k: max(files[f"hyperminhash-{k}"]) for k in ("members", "leaders", "candidates", "pairs", "links")}
    assert max(rounds.values()) <= 2, rounds


def test_parities_bound_what_sets_differ_in():
    rng = np.random.default_rng(3)
    for n in (1, 9, 140, 3000):
        a = rng.integers(0, 2**64, n, np.uint64)
        b = np.unique(np.r_[a[n // 8:], rng.integers(0, 2**64, n // 6, np.uint64)])
        differ = np.bitwise_count((H.parities(a) ^ H.parities(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b)) and (n != 140 or differ > 25) and not (H.parities(a) ^ H.parities(a[::-1])).any()


def test_copies_below_the_bound_do_not_become_pairs(spark, monkeypatch):
    made, written = [], H.written

    def kept(df, name):
        out = written(df, name)
        made.extend([out.count()] if name == "hyperminhash-candidates" else [])
        return out

    monkeypatch.setattr(H, "written", kept)
    rng = random.Random(21)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(0, 150, 5), 4):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert sum(made) < 300
