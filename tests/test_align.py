import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import edit

from runqc.functions import banded, kernels
from runqc.functions import sequence as sq
from runqc.operators import align as A
from runqc.operators import joins

random.seed(11)
dna = lambda n: "".join(random.choice("ACGT") for _ in range(n))


def test_distances_by_hand(rows):
    pairs = [("HELLO", "hello", 0), ("ACGT", "ACTT", 1), ("ACGT", "TCAT", 2), ("ABC", "ABCD", 1), ("ABCD", "ABC", 1)]
    df = rows(pairs, "a string, b string, d int")
    assert df.where(A.edit_distance("a", "b") != F.col("d")).count() == 0
    assert df.select(A.edit_distance("a", "b", 1).alias("x")).agg(F.min("x")).first()[0] == -1


def test_sequence_functions(rows):
    r = rows([("ACGTN", "aaACGTtt", "6mA+5mCG_5hmCG")], "s string, c string, m string").select(
        sq.reverse_complement("s"), sq.core("c"), sq.mod_bitflag("m")).first()
    assert tuple(r) == ("NACGT", "ACGT", 3)
    assert dict(sq.mod_table()) == {0: "non", 1: "6mA", 2: "5mCG_5hmCG", 4: "5mC_5hmC", 8: "4mC_5mC", 16: "5mC",
                                    3: "6mA+5mCG_5hmCG", 5: "6mA+5mC_5hmC", 9: "6mA+4mC_5mC", 17: "6mA+5mC"}


def test_range_join_at_any_width(rows):
    left = [(i, random.randint(0, 5000)) for i in range(300)]
    right = [(j, lo, lo + random.choice([0, 1, 7, 100, 3000])) for j in range(60) for lo in [random.randint(0, 4000)]]
    want = {(i, j) for i, x in left for j, lo, hi in right if lo <= x <= hi}
    got = joins.range_join(rows(left, "i int, x int"), rows(right, "j int, lo int, hi int"), "x", "lo", "hi")
    pairs = [(r.i, r.j) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_range_join_with_hot_values(spark, rows):
    """One experiment and one length hold a third of the rows, which are dealt over many partitions all the same."""
    data = [(i, "hot" if i % 3 == 0 else f"e{i % 7}", 500 if i % 3 == 0 else random.randint(0, 900)) for i in range(9000)]
    ranges = [(e, j, lo, lo + w) for e in ["hot", *(f"e{i}" for i in range(7))] for j, (lo, w) in enumerate([(0, 10), (490, 20), (400, 300), (600, 0)])]
    want = {(i, j) for i, e, x in data for f, j, lo, hi in ranges if e == f and lo <= x <= hi}
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, x in plain.items():
            spark.conf.set(k, x)
        got = joins.range_join(rows(data, "i int, e string, x int"), rows(ranges, "e string, j int, lo int, hi int"), "x", "lo", "hi", ["e"])
        found = got.select("i", "j", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert len(found) == len(want) and {(r.i, r.j) for r in found} == want
    share = Counter(r.part for r in found)
    assert max(share.values()) < len(found) / 8


@pytest.mark.parametrize("block", [4, 1024])
def test_best_reference(rows, monkeypatch, block):
    """Far and near reads, references of all lengths, ties; blocks of few references."""
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "CHUNK", 3 * block)
    refs = [(f"r{i}", dna(random.randint(5, 90)), i) for i in range(25)] + [("dup", "ACGT", 90), ("dup0", "ACGT", 30), ("none", "", 99)]
    reads = [(f"q{i}", dna(random.randint(1, 80))) for i in range(30)] + [("same1", "ACGT"), ("same2", "acgt"), ("empty", "")]
    for i in range(40):
        t = list(random.choice(refs)[1])
        for _ in range(random.randint(0, 8)):
            if t:
                t[random.randrange(len(t))] = random.choice(["A", "", "CG", "T"])
        reads.append((f"n{i}", "".join(t)))
    got = A.best_reference(rows(reads, "id string, seq string"), rows(refs, "ref_id string, ref_seq string, ord bigint")).collect()
    assert len(got) == len(reads)
    for r in got:
        d, _, name = min((edit(r.seq.upper(), s), o, n) for n, s, o in refs)
        assert (r.edit_distance, r.ref_id) == (d, name)


def test_covered_reads_are_not_scanned(rows):
    refs = [(f"r{i}", dna(120), i) for i in range(10)]
    reads = [("near", refs[3][1][:50] + "A" + refs[3][1][52:]), ("far", dna(120))]
    u = A._sequences(rows(reads, "id string, seq string"), "seq")
    r = rows(refs, "ref_id string, s string, ord bigint").withColumn("m", F.length("s"))
    assert {x.ref_id for x in A._within_pieces(u, r).collect()} == {"r3"}


def test_similarity_join_is_exact(rows):
    refs = [dna(random.randint(6, 25)) for _ in range(15)]
    reads = []
    for s in refs:
        for _ in range(4):
            t = list(s)
            for _ in range(random.randint(0, 4)):
                t[random.randrange(len(t))] = random.choice(["A", "", "CG", "T"])
            reads.append("".join(t))
    for k in (1, 2, 3):
        got = A.similarity_join(rows([(x,) for x in reads if x], "seq string"),
                                rows([(f"r{i}", s) for i, s in enumerate(refs)], "ref_id string, ref_seq string"), k)
        want = {(x, f"r{i}", edit(x, s)) for x in set(reads) if x for i, s in enumerate(refs) if edit(x, s) <= k}
        assert {(r.seq, r.ref_id, r.edit_distance) for r in got.collect()} == want


def test_ratio_switch(rows):
    ref, inner = dna(30), dna(20)
    data = [("short", ref, ref), ("long", inner + ref + inner, ref), ("empty", "", ref)]
    got = {r.n: r.d for r in rows(data, "n string, s string, r string").select("n", A.ratio_distance("s", "r").alias("d")).collect()}
    assert got == {"short": 0, "long": 0, "empty": 30}


def classify(rows, reads):
    t = {"A": dna(100), "B": dna(100), "C": dna(150)}
    targets = rows([(k, s, len(s), len(s) - 10, len(s) + 10, i) for i, (k, s) in enumerate(t.items())],
                   "target_id string, target_seq string, expected_length int, range_min int, range_max int, ord int")
    codes = rows([("e", f"barcode0{i}", k) for i, k in enumerate(t)], "experiment string, barcode string, target string")
    data = rows([(n, "e", b, f(t)) for n, b, f in reads], "read_id string, experiment string, barcode string, seq string")
    return {r.read_id: r for r in A.classify_reads(data, codes, targets).collect()}


def test_classification_rules(rows):
    got = classify(rows, [
        ("exact", "barcode02", lambda t: t["C"]), ("swapped", "barcode00", lambda t: t["C"]),
        ("unknown", "barcode77", lambda t: t["A"]), ("tiny", "barcode00", lambda t: "ACGT"),
        ("odd", "barcode00", lambda t: dna(125)), ("several", "barcode00", lambda t: t["A"]),
    ])
    assert (got["exact"].method, got["exact"].edit_distance, got["exact"].confidence) == ("size", 0, "high")
    assert got["swapped"].confidence == "mismatch"
    assert [got[n].method for n in ("unknown", "tiny", "odd")] == ["unknown_barcode", "filtered", "no_size_match"]
    s = got["several"]
    assert (s.method, s.target_id, s.confidence, s.matches_expected, s.candidates) == ("edit_distance", "A", "high", True, ["A", "B"])


def demux_one(seq, kit, flank):
    """Plain restatement of the search rules for one read."""
    if len(seq) < 50:
        return "unclassified", -1
    best, name = 10**9, "unclassified"
    for region in [seq[:150]] + ([seq[-150:]] if len(seq) > 200 else []):
        d, _, e = kernels.locate(flank, [region], "HW")[0]
        window = region[e + 1: e + 31] if d <= 2 else region
        for n, code in kit.items():
            x = kernels.locate(code, [window], "HW")[0][0]
            if x < best:
                best, name = x, n
    return (name if best <= 5 else "unclassified"), best


def test_demultiplexing(rows):
    # A bare read holds no flank within the limit; else the search looks behind a chance match, as it should.
    random.seed(11)
    kit, flank = {f"BC{i}": dna(24) for i in range(4)}, "AAGGTTAA"

    def bare(code):
        while True:
            read = dna(30) + code + dna(60)
            if kernels.locate(flank, [read], "HW")[0][0] > A.FLANK_EDITS:
                return read

    reads = [("none", "ACGT"), ("random", dna(300))]
    for n, code in kit.items():
        reads += [(f"{n}-head", dna(10) + flank + code + dna(80)), (f"{n}-tail", dna(200) + flank + code + dna(20)),
                  (f"{n}-noisy", dna(5) + flank + code[:10] + "T" + code[12:] + dna(60)), (f"{n}-bare", bare(code))]
    got = A.demultiplex(rows(reads, "id string, seq string"), kit, flank).collect()
    for r in got:
        assert (r.barcode, r.barcode_edits) == demux_one(r.seq, kit, flank), r.id
    assert all(r.barcode == r.id[:3] for r in got if r.id.endswith(("head", "tail", "bare")))


def test_error_profile_by_brute_force(rows):
    refs = [("r0", dna(20), 0), ("r1", dna(25), 1)]
    reads = []
    for i in range(30):
        s = list(random.choice(refs)[1])
        s[random.randrange(len(s))] = random.choice(["A", "C", "", "GT"])
        s = "".join(s)
        reads.append((f"q{i}", s, "".join(chr(33 + random.randint(5, 40)) for _ in s)))
    got = A.error_profile(rows(reads, "read_id string, seq string, qual string"), rows(refs, "ref_id string, ref_seq string, ord bigint"))
    want, gaps = {}, {}
    for _, s, q in reads:
        name, ref = min((edit(s, f), o, n, f) for n, f, o in refs)[2:]
        i = j = 0
        for op in banded.letters(banded.paths([s], [ref])[0]):
            gaps[op] = gaps.get(op, 0) + 1
            if op in "=X":
                want.setdefault((name, j), []).append((ord(q[i]) - 33, op == "="))
            i += op != "D"
            j += op != "I"
    rows_ = got.collect()
    assert {(r.ref_id, r.ref_pos) for r in rows_} == set(want)
    assert (sum(r.count_deleted for r in rows_), sum(r.count_inserted for r in rows_)) == (gaps.get("D", 0), gaps.get("I", 0))
    for r in rows_:
        x = want[r.ref_id, r.ref_pos]
        assert (r.n, r.count_correct) == (len(x), sum(ok for _, ok in x))
        assert r.empirical_error_rate == pytest.approx(1 - r.count_correct / r.n)
        assert r.predicted_error_rate == pytest.approx(sum(10 ** (-q / 10) for q, _ in x) / len(x))


def test_distance_matrix(rows):
    got = A.distance_columns(rows([("ACGT",)], "seq string"), {"a": "ACGA", "b": "AC"}).first().asDict()
    assert got == {"seq": "ACGT", "a": 1, "b": 2}


def test_few_references_are_held_against_all_reads_at_once(rows):
    """No windows of reads are spelt out where one block holds the references, and chunks are few."""
    refs = [(f"r{i}", dna(40), i) for i in range(10)]
    reads = [(dna(40),) for _ in range(3000)]
    u = A._sequences(rows(reads, "seq string"), "seq")
    r = rows(refs, "ref_id string, s string, ord bigint").withColumn("m", F.length("s"))
    got = A._scanned(u, r, u)
    chunks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert got.count() == 3000 and chunks == 1


def test_a_kit_is_searched_at_once(rows, monkeypatch):
    kit = {f"BC{i}": dna(24) for i in range(60)}
    reads = [(str(i), dna(random.choice([40, 60, 180, 250]))) for i in range(40)]
    want = {i: demux_one(s, kit, "AAGGTTAA") for i, s in reads}
    got = A.demultiplex(rows(reads, "id string, seq string"), kit, "AAGGTTAA").collect()
    assert {r.id: (r.barcode, r.barcode_edits) for r in got} == want
    calls, step = [], kernels.step
    monkeypatch.setattr(kernels, "step", lambda *a: calls.append(1) or step(*a))
    kernels.Panel(list(kit.values())).infixes([s[:30] for _, s in reads])
    assert len(calls) <= 30


def test_error_profile_counts_bases_without_quality(rows):
    """Reads of one text with whole, short, long and no qualities."""
    refs = rows([("r0", "ACGTAC", 0), ("r1", "TTTTTTTTT", 1)], "ref_id string, ref_seq string, ord bigint")
    reads = rows([("a", "ACGTAC", "++++++"), ("b", "ACGTAC", "++"), ("c", "acgtac", None), ("d", "ACTTAC", "5555555555"), ("e", None, "++")],
                 "read_id string, seq string, qual string")
    got = {r.ref_pos: r for r in A.error_profile(reads, refs).collect() if r.ref_id == "r0"}
    assert [(got[i].n, got[i].count_correct, got[i].count_incorrect) for i in range(6)] == [(4, 4, 0)] * 2 + [(4, 3, 1)] + [(4, 4, 0)] * 3
    assert got[5].predicted_error_rate == pytest.approx((10 ** -1 + 10 ** -2) / 2)
    assert got[2].mean_qscore_incorrect == pytest.approx(20) and got[0].mean_qscore_incorrect is None


def test_error_profile_counts_many_batches_at_once(monkeypatch):
    """A thousand reads in batches of ten take as many steps as in one batch, and no more bases are held than are counted at once."""
    import pandas as pd
    import pyarrow as pa

    reads = pd.DataFrame({"seq": [dna(random.randint(20, 30)) for _ in range(1000)], "qual": "+" * 25, "ref_id": "r0", "ref_seq": dna(25)})
    reads["edit_distance"] = [edit(a, b) for a, b in zip(reads.seq, reads.ref_seq)]
    table = pa.Table.from_pandas(reads, preserve_index=False)
    steps, step, sizes, tallied = [], kernels.step, [], A._tallied
    monkeypatch.setattr(kernels, "step", lambda *a: steps.append(1) or step(*a))
    monkeypatch.setattr(A, "_tallied", lambda x: sizes.append(int(x.seq.str.len().sum())) or tallied(x))
    total = lambda size: pd.concat([b.to_pandas() for b in A._profiled(iter(table.to_batches(max_chunksize=size)))]).groupby("ref_pos").sum(numeric_only=True)
    want = total(1000)
    whole = len(steps)
    assert np.allclose(total(10), want) and len(steps) == 2 * whole
    monkeypatch.setattr(A, "PROFILE_BASES", 3000)
    sizes.clear()
    assert np.allclose(total(10), want) and np.allclose(total(1000), want) and max(sizes) <= 3000 + 30


@pytest.mark.parametrize("far", ["", "\U0001F9EC\u0416"])
def test_paths_of_other_letters(far):
    """Letters that only one side has, also beyond the first plane."""
    pairs = [(dna(random.randint(0, 90)) + far, far[::-1] + dna(random.randint(0, 90)) + "N") for _ in range(40)] + [("", "AC"), ("AC", ""), ("", "")]
    for (q, t), ops in zip(pairs, banded.paths(*zip(*pairs))):
        assert ((ops != banded.DELETE).sum(), (ops != banded.INSERT).sum()) == (len(q), len(t))
        assert int((ops != banded.SAME).sum()) == edit(q, t)
        i = j = 0
        for op in ops.tolist():
            if op in (banded.SAME, banded.OTHER):
                assert (q[i] == t[j]) == (op == banded.SAME)
            i += op != banded.DELETE
            j += op != banded.INSERT


def test_barcode_summary_works_out_its_columns_once(rows):
    data = rows([(f"b{i % 2}", i, i % 7, float(i % 11), "in_range", "signal_positive") for i in range(40)],
                "barcode string, length int, ed int, qscore double, size_class string, end_reason string")
    calls = data.sparkSession.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            calls.add(len(pdf))
            yield pdf

    got = {r.barcode: r for r in A.barcode_summary(data.mapInPandas(count, data.schema)).collect()}
    assert calls.value == 40 and got["b0"].n == 20 and got["b0"].median_length == 19 and got["b1"].median_length == 20
