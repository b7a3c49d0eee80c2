"""Distances of many pairs as bits, against cell by cell ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import edit

from runqc.functions import kernels, lanes
from runqc.operators import align as A

random.seed(17)
dna = lambda n: "".join(random.choice("ACGT") for _ in range(n))


def near(text, edits):
    t = list(text)
    for _ in range(edits):
        if t:
            t[random.randrange(len(t))] = random.choice(["A", "", "CG", "T"])
    return "".join(t)


def coded(alphabet, texts):
    block, lengths = kernels._codes(texts)
    return kernels.coded(alphabet, block), lengths


def test_distances_are_exact_up_to_the_bound_and_never_too_small():
    refs = sorted([dna(random.randint(0, 40)) for _ in range(6)] + ["ACGT", ""], key=len)
    reads = sorted([dna(random.randint(0, 45)) for _ in range(70)] + [near(random.choice(refs), 3) for _ in range(60)] + ["ANNNT", ""], key=len)
    alphabet = np.array(sorted(map(ord, "ACGT")), np.uint32)
    block = lanes.Lanes(*coded(alphabet, reads), len(alphabet))
    codes, m = coded(alphabet, refs)
    want = np.array([[edit(r, f) for r in reads] for f in refs])
    for k in (0, 2, 9, 20, 100):
        got = block.distances(codes, m, k)
        assert (got >= want).all() and (got[want <= k] == want[want <= k]).all()


@pytest.mark.parametrize("short, few, first", [(1 << 15, 2048, 32), (30, 25, 2), (200, 60, 4)])
def test_closest_reads_of_all_lengths(monkeypatch, short, few, first):
    """Near, far and repetitive reads, letters that no reference has; reads and references beyond what lanes take."""
    monkeypatch.setattr(kernels, "SHORT", short)
    monkeypatch.setattr(kernels, "SHORT_REF", few)
    monkeypatch.setattr(lanes, "FIRST", first)
    refs = [dna(random.randint(2, 70)) for _ in range(25)] + ["ACGT", "ACGT", "", "A" * 40]
    reads = [dna(random.randint(0, 80)) for _ in range(60)] + [near(random.choice(refs), random.randint(0, 6)) for _ in range(60)]
    reads += ["", "N" * 33, "A" * 38, "acgt", dna(260), dna(150), dna(151)]
    which, d = kernels.Panel(refs).closest(reads)
    for i, r in enumerate(reads):
        assert (d[i], which[i]) == min((edit(r, f), j) for j, f in enumerate(refs))


def test_many_reads_take_few_vector_steps(monkeypatch):
    """All pairs of 2,000 reads and 200 references: a word holds 64 pairs of a cell, and cells off the band are not filled."""
    refs, reads = [dna(60) for _ in range(200)], [dna(60) for _ in range(2000)]
    words = []
    plain, bits = kernels.Panel._table, lanes.Lanes.distances
    monkeypatch.setattr(kernels.Panel, "_table", lambda self, c, n, members, peq: words.append(int(n.sum()) * len(members) * len(peq)) or plain(self, c, n, members, peq))
    monkeypatch.setattr(lanes.Lanes, "distances", lambda self, c, m, k: words.append(self.words * int(m.sum()) * min(k + 1, 2 * 60)) or bits(self, c, m, k))
    kernels.Panel(refs).closest(reads)
    # Before: a word for each base of each pair, of which each took some seventeen operations; now nine or ten.
    assert sum(words) < 0.9 * len(refs) * len(reads) * 60


def test_best_reference_works_out_its_reads_twice(rows):
    """Once for the distinct sequences, once for the rows."""
    data = rows([(f"q{i}", dna(30)) for i in range(50)] + [("none", None)], "id string, seq string")
    calls = data.sparkSession.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            calls.add(len(pdf))
            yield pdf

    refs = rows([(f"r{i}", dna(30), i) for i in range(5)], "ref_id string, ref_seq string, ord bigint")
    got = A.best_reference(data.mapInPandas(count, data.schema), refs)
    assert got.where(F.col("seq").isNotNull()).count() == 50 and got.count() == 50
    calls.value = 0
    A.best_reference(data.mapInPandas(count, data.schema), refs).collect()
    assert calls.value == 2 * 51
