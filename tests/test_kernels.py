import tracemalloc

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from runqc.functions import banded as B
from runqc.functions import kernels as K

dna = lambda lo, hi: st.text("ACGT", min_size=lo, max_size=hi)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(dna(1, 10), st.lists(dna(0, 25), min_size=1, max_size=5))
def test_infix_and_prefix(query, targets):
    for mode in ("HW", "SHW"):
        for target, (d, s, e) in zip(targets, K.locate(query, targets, mode)):
            spans = [target[i:j] for i in range(len(target) + 1) for j in range(i, len(target) + 1) if mode == "HW" or i == 0]
            assert d == min(edit(query, x) for x in spans)
            assert edit(query, target[s: e + 1]) == d


def full_table(query, target):
    """The path from the whole table: the diagonal first, then the query's base, then the target's, read from the end."""
    table = [list(range(len(target) + 1))]
    for i, c in enumerate(query, 1):
        row = [i]
        for j, d in enumerate(target, 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (c != d)))
        table.append(row)
    ops, i, j = [], len(query), len(target)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (query[i - 1] != target[j - 1]):
            ops.append("=" if query[i - 1] == target[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return "".join(reversed(ops))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dna(0, 24), dna(0, 24)), min_size=1, max_size=8), st.booleans(), st.sampled_from([30, 300, B.CELLS]))
def test_banded_paths_are_those_of_the_whole_table(pairs, known, cells):
    """With and without the distance, in one block, in many, and traced back part by part."""
    before, B.CELLS = B.CELLS, cells
    try:
        found = B.paths([a for a, _ in pairs], [b for _, b in pairs], [edit(a, b) for a, b in pairs] if known else None)
    finally:
        B.CELLS = before
    assert [B.letters(ops) for ops in found] == [full_table(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(dna(0, 20), dna(0, 20))
def test_positions(a, b):
    ops = B.paths([a], [b])[0]
    at, deleted, inserted = B.positions(ops)
    assert len(at) == len(a) and sum(at != 0) + len(deleted) == len(b) and sum(at == 0) == len(inserted)
    assert all(a[i] == b[p - 1] for i, p in enumerate(at) if p > 0) and all(a[i] != b[-p - 1] for i, p in enumerate(at) if p < 0)
    assert sorted([abs(p) - 1 for p in at if p] + list(deleted)) == list(range(len(b)))


def test_long_pairs_in_little_memory():
    rng = np.random.default_rng(1)
    a = rng.choice(list("ACGT"), 30_000)
    b = [c for i, c in enumerate(a) if i % 997] + ["A"] * 40
    for i in range(0, len(b), 401):
        b[i] = "N"
    tracemalloc.start()
    ops = B.paths(["".join(a)], ["".join(b)])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # the whole table would have 3.6 GB
    assert (ops != B.DELETE).sum() == len(a) and (ops != B.INSERT).sum() == len(b) and 80 < (ops != B.SAME).sum() < 160


@settings(max_examples=25, deadline=None)
@given(st.lists(dna(0, 140), min_size=1, max_size=6), st.lists(st.text("ACGTN", max_size=150), min_size=1, max_size=6))
def test_panel_distances(refs, reads):
    reads = sorted(reads, key=len)
    table = K.Panel(refs).distances(reads)
    assert np.array_equal(table, [[edit(r, f) for f in refs] for r in reads])


def test_panel_prefers_the_first_reference():
    which, d = K.Panel(["ACGT", "ACGT", "TTTT"]).closest(["ACGA", "TTTT"])
    assert list(which) == [0, 2] and list(d) == [1, 0]


def test_cigar_text():
    assert [B.cigar(ops) for ops in B.paths(["ACGT", "ACT", "", "", "AC"], ["ACGT", "ACGT", "AC", "", ""])] == ["4=", "2=1D1=", "2D", "", "2I"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dna(0, 70), st.text("ACGTN", max_size=150)), min_size=1, max_size=6), st.sampled_from([1, 9, 512]))
def test_pairs_are_located_together(pairs, piece):
    """Also where long targets are searched in pieces; ``locate`` is the plain version."""
    before, K.PIECE = K.PIECE, piece
    try:
        for mode in ("HW", "SHW"):
            got = K.locate_pairs(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), mode).to_numpy()
            assert np.array_equal(got, [K.locate(a, [b], mode)[0] for a, b in pairs])
    finally:
        K.PIECE = before


def test_distinct_queries_share_their_steps(monkeypatch):
    """500 queries with a target each take as many steps as the longest pair, not as all of them."""
    rng, steps, step = np.random.default_rng(3), [], K.step
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    monkeypatch.setattr(K, "step", lambda *a: steps.append(1) or step(*a))
    monkeypatch.setattr(K, "_final_row", None)
    K.locate_pairs(pd.Series([text(30) for _ in range(500)]), pd.Series([text(60) for _ in range(499)] + [text(20_000)]), "HW")
    assert len(steps) < 2 * (K.PIECE + 3 * 60)


@settings(max_examples=40, deadline=None)
@given(st.lists(dna(0, 140), min_size=1, max_size=30), st.lists(st.text("ACGTN", max_size=300), min_size=1, max_size=8))
def test_closest_is_the_first_of_the_least(refs, reads):
    which, d = K.Panel(refs).closest(reads)
    table = np.array([[edit(r, f) for f in refs] for r in reads])
    assert np.array_equal(which, table.argmin(axis=1)) and np.array_equal(d, table.min(axis=1))


def test_references_of_other_lengths_are_not_tried(monkeypatch):
    rng, tried, table = np.random.default_rng(4), [], K.Panel._table
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    monkeypatch.setattr(K.Panel, "_table", lambda self, codes, *a: tried.append(len(codes) * len(a[1])) or table(self, codes, *a))
    refs, reads = [text(n) for n in range(5, 205)], [text(60) for _ in range(50)]
    which, _ = K.Panel(refs).closest(reads)
    assert sum(tried) < 0.5 * len(refs) * len(reads) and all(25 < len(refs[i]) < 95 for i in which)


def test_infixes_of_a_panel():
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("ACGTN"), n))
    refs, texts = [text(n) for n in (0, 1, 8, 24, 64, 65, 130)], [text(n) for n in (0, 1, 30, 150, 90, 30, 300)]
    d, e = K.Panel(refs).infixes(texts)
    for i, ref in enumerate(refs):
        want = K.locate_ends(ref, texts, "HW")
        assert np.array_equal(d[:, i], want[0]) and np.array_equal(e[:, i], want[1])


def test_paths_do_not_fill_the_band(monkeypatch):
    """A short target against a long read: the band is as wide as the read, the bits as few as the target's."""
    rng = np.random.default_rng(7)
    a, b = "".join(rng.choice(list("ACGT"), 3000)), "".join(rng.choice(list("ACGT"), 70))
    monkeypatch.setattr(B, "_solve", None)
    for q, t in ((a, b), (b, a), (a[:70], b)):
        assert B.letters(B.paths([q], [t])[0]) == full_table(q, t)
