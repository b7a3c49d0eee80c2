import math
import zlib
from collections import Counter

import numpy as np

from runqc.llm import lm


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def base_scores(rows):
    learn = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    c = Counter(w for t in learn for w in words(t))
    n, v = sum(c.values()) + len(learn), len(c) + bool(learn)
    one = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return {(i, t): (len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + bool(learn), n, sum(one(c[w]) for w in words(t)) + one(len(learn))) for i, t in rows}


def test_base_scores_and_odd_documents(odd_docs, no_docs, monkeypatch):
    for common in (lm.COMMON_WORDS, 3):
        monkeypatch.setattr(lm, "COMMON_WORDS", common)
        want = base_scores([(r.doc_id, r.text) for r in odd_docs.collect()])
        rows = lm.scores(odd_docs).collect()
        assert len(rows) == odd_docs.count()
        left = Counter((str(i), n, k, t) for (i, _), (n, k, t, _) in want.items())
        assert {(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in rows} == set(left)
        by_id = {}
        for (i, _), w in want.items():
            by_id.setdefault(str(i), []).append(w[3])
        for r in rows:
            assert any(abs(r.base_score - b) < 1e-6 * abs(b) for b in by_id[str(r.doc_id)])
            assert math.isfinite(r.score) and r.score < 0 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0)
    assert lm.scores(no_docs).collect() == []


def small_mixer():
    text = "the cat sat on the mat and the dog sat on the log " * 40
    trees = lm.Trees([text])
    symbols, counts = lm.Symbols(lm.pieces_of(text)), [np.zeros((1 << b, 2)) for b in lm.SLOT_BITS]
    for _, _, bits, slots in lm.levels(*symbols.codes(trees), symbols.contexts()):
        for c, s in zip(counts, slots):
            np.add.at(c, (s, bits), 1)
    tables = [np.clip(np.round(lm.SCALE * np.log((c[:, 1] + 0.3) / (c[:, 0] + 0.3))), -127, 127).astype(np.int8) for c in counts]
    return lm.Mixer(trees, tables)


def test_codes_are_whole_trees():
    for texts in ([], [None, ""], ["abra kadabra " * 500, "éàü" * 50]):
        trees = lm.Trees(texts)
        lengths = trees.length.reshape(-1, 257)
        assert np.allclose((2.0 ** -lengths).sum(1), 1) and lengths.max() < 31 and lengths.min() > 0
    lengths, _ = lm._huffman(2.0 ** np.arange(257).clip(0, 60))
    assert lengths.max() < 31


def test_probabilities_of_all_continuations_sum_to_one():
    mixer = small_mixer().fitted(["the dog sat on the mat"])
    before = b"the cat s"
    after = [(b"", before + bytes([b]), False) for b in range(256)] + [(b"", before, True)]
    log_p = mixer.score(after)[0] - mixer.score([(b"", before, False)])[0]
    assert abs(np.exp(log_p).sum() - 1) < 1e-3


def test_score_depends_on_the_text_alone_and_pieces_add_up(monkeypatch):
    mixer = small_mixer()
    long = "the cat sat on a log and " * 400
    alone = mixer.log10_many([long])[0][0]
    together, sizes = mixer.log10_many(["x", long, None, "the mat", long, ""])
    assert sizes == [1, len(long) - 1, 0, 7, len(long) - 1, 0]
    assert abs(together[1] - alone) < 1e-3 and abs(together[4] - alone) < 1e-3 and together[2] == together[5]
    assert alone / len(long) > mixer.log10_many(["zq xj vvk qqz " * 100])[0][0] / 1400
    monkeypatch.setattr(lm, "PIECE", 4096)
    assert abs(mixer.log10_many([long])[0][0] / alone - 1) < 0.02


def test_trees_tables_and_weights_come_from_all_texts(spark):
    """Long texts (over 20,000 characters) and all of many short ones count; no bit of any is left out."""
    texts = ["the cat sat on the mat and the dog sat on the log " * 900, None, ""] + [f"cat {i} sat on log {i % 7}" for i in range(2500)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen, n = lm.tree_counts(frame)
    trees, plain = lm.Trees.counted(seen, n), lm.Trees(texts)
    assert np.array_equal(trees.length, plain.length) and np.array_equal(trees.code, plain.code) and np.array_equal(trees.row, plain.row)
    whole = lm.Symbols([p for t in texts for p in lm.pieces_of(t)])
    assert n.sum() == len(whole.symbol)
    tables, without = lm.slot_log_odds(frame, trees)
    counts = lm.mixed_counts(frame, trees, without)
    assert counts.sum() == whole.codes(trees)[0].sum()
    slots = [np.zeros((len(t), 2)) for t in tables]
    for _, _, bits, found in lm.levels(*whole.codes(trees), whole.contexts()):
        for c, s in zip(slots, found):
            np.add.at(c, (s, bits), 1)
    for c, t, w in zip(slots, tables, without):
        assert np.array_equal(t, lm._odds(c[:, 1], c[:, 0]))
        assert np.array_equal(w[1::2], lm._odds(np.maximum(c[:, 1] - 1, 0), c[:, 0]))
    # The weights lose less than those they start from on every gate's counted bits, the others left out.
    start, cells = lm.Mixer(trees, tables).weights, 1 << lm.FIT_BITS
    step = 256 // cells
    at = (np.stack(np.unravel_index(np.arange(cells**3), (cells,) * 3), 1) * step - 128 + (step - 1) / 2) / lm.SCALE
    loss = lambda w, c: float((c[:, 0] * np.logaddexp(0, at @ w[:3] + w[3]) + c[:, 1] * np.logaddexp(0, -(at @ w[:3] + w[3]))).sum())
    fitted = lm.fitted_weights(counts, start)
    assert all(loss(f, c) < loss(w, c) for f, w, c in zip(fitted, start, counts) if c.sum() > 1000) and counts[0].sum() > 1000


def test_tables_are_read_once_a_stretch_not_once_a_block(monkeypatch):
    """Scores agree with a plain computation block by block, and all blocks of a batch share one pass through the tables."""
    mixer = small_mixer()
    text = "the cat sat on a log and the dog sat by the mat " * 300
    [piece] = lm.pieces_of(text)
    symbols, factors, want = lm.Symbols([piece]), np.ones(lm.GATES), 0.0
    block, (length, code), contexts = lm.BLOCKS[symbols.place], symbols.codes(mixer.trees), symbols.contexts()
    for b in np.unique(block):
        of, step, seen = block == b, np.zeros(lm.GATES), np.full(lm.GATES, 256.0)
        for depth, _, bits, slots in lm.levels(length[of], code[of], [c[of] for c in contexts]):
            gate = min(depth, lm.GATES - 1)
            x = [t[s].astype(float) / lm.SCALE for t, s in zip(mixer.tables, slots)]
            against = (1 - 2 * bits) * (np.stack([*x, np.ones(len(bits))], 1) @ mixer.weights[gate])
            odds = np.exp(np.minimum(factors[gate] * against, 30))
            want -= np.log(1 + odds).sum()
            step[gate] += ((1 / (1 + odds) - 1) * against).sum()
            seen[gate] += len(bits)
        factors = factors + lm.REFINE * step / seen
    called, levels = [], lm.levels

    def counted(*given):
        called.append(len(given[0]))
        return levels(*given)

    monkeypatch.setattr(lm, "levels", counted)
    got, after = mixer.score([piece])
    assert abs(got[0] / want - 1) < 1e-5 and np.allclose(after[0], factors, atol=1e-4)
    assert len(np.unique(block)) > 20 and len(called) == 1 and called[0] == len(block)
    # Every stretch is counted on its own, and none is left out.
    monkeypatch.setattr(lm, "STRETCH", 1000)
    assert np.allclose(mixer.score([piece])[0], got, rtol=1e-6)
