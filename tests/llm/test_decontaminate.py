import random
from collections import Counter

import numpy as np

from runqc.llm import decontaminate as D

RNG = random.Random(2)
VOCABULARY = ["".join(RNG.choice("aeioustrnl") for _ in range(RNG.randrange(2, 8))) for _ in range(900)] + ["the", "of", "and"] * 120


def passage(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def item(n):
    words = passage(n).split()
    return " ".join(words[: 2 * n // 3]).capitalize() + "? " + " ".join(words[2 * n // 3:]) + "."


ITEMS = [(i, item(n)) for i, n in enumerate([12, 20, 35, 60, 64, 65, 130, 200] * 6)] + [(90, None), (91, ""), (92, "?!"), (93, "Word."), (None, item(20))]
DOCS = [(i, passage(RNG.choice([0, 5, 50, 127, 128, 129, 400]))) for i in range(60)]
DOCS += [(100 + i, passage(RNG.randrange(300)) + "\n" + t.upper() + " " + passage(RNG.randrange(300))) for i, t in ITEMS[:48]]
DOCS += [(200, ITEMS[3][1][: len(ITEMS[3][1]) // 2]), (201, None), (202, ""), (203, passage(3000) + " " + ITEMS[2][1])]


def plain():
    """Items whose words occur in a row."""
    padded = lambda t: f" {' '.join(D.words_of(t))} "
    items = [(i, padded(t)) for i, t in ITEMS if i is not None and D.words_of(t)]
    return {(d, i) for d, t in DOCS for i, p in items if p in padded(t)}


def test_found_items_are_those_in_the_texts(spark, monkeypatch):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain() - {(d, 93) for d, _ in DOCS}
    for units in (D.SHARD_UNITS, 20):
        monkeypatch.setattr(D, "SHARD_UNITS", units)
        found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} - {(d, 93) for d, _ in DOCS}
        assert want <= found and all(d >= 100 for d, _ in found)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in D.clean(docs, bench.where("item_id <> 93")).collect()}
    assert gone == {d for d, _ in want}


def test_search_finds_all_above_the_threshold():
    units = [(n, D.words_of(passage(RNG.randrange(3, 60)))) for n in range(150)]
    df = Counter(w for _, ws in units for w in set(ws))
    index = D.BlockMaxIndex(units, df, len(units), sum(len(w) for _, w in units) / len(units))
    for _ in range(120):
        near = units[RNG.randrange(150)][1]
        terms = sorted({RNG.randrange(len(index.ids)) for _ in range(50)} | {index.terms[w] for w in near[: RNG.randrange(len(near))]})
        scores = Counter()
        for t in terms:
            for u, x in zip(index.ids[t], index.impact[t]):
                scores[u] += x
        for threshold in (0.1, 0.3, 0.6):
            assert sorted((u, round(x, 9)) for u, x in index.search(terms, threshold)) == sorted((u, round(x, 9)) for u, x in scores.items() if x >= threshold - 1e-9)


def test_no_passage_with_a_hit_is_given_up():
    items = [(i, t) for i, t in ITEMS if i is not None and D.words_of(t)]
    units = [(n, D.words_of(t)[:D.UNIT]) for n, (_, t) in enumerate(items)]
    df = Counter(w for _, ws in units for w in set(ws))
    index = D.BlockMaxIndex(units, df, len(units), sum(len(w) for _, w in units) / len(units))
    detector = D.Detector(index, dict(enumerate(i for i, _ in items)), {}, 0.5, 0.8, 0.8)
    for _, text in DOCS:
        known = np.array([index.terms.get(w, -1) for w in D.words_of(text)], np.int64)
        if len(known):
            starts = range(0, max(1, len(known) - 64), 64)
            hopeful = set(detector.hopeful(known, len(starts)).tolist())
            for n, s in enumerate(starts):
                terms = sorted({int(t) for t in known[s:s + 128] if t >= 0})
                assert n in hopeful or not index.search(terms, 0.5)


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, odd_docs.where("doc_id = 7").first().text)], "item_id long, text string")
    kept = D.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {7, 105, 106}.isdisjoint(r.doc_id for r in kept.collect())
    assert D.clean(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert D.contaminated(no_docs, bench).collect() == []


def test_clashing_and_missing_item_ids(spark):
    texts = [item(30) for _ in range(5)]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{passage(80)} {t} {passage(80)}") for i, t in enumerate(texts)] + [(9, passage(200))], "doc_id long, text string")
    found = sorted(((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()), key=str)
    assert found == sorted([(0, 1), (1, 1), (2, None), (3, None), (4, 2)], key=str)
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [9]
