import random

import numpy as np
import pytest

from runqc.llm import lines as L


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain(docs):
    """Dropped line numbers per document, each line against all earlier ones."""
    seen, dropped = [], [[] for _ in docs]
    order = sorted((i if i is not None else 2**63, k, n, t) for k, (i, text) in enumerate(docs) for n, t in enumerate(L.lines_of(text)))
    for _, k, n, t in order:
        if t.strip():
            if any(t == s or min(len(s), len(t)) >= L.LEAST_LENGTH and one_edit(s, t) for s in seen):
                dropped[k].append(n)
            seen.append(t)
    return dropped


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (3, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 200)]

    def changed(s):
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + rng.choice("abx") + s[i:], s[:i] + s[i + 1:] or "q", s[:i] + rng.choice("abx") + s[i + 1:]])
        return s

    docs = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.85 else rng.choice(["", "  ", base[5]]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    return docs + [(200, None), (201, ""), (None, docs[5][1]), (202, base[7] + "\n" + base[7]), (203, "x" * 50_000 + "\n" + "x" * 49_999)]


@pytest.mark.parametrize("crowded", [16, 1])
def test_lines_against_all_earlier_ones(spark, monkeypatch, crowded):
    monkeypatch.setattr(L, "CROWDED", crowded)
    docs = made(crowded)
    got = L.line_decisions(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), keep=True).collect()
    want = dict(zip(docs, plain(docs)))
    assert len(got) == len(docs)
    for r in got:
        assert list(r.dropped) == want[(r.doc_id, r.doc.text)]
        assert r.n_lines == len(L.lines_of(r.doc.text)) and r.n_kept == r.n_lines - len(r.dropped)


def test_wanted_texts_are_joined_when_they_are_many(spark, monkeypatch):
    docs = made(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    few = sorted(map(str, L.line_decisions(frame).collect()))
    monkeypatch.setattr(L, "LISTED", 1)
    assert sorted(map(str, L.line_decisions(frame).collect())) == few


def test_texts_lose_the_lines(odd_docs, no_docs):
    out = L.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    repeated = [r.text for r in out.where("doc_id = 3").collect()]
    assert len(repeated) == 3 and sum(bool(t) for t in repeated) == 1
    assert [r.text for r in out.where("doc_id in (100, 101)").orderBy("doc_id").collect()] == [None, ""]
    assert L.line_decisions(no_docs).collect() == []


@pytest.mark.parametrize("group", [4096, 30])
def test_crowded_lines_make_few_rows(spark, monkeypatch, group):
    """Many lines within a stretch of one another: those of a key are cut again in a task, or as a dozen rows a line."""
    made, written = {}, L.written

    def kept(df, name):
        out = written(df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(L, "written", kept)
    monkeypatch.setattr(L, "GROUP", group)
    rng = random.Random(group)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = []
    for _ in range(150):
        line = base
        for _ in range(rng.choice([1, 1, 2, 3])):
            i = rng.randrange(200, 240)
            line = rng.choice([line[:i] + rng.choice("xyz") + line[i:], line[:i] + line[i + 1:], line[:i] + rng.choice("xyz") + line[i + 1:]])
        texts.append(line)
    docs = [(i, "\n".join(texts[3 * i:3 * i + 3])) for i in range(50)]
    got = L.line_decisions(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), keep=True).collect()
    want = dict(zip(docs, plain(docs)))
    assert all(list(r.dropped) == want[(r.doc_id, r.doc.text)] for r in got) and len(got) == 50
    assert 0 < sum(len(r.dropped) for r in got) < 150
    finer = [t.count() for t in made.get("line-finer", [])]
    assert not finer if group == 4096 else finer and sum(finer) < 150 * 100
    for _ in range(20):
        lines = list({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(60)})
        near = L.near_in_group(lines, np.arange(len(lines)))
        assert list(near) == [any(one_edit(s, t) for s in lines[:k]) for k, t in enumerate(lines)]
