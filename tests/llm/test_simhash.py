import random

import pytest
import xxhash

from runqc.llm import simhash as S


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits):
    """Least index reachable over links, by union of all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_that_of_plain_code():
    for text in (None, "", " \n", "one", "One two", "a b c", "A  b\tc d\ne f g", "x\xa0y é　z w", "the of and " * 50):
        assert S.fingerprint(text, 3) & (2**64 - 1) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowded", [64, 2, 0])
def test_links_give_all_components(spark, crowded):
    rng = random.Random(crowded)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for centre in list(fps)[:6]:
        fps |= {flip(centre, rng.randrange(1, 5)) for _ in range(15)}
    half = rng.getrandbits(32)
    fps |= {half << 32 | rng.getrandbits(3) for _ in range(20)} | {rng.getrandbits(3) << 32 | half for _ in range(20)}
    fps = sorted(fps, key=signed)
    edges = S.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2, crowded).collect()
    assert all((e.a ^ e.b).bit_count() <= 2 or ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    found = {r.node: r.root for r in S.components(S.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2, crowded)).collect()}
    want = roots(fps, 2)
    for i, x in enumerate(fps):
        assert found.get(signed(x), signed(x)) == signed(fps[want[i]])


def test_four_bits(spark):
    rng = random.Random(9)
    fps = sorted({(rng.getrandbits(64) & 0xFFF) | 0xABC << 50 for _ in range(40)}, key=signed)
    found = {r.node: r.root for r in S.components(S.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 4, 8)).collect()}
    for i, r in enumerate(roots(fps, 4)):
        assert found.get(signed(fps[i]), signed(fps[i])) == signed(fps[r])
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_near_duplicates_of_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = [(i, f"{f:016x}", order[r][0]) for (i, f), r in zip(order, roots([f for _, f in order], 2))]
    got = S.near_duplicates(odd_docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert S.near_duplicates(no_docs).collect() == []


def plain_kept(rows):
    """Rows that stay when both rules are applied to all pairs: two bits of the fingerprints, or sets of five words."""
    texts = sorted({t for _, t in rows}, key=str)
    fps = {t: plain_fingerprint(t) for t in texts}
    words = {t: S.lower_words(t) for t in texts}
    sets = {t: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for t, w in words.items()}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            similar = sets[a] and sets[b] and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both)
            if similar or (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    first = {}
    for doc_id, t in rows:
        first.setdefault(find(t), set()).add((doc_id is None, doc_id or 0))
    return sorted((min(x)[1] if not min(x)[0] else None for x in first.values()), key=str)


def test_one_row_of_each_group_stays(odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == plain_kept([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("least, most", [(2, 5), (4, 9)])
def test_large_group_of_near_copies(spark, least, most):
    """Copies of one text with some words changed, dense and sparse around the bound: all pairs decide."""
    rng = random.Random(most)
    words = [f"w{i}" for i in range(4000)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for i in range(500):
        copy = list(base)
        for _ in range(rng.randint(least, most)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[i:i + 60])) for i in range(80)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == plain_kept(rows)


def test_rows_without_or_with_shared_ids_are_decided_by_their_group(spark):
    rng = random.Random(5)
    text = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 5) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (1, text[3]), (7, text[3]), (7, text[4]), (7, text[5]), (None, text[5])]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (1, text[3]), (7, text[4]), (7, text[5])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("crowded", [32, 0])
def test_copies_with_changed_words_go_and_other_texts_stay(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CROWDED_BAND", crowded)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sets = lambda t: {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(60, 200))]
        near = base[:30] + [word()] + base[31:]  # five shingles of at least 56 differ
        far = base[:10] + [word()] + base[11:20] + [word()] + base[21:30] + [word()] + base[31:60]  # 15 of 56
        rows += [(i, base), (100 + i, near), (200 + i, far)]
        assert len(sets(base) & sets(near)) >= 0.8 * len(sets(base) | sets(near)) and len(sets(base) & sets(far)) < 0.7 * len(sets(base) | sets(far))
    fps = {i: plain_fingerprint(" ".join(t)) for i, t in rows}
    assert sum((fps[i] ^ fps[100 + i]).bit_count() > 2 for i in range(60)) > 40
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [*range(60), *range(200, 260)]


def test_similarity_is_that_of_plain_sets():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 40))] for _ in range(2))
        plain = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in (a, b)]
        found = [S.shingle_set(" ".join(t), 5) for t in (a, b)]
        if min(len(a), len(b)) >= 5:
            assert S.similarity(*found) == len(plain[0] & plain[1]) / len(plain[0] | plain[1])
