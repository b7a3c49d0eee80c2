import hashlib
import re

import numpy as np
import pytest

from runqc.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "", "a@b.c_x@d.e", "a@@b.c", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1 256.0.0.1 255.255.255.255", "a.b@c-d.e.f.", "@a.b", "é@a.b x@a",
    "00001.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (286) 555-5136, +12, +1234567890123456", "pay 4041894974608795 to me.you@mail.example.com",
    "1" * 3000 + ".2", "9 4111111111111111", "٣٤@x.y ١.٢.٣.٤", "tel+44 20 7946 0958.", "€5 x" * 40,
]


def plain(text):
    def luhn(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def kept(kind, m):
        digits = "".join(c for c in m if c in "0123456789")
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if kept(k, m.group())]


def test_base_spans():
    for t in TEXTS:
        assert P.base_spans(t) == plain(t), t
    assert P.base_spans("7" * 50_000 + " " + "a" * 50_000 + "@") == plain("7" * 50) == []


def windows(n=600):
    rng = np.random.default_rng(3)
    codes, tags = [], []
    for _ in range(n):
        words = ["".join(rng.choice(list("abdehinorst"), rng.integers(2, 8))) for _ in range(9)]
        kind = rng.integers(0, 5)
        digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        if kind < 4:
            words[4] = [f"{words[0]}.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(x) for x in rng.integers(0, 256, 4)), "4111111111111111", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"][kind]
        text = " ".join(words)[:P.TRAIN_LENGTH].ljust(P.TRAIN_LENGTH)
        codes.append(P.encode(text))
        tags.append(P.tags_of(P.base_spans(text), len(text)))
    return np.array(codes), np.array(tags)


def test_gradients():
    codes, tags = windows(8)
    net = P.Network(1)
    run = lambda: net.loss(codes.T.astype(np.int64), tags.T.astype(np.int64))
    _, grad = run()
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, e = net.p[k][at], 1e-2
        net.p[k][at] = was + e
        up = run()[0]
        net.p[k][at] = was - e
        down = run()[0]
        net.p[k][at] = was
        assert abs((up - down) / (2 * e) - g[at]) < 0.02 * abs(g[at]) + 0.05, k


@pytest.fixture(scope="module")
def tagger():
    return P.Tagger(P.train(*windows(), steps=250))


def test_tagger_finds_most_spans_and_little_else(tagger):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abdehinorst"), 5)) for _ in range(200)) for _ in range(20)]
    texts[3] = texts[3][:700] + " 192.168.20.35 " + texts[3][700:]
    texts[7] = texts[7][:470] + " nora.12@mail3.example.com " + texts[7][470:]
    found = tagger.spans(texts)
    assert [i for i, f in enumerate(found) if f] == [3, 7] and found[3][0][0] == "ip" and found[7][0][0] == "email"
    assert tagger.spans([]) == [] and tagger.spans(["", "a"]) == [[], []]


def test_skipped_windows_hold_no_span(tagger):
    codes = windows(60)[0].T.astype(np.int64)
    e, lanes = tagger.emissions(codes)
    tags, _ = tagger.decode(e)
    assert set(np.flatnonzero(tags.any(0))) <= set(lanes)
    a = tagger.a  # Viterbi against the sum over all paths of a short stretch
    short = e[:4, :, 0]
    best = max(np.ndindex(*[P.TAGS] * 4), key=lambda p: sum(short[i, t] for i, t in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:])))
    assert tuple(tagger.decode(e[:4, :, :1])[0][:, 0]) == best


def test_added_spans_are_whole_and_touch_no_base_span():
    class Fixed:
        def spans(self, texts):
            return [[("card", 2, 18), ("phone", 0, 3), ("ip", 0, 2)] for _ in texts]

    (base, every), = P.all_spans(["9 4111111111111111"], Fixed())
    assert base == [] and every == [("card", 2, 18)]
    (base, every), = P.all_spans(["x 4111111111111111"], Fixed())
    assert base == every == [("card", 2, 18)]


def test_odd_documents(spark, odd_docs, no_docs, tagger):
    got = P.find_pii(odd_docs, tagger).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    want = sorted((i, hashlib.sha256(P.joined(plain(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert P.find_pii(no_docs, None).collect() == [] and P.trained_tagger(no_docs) is None
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in P.find_pii(frame, None).collect():
        spans = plain(TEXTS[r.doc_id])
        assert r.spans == P.joined(spans) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in P.KINDS]


def test_training_on_documents(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    codes, tags = P.labelled_windows(frame, "doc_id", "text")
    assert codes.shape == tags.shape and codes.shape[1] == P.TRAIN_LENGTH and tags.any()
