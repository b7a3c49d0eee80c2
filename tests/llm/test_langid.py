import random

import numpy as np
import pytest

from runqc.llm import langid as G

SOUNDS = {"en": ["the", "ing", "ea", "ou", "th", "ed"], "de": ["sch", "ung", "ei", "der", "ü", "cht"], "fr": ["eau", "que", "é", "ou", "ment", "les"]}
RNG = random.Random(6)


def text(lang, n=30):
    return " ".join("".join(RNG.choice(SOUNDS[lang]) for _ in range(RNG.randrange(1, 4))) for _ in range(n))


def labelled(spark):
    return spark.createDataFrame([(i, text(lang, 60), lang) for i in range(30) for lang in SOUNDS], "doc_id long, text string, lang string")


def test_markup():
    page = "<html lang='x'><!-- <p>no --><script>var a='<b>';</script><STYLE>p{}</style ><p>Th&eacute; a &amp; b</p></html>"
    assert G.markup_text(page).split() == ["Thé", "a", "&", "b"] and G.markup_text(None) == ""


def test_text_evidence_is_normalised_likelihood():
    model = G.TextModel([("en", text("en", 200)), ("de", text("de", 200))])
    assert np.allclose(np.exp(model.logp).sum(0), 1, atol=1e-3)
    assert model.evidence("") is None and model.evidence(None) is None and model.evidence(" 12 .") is None
    e = model.evidence(text("de"))
    assert model.languages == ["de", "en"] and e[0] == 0 > e[1]


@pytest.mark.parametrize("most", [G.BROADCAST_ROWS, 1])
def test_pages(spark, monkeypatch, most):
    monkeypatch.setattr(G, "BROADCAST_ROWS", most)
    pages = []
    for i in range(120):
        lang = list(SOUNDS)[i % 3]
        said = lang if i % 10 else "en"  # a tenth declare English, whatever they are
        host = f"www.{lang}{i % 4}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[lang]}"
        pages.append((i, f"https://user@{host}:80/a/{i}?q#x" if i % 2 else f"HTTP://{host}", f'<html lang="{said}-XX"><body>{text(lang, 1 if i < 20 else 25)}</body>'))
    pages += [(500, None, None), (501, "nonsense", "<p>12 34</p>"), (502, "http://h", ""), (503, pages[5][1], pages[5][2]), (None, "http://h.de/", "<p>" + text("de") + "</p>")]
    rows = {r.page_id: r for r in G.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled(spark)).collect()}
    assert len(rows) == len(pages)
    assert np.mean([rows[i].language == list(SOUNDS)[i % 3] for i in range(120)]) > 0.97
    assert all(rows[i].language == list(SOUNDS)[i % 3] for i in range(20, 120))
    assert all(rows[i].language is None and rows[i].confidence == 0 for i in (500, 501, 502))
    assert rows[1].host == "www.de1.example.de" and rows[1].suffix == "de" and rows[1].declared == "de" and rows[None].language == "de"


def test_known_language(spark, odd_docs, no_docs):
    kept = G.known_language(odd_docs, odd_docs)
    assert kept.columns == odd_docs.columns
    gone = {str(r.doc_id) for r in odd_docs.collect()} - {str(r.doc_id) for r in kept.collect()}
    assert {"100", "101", "102", "104"} <= gone
    assert G.known_language(no_docs, no_docs).count() == 0
    assert G.known_language(odd_docs, no_docs).count() == 0
    docs = labelled(spark).selectExpr("*", "lang as source")
    assert G.known_language(docs, docs).count() == docs.count()
