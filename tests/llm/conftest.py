import random

import pytest

CLASHING = "doc string, count int, size long, row long, hits string, evidence string, h long, fp long, place long, part int, copies int, id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with NULLs, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and", "ontion", "Ereth", "thble", "lyne", "éan", "auf", "que"]) + rng.choice(["", "", ",", "."])
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, None, "en", "a"), (101, "", "de", "b"), (102, " \t\n ", None, None), (103, text(20_000), "en", "a"), (104, "1234 !!", "en", "b")]
    rows += [rows[3], rows[3], (None, text(12), "en", "a"), (5, text(9), None, "b"), (105, rows[7][1], "en", "a"), (106, rows[7][1] + " x", "de", "b")]
    extra = tuple([None] * 12)
    return spark.createDataFrame([r + (len(r[1] or ""),) + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
