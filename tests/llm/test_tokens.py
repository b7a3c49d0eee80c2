import glob
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from runqc.llm import tokens as T

ODD = ["", "a  b\n\tc", "don't I'll 'S", "ΑΣ Σίγμα ΟΔΟΣ", "<|endoftext|> x", "ﬁn Å Å éa İI ß ẞ K", "\x1cfoo\x85bar\xa0baz \x1f\x0b\x0c",
       "!!! a%%% 12ab3 _x_ a_b", None, "日本語テスト 한국어 👍🏽x", "á ́b", "x" * 500, "Ⅷ² ٣  a b", "  lead trail  ", "\r\n", "ÉCOLE École", "a,b. (c)"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(T.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_encoded_as_whole_texts(tokenizer):
    words = T._Words(T.vocabulary_path())
    for texts in (ODD, ODD[::-1], [], ["", None]):
        ids, counts = words.encode(texts)
        ends = np.cumsum(counts).astype(int).tolist()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [ids_of(tokenizer, t) for t in texts]


def test_files_hold_all_ids_in_order(spark, odd_docs, no_docs, tokenizer, tmp_path):
    path = str(tmp_path / "tokens")
    T.write_tokens(odd_docs.repartition(5), path)
    got = T.read_tokens(spark, path).orderBy("start").collect()
    texts = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == T.END_ID
        start += r.n_tokens
    want = sorted((str(i), [*ids_of(tokenizer, t), 1]) for i, t in texts)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in T.token_digests(T.read_tokens(spark, path)).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert {r.doc_id for r in T.read_tokens(spark, path, [7, 103]).collect()} == {7, 103}
    assert T.stored_digests(no_docs).collect() == []


def test_files_carry_bloom_filters(spark, odd_docs, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "tokens")
    T.write_tokens(odd_docs, path)
    file = max(glob.glob(f"{path}/*.orc"), key=lambda f: len(open(f, "rb").read()))
    assert orc.ORCFile(file).nrows > 0
    plan = T.read_tokens(spark, path, [7])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_tasks_hold_bounded_batches_of_texts(spark, tmp_path, monkeypatch):
    """Texts reach the workers a few at a time, and the session's own setting holds again afterwards."""
    made, setting, most = T._encode, "spark.sql.execution.arrow.maxRecordsPerBatch", T.AT_ONCE

    def checked(path, end_id):
        run = made(path, end_id)

        def held(batches):
            def few():
                for b in batches:
                    assert b.num_rows <= most
                    yield b

            return run(few())

        return held

    before = spark.conf.get(setting)
    monkeypatch.setattr(T, "_encode", checked)
    docs = spark.range(12 * most).selectExpr("id AS doc_id", "'a b c' AS text")
    T.write_tokens(docs, str(tmp_path / "tokens"))
    assert T.read_tokens(spark, str(tmp_path / "tokens")).count() == 12 * most
    with pytest.raises(Exception):
        T.write_tokens(docs, str(tmp_path / "tokens"))  # is there already
    assert spark.conf.get(setting) == before
