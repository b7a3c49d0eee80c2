import ast
import pathlib
import shutil
import subprocess
import sys

import corpus_pipeline as C
from runqc.llm import decontaminate, langid, mixing, simhash, tokens

ROOT = pathlib.Path(C.__file__).parent
SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_columns_and_take_effect(spark):
    assert [name for name, _ in C.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    plain = [lambda d: langid.known_language(d, d), simhash.keep_one, lambda d: decontaminate.clean(d, bench), mixing.mixed_rows]
    for (name, stage), same in zip(C.STAGES, plain):
        out = C.written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and ids(out) == ids(same(docs))
        if name != "mixing":
            assert set(ids(out)) <= set(ids(docs))
        docs = out
    # What passed all filters: one document of each component, none with a whole benchmark item in it.
    kept = C.written(simhash.near_duplicates(docs.dropDuplicates(["doc_id"])), "again")
    assert kept.select("component_id").distinct().count() == kept.count()
    items = [f" {' '.join(decontaminate.words_of(r.text))} " for r in bench.collect()]
    assert not any(i in f" {' '.join(decontaminate.words_of(r.text))} " for r in docs.collect() for i in items)
    want = sorted(map(tuple, tokens.stored_digests(docs).collect()))
    assert sorted(map(tuple, C.run(spark, SF).collect())) == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, base.where("doc_id = 9").first().text)], "item_id long, text string")
    for name, docs, items in (("odd", base, bench), ("none", base.limit(0), bench.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows = C.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")


def test_nothing_else_needs_this_subpackage():
    for file in ROOT.rglob("*.py"):
        inside = file.relative_to(ROOT).parts
        if inside[:2] in (("runqc", "llm"), ("tests", "llm")) or inside[0] in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                names = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
                assert not any("runqc.llm" in n or "corpus_pipeline" in n for n in names), file


def test_entry_works_without_it(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "runqc", tmp_path / "runqc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_texts_are_not_shuffled_to_small_tables(spark, monkeypatch):
    """Mixing and the language sample join whole texts to small tables; neither deals the texts out by a key for it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(str, mixing.mixed_rows(docs).collect()))
    known = sorted(map(str, langid.known_language(docs, docs).select("doc_id").collect()))
    seen, fit = [], langid.fit

    def kept(*given, **how):
        seen.append(fit(*given, **how))
        return seen[-1]

    monkeypatch.setattr(langid, "fit", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (100_000, 0):
            monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
            mixed = mixing.mixed_rows(docs)
            assert ("BroadcastHashJoin" in mixed._jdf.queryExecution().executedPlan().toString()) == (most > 0)
            assert sorted(map(str, mixed.collect())) == want
            monkeypatch.setattr(langid, "BROADCAST_ROWS", most)
            assert sorted(map(str, langid.known_language(docs, docs).select("doc_id").collect())) == known
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(seen) == 2 and (seen[0].logp == seen[1].logp).all()
