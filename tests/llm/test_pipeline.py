"""The pipeline's stages on planted documents, and the queries on the small tables."""

import os
import random
import re
import zlib

import pytest

from .conftest import words

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = [], []
    for k in range(400):
        t, y = words(rng, 60), int(rng.random() < 0.3)
        if y:
            t += f". you {rng.choice(['grobbish', 'vilezz'])} thing"
        docs.append((k, t))
        labels.append((k, 0, y))
    items = [(k, words(rng, 30)) for k in range(5)]
    clean = [(1000 + k, words(rng, 50)) for k in range(30)]
    toxic = [(1100 + k, words(rng, 50) + ". grobbish you") for k in range(5)]
    leaks = [(1200 + k, words(rng, 20) + " " + x + " " + words(rng, 20)) for k, x in items]
    base = words(rng, 80)
    near = [(1300, base)] + [(1300 + k, base + f" tail{k}") for k in range(1, 5)]
    run = "\n".join(words(rng, 12) for _ in range(4))
    lines = [(1400 + k, words(rng, 40) + "\n" + run + "\n" + words(rng, 40)) for k in range(3)]
    odd = [(1500, None), (1501, ""), (1502, words(rng, 6000))]
    rows = docs + clean + toxic + leaks + near + lines + odd
    spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {"toxic": {d for d, _ in toxic} | {d for d, _, y in labels if y}, "leaks": {d for d, _ in leaks}, "near": {d for d, _ in near}, "lines": {d for d, _ in lines}, "run": run, "all": {d for d, _ in rows}}


def test_each_stage_does_its_work_and_keeps_clean_documents(spark, planted, tmp_path):
    folder, case = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted(docs.columns) == sorted(columns)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == case["all"] - case["toxic"]
    assert [case["run"] in kept["line dedup"][d] for d in sorted(case["lines"])] == [True, False, False]
    assert set(kept["line dedup"]) - set(kept["near duplicates"]) == case["near"] - {1300}
    assert set(kept["near duplicates"]) - set(kept["decontamination"]) == case["leaks"]
    pieces = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"])
    for d, t in kept["decontamination"].items():
        own = [r for r in pieces if r.doc_id == d]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_stages_on_odd_rows(spark, planted, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long text, ties and clashing names."""
    folder, _ = planted
    rng = random.Random(11)
    long, same = words(rng, 40_000), words(rng, 70)
    rows = [(9001, None, None, None, None), (None, None, None, None, None), (None, same, "en", "s", 1), (9002, "", "en", "s", 0), (9003, long, "en", "s", 1), (9004, same, "en", "s", 1), (9004, same, "en", "s", 1), (9004, words(rng, 50), "en", "s", 1), (9005, " \n\t", "en", "s", 3)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "k", 2, "x", "y") for r in rows], names + ", key string, node long, fp string, line_key string")
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sum(r.doc_id is None for r in docs.collect()) == 2, name
    left = docs.collect()
    assert {r.doc_id for r in left} == {None, 9001, 9002, 9003, 9004, 9005} and next(r.text for r in left if r.doc_id == 9003) == long
    pieces = pipeline.pack(spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {None, 9001, 9002, 9003, 9004, 9005}


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]


def test_empty_corpus(spark, planted, tmp_path):
    folder, _ = planted
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert pipeline.run(spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_registered_queries_return_every_row(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    names = [n for n in q if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in q
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for n in names:
        rows = q[n](spark, SF).count()
        if n in ("op4_ngram", "op5_toxicity"):
            fold, held = (7, 2) if n == "op4_ngram" else (5, 0)
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held) for r in q[n](spark, SF).collect()), n
        if n.startswith(("op2_", "op4_", "op5_", "op6_", "op7_", "op10_")):
            assert rows == docs, n
        elif n.startswith("op3_"):
            assert rows == spark.read.parquet(f"{SF}/pages.parquet").count()
