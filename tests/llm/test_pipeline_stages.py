"""The pipeline's stages one after another, each against what its operator says of the stage's own input."""

import importlib
from collections import Counter

import pytest
import corpus_pipeline
from panelcast.llm import decontaminate, langid, secret_scan, simhash


@pytest.fixture(scope="module")
def folder(clashing, benchmark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clashing.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return path


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_each_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert set(docs.select(columns[5:]).distinct().collect()) == {tuple("own" for _ in columns[5:])}
        if name == "language_id":
            said = langid.predict(before.select("text"), langid.fit(langid.learned_rows(before)))
            texts = Counter(r.text for r in said.collect() if r.lang_pred != "und" and r.score >= langid.REJECT_BELOW)
            assert Counter(r.text for r in docs.collect()) == texts and docs.count() < before.count()
        elif name == "simhash_near_dedup":
            first = {r.component_id for r in simhash.near_duplicates(before).collect()}
            kept = [r.doc_id for r in docs.collect()]
            assert sorted(i for i in kept if i is not None) == sorted(i for i in first if i is not None)
            assert 101 not in kept and 7 in kept and kept.count(5) == 1
        elif name == "benchmark_decontamination":
            said = decontaminate.query(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
            bad = {r.doc_id for r in said if r.contaminated}
            assert counted(docs) == Counter(tuple(r) for r in before.collect() if r.doc_id not in bad) and bad
        elif name == "secret_scan":
            dirty = {r.doc_id for r in secret_scan.query(before).collect() if r.spans}
            assert {r[0] for r in (counted(before) - counted(docs))} == dirty and dirty
            assert not any(r.spans for r in secret_scan.query(docs).collect())
            assert docs.count() == before.count()
        else:
            rows = docs.collect()
            assert [r.position for r in rows] == sorted(r.position for r in rows)
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
            assert sum(r.taken for r in rows) == pytest.approx(sum(len(r.text.split()) for r in before.collect()), abs=5)


def test_run_is_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    assert counted(corpus_pipeline.run(spark, folder)) == counted(docs)


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_everything_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {k.split("_")[0] for k in names}
    assert {"op2_url_filters", "op3_curriculum_mix"} <= set(entry.oracle_sql())
