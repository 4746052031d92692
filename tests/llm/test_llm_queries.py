"""The registered queries of this subpackage: against DuckDB where SQL can express them, else their shape; and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, queries, simhash, toxicity
from tests.oracle import connect, same

COLUMNS = {
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_html": {"page_id", "url", "text", "n_chars"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_secrets": {"doc_id", "start", "is_secret"},
    "op10_mixing": {"doc_id", "probability", "sampled"},
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_shape(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(df.columns)
    table = "pages" if name == "op5_html" else "documents"
    if name != "op9_secrets":
        assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before.count()
        if name == "simhash":
            assert docs.count() == simhash.components_of(before).select("component_id").distinct().count()
        if name == "decontamination":
            got = decontaminate.match(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert got.where(F.size("spans") > 0).count() == 0
        if name == "secrets":
            assert docs.count() == before.count()
    assert toxicity.train(docs.limit(0), spark.read.parquet(f"{sf}/labels.parquet")) is None


def test_pipeline_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.select("doc_id").distinct().count() == got.count()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, clashing names, no labels; and empty tables."""
    item = " ".join(f"bench{i}" for i in range(14))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(None, None, None, None, None), (None, "some words here", "en", "a", 15), (1, None, "en", None, 0), (2, "", None, "a", 0), (3, f"free words {item} and {'more ' * 60}", "en", "a", 9), (4, item, "en", "a", 9)]
    rows += [(5, f'x token = "{key}" y', "en", "b", 9)] * 3 + [(6, "long words " * 100_000, "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("__cut", "__h", "__nth", "score", "found", "mix_factor"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert {"__cut", "__h", "__nth", "score", "found", "mix_factor"} <= set(docs.columns)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(texts[None]) == 2 and 4 not in texts and len(texts[5]) == 1 and key not in texts[5][0] and "bench3" not in texts[3][0] and len(texts[6][0]) == 1_100_000
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(empty / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
