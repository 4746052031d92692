"""Search by the index of character pairs, and names recognised in tables of queries, against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, recognition
from tessera.operators import retrieval as R
from tessera.plans import knowledge_views as V

RELATIONS = "product_name string, subject string, predicate string, object string, evidence array<string>"
QUERIES = ["哪些管理人有商品期货CTA策略", "哪些管理人有WorldQuant背景", "灵均投资 市场中性3号2 如何", "九坤概况", "没有这样的东西"]


@pytest.fixture(scope="module")
def profiles(spark, sf):
    return V.profiles(spark, sf)


@pytest.fixture(scope="module")
def relations(spark, profiles):
    names = [r[0] for r in profiles.select("product_name").distinct().orderBy("product_name").limit(30).collect()]
    rows = [(n, n, "has_people_background" if k % 2 else "has_exposure_constraint", "WorldQuant背景" if k % 2 else "行业偏离≤±3%", ["某处 "]) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, RELATIONS)


@pytest.fixture(scope="module")
def index(profiles, relations):
    return postings.build(profiles, relations=relations)


@pytest.mark.parametrize("query", QUERIES)
def test_results_are_those_of_a_full_scan(profiles, relations, index, query):
    cols = ["rank", "product_name", "manager", "score", "satisfied", "matched"]
    got = R.search(profiles, query, 7, relations=relations, index=index).select(cols).collect()
    assert got == R.search(profiles, query, 7, relations=relations).select(cols).collect()


def test_bounds_are_never_below_scores(profiles, relations, index):
    rnd = random.Random(5)
    for query in QUERIES[:2] + ["".join(rnd.sample("商品期货指增中性多因子行业偏离", 6))]:
        intent = index.intent(query)
        bound = {r["id"]: r["bound"] for r in postings.bounds(index, intent).collect()}
        scores = R.scored(index.profiles, intent, relations).select("id", "score").collect()
        assert all(bound[r["id"]] >= r["score"] for r in scores)


def test_only_candidates_are_scanned(index, capsys):
    got = index.candidates(index.intent(QUERIES[0]), 5)
    got.explain("formatted")
    shown = capsys.readouterr().out
    assert "PushedFilters: [In(id" in shown or "PushedFilters: [IsNotNull(id)" in shown
    assert 5 <= got.count() < index.profiles.count() / 2
    lists = postings.read(index, {"商品"})
    lists.explain("formatted")
    shown = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(folder" in shown and "EqualTo(pair,商品)" in shown


def test_words_of_one_letter_need_a_scan(index, profiles):
    intent = R.Intent("x", terms=["中", "商品"], conditions=[])
    assert postings.bounds(index, intent) is None and index.candidates(intent, 3).count() == profiles.count()


def test_common_pairs_are_cut_and_repeated_texts_kept(spark):
    rows = [(k, f"同名产品{k % 3}", "某某投资", ["商品CTA"], "商品期货") for k in range(300)] + [(k, "", "", [], "") for k in (300, 301)]
    df = spark.createDataFrame(rows, "id long, product_name string, manager string, primary_tags array<string>, profile_text string")
    keep = postings.CHUNK
    postings.CHUNK = 50
    try:
        index = postings.build(df)
    finally:
        postings.CHUNK = keep
    assert index.postings.where("pair = '商品'").count() > 3
    assert postings.read(index, {"商品"}).count() == 300
    assert R.search(df, "商品期货CTA", 9, index=index).select("score").collect() == R.search(R.with_defaults(df), "商品期货CTA", 9).select("score").collect()
    empty = postings.build(df.limit(0))
    assert R.search(df.limit(0), "商品期货CTA", 9, index=empty).count() == 0


def test_intents_of_a_table_are_those_of_single_queries(spark, profiles):
    names = recognition.name_keys(profiles).cache()
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, QUERIES[0], "", None]], "query string")
    got = {r["query"]: r for r in recognition.intents(asked, names).collect()}
    assert set(got) == {*QUERIES, ""}
    for q in QUERIES:
        one = R.intent_of(profiles, q)
        assert (got[q]["manager"], got[q]["product"], got[q]["mode"], got[q]["terms"], got[q]["conditions"]) == (one.manager, one.product, one.mode, one.terms, [c for c, _ in one.conditions])
    in_blocks = {r["query"]: r["name"] for r in recognition.recognised(asked, names, block=5, part=3).where("kind = 'manager'").collect()}
    assert in_blocks == {q: r["manager"] for q, r in got.items() if r["manager"]}


def test_longest_name_wins(spark):
    profiles = spark.createDataFrame([("甲投资", "甲号1"), ("甲乙投资", "甲乙1号"), ("甲乙 投资", "甲乙1号"), ("", "ab"), ("丙", None)], "manager string, product_name string")
    got = recognition.recognised(spark.createDataFrame([("甲乙投资的甲乙1号好吗",), ("只有甲",), ("ab丙",)], "query string"), recognition.name_keys(profiles))
    assert sorted(map(tuple, got.collect())) == [("甲乙投资的甲乙1号好吗", "manager", "甲乙 投资"), ("甲乙投资的甲乙1号好吗", "product", "甲乙1号")]
    assert R.asked("甲乙投资的甲乙1号好吗", recognition.name_keys(profiles)).manager == "甲乙 投资"
    assert got.where(F.col("query") == "只有甲").count() == 0
