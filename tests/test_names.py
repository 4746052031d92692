"""Names and taxonomy on Han text, which the star schema doesn't hold."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import taxonomy as X


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def analyzed(spark, product, manager):
    return N.analyzed(spark.createDataFrame([(product, manager)], "product_name string, manager string")).first()


def test_generic_line(spark):
    r = analyzed(spark, "中证1000指数增强产品", "平方和")
    assert r["is_generic"] and r["family"] == "1000_index_enhancement" and r["quality_status"] == "weak_line" and r["entity_type"] == "strategy_line"
    assert r["entity_confidence"] == "low" and r["canonical_name"] == "平方和中证1000指数增强"


def test_same_product_two_spellings(spark):
    a, b = analyzed(spark, "双隆-隆元1号", "双隆"), analyzed(spark, "隆元一号", "双隆")
    assert a["canonical_key"] == b["canonical_key"] or N.text_key(a["canonical_key"]) == N.text_key(b["canonical_key"])
    assert not a["is_generic"] and not b["is_generic"]


@pytest.mark.parametrize("names,n", [(["托特私募", "托特（三亚）私募基金管理有限公司", "三亚托特私募"], 1)])
def test_manager_identity(spark, names, n):
    assert len({one(spark, N.identity_key, x) for x in names}) == n


def test_registry_keeps_namesakes_apart(spark):
    reg = spark.createDataFrame([("深圳图灵", "深圳图灵"), ("海南图灵", "海南图灵")], "alias string, identity string")
    df = spark.createDataFrame([("深圳图灵",), ("海南图灵",), ("图灵",)], "manager string")
    assert N.with_identity(df, "manager", reg).select("manager_key").distinct().count() == 3


def test_keys(spark):
    assert one(spark, N.match_key, "中证-1000_指增 A") == "中证1000指增a"
    assert one(spark, N.fold_key, "Straße") == "strasse"
    assert one(spark, N.wikilink, "x [[甲 乙]] y") == "甲 乙" and one(spark, N.clean_name, " -[[甲 乙]]。") == "甲乙"
    assert one(spark, N.bigrams, "量化 CTA多头") == ["量化", "化多", "多头"] and one(spark, N.bigrams, "x") == []
    assert one(spark, N.strip_company, "甲乙投资管理有限公司") == "甲乙" and one(spark, N.strip_city, "深圳市上海甲") == "甲"


def classify(spark, text):
    return X.classified(spark.createDataFrame([(text,)], "text string")).first()


def test_taxonomy(spark):
    r = classify(spark, "中证1000指数增强策略，使用Barra风险模型")
    assert r["primary_code"] == "EQ_INDEX_ENH" and "1000指增" in r["secondary_tags"] and r["facets"]["benchmark"] == ["中证1000"] and r["tag_confidence"] == "high"
    r = classify(spark, "商品期货趋势CTA，趋势跟踪")
    assert r["primary_code"] == "CTA" and {"商品CTA", "趋势CTA"} <= set(r["secondary_tags"]) and "商品期货" in r["facets"]["instrument"]
    r = classify(spark, "")
    assert r["primary_code"] == "OTHER_REVIEW" and r["tag_confidence"] == "low" and r["secondary_codes"] == []
    assert classify(spark, None)["tag_review_status"] == "needs_review"


def test_air_index_is_long_only(spark):
    assert "EQ_LONG" == classify(spark, "空气指增 量化多头")["primary_code"]


def test_match_score(spark):
    df = spark.createDataFrame([(["甲 乙1号"], ["甲乙1号"]), (["甲乙"], ["甲乙1号"]), (["丙"], ["丁"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(N.overlap_score(F.col("a"), F.col("b"))).collect()] == [4, 2, 0]


def test_guardrails(spark):
    from tessera.operators import enrichment as E

    rows = [("甲A500指增一号", ["500指增", "A500指增", "商品CTA"], {"benchmark": ["中证500", "中证A500"], "horizon": ["日内"]}), ("甲一号", ["500指增"], {"benchmark": ["中证500"]})]
    df = spark.createDataFrame(rows, "product_name string, secondary_tags array<string>, facets map<string,array<string>>")
    a, b = E.guarded(df, ["product_name"]).orderBy(F.desc("benchmark")).collect()
    assert (a["benchmark"], a["secondary_tags"], a["rejected_tags"], a["facets"]["benchmark"]) == ("A500", ["A500指增", "商品CTA"], ["500指增"], ["中证A500"])
    assert (b["benchmark"], b["secondary_tags"], b["facets"]) == ("", [], {})
    assert one(spark, lambda c: E.product_lines(c), "中证1000指增与CTA") == ["指数增强", "1000指增", "CTA"]
    assert one(spark, E.backgrounds, "曾在WorldQuant，千禧") == ["WorldQuant背景", "Millennium背景"]
    assert one(spark, E.exposure_constraints, "行业偏离3%以内，Barra") == ["行业暴露3%以内", "Barra风险约束"]


def test_groups_snippets_and_external(spark):
    from tessera.operators import enrichment as E

    df = spark.createDataFrame([("a", ["商品CTA"], [], "", 2.0), ("b", [], [], "做指增的", 1.0), ("c", [], [], "无", 3.0), ("d", ["商品CTA"], [], "", 5.0)], "product_name string, secondary_tags array<string>, primary_tags array<string>, profile_text string, score double")
    assert [(r["group"], r["products"]) for r in E.grouped(df).collect()] == [("商品CTA", ["d", "a"]), ("指数增强", ["b"]), ("其他策略", ["c"])]
    s = lambda lines, terms: spark.createDataFrame([(lines, terms)], "l array<string>, t array<string>").select(E.snippet(F.col("l"), F.col("t"), F.lit("z")).alias("x")).first()["x"]
    assert s(["- 甲", "乙 CTA"], ["无", "cta"]) == "乙 CTA" and s(["甲"], ["x"]) == "甲" and s([], ["x"]) == "z"
    maps = spark.createDataFrame([([{"url": "u"}], [{"url": "u"}, {"url": "v"}])], "a array<map<string,string>>, b array<map<string,string>>")
    assert len(maps.select(E.merged_external(F.col("a"), F.col("b")).alias("x")).first()["x"]) == 2
    ids = spark.createDataFrame([("k1", ["1"]), ("k2", ["1", "2"]), ("k3", ["2"])], "canonical_key string, external_ids array<string>")
    assert {r[0]: r[1] for r in E.by_external_identity(ids).collect()} == {"k1": "k2", "k2": "k3", "k3": "k3"}
    assert one(spark, lambda c: E.positioning(F.array(c), F.array().cast("array<string>"), F.array(F.lit("CTA")), F.array().cast("array<string>"), F.array().cast("array<string>")), "管理期货") == "一级策略：管理期货；产品线：CTA"
