"""Work that grows with a key's rows, or with the rows of a small file, is dealt over tasks; results don't change by it."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import joins as J
from tessera.operators import knowledge as K
from tessera.operators import layout as LY
from tessera.operators import postings
from tessera.operators import retrieval as R
from tessera.plans import check_queries as C
from tessera.plans import knowledge_views as V
from tests.test_library import profiles  # noqa: F401


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """25,000 parts in one file: rows of 0.1 MB that make profiles of 20 MB."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(25_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_rows_of_a_small_file_are_dealt(spark, parts):
    for of in (V.profiles, V.products, V.notes):
        t = of(spark, parts)
        sizes = [r["n"] for r in t.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 25_000 and max(sizes) <= 12_000


def test_lists_of_a_key_have_a_bound(spark):
    t = spark.range(3_000).select(F.lit("k").alias("k"), "id").unionByName(spark.range(3).select(F.lit(None).cast("string").alias("k"), "id"))
    d = J.dealt(t, ["k"], 100)
    assert d.agg(F.max(F.size("items"))).first()[0] < 200 and d.select(F.sum(F.size("items"))).first()[0] == 3_003
    got = J.every_pair(t.select("k").distinct(), d, d, ["k"], ["k"]).select("l.id", F.col("r.id").alias("other"))
    assert got.count() == got.distinct().count() == 9_000_000


def test_repeated_boxes_overlap_as_single_ones(spark):
    box = lambda m: [F.expr(e).cast("double").alias(n) for e, n in ((f"id * 7 % {m}", "left"), (f"id * 13 % {m}", "top"), ("1 + id % 5", "width"), ("1 + id % 4", "height"))]
    s = spark.range(900).select("id", F.expr("id % 2").alias("page"), *box(20)).unionByName(spark.sql("SELECT 900L AS id, 0L AS page, CAST(NULL AS DOUBLE) AS left, 0D AS top, 1D AS width, 1D AS height UNION ALL SELECT 901L, NULL, 0D, 0D, 9D, 9D"))
    a, b = s.alias("a"), s.alias("b")
    plain = a.join(b, F.expr("a.page = b.page AND a.id < b.id")).select(F.col("a.page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), G.overlap("a", "b").alias("area")).where("area IS NOT NULL AND b <> 900")  # a box without a side is in no cell
    got = G.overlaps(s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.columns == ["page", "a", "b", "area"]


def test_fragments_of_one_key_are_all_attached(spark):
    generic = spark.range(1_000).select("id", F.lit("m").alias("manager"), F.expr("if(id % 10 = 0, NULL, 'f')").alias("family"))
    real = spark.range(700).select(F.lit("m").alias("manager"), F.lit("f").alias("family"), F.concat(F.lit("p"), "id").alias("canonical_key"))
    got = K.attached(generic, real, ["manager", "family"])
    assert got.columns == ["manager", "family", "id", "target_key"] and got.count() == got.distinct().count() == 900 * 700
    text = got._jdf.queryExecution().toString()
    assert "collect_list" in text  # lists meet, not rows


def test_a_list_is_taken_to_rows_before_it_meets_the_next(spark):
    t = spark.range(700).select(F.expr("id % 3").alias("k"), "id")
    got = J.every_pair(t.select("k").distinct(), J.dealt(t, ["k"], 50), J.dealt(t, ["k"], 50), ["k"], ["k"]).select("l.id", F.col("r.id").alias("other"))
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(700) for b in range(700) if a % 3 == b % 3]
    last = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert last.count("Generate explode") == 1  # not the product of two lists from one row


def test_attached_profiles_are_worked_out_once(spark, parts):
    got = C.group_attach(spark, parts)
    assert "part.parquet" not in "".join(got.inputFiles()) and "repartition" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    keys = lambda t: sorted(map(tuple, t.groupBy("manager", "family").agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_distinct("target_key")).collect()))
    p = V.profiles(spark, parts).select("id", "manager", F.col("primary_tag").alias("family"), "product_name")
    plain = p.where("id % 6 = 0").drop("product_name").join(p.where("id % 36 BETWEEN 1 AND 3").select("manager", "family", F.col("product_name").alias("target_key")).distinct(), ["manager", "family"])
    assert keys(got) == keys(plain) and len(keys(got)) == 5


def test_attached_rows_are_dealt_by_their_number(spark):
    generic = spark.range(300).select("id", F.expr("if(id % 400 < 399, 'm', 'n')").alias("manager"))
    real = spark.range(20_000).select(F.expr("if(id % 400 < 399, 'm', 'n')").alias("manager"), F.concat(F.lit("p"), "id").alias("canonical_key"))
    got = K.attached(generic, real, ["manager"], rows=100_000)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 300 * 19_950 and got.rdd.getNumPartitions() == 60 and max(sizes) < 1_000_000
    assert K.attached(generic.where("id < 0"), real, ["manager"]).count() == 0


def test_fragments_of_one_key_merge_as_a_fold(spark):
    t = spark.range(2_000).select(F.expr("if(id % 3 = 0, NULL, 'k')").alias("k"), F.expr("id % 50").alias("o"), F.array(F.concat(F.lit("x"), F.col("id") * 7 % 31), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("y"), F.col("id") % 9)).alias("xs"), F.lit("t").alias("name"), F.lit("low").alias("c"))
    t = t.unionByName(spark.sql("SELECT 'e' AS k, 1L AS o, CAST(NULL AS ARRAY<STRING>) AS xs, '' AS name, 'high' AS c"))
    got = K.merged_fragments(t, ["k"], ["o"], ["name"], ["xs"], {"c": K.CONFIDENCE}, most=20)
    assert got.columns == ["k", "name", "xs", "c", "fragments"]
    for r in got.collect():
        rows = sorted((x["o"], x["xs"] or [], x["o"]) for x in t.where(F.col("k").eqNullSafe(r["k"])).select("o", F.transform("xs", lambda v: F.coalesce(v, F.lit(""))).alias("xs")).collect())
        assert r["xs"] == list(dict.fromkeys(v for _, xs, _ in rows for v in xs if v))[:20]
    assert {r["k"]: r["fragments"] for r in got.collect()} == {"k": 1_333, None: 667, "e": 1}
    assert "collect_list(struct(o" not in got._jdf.queryExecution().toString()


def test_first_of_alike_candidates_decide(spark):
    left = spark.createDataFrame([("甲一号", "甲投资管理有限公司"), ("甲", "甲"), ("丙二号", "乙")], "product_name string, manager string")
    c = spark.range(400).select(F.col("id").alias("candidate_id"), F.element_at(F.array(*[F.lit(x) for x in ("甲一号", "甲一号增强", "乙", "甲")]), F.expr("cast(1 + id % 4 as int)")).alias("candidate_name"), F.element_at(F.array(*[F.lit(x) for x in ("甲", "乙", "甲投资", None)]), F.expr("cast(1 + id div 4 % 4 as int)")).alias("candidate_manager"))
    few = K.first_alike(c, 3)
    assert few.count() == 48
    rows = lambda t: sorted(map(tuple, K.best_candidates(K.candidate_matches(left, t), 3).collect()))
    assert rows(few) == rows(c) and rows(c)


def test_terms_are_found_wherever_they_stand(spark):
    q = spark.createDataFrame([("abcab",), ("",), (None,), ("zab",), ("xyz",)], "query string")
    closed = spark.createDataFrame([("AB", "s"), ("abc", "s"), ("Ab", "t"), ("", "u")], "term string, synonym string")
    got = LY.expanded(q, closed, F.lower("term"))
    assert sorted(map(tuple, got.collect())) == sorted([("abcab", x) for x in ("AB", "Ab", "abc", "s", "t")] + [("zab", x) for x in ("AB", "Ab", "s", "t")])
    assert LY.expanded(q, closed.limit(0), F.lower("term")).count() == 0


def test_index_of_many_chunks(spark, profiles, monkeypatch):  # noqa: F811
    monkeypatch.setattr(postings, "CHUNK", 1)
    monkeypatch.setattr(postings, "ROWS", 2)
    t = profiles.withColumn("id", F.monotonically_increasing_id())
    index = postings.build(t)
    assert len(index.profiles.inputFiles()) > 1  # readers get work for several tasks
    files = index.postings.select(F.input_file_name().alias("f"), "chunk").distinct().groupBy("chunk").agg(F.count_distinct(F.regexp_extract("f", r"part-(\d+)", 1)).alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1  # a chunk is one task's, from its profiles to its lists
    asked = "哪些管理人有期货策略？"
    rows = lambda d: sorted(map(tuple, d.select("rank", "product_name", "score").collect()))
    assert rows(R.search(index.profiles, asked, 10, index=index)) == rows(R.search(profiles, asked, 10))
