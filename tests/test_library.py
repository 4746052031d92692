"""Series, attribution, text, geometry, retrieval, knowledge, sources and streams on small hand-made cases."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import geometry as G
from tessera.operators import joins as J
from tessera.operators import knowledge as K
from tessera.operators import retrieval as R
from tessera.operators import series as S
from tessera.operators import text as X
from tessera.operators.risk import parity_weights, risk_parity
from tessera.sources import io
from tessera.sources.keyed import KeyedTable
from tessera.streaming import ingest


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def nav(spark, values, series="s"):
    return spark.createDataFrame([(series, day(i), v) for i, v in enumerate(values)], "series string, day date, nav double")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kpis_by_hand(spark):
    r = S.nav_kpis(nav(spark, [1.0, 1.2, 0.9, 0.9, 1.1]), "2024-01-02", "2024-01-05").first()
    assert r["begin_used"] == day(0) and r["n_days"] == 4 and abs(r["interval_return"] - 0.1) < 1e-12
    assert abs(r["max_drawdown"] + 0.25) < 1e-12 and r["peak_date"] == day(1) and r["trough_date"] == day(2)
    rets = np.array([1.2, 0.75, 1.0, 1.1 / 0.9]) - 1
    assert abs(r["annual_vol"] - rets.std(ddof=1) * np.sqrt(252)) < 1e-9
    assert S.nav_kpis(nav(spark, [1.0]), "2024-01-01", "2024-02-01").count() == 0


def test_changes_ranks_and_buckets(spark):
    t = nav(spark, [1.0, None, 2.0])
    assert [r["ret"] for r in S.changes(t, pad=True).orderBy("day").collect()] == [None, 0.0, 1.0]
    assert [r["ret"] for r in S.changes(t).orderBy("day").collect()] == [None, None, None]
    df = spark.createDataFrame([(1, v) for v in (5.0, 5.0, 3.0, 9.0)], "g int, v double")
    assert sorted(r["rank_avg"] for r in S.average_rank(df, "v", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert [r["b"] for r in S.quantile_bucket(df, "v", ["g"], 2, "b").orderBy("v").collect()] == [1, 1, 1, 2]


def test_running_product_is_sign_safe(spark):
    from pyspark.sql import Window as W

    df = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, -1.5, None, -3.0, -1.0, 2.0])], "i int, r double")
    got = [x["p"] for x in df.withColumn("p", S.running_product(F.col("r"), W.orderBy("i").rowsBetween(W.unboundedPreceding, 0))).orderBy("i").collect()]
    assert np.allclose(got, [1.1, -0.55, -0.55, 1.1, 0.0, 0.0])


def test_interval_and_drilldown(spark):
    rows = [("cum", i, v) for i, v in enumerate([1.0, 1.1, 1.2, 1.3])] + [("inc", i, v) for i, v in enumerate([0.1, -0.2, 0.3])] + [("two", i, v) for i, v in enumerate([5.0, 6.0])]
    got = {r["k"]: r for r in A.interval_values(spark.createDataFrame(rows, "k string, day int, value double"), ["k"]).collect()}
    assert got["cum"]["is_cumulative"] and abs(got["cum"]["total"] - 0.3) < 1e-9
    assert not got["inc"]["is_cumulative"] and abs(got["inc"]["total"] - 0.2) < 1e-9 and abs(got["inc"]["compound"] - (1.1 * 0.8 * 1.3 - 1)) < 1e-9
    assert not got["two"]["is_cumulative"]
    t = spark.createDataFrame([(f"t{i}", v / 10_000) for i, v in enumerate([1, 2, 3, -4, 5])], "track string, c double")
    assert {r["track"] for r in A.drilldown(t, "track", "c").collect()} == {"t0", "t2", "t3", "t4"}
    assert {r["track"] for r in A.drilldown(t, "track", "c", threshold_bp=4).collect()} == {"t3", "t4"}


def test_asof_takes_exact_and_earlier(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20, 0), ("a", 5, 50, 0), ("a", 5, 51, 1)], "k string, t int, w int, tie int")
    assert {r["v"]: r["w"] for r in J.asof(left, right, ["k"], "t", ["w"], "tie").collect()} == {"x": None, "y": 51, "z": None}


def test_risk_parity_shares():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = parity_weights(cov)
    share = w * (cov @ w) / (w @ cov @ w)
    assert abs(w.sum() - 1) < 1e-12 and np.allclose(share, 1 / 3, atol=1e-9)


def test_risk_parity_by_blocks(spark):
    rng = np.random.default_rng(5)
    ret = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12)) * 0.01 + rng.normal(size=(60, 12)) * 0.02
    rows = [(d, f"s{k:02d}", float(ret[d, k])) for d in range(60) for k in range(12)] + [(d, "still", 0.5) for d in range(60)] + [(1, "once", 0.1), (2, "none", None)]
    df = spark.createDataFrame(rows, "day int, series string, ret double")
    want = parity_weights(np.cov(ret.T))
    for block in (6, 100):
        got = {r["series"]: r for r in risk_parity(df, block=block, tolerance=1e-9).collect()}
        assert sorted(got) == [f"s{k:02d}" for k in range(12)]  # neither without variance nor with one day
        assert np.allclose([got[f"s{k:02d}"]["weight"] for k in range(12)], want, atol=1e-8) and np.allclose([r["risk_share"] for r in got.values()], 1 / 12, atol=1e-8)
    assert risk_parity(df.limit(0)).count() == 0


def test_folds_and_numbers_of_groups(spark):
    from tessera.operators.custom import grouped_fold, numbered

    df = spark.range(5_000).select(F.when(F.col("id") % 10 > 2, "hot").when(F.col("id") % 10 == 1, "b").alias("k"), (F.col("id") * 7919 % 5_003).alias("v"))
    got = numbered(df, ["k"], ["v"])
    by: dict = {}
    for r in got.collect():
        by.setdefault(r["k"], []).append((r["number"], r["v"]))
    assert sorted(map(len, by.values())) == [500, 1_000, 3_500] and None in by
    for rows in by.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    fold = grouped_fold(df, ["k"], lambda g: {"n": len(g), "s": g["v"].sum()}, lambda g: {"n": g["n"].sum(), "s": g["s"].sum()}, "n long, s long")
    assert {r["k"]: (r["n"], r["s"]) for r in fold.collect()} == want
    assert grouped_fold(df.limit(0), ["k"], len, len, "n long").count() == 0 and numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_first_override_without_overrides(spark):
    items = spark.createDataFrame([(1, "a"), (2, None)], "id int, kind string")
    o = spark.createDataFrame([(None, "a", "x"), (2, "a", "y"), (9, None, "z")], "n int, kind string, note string")
    held = lambda t: {r["id"]: r["note"] for r in J.first_override(items, t, ["kind"], "n", ["id"]).collect()}
    assert held(o) == {1: "y", 2: "z"} and held(o.where("kind = 'a' AND n IS NULL")) == {1: "x", 2: None} and held(o.limit(0)) == {1: None, 2: None}


def test_text(spark):
    assert value(spark, X.compacted(F.lit("a  b\n\n a b\nc\0\nc\nd"))) == "a b\nc\nd"
    assert value(spark, X.section(F.lit("# A\nx\n## B\ny\n# C\nz"), "## B")) == "y" and value(spark, X.section(F.lit("x"), "# A")) is None
    assert value(spark, X.masked(F.lit("foobar foo"), ["foo", "foobar"])) == "*** ***" and value(spark, X.cut_at(F.lit("abcXdeY"), ["Y", "X"])) == "abc"
    md = "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    assert value(spark, X.table_rows(F.lit(md))) == [["a", "b"], ["1", "x\\|y"]]
    assert value(spark, X.to_markdown(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1|2"))))) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert value(spark, X.frontmatter(F.lit("---\na: 1\n---\nbody"))) == "a: 1" and value(spark, X.frontmatter(F.lit("body"))) is None
    assert value(spark, X.embedded_json(F.lit('x <!-- P [{"n":"a"}] --> y'), "P", "array<struct<n:string>>"))[0]["n"] == "a"
    fee = value(spark, X.fee_rates(F.lit("业绩报酬计提 10% 至 20％")))
    assert (fee["low"], fee["high"], fee["kind"]) == (10.0, 20.0, "performance")
    assert value(spark, X.is_valid(F.lit("a good line of text, long enough to be used as a document. " * 3)))
    assert not value(spark, X.is_valid(F.lit("same\n" * 40 + "other line of words that is longer than the rest"))) and not value(spark, X.is_valid(F.lit(None).cast("string")))
    spans = spark.createDataFrame([(1, 100.0, 0.0, 10.0, 50.0, "ab"), (1, 100.0, 20.0, 30.0, 50.2, "cd"), (1, 100.0, 31.0, 40.0, 50.0, "ef"), (1, 100.0, 0.0, 9.0, 60.0, "- 3 -"), (1, 100.0, 0.0, 9.0, 2.0, "head")], "page int, page_height double, x0 double, x1 double, y0 double, text string")
    assert [r["text"] for r in X.layout_lines(spans).collect()] == ["ab cdef"]


def test_rectangles(spark):
    shapes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 10.0, 10.0), (1, 3, 10.0, 0.0, 3.0, 3.0), (2, 4, 0.0, 0.0, 10.0, 10.0)], "page int, id int, left double, top double, width double, height double")
    assert [tuple(r) for r in G.overlaps(shapes).collect()] == [(1, 1, 2, 25.0)]
    box = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)])
    assert value(spark, G.to_pdf(box, F.lit(100.0), F.lit(200.0), F.lit(50.0), F.lit(100.0))) == [5.0, 80.0, 15.0, 90.0]


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [("双隆商品CTA一号", "双隆", ["管理期货"], ["商品CTA"], "商品期货趋势"), ("双隆股指二号", "双隆", ["管理期货"], ["股指CTA"], "股指期货"), ("双隆三号", "双隆", ["管理期货"], [], "量化CTA"), ("伽马期货一号", "伽马", ["管理期货"], [], "期货策略"), ("甲股票一号", "甲", ["股票多头"], [], "主观选股")]
    return R.with_defaults(spark.createDataFrame(rows, "product_name string, manager string, primary_tags array<string>, secondary_tags array<string>, profile_text string")).cache()


def test_search_by_condition_and_manager(spark, profiles):
    intent = R.intent_of(profiles, "哪些管理人有期货策略？")
    assert intent.mode == "manager_filter" and [c for c, _ in intent.conditions] == ["管理期货"]
    top = R.by_manager(R.scored(profiles, intent), 2).collect()
    assert [(r["manager"], r["matched_products"]) for r in top] == [("双隆", 3), ("伽马", 1)]
    got = R.search(profiles, "双隆有哪些产品线", 10).collect()
    assert {r["manager"] for r in got} == {"双隆"} and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]


def test_packing_skips_and_goes_on(spark, profiles):
    t = profiles.limit(3).withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.orderBy("product_name")))
    t = t.withColumn("profile_text", F.when(F.col("rank") == 2, F.repeat(F.lit("长"), 400)).otherwise(F.lit("短文")))
    assert sorted(r["rank"] for r in R.packed(t, budget=100).collect()) == [1, 3]


def test_knowledge(spark, profiles):
    frag = spark.createDataFrame([("a", 2, "late", ["x", "y"], "high"), ("a", 1, "", ["y", "z"], "low"), ("a", 3, "last", None, "medium")], "k string, o int, name string, lines array<string>, conf string")
    r = K.merged_fragments(frag, ["k"], ["o"], ["name"], ["lines"], {"conf": K.CONFIDENCE}).first()
    assert (r["name"], r["lines"], r["conf"], r["fragments"]) == ("late", ["y", "z", "x"], "low", 3)
    rel = K.relations(profiles, {"primary_tags": "has_primary_strategy", "manager": "belongs_to_manager"})
    assert rel.where("predicate = 'belongs_to_manager'").count() == 5 and rel.where("object = '管理期货'").count() == 4
    issues = K.health(profiles.withColumn("canonical_name", F.when(F.col("manager") == "双隆", "同名").otherwise(F.col("product_name"))))
    assert issues.where("kind = 'duplicate_canonical_product'").count() == 1 and K.status_of(issues).first()["status"] == "warning"
    now = F.lit("2024-02-01")
    first = K.review_queue(issues, spark.createDataFrame([], "item_id string, created_at string, status string"), spark.createDataFrame([], "kind string, manager string, product_name string, status string, priority int"), now)
    old = first.select("item_id", F.lit("2023-01-01").alias("created_at"), "status")
    rules = spark.createDataFrame([("missing_evidence_summary", None, None, "suppressed", 1)], "kind string, manager string, product_name string, status string, priority int")
    second = K.review_queue(issues, old, rules, now).collect()
    assert len(second) == first.count() - 5 and {r["created_at"] for r in second} == {"2023-01-01"}
    left = spark.createDataFrame([("甲一号", "甲投资管理有限公司")], "product_name string, manager string")
    cand = spark.createDataFrame([(1, "甲一号", "甲"), (2, "甲一号增强", "甲"), (3, "甲一号", "乙")], "candidate_id int, candidate_name string, candidate_manager string")
    m = K.candidate_matches(left, cand)
    assert {(r["candidate_id"], r["score"]) for r in m.collect()} == {(1, 8), (2, 6)} and [r["candidate_id"] for r in K.best_candidates(m).collect()] == [1]
    score = lambda folder, query: spark.range(1).select(K.folder_score(F.lit(folder), F.lit(query))).first()[0]
    assert [score(*x) for x in (("甲 乙", "甲乙"), ("0001_甲乙", "甲乙"), ("丙甲乙丁", "甲乙"), ("甲丙", "甲乙"), ("甲", ""))] == [190, 180, 90, 10, 0]
    folders = spark.createDataFrame([(1, "0001_甲投资有限公司", "0001", 90), (1, "0001_甲私募基金管理有限公司", "0001", 85), (2, "甲", "", 50), (3, "乙", "", 50), (3, "丙", "", 45), (4, "丁", "0002", 90), (4, "戊", "0003", 60)], "k int, name string, code string, score int")
    assert {r["k"]: r["name"] for r in K.chosen_folder(folders, ["k"]).collect()} == {1: "0001_甲私募基金管理有限公司", 2: "甲", 4: "丁"}


def test_report_rules(spark):
    good, bad = "## 结论\n| a | b |\n| - | - |\nP1 证据强度：高", "| a | b\n| c | d | e |\nP3 大概是 证据强度：强\n```x```"
    df = spark.createDataFrame([("g", good), ("b", bad)], "path string, content string")
    got = K.report_issues(df, ["## 结论"]).collect()
    assert {r["rule"] for r in got if r["path"] == "b"} == {"sections", "table_breaks", "table_width", "evidence_priority", "evidence_strength", "speculation", "code_block"}
    assert not [r for r in got if r["path"] == "g"]
    reports = spark.createDataFrame([("甲乙一号审计", "甲乙一号-20240101-120000.md"), ("甲乙一号", "x-20230101-120000.md"), ("无", "y.md")], "title string, filename string")
    assert [r["score"] for r in K.found_reports(reports, "甲乙一号").collect()] == [1080, 780]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "尽调笔记20240105.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "a" / "介绍.md").write_text("正文", encoding="utf-8")
    (tmp_path / "a" / "x.bin").write_bytes(b"\0")
    (tmp_path / "a" / "~$tmp.md").write_text("skip")
    cat = io.catalogue(spark, str(tmp_path / "a"), [".txt", ".md"]).collect()
    hints = spark.createDataFrame([("纪要2024-1-5.md",), ("2024年12月31日路演纪要",), ("20240230.txt",), ("x",)], "n string").select(io.date_hint(F.col("n")).alias("d"), io.file_category(F.col("n"))["category"].alias("c")).collect()
    assert [(r["d"], r["c"]) for r in hints] == [(dt.date(2024, 1, 5), "text_note"), (dt.date(2024, 12, 31), "meeting_or_interview"), (None, "text_note"), (None, "other")]
    assert [(r["category"], r["priority"]) for r in cat] == [("diligence_note", 100), ("text_note", 60)] and cat[0]["date_hint"] == dt.date(2024, 1, 5)
    docs = {r["path"].rsplit(".", 1)[1]: r for r in io.parsed(spark, str(tmp_path / "a")).where("path NOT LIKE '%~$%'").collect()}
    assert docs["txt"]["content"] == "中文内容" and docs["md"]["content"] == "正文" and docs["bin"]["status"] == "error"
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": "x"}\n')
    assert sorted(r["b"] for r in io.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int, b string", {"b": F.lit("-")}).where("a IS NOT NULL").collect()) == ["-", "x"]
    log = []
    df = io.first_readable(spark, [("parquet", str(tmp_path / "none")), ("json", str(tmp_path / "r.jsonl"))], log.append)
    assert df.count() == 3 or df.count() == 4
    assert len(log) == 1
    part = spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, tradingday string")
    io.write_partitioned(part, str(tmp_path / "p"))
    io.write_partitioned(part.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "p"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 9]
    cells = spark.createDataFrame([("s", "A1", "#REF!"), ("s", "A2", "ok"), ("t", "B1", " #REF! ")], "sheet string, cell string, value string")
    r = io.cell_errors(cells).first()
    assert (r["error"], r["n"], r["places"]) == ("#REF!", 2, ["s!A1", "t!B1"])
    assert io.parameters('{"a": 1}', ["a=2", "b=x=y"]) == {"a": 2, "b": "x=y"}
    assert "| 1 |" in io.to_markdown(part.select("v")) and "<td>1</td>" in io.to_html(part.select("v"))
    with pytest.raises(ValueError):
        io.parameters("[1]")


def test_streams(spark, tmp_path, sf):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("event_id < 500").coalesce(1).write.parquet(str(src))
    run = lambda: ingest.upsert_batches(ingest.file_stream(spark, str(src), events.schema, 1), str(tmp_path / "out"), ["user_id"], ["ts", "event_id"], str(tmp_path / "cp"))
    q = run()
    q.awaitTermination(120)
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(src))
    q = run()
    q.awaitTermination(120)
    got = {r["user_id"]: r["event_id"] for r in KeyedTable(spark, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"]).read().collect()}
    want = {r["user_id"]: r["event_id"] for r in K.latest(events, ["user_id"], ["ts", "event_id"]).collect()}
    assert got == want
    w = ingest.windowed(ingest.file_stream(spark, str(src), events.schema), "ts", ["event_type"], "value", "1 day")
    q = w.writeStream.format("memory").queryName("w1").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w1").first()[0] == events.count()
    once = ingest.without_repeats(ingest.file_stream(spark, str(src), events.schema), ["event_id"], "ts", "60 days")
    q = once.writeStream.format("memory").queryName("w2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM w2").first()[0] == events.count()


def test_unnesting(spark):
    bar = json.dumps({"2024-01-07": [{"FundID": 1, "Name": "a", "Yield": 0.1, "NetValue": 1.1}], "bad": []})
    assert [tuple(r) for r in A.unnested_bars(spark.createDataFrame([(bar,)], "bar string")).collect()] == [(dt.date(2024, 1, 7), 1, "a", 0.1, 1.1)]
    wide = spark.createDataFrame([(1, "0.5", 2.0)], "k int, `甲贡献` string, `甲收益` double")
    assert {(r["name"], r["measure"], r["value"]) for r in A.unpivoted(wide, ["k"], {"贡献": "c", "收益": "r"}).collect()} == {("甲", "c", 0.5), ("甲", "r", 2.0)}


def test_profile_build(spark):
    from tessera.plans import profiles as P

    note = lambda path, manager, entity, body: (path, f"---\nentity_type: product\nmanager: {manager}\nprimary_entity: '[[{entity}]]'\nmain_strategies: [{body}]\n---\n{entity} 的策略是{body}。\n")
    files = spark.createDataFrame([note("a.md", "双隆", "双隆隆元1号", "商品CTA"), note("b.md", "双隆", "隆元一号", "趋势CTA"), note("c.md", "平方和", "中证1000指数增强产品", "1000指增"), note("d.md", "平方和", "平方和财赢1号", "量化多头")], "path string, content string")
    got = P.build(files)
    rows = {r["product_name"]: r for r in got["profiles"].collect()}
    assert len(rows) == 3 and sorted(r["fragments"] for r in rows.values()) == [1, 1, 2]
    assert got["relations"].where("predicate = 'belongs_to_manager' AND object = '双隆'").count() == 1
    assert got["status"].first()["status"] == "warning" and got["relations"].where("predicate = 'has_product'").count() == 3
    body = '---\nentity_type: odd\nmentioned_products_simple:\n  - "[[甲一号]]"\n  - 乙二号\n---\n<!-- SYSTEM_MENTIONED_PRODUCTS not json -->'
    parsed = P.notes(spark.createDataFrame([("x.md", body)], "path string, content string"))
    assert parsed.first()["mentioned"] == ["甲一号", "乙二号"]
    assert {r["kind"] for r in P.note_issues(parsed, ["manager"]).collect()} == {"missing_fields", "unknown_entity_type", "unreadable_products"}
    assert sorted(r["product_name"] for r in P.fragments(parsed).collect()) == ["乙二号", "甲一号"]
    assert P.manager_pages(got["profiles"]).where("manager = '双隆'").first()["markdown"].startswith("# 双隆\n\n- [[")
    assert {r["quality_status"] for r in P.quality_report(got["profiles"]).collect()} == {"confirmed", "weak_line"}


def test_lifecycle_and_plans(spark):
    from tessera.plans import profiles as P

    man = spark.createDataFrame([("a", "h1", 1, "r", "success", "na"), ("b", "h2", 1, "r", "success", "nb"), ("b", "h2", 2, "r", "failed", "nb"), ("c", "h3", 1, "r", "success", "nc")], "source_path string, sha256 string, parsed_at int, run_id string, status string, source_note_path string")
    here = spark.createDataFrame([("b",), ("c",), ("na",)], "path string")
    assert {(r["source_path"], r["kind"]) for r in P.lifecycle_issues(man, here).collect()} == {("a", "source_missing"), ("b", "parse_failed"), ("c", "note_missing")}
    files = spark.createDataFrame([("x", "h1"), ("y", "h9")], "path string, sha256 string")
    assert [r["path"] for r in P.changed_only(files, man).collect()] == ["y"]
    md = spark.createDataFrame([("v.md", "## 标签\n| label | code |\n| --- | --- |\n| 低波动 | A |\n| 高 | B |\n## 下\n")], "path string, content string")
    words = P.vocabulary(md, "## 标签", ["label", "code"])
    assert [(r["label"], r["code"]) for r in words.collect()] == [("低波动", "A"), ("高", "B")]
    assert [r["code"] for r in P.labels_like(words, "低波").collect()] == ["A"] and [r["code"] for r in P.labels_like(words, "高").collect()] == ["B"]
    funds = spark.createDataFrame([("f",), ("g",)], "fund string")
    reports = spark.createDataFrame([("f", "p1", 1), ("f", "p2", 2)], "fund string, path string, stamp int")
    assert {r["fund"]: (r["report"], r["action"]) for r in P.audit_plan(funds, reports).collect()} == {"f": ("p2", "reuse"), "g": (None, "audit")}
    assert [r["call"] for r in P.documented_calls(spark.createDataFrame([("a", "### x `fund_nav(a, b)`\ntext\n## get_nav()")], "path string, content string")).collect()] == ["fund_nav", "get_nav"]


def test_report(spark):
    from tessera.plans import report as T

    k = S.nav_kpis(nav(spark, [1.0, 1.1, 1.05]), "2024-01-01", "2024-01-03")
    strat = spark.createDataFrame([("x", 0.02), ("y", 0.01)], "strategy string, contribution double")
    tracks = spark.createDataFrame([("t1", 0.01), ("t2", -0.005)], "track string, contribution double")
    text = T.summary("P", k, strat, tracks)
    assert "3.00%" in text and "t1（100.0bp）" in text and "t2（-50.0bp）" in text
    hint = spark.createDataFrame([("size", 0.5), ("size", -0.5), ("size", 0.01), ("odd", 1.0)], "f string, e double").select(T.factor_hint(F.col("f"), F.col("e")).alias("h"))
    assert [r["h"] for r in hint.collect()] == ["偏大盘", "偏小盘", "中性", "正暴露"]


def test_ingest_rules(spark):
    df = spark.createDataFrame([("q", "a", 10), ("q", "b", 40), ("q", "c", 5), ("r", "d", 1)], "q string, name string, score int")
    assert {(r["name"], r["shown"]) for r in K.visible(df, ["q"], most=2).collect()} == {("b", True), ("a", False), ("d", True)}
    runs = spark.createDataFrame([(0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 2, 0), (2, 2, 1, 0, 2, 0), (2, 2, 2, 1, 1, 0), (2, 2, 2, 0, 0, 2), (2, 2, 2, 0, 2, 0)], "sources int, profiles int, indexed int, failed int, processed int, skipped int")
    assert [r["status"] for r in K.run_status(runs).collect()] == ["failed", "no_sources", "no_profiles", "index_incomplete", "partial", "unchanged", "success"]
    assert value(spark, K.product_mentions(F.lit("看 隆元1号 和 隆元1号, 财赢十二期"))) == ["隆元1号", "财赢十二期"]
    assert value(spark, K.strategy_mentions(F.lit("做cta的"), ["CTA", "套利"])) == ["[[CTA]]"]


def test_scalars(spark):
    from tessera.functions import scalar as C

    assert value(spark, C.json_list(F.lit('["a", "", null, "b"]'))) == ["a", "b"] and value(spark, C.json_list(F.lit("x"))) == []
    assert value(spark, C.mapped(F.lit(" HIGH "), {"high": "h"}, "?")) == "h" and value(spark, C.mapped(F.lit("x"), {"high": "h"}, "?")) == "?"
    assert value(spark, C.short_error(F.lit('{"code": 5, "msg": "bad", "detail": "very"}'))) == "5 bad very" and value(spark, C.short_error(F.lit("plain  text"))) == "plain text"
    assert value(spark, C.score_after(F.lit("| 最大回撤 | -3.5 | x |"), "最大回撤")) == -3.5 and value(spark, C.score_after(F.lit("none"), "最大回撤")) is None
    assert value(spark, C.percent_text(F.lit(0.1234))) == "12.34%" and value(spark, C.bp_text(F.lit(None).cast("double"))) == "-" and value(spark, C.ellipsis(F.lit("abc, def"), 5)) == "abc…"
    assert value(spark, C.soft_double(F.lit("nope"))) is None and value(spark, C.soft_day(F.lit("2024-02-30"))) is None and value(spark, C.missing_to(F.lit("NaN"), "?")) == "?"
    assert str(value(spark, C.previous_sunday(F.lit("2024-01-07").cast("date")))) == "2024-01-07" and str(value(spark, C.previous_sunday(F.lit("2024-01-06").cast("date")))) == "2023-12-31"


def test_field_rules(spark):
    from tessera.operators.report_rules import PORTRAIT_ROWS, field_issues

    head = "### 字段审核\n| f | v | c | r |\n| - | - | - | - |\n| strategyType | a | 一致 | x |\n| `raceName` | a | {race} | x |\n| fundType | a | {kind} | {why} |\n### 策略画像\n" + "\n".join(PORTRAIT_ROWS) + "\n### 关键证据\n{proof}\n### 口径说明\n{note}\n"
    fill = lambda **k: head.format(**{"race": "一致", "kind": "一致", "why": "直接", "proof": "**P1** x", "note": "- **推论边界风险**：y", **k})
    docs = {
        "good": fill(), "none": fill(race="需补充"), "two": fill(race="需修正 建议: 甲<br>建议: 乙"), "many": fill(race="需修正 建议: 甲、乙"), "one": fill(race="需修正（建议: 甲）"), "unsure": fill(race="需补充 建议: 待人工确认"),
        "kind": fill(kind="建议: 丙", why="无直接证据"), "chain": fill(proof="**P1** a\n**P2** b\n**P2** c"), "note": fill(note="- 其他\n- **推论边界风险**"), "list": fill(note="推论边界风险"), "rows": "### 字段审核\n| a | b | c | d |\n", "empty": None,
    }
    got = {}
    for r in field_issues(spark.createDataFrame(list(docs.items()), "path string, content string")).collect():
        got.setdefault(r["path"], []).append(r["rule"])
    assert got == {"none": ["race_suggestion"], "two": ["race_suggestion"], "many": ["race_suggestion"], "unsure": ["race_suggestion"], "kind": ["fund_type", "fund_type"], "chain": ["evidence_chain"], "note": ["boundary_first"], "list": ["boundary_first"], "rows": ["audit_rows"], "empty": ["audit_rows"]}


def test_office_files_sinks_and_readers(spark, tmp_path):
    import zipfile

    from tessera.sources import office

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>第一</w:t></w:r><w:r><w:tab/><w:t>段</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:sp><p:txBody><a:p><a:r><a:t>slide</a:t></a:r><a:r><a:t> {k}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp></p:sld>')
    (tmp_path / "c.docx").write_bytes(b"no archive")
    office.register()
    got = {r["path"].rsplit("/", 1)[1]: r for r in io.parsed(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["content"] == "第一\t段\n\nend" and got["b.pptx"]["content"] == "slide 2\nmore\nslide 10\nmore"
    assert (got["c.docx"]["status"], got["c.docx"]["content"]) == ("error", None)
    t = spark.range(3)
    for kind in ("parquet", "orc", "csv", "json"):
        io.write(t, kind, str(tmp_path / "out" / kind))
        assert sorted(int(r[0]) for r in io.read(spark, kind, str(tmp_path / "out" / kind)).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="unknown sink"):
        io.write(t, "fax", "x")
    io.register_reader("numbers", lambda s, path: s.range(int(path)))
    assert io.first_readable(spark, [("absent", "x"), ("numbers", "4")]).count() == 4
    io.write_report(t.select("id", F.concat(F.lit("line "), "id").alias("text")), str(tmp_path / "report"), ["id"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["line 0", "line 1", "line 2"]


def test_groups_indexes_and_limits(spark, profiles):
    from tessera.operators import custom
    from tessera.operators import series as S

    with pytest.raises(ValueError, match="a group of"):
        custom.grouped_apply(spark.range(10).withColumn("k", F.lit(1)), ["k"], lambda g: g, "id long, k int", most_rows=5)
    with pytest.raises(ValueError, match="choose some"):
        S.correlations(spark.range(5).select(F.lit(1).alias("day"), F.col("id").alias("series"), F.lit(0.1).alias("ret")), most=3)
    index = R.bigram_index(profiles.withColumn("profile_text", F.col("product_name")))
    assert 0 < R.index_candidates(profiles, index, profiles.first()["product_name"]).count() <= profiles.count() and R.index_candidates(profiles, index, "abc").count() == profiles.count()
