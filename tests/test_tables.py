"""Keyed tables, reruns, bucketed relations and the data source, on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import datasource, relations
from tessera.sources.keyed import KeyedTable
from tessera.streaming import ingest


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable(spark, path, ["k"], ["at"], buckets=32)
    t.upsert(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    before = files(path)
    v = t.upsert(spark.createDataFrame([(5, 2, "new"), (7, 0, "late"), (None, 1, "nokey"), (-1, 1, "more"), (-1, 3, "last")], "k long, at int, v string"))
    added = {f: n for f, n in files(path).items() if f not in before}
    assert sum(added.values()) < sum(before.values()) / 4 and v.number == 1 and sum(v.rows.values()) == 20_002
    got = {r["k"]: r["v"] for r in t.lookup(spark.createDataFrame([(5,), (7,), (-1,), (99_999,)], "k int")).collect()}
    assert got[5] == "new" and len(got[7]) == 64 and got[-1] == "last" and set(got) == {5, 7, -1}
    assert t.read().count() == 20_002 and t.read(0).count() == 20_000
    assert t.expire(1) > 0 and t.versions() == [1] and t.read().count() == 20_002
    with pytest.raises(ValueError, match="is kept by"):
        KeyedTable(spark, path, ["v"]).read()
    with pytest.raises(ValueError, match="nothing was written"):
        KeyedTable(spark, str(tmp_path / "absent"), ["k"]).read()


def test_runs_and_versions_are_written_once(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=4)
    one = spark.createDataFrame([(1, "x", 1.0), (1, None, 2.0)], "a int, b string, v double")
    t.upsert(one, ("job", 0))
    assert t.upsert(one.withColumn("v", F.lit(9.0)), ("job", 0)).number == 0
    assert t.upsert(one.withColumn("v", F.lit(9.0)), ("other", 0)).number == 1
    assert rows(t.read()) == [(1, "x", 9.0), (1, None, 9.0)]
    stale = t.version()
    t.upsert(one.limit(0), ("job", 1))
    with pytest.raises(RuntimeError, match="someone else"):
        stale.number += 1
        t._commit(stale)
    assert rows(t.read()) == [(1, "x", 9.0), (1, None, 9.0)] and t.version().runs == {"job": 1, "other": 0}


def test_a_write_that_breaks_off_is_not_seen(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    broken = spark.createDataFrame([(1, "c")], "k int, v string").withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        t.upsert(broken)
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.versions() == [0]


def test_a_day_run_again_adds_nothing(spark, tmp_path):
    src, out, cp, again = (str(tmp_path / n) for n in ("in", "out", "cp", "again"))
    schema = "id long, at timestamp, v string"

    def run():
        ingest.insert_batches(ingest.file_stream(spark, src, spark.createDataFrame([], schema).schema), out, ["id"], ["at"], cp, again).awaitTermination(120)
        return rows(KeyedTable(spark, out, ["id"], ["at"]).read().select("id", "v"))

    day = spark.sql("SELECT id, TIMESTAMP'2024-01-01 10:00:00' AS at, concat('v', id) AS v FROM range(50)")
    day.write.parquet(src)
    first = run()
    assert len(first) == 50
    later = day.where("id < 20").withColumn("at", F.expr("at + INTERVAL 3 DAYS")).withColumn("v", F.when(F.col("id") == 3, "changed").otherwise(F.col("v")))
    later.unionByName(spark.sql("SELECT 60L AS id, TIMESTAMP'2024-01-04 10:00:00' AS at, 'new' AS v")).write.mode("append").parquet(src)
    day.write.mode("append").parquet(src)
    assert set(run()) == {*first, (60, "new")}
    repeats = spark.read.parquet(again)
    assert repeats.select("id").distinct().count() == 50 and repeats.where("id = 3 AND NOT same").count() == 1


def test_relations_are_joined_without_a_shuffle(spark, tmp_path, capsys):
    r = spark.createDataFrame([(f"s{k % 50}", "p" if k % 3 else "q", f"o{k}") for k in range(300)], "subject string, predicate string, object string")
    relations.save_relations(r, "test_relations", 4)
    left = relations.save(spark.createDataFrame([(f"s{k}", k) for k in range(60)], "name string, k int"), "test_names", "name", buckets=4)
    got = relations.related(spark, left, "name", ["p"], "test_relations")
    got.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [predicate" in plan.replace("isnotnull(predicate#", "predicate").replace("(predicate", "predicate")
    assert got.count() == 200


def test_data_source_reads_filters_and_writes(spark, tmp_path, capsys):
    for name, text in [("a.md", "one"), ("b/c.TXT", "three"), ("b/d/e.md", "longer text"), ("f/g.md", ""), ("f/_hidden.md", "x")]:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    datasource.register(spark)
    df = spark.read.format("file_catalogue").load(str(tmp_path / "in"))
    assert sorted((r["folder"], r["name"], r["suffix"], r["size"]) for r in df.collect()) == [("", "a.md", ".md", 3), ("b", "c.TXT", ".txt", 5), ("b/d", "e.md", ".md", 11), ("f", "g.md", ".md", 0)]
    few = datasource.files(spark, str(tmp_path / "in"), "suffix = '.md' AND size > 2 AND folder IN ('', 'b/d') AND length(name) = 4")
    few.explain()
    plan = capsys.readouterr().out
    left = plan.split("Filter", 1)[1].split("+-")[0]
    assert "length(name" in left and "suffix" not in left and "size" not in left  # only what the source can't do is left to Spark
    assert sorted(r["name"] for r in few.collect()) == ["a.md", "e.md"]
    out = str(tmp_path / "out")
    df.write.format("file_catalogue").mode("append").save(out)
    df.where("size = 0").write.format("file_catalogue").mode("append").save(out)
    assert spark.read.json(out).count() == 5 and not [f for f in os.listdir(out) if f.startswith("_draft")]
    df.where("size = 0").write.format("file_catalogue").mode("overwrite").save(out)
    assert [r["name"] for r in spark.read.json(out).collect()] == ["g.md"]
    bad = df.withColumn("size", F.when(F.col("size") > 4, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("file_catalogue").mode("append").save(out)
    assert [r["name"] for r in spark.read.json(out).collect()] == ["g.md"]
