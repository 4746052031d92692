"""Queries on stored tables: keyed upserts, reruns of a day, bucketed relations, catalogues of files; with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import knowledge as K
from tessera.plans import knowledge_views as V
from tessera.session import fresh_path, table
from tessera.sources import datasource, relations
from tessera.sources.keyed import KeyedTable

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END AS seq FROM orders
UNION ALL SELECT -1 - o_orderkey, o_totalprice, 'N', 1 FROM orders WHERE o_orderkey % 13 = 0""")
def keyed_upsert(spark, sf):
    """Orders written once, then a batch of updates, rows that come too late, and new keys; a batch that is repeated changes nothing."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    held = KeyedTable(spark, fresh_path(spark, "orders"), ["o_orderkey"], ["seq"], buckets=16)
    held.upsert(o.withColumn("seq", F.lit(2)), ("load", 0))
    newer = o.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"), F.lit(3).alias("seq"))
    late = o.where("o_orderkey % 11 = 0").select("o_orderkey", (F.col("o_totalprice") - 1).alias("o_totalprice"), F.lit("L").alias("o_orderstatus"), F.lit(1).alias("seq"))
    new = o.where("o_orderkey % 13 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit("N").alias("o_orderstatus"), F.lit(1).alias("seq"))
    batch = newer.unionByName(late).unionByName(new)
    held.upsert(batch, ("load", 1))
    held.upsert(batch.withColumn("seq", F.lit(9)), ("load", 1))
    held.expire(1)
    return held.read()


@query("""WITH e AS (SELECT event_id, event_type, value FROM events)
SELECT event_type, count(*) AS events, CAST(sum(value) AS DOUBLE) AS total, count(*) FILTER (event_id % 5 = 0) AS repeats, count(*) FILTER (event_id % 10 = 0) AS conflicting FROM e GROUP BY 1""")
def rerun_day(spark, sf):
    """Events of the first half, then all again with some changed: each is written once, and what came again is told apart."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    held = KeyedTable(spark, fresh_path(spark, "events"), ["event_id"], buckets=16)
    held.insert(e.where("event_id % 5 = 0"), ("day", 0))
    again = held.insert(e.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value"))), ("day", 1))
    held.insert(e, ("day", 1))
    told = again.groupBy("event_type").agg(F.count(F.lit(1)).alias("repeats"), F.count_if(~F.col("same")).alias("conflicting"))
    written = held.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return written.join(told, "event_type", "left").select("event_type", "events", "total", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("conflicting", F.lit(0)).alias("conflicting"))


@query(f"""WITH {V.PROFILES_CTE}, r AS (SELECT DISTINCT trim(product_name) AS subject, 'has_strategy' AS predicate, trim(secondary_tag) AS object, manager FROM profiles WHERE secondary_tag <> ''
UNION SELECT DISTINCT trim(product_name), 'has_risk_point', trim(risk_point), manager FROM profiles WHERE risk_point <> ''),
p AS (SELECT product_name, count(*) AS profiles FROM profiles GROUP BY 1)
SELECT product_name, profiles, predicate, object, manager FROM p JOIN r ON p.product_name = r.subject WHERE predicate = 'has_strategy'""")
def relation_reads(spark, sf):
    """Products with their relations of one predicate, both stored in buckets: the join reads one folder and shuffles nothing."""
    p = V.profiles(spark, sf)
    held = relations.save_relations(K.relations(p, {"secondary_tag": "has_strategy", "risk_point": "has_risk_point"}), "profile_relations", 8)
    names = relations.save(p.groupBy("product_name").agg(F.count(F.lit(1)).alias("profiles")), "profile_names", "product_name", buckets=8)
    got = relations.related(spark, names, "product_name", ["has_strategy"], "profile_relations")
    return got.join(held.where("predicate = 'has_strategy'").select("subject", "object", "manager").hint("merge"), ["subject", "object"]).select("product_name", "profiles", "predicate", "object", "manager")


@query("SELECT 'brand=' || p_brand AS folder, '.json' AS suffix, count(DISTINCT p_brand) AS files, true AS filled FROM part GROUP BY p_brand")
def file_source(spark, sf):
    """Files of a folder through the library's own data source, with filters on suffix and size pushed into it."""
    path = fresh_path(spark, "files")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_partkey", "p_name")
    p.repartition("brand").write.partitionBy("brand").json(path)
    got = datasource.files(spark, path, "suffix = '.json' AND size > 0")
    return got.withColumn("folder", F.url_decode("folder")).groupBy("folder", "suffix").agg(F.count(F.lit(1)).alias("files"), (F.min("size") > 0).alias("filled"))
