"""Views that give the library's operators their input from the star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.session import table

#: The interval of the indicators on daily values, and of those on monthly ones.
BEGIN, END = "2024-01-06", "2024-01-28"
BEGIN_M, END_M = "1996-06-01", "2000-12-31"


def nav(spark: SparkSession, sf: str) -> DataFrame:
    """Net asset values of a user by day: 1000 and the mean event value."""
    t = table(spark, sf, "events").where("value > 0").groupBy(F.col("user_id").alias("series"), F.to_date("ts").alias("day"))
    return t.agg((1000 + F.avg("value")).alias("nav"))


def factor(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value of an event type and day."""
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day"))
    return t.agg(F.avg("value").alias("nav"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price of a supplier's lines by month of shipping."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"))
    return t.agg(F.avg("l_extendedprice").alias("nav"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Region as strategy, nation as track, supplier as fund, with the fund's share of its track."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    t = t.select(F.col("r_name").alias("strategy"), F.col("n_name").alias("track"), F.col("s_suppkey").alias("fund_id"), F.col("s_name").alias("name"), F.greatest("s_acctbal", F.lit(0.0)).alias("size"))
    return t.withColumn("weight", F.try_divide("size", F.sum("size").over(W.partitionBy("track"))))


NAV = "nav AS (SELECT user_id AS series, CAST(ts AS DATE) AS day, 1000 + avg(value) AS nav FROM events WHERE value > 0 GROUP BY 1, 2)"
FACTOR = "factor AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, avg(value) AS nav FROM events GROUP BY 1, 2)"
MONTHLY = "monthly AS (SELECT l_suppkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, avg(l_extendedprice) AS nav FROM lineitem GROUP BY 1, 2)"
CALENDAR = "calendar AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
HIERARCHY = """hierarchy AS (
  SELECT strategy, track, fund_id, name, size, size / nullif(sum(size) OVER (PARTITION BY track), 0) AS weight FROM (
    SELECT r_name AS strategy, n_name AS track, s_suppkey AS fund_id, s_name AS name, greatest(s_acctbal, 0.0) AS size
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, days as text: what results are compared by."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.date_format(c, "yyyy-MM-dd").alias(c) if k == "date" else F.col(c) for c, k in df.dtypes])
