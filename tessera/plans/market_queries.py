"""Market, relational, text and streaming-like queries on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import scalar as C
from tessera.operators import geometry as G
from tessera.operators import joins as J
from tessera.operators import knowledge as K
from tessera.operators import market as M
from tessera.operators import text as X
from tessera.plans import views as V
from tessera.plans.views import rounded
from tessera.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_D = "strftime({}, '%Y-%m-%d')"
TODAY = "2024-01-25"


def _quotes(spark, sf):
    return V.nav(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))


_TOTAL = "SELECT series AS code, round(arg_max(nav, day) / arg_min(nav, day) - 1, 6) AS return, count(*) AS n, strftime(max(day), '%Y-%m-%d') AS last_day FROM nav WHERE {} GROUP BY series"


@query(f"WITH {V.NAV} {_TOTAL.format(f'''day BETWEEN DATE '2024-01-01' AND DATE '{TODAY}' AND series IN (1, 2, 3, 5, 8, 13)''')}")
def fund_ytd_return(spark, sf):
    return rounded(M.total_return(M.ytd(_quotes(spark, sf), [1, 2, 3, 5, 8, 13], TODAY)))


@query(f"WITH {V.NAV} {_TOTAL.format(f'''day BETWEEN DATE '{TODAY}' - 14 AND DATE '{TODAY}' ''')}")
def fund_recent_return(spark, sf):
    return rounded(M.total_return(M.recent(_quotes(spark, sf), None, TODAY, 14)))


@query(f"WITH {V.NAV} {_TOTAL.format('''day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' ''')}")
def fund_period_return(spark, sf):
    return rounded(M.total_return(M.period(_quotes(spark, sf), None, F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))))


@query(f"""WITH {V.MONTHLY} SELECT series AS code, {", ".join(f"round(arg_max(nav, day) / arg_min(nav, day) FILTER (day >= DATE '2000-12-31' - {30 * m}) - 1, 6) AS return_{m}m" for m in (1, 3, 6))} FROM monthly WHERE day <= DATE '2000-12-31' GROUP BY series""")
def fund_performance(spark, sf):
    q = V.monthly(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))
    return rounded(M.performance(q, None, "2000-12-31"))


def _holdings(spark, sf):
    """Lines of a supplier's last year as holdings of parts."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("report_date"), F.col("l_partkey").alias("asset"))
    return t.agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("""WITH h AS (SELECT l_suppkey AS code, year(l_shipdate) AS report_date, l_partkey AS asset, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, max(report_date) OVER (PARTITION BY code) AS last FROM h),
r AS (SELECT code, asset, value, row_number() OVER (PARTITION BY code ORDER BY value DESC, asset) AS rank FROM m WHERE report_date = last)
SELECT code, asset, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def fund_holdings(spark, sf):
    return M.latest_holdings(_holdings(spark, sf)).select("code", "asset", "value", "rank")


@query("""WITH h AS (SELECT l_suppkey AS code, l_partkey AS asset, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)
SELECT code, p_type AS industry, sum(weight) AS weight FROM h LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_size > 10) ON asset = p_partkey GROUP BY 1, 2""")
def industry_rollup(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.col("l_partkey").alias("asset")).agg(F.sum("l_quantity").alias("weight"))
    i = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("industry"))
    return M.industry_rollup(h, i)


@query("""SELECT o_custkey AS code, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders WHERE o_orderdate <= DATE '1998-01-01' GROUP BY 1""")
def point_in_time(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("at"), F.col("o_totalprice").alias("price"))
    got = M.point_in_time(t, ["code"], "at", F.lit("19980101999999999999"))
    return rounded(got.select("code", "price", "day"))


@query(f"SELECT DISTINCT {_D.format('ts')} AS day FROM events ORDER BY day DESC LIMIT 7")
def recent_trading_days(spark, sf):
    return rounded(M.recent_days(V.calendar(spark, sf), 7))


@query(f"SELECT {_D.format('max(o_orderdate)')} AS day FROM orders GROUP BY date_trunc('quarter', o_orderdate)")
def reporting_dates(spark, sf):
    return rounded(M.reporting_dates(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') ORDER BY p_name = 'red' DESC, length(p_name), p_name, p_partkey LIMIT 5")
def name_search(spark, sf):
    return M.found_by_name(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "red", 5, ["p_partkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001') ORDER BY s_name, s_suppkey LIMIT 20")
def fund_search_quick(spark, sf):
    return M.search_quick(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "00001", ["s_name", "s_suppkey"])


@query(f"""WITH g AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS value FROM events GROUP BY 1, 2)
SELECT {_D.format('day')} AS day, event_type, round(value, 4) AS value, round(value / sum(value) OVER (PARTITION BY day), 4) AS share FROM g""")
def asset_allocation(spark, sf):
    t = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return rounded(M.shares_by_day(t, "event_type"), 4)


@query(f"""WITH g AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS pnl FROM events GROUP BY 1, 2)
SELECT {_D.format('day')} AS day, event_type, round(pnl, 4) AS pnl, round(sum(pnl) OVER (PARTITION BY event_type ORDER BY day), 4) AS cum_pnl FROM g""")
def cumulative_pnl(spark, sf):
    t = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return rounded(M.running_pnl(t, "event_type"), 4)


@query("""WITH x AS (SELECT p_brand, sum(p_retailprice) AS w, avg(p_size) AS size FROM part GROUP BY 1)
SELECT p_brand, round(w, 2) AS w, round(size, 2) AS size FROM x UNION ALL SELECT 'weighted mean', round(sum(w), 2), round(sum(w * size) / sum(w), 2) FROM x""")
def exposure_by_fund(spark, sf):
    x = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("w"), F.avg("p_size").alias("size"))
    return rounded(M.with_total_row(x, "p_brand", "weighted mean", "w", ["size"]), 2)


@query("SELECT s_suppkey, s_nationkey, round((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6) AS s_acctbal_norm FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def fund_score(spark, sf):
    return rounded(M.minmax(table(spark, sf, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", "s_nationkey", "s_acctbal_norm"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'STANDARD' THEN 'S' ELSE p_type END AS code FROM part")
def name_to_code(spark, sf):
    return table(spark, sf, "part").select("p_partkey", M.name_to_code(F.col("p_type"), {"ECONOMY": "E", "STANDARD": "S"}).alias("code"))


@query("SELECT o_orderkey, try_cast(o_orderstatus AS DOUBLE) AS bad, try_cast(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS good, coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS label FROM orders")
def soft_casts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.soft_double(F.col("o_orderstatus")).alias("bad"), C.soft_double(F.col("o_custkey").cast("string")).alias("good"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("-")).alias("label"))


@query(f"SELECT o_orderkey, {_D.format('o_orderdate - INTERVAL 1 DAY * dayofweek(o_orderdate)')} AS sunday, {_D.format('''date_trunc('quarter', o_orderdate)''')} AS quarter FROM orders")
def date_anchors(spark, sf):
    d = F.to_date("o_orderdate")
    return rounded(table(spark, sf, "orders").select("o_orderkey", C.previous_sunday(d).alias("sunday"), C.period_start(d, 4).alias("quarter")))


# --- counting, set and log operators


@query("""SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3""")
def counter_top(spark, sf):
    return K.counter_top(table(spark, sf, "events"), "event_type", "event_id", 3).select(F.col("event_type").alias("value"), "n")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def latest_by_key(spark, sf):
    return K.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""SELECT s_nationkey, count(*) AS suppliers, count(DISTINCT round(s_acctbal / 1000)) AS bands FROM supplier GROUP BY 1 HAVING count(*) > 1""")
def duplicates_having(spark, sf):
    got = K.repeated_keys(table(spark, sf, "supplier"), ["s_nationkey"], F.round(F.col("s_acctbal") / 1000))
    return got.select("s_nationkey", F.col("rows").alias("suppliers"), F.col("values").alias("bands"))


@query("""SELECT CASE WHEN max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END) >= 3 THEN 'error' ELSE 'warning' END AS status, count(*) AS issues FROM orders""")
def severity_rollup(spark, sf):
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "warning").otherwise("ok")
    return K.status_of(table(spark, sf, "orders").select(sev.alias("severity")))


@query("""SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey""")
def unseen_customers(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.unseen(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@query("""SELECT p_partkey AS id, p_retailprice AS v FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT p_partkey, p_retailprice * 2 FROM part WHERE p_partkey % 10 = 3""")
def upsert(spark, sf):
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    new = old.where("id % 10 = 3").withColumn("v", F.col("v") * 2)
    return J.upserted(old, new, ["id"])


@query("""WITH o(n, kind, region, note) AS (VALUES (1, 'ECONOMY', NULL, 'all economy'), (2, NULL, 'Brand#2', 'all of brand 2'), (3, NULL, NULL, 'rest')),
j AS (SELECT p_partkey, note, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS rn FROM part LEFT JOIN o ON (kind IS NULL OR kind = p_type) AND (region IS NULL OR region = p_brand))
SELECT p_partkey, note FROM j WHERE rn = 1""")
def first_override(spark, sf):
    o = spark.sql("SELECT * FROM VALUES (1, 'ECONOMY', NULL, 'all economy'), (2, NULL, 'Brand#2', 'all of brand 2'), (3, NULL, NULL, 'rest') AS t(n, p_type, p_brand, note)")
    return J.first_override(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), o, ["p_type", "p_brand"], "n", ["p_partkey"]).select("p_partkey", "note")


@query("""WITH s AS (SELECT p_partkey AS id, p_size % 7 AS page, (p_partkey * 7) % 50 AS l, (p_partkey * 13) % 40 AS t, 1 + p_size % 5 AS w, 1 + p_partkey % 4 AS h FROM part),
j AS (SELECT a.page AS page, a.id AS a, b.id AS b, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l) AS w, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t) AS h FROM s a JOIN s b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, CAST(w * h AS DOUBLE) AS area FROM j WHERE w > 0.05 AND h > 0.05""")
def rectangle_overlaps(spark, sf):
    d = lambda e, n: F.expr(e).cast("double").alias(n)
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("p_size % 7").alias("page"), d("(p_partkey * 7) % 50", "left"), d("(p_partkey * 13) % 40", "top"), d("1 + p_size % 5", "width"), d("1 + p_partkey % 4", "height"))
    return G.overlaps(s)


# --- text


@query(r"""SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]+', '', 'g'))) AS k FROM documents""")
def match_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(N.match_key(F.col("text"))).alias("k"))


@query(r"""WITH l AS (SELECT doc_id, ord, trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
k AS (SELECT doc_id, ord, line, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM l WHERE line <> '')
SELECT d.doc_id AS doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY ord), '')) AS compacted FROM documents d LEFT JOIN (SELECT * FROM k WHERE prev IS NULL OR prev <> line) k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def text_compaction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.compacted(F.col("text"))).alias("compacted"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT doc_id, line, count(*) AS c FROM l WHERE length(line) BETWEEN 2 AND 24 GROUP BY 1, 2)
SELECT doc_id, round(sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / sum(c), 6) AS ratio, CAST(sum(c) AS BIGINT) AS short_lines FROM n GROUP BY doc_id""")
def repeated_lines(spark, sf):
    return rounded(X.repeated_line_ratio(table(spark, sf, "documents"), "doc_id"))


@query(r"""WITH d AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), l AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, trim(unnest(string_split(t, chr(10))), ' ') AS line FROM d) WHERE length(line) BETWEEN 2 AND 24 GROUP BY 1, 2),
r AS (SELECT doc_id, sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / sum(c) AS ratio FROM l GROUP BY 1),
v AS (SELECT doc_id, length(t) AS n, CAST(length(t) - length(regexp_replace(t, '[\p{L}\p{N}\s.,;:!?%()\-，。；：！？（）、]', '', 'g')) AS DOUBLE) / greatest(length(t), 1) AS share FROM d)
SELECT v.doc_id AS doc_id, share > 0.9 AS mostly_text, n >= 50 AND share >= 0.3 AND coalesce(ratio, 0) <= 0.28 AS usable FROM v LEFT JOIN r ON v.doc_id = r.doc_id""")
def text_validity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (X.valid_ratio(F.trim(F.coalesce("text", F.lit("")))) > 0.9).alias("mostly_text"), X.is_valid(F.col("text")).alias("usable"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 79), '[\\s,;:.]+$', '') || '…' END AS short FROM documents""")
def text_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.ellipsis(F.col("text"), 80).alias("short"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(token|Licensed|the)', '***', 'g')) AS masked FROM documents""")
def text_mask(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.masked(F.col("text"), ["the", "token", "Licensed"])).alias("masked"))


@query("""SELECT doc_id, CASE WHEN strpos(text, 'token') > 0 THEN length(left(text, strpos(text, 'token') - 1)) ELSE length(text) END AS kept FROM documents""")
def text_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.cut_at(F.col("text"), ["token"])).cast("long").alias("kept"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_&.\-]+')) AS BIGINT) AS words, regexp_extract(text, '[A-Za-z][A-Za-z0-9_&.\-]+') AS first_word FROM documents""")
def latin_words(spark, sf):
    w = N.latin_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).alias("first_word"))


@query("""SELECT doc_id, substr(sha256(lower(concat_ws('|', lang, source, CAST(doc_id AS VARCHAR)))), 1, 16) AS item_id FROM documents""")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.stable_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("item_id"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT r_name, n_name, sum(s_acctbal) AS total, grouping(r_name) AS g1, grouping(n_name) AS g2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""".replace("sum(s_acctbal) AS total, grouping(r_name) AS g1, grouping(n_name) AS g2", "round(sum(s_acctbal), 2) AS total"))
def rollup_totals(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return t.rollup("r_name", "n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(sid AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def sessionized(spark, sf):
    t = K.sessions_of(table(spark, sf, "events"), "user_id", "ts", "event_id", 6 * 3600)
    return t.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- trends, comparisons and the knowledge base on invented notes


@query(f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value AS w, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS x FROM events)
SELECT {_D.format('day')} AS day, event_type, round(sum(w * x) / sum(w) FILTER (x IS NOT NULL), 6) AS exposure, round(coalesce(sum(w) FILTER (x IS NOT NULL), 0) / sum(w), 6) AS coverage FROM e GROUP BY 1, 2""")
def exposure_trend(spark, sf):
    from tessera.operators.attribution import weighted_exposure

    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("value").alias("weight"), F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k").cast("double")).alias("exposure"))
    return rounded(weighted_exposure(e, ["day", "event_type"]))


@query(f"""WITH {V.FACTOR}, r AS (SELECT series, day, nav / first(nav) OVER (PARTITION BY series ORDER BY day) AS v FROM factor)
SELECT a.series AS series, {_D.format('a.day')} AS day, round(a.v - b.v, 6) AS excess FROM r a JOIN r b ON a.day = b.day AND b.series = 'view' WHERE a.series <> 'view'""")
def benchmark_comparison(spark, sf):
    from tessera.operators.series import against_benchmark

    return rounded(against_benchmark(V.factor(spark, sf), "view"))


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 DAY - INTERVAL 1 DAY * 30, '%Y-%m-%d') AS prev_begin, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS prev_end FROM orders")
def analysis_windows(spark, sf):
    from tessera.operators.attribution import previous_window

    d = F.to_date("o_orderdate")
    a, b = previous_window(d, F.date_add(d, 30))
    return rounded(table(spark, sf, "orders").select("o_orderkey", a.alias("prev_begin"), b.alias("prev_end")))


@query("""WITH t AS (SELECT n_name, s_name, s_acctbal / 10000 AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY c DESC, s_name) AS rn FROM t WHERE c > 0)
SELECT n_name, string_agg(s_name, '，' ORDER BY rn) AS names FROM r WHERE rn <= 2 GROUP BY 1""")
def top_names(spark, sf):
    from tessera.plans.report import top_text

    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("n_name", "s_name", (F.col("s_acctbal") / 10_000).alias("c"))
    return top_text(t, ["n_name"], "s_name", "c").select("n_name", F.regexp_replace("text", "（[^）]*）", "").alias("names"))


@query("""SELECT n_nationkey, n_name, string_agg(s_name, chr(10) ORDER BY s_name) AS products FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def manager_rollup(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return K.listed_by(t, ["n_nationkey", "n_name"], "s_name").withColumnRenamed("listed", "products")
