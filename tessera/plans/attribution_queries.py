"""Queries of attribution, exposures and the joins they need."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import joins as J
from tessera.operators import series as S
from tessera.operators.risk import risk_parity as _risk_parity
from tessera.plans import views as V
from tessera.plans.views import BEGIN, BEGIN_M, END, END_M, rounded
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


def _panel(spark, sf):
    """Monthly price level and share of quantity of each region."""
    t = table(spark, sf, "lineitem").join(V.hierarchy(spark, sf), F.col("l_suppkey") == F.col("fund_id"))
    g = t.groupBy("strategy", F.trunc(F.to_date("l_shipdate"), "month").alias("day")).agg(F.avg("l_extendedprice").alias("nav"), F.sum("l_quantity").alias("q"))
    return g.withColumn("weight", F.col("q") / F.sum("q").over(W.partitionBy("day")))


_PANEL = f"""{V.HIERARCHY}, panel AS (
  SELECT strategy, day, nav, q / sum(q) OVER (PARTITION BY day) AS weight FROM (
    SELECT strategy, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, avg(l_extendedprice) AS nav, sum(l_quantity) AS q
    FROM lineitem JOIN hierarchy ON l_suppkey = fund_id GROUP BY 1, 2))"""
_STRATEGY = f"""t AS (SELECT *, lag(day) OVER w AS prev_day, lag(weight) OVER w AS prev_weight, nav / lag(nav) OVER w - 1 AS ret FROM panel WHERE day <= DATE '{END_M}' WINDOW w AS (PARTITION BY strategy ORDER BY day)),
layer AS (SELECT strategy, avg(weight) FILTER (day > DATE '{BEGIN_M}') AS avg_weight, arg_max(nav, day) / arg_max(nav, day) FILTER (day <= DATE '{BEGIN_M}') - 1 AS interval_return,
  sum(ret * prev_weight) FILTER (day > DATE '{BEGIN_M}' AND prev_day >= DATE '{BEGIN_M}') AS contribution FROM t GROUP BY strategy)"""


@query(f"WITH {_PANEL}, {_STRATEGY} SELECT strategy, round(avg_weight, 6) AS avg_weight, round(interval_return, 6) AS interval_return, round(contribution, 6) AS contribution FROM layer")
def strategy_layer(spark, sf):
    return rounded(A.strategy_layer(_panel(spark, sf), F.lit(BEGIN_M).cast("date"), F.lit(END_M).cast("date")))


@query(f"WITH {_PANEL}, {_STRATEGY} SELECT strategy AS main_strategy, round(contribution, 6) AS contribution FROM layer ORDER BY abs(contribution) DESC, strategy LIMIT 1")
def main_strategy(spark, sf):
    t = A.strategy_layer(_panel(spark, sf), F.lit(BEGIN_M).cast("date"), F.lit(END_M).cast("date"))
    return rounded(A.largest_contribution(t, "strategy").select(F.col("strategy").alias("main_strategy"), "contribution"))


def _track_rows(spark, sf):
    """Yearly contributions of nations: increments, and running totals for every other nation."""
    t = table(spark, sf, "lineitem").join(V.hierarchy(spark, sf), F.col("l_suppkey") == F.col("fund_id"))
    g = t.groupBy("strategy", "track", F.year("l_shipdate").alias("day")).agg((F.avg("l_discount") - 0.05).alias("inc"))
    run = F.sum(F.col("inc") + 0.05).over(W.partitionBy("track").orderBy("day"))
    number = F.regexp_extract("track", r"(\d+)", 1).cast("int")
    return g.withColumn("value", F.when(number % 2 == 0, F.col("inc")).otherwise(run))


_TRACKS = f"""{V.HIERARCHY}, tr AS (
  SELECT strategy, track, day, CASE WHEN CAST(regexp_extract(track, '(\\d+)', 1) AS INT) % 2 = 0 THEN inc ELSE sum(inc + 0.05) OVER (PARTITION BY track ORDER BY day) END AS value FROM (
    SELECT strategy, track, year(l_shipdate) AS day, avg(l_discount) - 0.05 AS inc FROM lineitem JOIN hierarchy ON l_suppkey = fund_id GROUP BY 1, 2, 3)),
st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY strategy, track ORDER BY day)) AS step FROM tr),
iv AS (SELECT strategy, track, count(*) AS n, coalesce(count(*) >= 3 AND median(abs(value)) > 0 AND median(step) / nullif(median(abs(value)), 0) < 0.7, false) AS is_cumulative,
  arg_max(value, day) - arg_min(value, day) AS diff, sum(value) AS total, product(1 + value) - 1 AS compound FROM st GROUP BY strategy, track),
layer AS (SELECT strategy, track, n, is_cumulative, CASE WHEN is_cumulative THEN diff ELSE total END AS total, CASE WHEN is_cumulative THEN diff ELSE compound END AS compound FROM iv)"""


@query(f"WITH {_TRACKS} SELECT strategy, track, n, is_cumulative, round(total, 6) AS total, round(compound, 6) AS compound FROM layer")
def interval_values(spark, sf):
    return rounded(A.interval_values(_track_rows(spark, sf), ["strategy", "track"]))


@query(f"""WITH {_TRACKS}, d AS (SELECT strategy, track, total, abs(total) * 10000 >= 400 AS big, max(abs(total)) OVER (PARTITION BY strategy) * 10000 >= 400 AS anyone,
  row_number() OVER (PARTITION BY strategy ORDER BY total, track) AS lo, row_number() OVER (PARTITION BY strategy ORDER BY total DESC, track) AS hi FROM layer)
SELECT strategy, track, round(total, 6) AS total, CASE WHEN anyone THEN '|contrib|>=400bp' ELSE 'top2/bottom2' END AS reason FROM d WHERE CASE WHEN anyone THEN big ELSE lo <= 2 OR hi <= 2 END""")
def track_drilldown(spark, sf):
    t = A.interval_values(_track_rows(spark, sf), ["strategy", "track"]).select("strategy", "track", "total")
    return rounded(A.drilldown(t, "track", "total", ["strategy"], threshold_bp=400.0))


@query("""SELECT n_name, s_name, s_acctbal FROM (SELECT n_name, s_name, s_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal, s_name) AS lo, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_name) AS hi
FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE lo <= 2 OR hi <= 2""")
def top_and_bottom(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("n_name", "s_name", "s_acctbal")
    return A.top_and_bottom(t, ["n_name"], "s_acctbal", "s_name", 2)


def _bars(spark, sf):
    """Weekly bars of users: last value, and the week's yield; every third user's yields run on."""
    nav = V.nav(spark, sf).select(F.col("series").alias("fund_id"), F.date_sub("day", F.dayofweek("day") - 1).alias("week"), "day", "nav")
    g = nav.groupBy("fund_id", F.col("week").alias("day")).agg(F.max_by("nav", "day").alias("nav"), ((F.max_by("nav", "day") - F.min_by("nav", "day")) / 1000).alias("inc"))
    run = F.sum(F.abs("inc") + 0.1).over(W.partitionBy("fund_id").orderBy("day"))
    return g.select("fund_id", "day", F.concat(F.lit("fund "), F.col("fund_id")).alias("name"), "nav", F.when(F.col("fund_id") % 3 == 0, run).otherwise(F.col("inc")).alias("yield"))


def _funds(spark, sf):
    ids = V.nav(spark, sf).select(F.col("series").alias("fund_id")).distinct()
    tracks = ids.where("fund_id % 4 <> 0").select("fund_id", F.concat(F.lit("track fund "), F.col("fund_id")).alias("name"), F.concat(F.lit("track "), F.col("fund_id") % 6).alias("track"), ((F.col("fund_id") % 5) / 100).alias("ratio"))
    weights = ids.where("fund_id % 7 <> 0").select("fund_id", ((F.col("fund_id") % 9) / 200).alias("weight"))
    return A.fund_layer(_bars(spark, sf), tracks, weights, F.lit(BEGIN).cast("date"), F.lit(END).cast("date"), 0.25, 0.4)


_FUNDS = f"""{V.NAV}, wk AS (SELECT series AS fund_id, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS week, day, nav FROM nav),
b0 AS (SELECT fund_id, week AS day, arg_max(nav, day) AS nav, (arg_max(nav, day) - arg_min(nav, day)) / 1000 AS inc FROM wk GROUP BY fund_id, week),
bars AS (SELECT fund_id, day, nav, CASE WHEN fund_id % 3 = 0 THEN sum(abs(inc) + 0.1) OVER (PARTITION BY fund_id ORDER BY day) ELSE inc END AS y FROM b0),
lim AS (SELECT CAST(DATE '{BEGIN}' - CAST(dayofweek(DATE '{BEGIN}') AS INTEGER) AS DATE) AS lo, CAST(DATE '{END}' - CAST(dayofweek(DATE '{END}') AS INTEGER) AS DATE) AS hi),
f1 AS (SELECT b.*, lo, lag(day) OVER w AS prev_day, nav / lag(nav) OVER w - 1 AS r, y - lag(y) OVER w AS dy FROM bars b, lim WHERE day BETWEEN lo AND hi WINDOW w AS (PARTITION BY fund_id ORDER BY day)),
kind AS (SELECT fund_id, coalesce(count(*) >= 3 AND median(abs(y)) > 0 AND median(abs(dy)) / nullif(median(abs(y)), 0) < 0.7, false) AS cum FROM f1 GROUP BY fund_id),
f2 AS (SELECT fund_id, day, coalesce(day > lo AND prev_day >= lo, false) AS valid, CASE WHEN cum THEN dy ELSE y END AS inc, r FROM f1 JOIN kind USING (fund_id)),
f3 AS (SELECT fund_id, day, valid, CASE WHEN valid THEN coalesce(inc, 0) ELSE 0 END AS raw, CASE WHEN valid THEN r END AS r FROM f2),
f4 AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY fund_id ORDER BY day ROWS UNBOUNDED PRECEDING)) AS growth FROM f3),
f5 AS (SELECT *, growth / max(growth) OVER (PARTITION BY fund_id ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM f4),
f6 AS (SELECT fund_id, sum(raw) AS raw, sum(abs(raw)) AS abs_raw, count(*) FILTER (raw <> 0) AS bar_count, arg_max(growth, day) FILTER (r IS NOT NULL) - 1 AS fund_return, min(fall) AS fund_mdd, count(*) FILTER (valid) AS valid_rows FROM f5 GROUP BY fund_id),
f7 AS (SELECT *, fund_id % 4 <> 0 AS mapped, CASE WHEN fund_id % 4 <> 0 THEN (fund_id % 5) / 100 END AS tw, CASE WHEN fund_id % 7 <> 0 THEN (fund_id % 9) / 200 END AS ow FROM f6),
f8 AS (SELECT *, coalesce(CASE WHEN tw > 0 THEN tw END, ow, 0) AS weight, coalesce(fund_return, 0) * coalesce(CASE WHEN tw > 0 THEN tw END, ow, 0) * CASE WHEN tw > 0 THEN 0.4 ELSE 1 END AS by_return FROM f7),
sc AS (SELECT CASE WHEN 0.25 / nullif(sum(raw), 0) BETWEEN 0.05 AND 5 THEN 0.25 / sum(raw) END AS a, CASE WHEN 0.25 / nullif(sum(by_return), 0) BETWEEN 0.05 AND 5 THEN 0.25 / sum(by_return) END AS b FROM f8)"""


@query(f"""WITH {_FUNDS} SELECT fund_id, CASE WHEN mapped THEN 'track fund ' ELSE 'fund ' END || fund_id AS name, CASE WHEN mapped THEN 'track ' || (fund_id % 6) ELSE '{A.UNMAPPED}' END AS track,
  round(weight, 6) AS weight, bar_count, round(fund_return, 6) AS fund_return, round(fund_mdd, 6) AS fund_mdd, round(CASE WHEN a IS NOT NULL THEN raw * a ELSE by_return * coalesce(b, 1) END, 6) AS contribution FROM f8, sc""")
def fund_layer(spark, sf):
    return rounded(_funds(spark, sf).select("fund_id", "name", "track", "weight", "bar_count", "fund_return", "fund_mdd", "contribution"))


@query(f"WITH {_FUNDS} SELECT round(sum(valid_rows) FILTER (mapped) / sum(valid_rows), 6) AS by_rows, round(sum(abs_raw) FILTER (mapped) / sum(abs_raw), 6) AS by_size FROM f8")
def mapping_coverage(spark, sf):
    return rounded(A.mapping_coverage(_funds(spark, sf)))


def _exposures(spark, sf):
    p = table(spark, sf, "part")
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double"))
    return p.select("p_brand", "p_type", F.col("p_retailprice").alias("weight"), F.inline(F.array(F.struct(F.lit("size").alias("factor"), size.alias("exposure")), F.struct(F.lit("price").alias("factor"), F.log("p_retailprice").alias("exposure")))))


_EXPOSURES = """e AS (SELECT p_brand, p_type, p_retailprice AS weight, 'size' AS factor, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS exposure FROM part
UNION ALL SELECT p_brand, p_type, p_retailprice, 'price', ln(p_retailprice) FROM part)"""
_WEIGHTED = "round(sum(weight * exposure) / sum(weight) FILTER (exposure IS NOT NULL), 6) AS exposure, round(coalesce(sum(weight) FILTER (exposure IS NOT NULL), 0) / sum(weight), 6) AS coverage"


@query(f"WITH {_EXPOSURES} SELECT p_brand, factor, {_WEIGHTED} FROM e GROUP BY p_brand, factor")
def weighted_exposure(spark, sf):
    return rounded(A.weighted_exposure(_exposures(spark, sf), ["p_brand", "factor"]))


@query(f"""WITH {_EXPOSURES}, s AS (SELECT p_type, factor, sum(weight * exposure) / sum(weight) FILTER (exposure IS NOT NULL) AS x, sum(weight) FILTER (exposure IS NOT NULL) / sum(weight) AS c FROM e GROUP BY 1, 2),
w AS (SELECT p_type, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS w FROM part GROUP BY 1)
SELECT factor, round(sum(w * x), 6) AS exposure, round(sum(w * c) / sum(w), 6) AS coverage FROM s JOIN w USING (p_type) GROUP BY factor""")
def portfolio_exposure(spark, sf):
    x = A.weighted_exposure(_exposures(spark, sf), ["p_type", "factor"])
    p = table(spark, sf, "part")
    w = p.groupBy("p_type").agg(F.sum("p_retailprice").alias("v")).crossJoin(F.broadcast(p.agg(F.sum("p_retailprice").alias("t")))).select("p_type", (F.col("v") / F.col("t")).alias("weight"))
    return rounded(A.portfolio_exposure(x, w, "p_type"))


_FACTORS = f"{V.FACTOR}, r AS (SELECT series AS factor, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM factor)"


def _factor_returns(spark, sf):
    return S.changes(V.factor(spark, sf)).select(F.col("series").alias("factor"), "day", "ret")


@query(f"""WITH {_FACTORS}, g AS (SELECT factor, day, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY factor ORDER BY day ROWS UNBOUNDED PRECEDING)) AS growth FROM r WHERE ret IS NOT NULL),
d AS (SELECT *, growth / max(growth) OVER (PARTITION BY factor ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM g)
SELECT factor, round(arg_max(growth, day) - 1, 6) AS factor_return, round(stddev_samp(ret) * sqrt(252), 6) AS factor_vol, round(min(fall), 6) AS factor_mdd, round(sum(ret), 6) AS sum_yield FROM d GROUP BY factor""")
def factor_stats(spark, sf):
    return rounded(A.factor_stats(_factor_returns(spark, sf)))


@query(f"""WITH {_FACTORS}, x AS (SELECT event_type AS factor, CAST(ts AS DATE) AS day, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 100 AS exposure FROM events WHERE day(ts) % 4 = 0 GROUP BY 1, 2)
SELECT r.factor AS factor, count(x.exposure) AS days, round(sum(x.exposure * r.ret) * 10000, 4) AS contrib_bp FROM r ASOF LEFT JOIN x ON r.factor = x.factor AND r.day >= x.day WHERE r.ret IS NOT NULL GROUP BY r.factor""")
def factor_contribution(spark, sf):
    e = table(spark, sf, "events").where(F.dayofmonth("ts") % 4 == 0)
    x = e.groupBy(F.col("event_type").alias("factor"), F.to_date("ts").alias("day")).agg((F.avg(F.get_json_object("props", "$.k").cast("double")) / 100).alias("exposure"))
    got = J.asof(_factor_returns(spark, sf).where("ret IS NOT NULL"), x, ["factor"], "day", ["exposure"])
    return got.groupBy("factor").agg(F.count("exposure").alias("days"), F.round(F.sum(F.col("exposure") * F.col("ret")) * 10_000, 4).alias("contrib_bp"))


@query("""WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view')
SELECT l.event_id AS event_id, l.user_id AS user_id, l.value AS value, r.view_id AS view_id, r.view_value AS view_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return J.asof(left, right, ["user_id"], "ts", ["view_id", "view_value"], tie="view_id").select("event_id", "user_id", "value", "view_id", "view_value")


@query(f"WITH {V.NAV} SELECT series, round(arg_max(nav, day), 6) AS nav, {_D.format('max(day)')} AS day FROM nav WHERE day <= DATE '{BEGIN}' GROUP BY series")
def last_at_or_before(spark, sf):
    return rounded(J.last_at(V.nav(spark, sf), ["series"], "day", "nav", F.lit(BEGIN).cast("date")))


@query("""SELECT p_partkey, coalesce(m, false) AS matched FROM part LEFT JOIN (SELECT DISTINCT l_partkey, true AS m FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey""")
def marked_left_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.marked_left(p, big, ["p_partkey"])


@query("""WITH g AS (SELECT r_name, year(o_orderdate) AS y, n_nationkey, sum(o_totalprice) AS v, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
s AS (SELECT r_name, y, sum(v) AS v, count(*) AS n, avg(m) / 100000 - 1 AS rp, (min(m) + max(m)) / 200000 - 1 AS rb FROM g GROUP BY 1, 2),
w AS (SELECT *, v / sum(v) OVER (PARTITION BY y) AS wp, n / sum(n) OVER (PARTITION BY y) AS wb FROM s)
SELECT r_name, y, round((wp - wb) * (rb - sum(wb * rb) OVER (PARTITION BY y)), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM w""")
def brinson_attribution(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    t = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    g = t.groupBy("r_name", F.year("o_orderdate").cast("long").alias("y"), "n_nationkey").agg(F.sum("o_totalprice").alias("v"), F.avg("o_totalprice").alias("m"))
    s = g.groupBy("r_name", "y").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"), (F.avg("m") / 100_000 - 1).alias("rp"), ((F.min("m") + F.max("m")) / 200_000 - 1).alias("rb"))
    w = s.withColumns({"wp": F.col("v") / F.sum("v").over(W.partitionBy("y")), "wb": F.col("n") / F.sum("n").over(W.partitionBy("y"))})
    return rounded(A.brinson(w, ["y"]).select("r_name", "y", "allocation", "selection", "interaction"))


@query(f"""WITH {V.NAV} SELECT series AS fund_id, {_D.format('day')} AS day, round(nav, 6) AS nav FROM nav""")
def unnest_bars(spark, sf):
    n = V.nav(spark, sf)
    rows = n.groupBy("day").agg(F.to_json(F.collect_list(F.struct(F.col("series").alias("FundID"), F.col("nav").alias("NetValue")))).alias("r"))
    doc = rows.select(F.concat(F.lit('{"'), F.date_format("day", "yyyy-MM-dd"), F.lit('":'), F.col("r"), F.lit("}")).alias("bar"))
    return rounded(A.unnested_bars(doc).select(F.col("FundID").alias("fund_id"), "day", F.col("NetValue").alias("nav")))


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS trading_day, event_type AS name, round(sum(value), 4) AS pnl FROM events GROUP BY 1, 2""")
def pnl_by_period(spark, sf):
    g = table(spark, sf, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("trading_day"), "event_type").agg(F.sum("value").alias("v"))
    doc = g.groupBy("trading_day").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "v")))).alias("data"))
    return rounded(A.period_pnl(doc), 4)


@query("""WITH g AS (SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'view') AS vn, sum(value) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'click') AS cn FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, 'view' AS name, 'contribution' AS measure, round(v, 4) AS value FROM g UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'view', 'return', round(vn, 4) FROM g
UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'click', 'contribution', round(c, 4) FROM g UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'click', 'return', round(cn, 4) FROM g""")
def unpivot_columns(spark, sf):
    g = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"))
    pick = lambda k, f: f(F.when(F.col("event_type") == k, F.col("value")))
    wide = g.agg(pick("view", F.sum).alias("view贡献"), pick("view", F.count).alias("view收益"), pick("click", F.sum).alias("click贡献"), pick("click", F.count).alias("click收益"))
    return rounded(A.unpivoted(wide, ["day"], {"贡献": "contribution", "收益": "return"}), 4)


@query(f"""WITH RECURSIVE {V.FACTOR}, r AS (SELECT series, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM factor),
p AS (SELECT x.series AS a, y.series AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y ON x.day = y.day WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2),
m AS (SELECT list(a ORDER BY a) AS names, list(c ORDER BY a) AS c, CAST(count(*) AS DOUBLE) AS n FROM (SELECT a, list(cov ORDER BY b) AS c FROM p GROUP BY a)),
step(k, x) AS (SELECT 0, list_transform(c, lambda v, i: 1 / sqrt(n * v[i])) FROM m
  UNION ALL SELECT k + 1, list_transform(x, lambda v, i: (v + (sqrt((list_dot_product(c[i], x) - c[i][i] * v) ** 2 + 4 * c[i][i] / n) - list_dot_product(c[i], x) + c[i][i] * v) / (2 * c[i][i])) / 2) FROM step, m WHERE k < 300),
w AS (SELECT unnest(names) AS series, unnest(x) AS x, unnest(list_transform(c, lambda v, i: list_dot_product(v, x) * x[i])) AS risk FROM step, m WHERE k = 300)
SELECT series, round(x / sum(x) OVER (), 6) AS weight, round(risk / sum(risk) OVER (), 6) AS risk_share FROM w""")
def risk_parity(spark, sf):
    return rounded(_risk_parity(S.changes(V.factor(spark, sf))))
