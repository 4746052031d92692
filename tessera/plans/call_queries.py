"""Data calls on the star schema: plain scans by keys and days, and the joins of several such, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import market as M
from tessera.operators import series as S
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


#: Name of a call: table that stands for its own, columns, key and keys, day and interval.
SCANS = {
    "cb_list": ("part", ["p_partkey", "p_name", "p_brand"], None, None, None, None, None),
    "cb_daily_market_data": ("orders", ["o_custkey", "o_orderdate", "o_totalprice"], "o_custkey", [1, 4, 7], "o_orderdate", "1995-01-01", "1996-12-31"),
    "etf_daily_market_data": ("orders", ["o_custkey", "o_orderdate", "o_totalprice"], "o_custkey", [2, 5], "o_orderdate", "1996-01-01", None),
    "forex_hist_em": ("events", ["event_type", "ts", "value"], "event_type", ["click"], None, None, None),
    "open_fund_list": ("supplier", ["s_suppkey", "s_name", "s_nationkey"], None, None, None, None, None),
    "get_fund_in_label": ("customer", ["c_custkey", "c_mktsegment"], "c_mktsegment", ["BUILDING", "MACHINERY"], None, None, None),
    "fund_scale": ("supplier", ["s_suppkey", "s_acctbal"], "s_suppkey", [1, 2, 3], None, None, None),
    "fund_stock_info_hreport": ("lineitem", ["l_suppkey", "l_partkey", "l_shipdate", "l_quantity"], "l_suppkey", [1, 2], "l_shipdate", "1997-01-01", "1997-06-30"),
    "future_product_list": ("nation", ["n_nationkey", "n_name"], None, None, None, None, None),
    "future_daily_market_data": ("lineitem", ["l_partkey", "l_shipdate", "l_extendedprice"], "l_partkey", [1, 2, 3], "l_shipdate", "1994-01-01", "1997-12-31"),
    "index_price": ("orders", ["o_custkey", "o_orderdate", "o_totalprice"], "o_custkey", [10, 11], None, None, None),
    "risk_factor_returns": ("events", ["event_type", "ts", "value"], "event_type", ["view", "purchase"], None, None, None),
    "index_component": ("lineitem", ["l_orderkey", "l_partkey", "l_quantity"], "l_orderkey", [1, 2, 3, 5], None, None, None),
    "macro_bank_usa_interest_rate": ("region", ["r_regionkey", "r_name"], None, None, None, None, None),
    "macro_usa_non_farm": ("nation", ["n_nationkey", "n_regionkey"], None, None, None, None, None),
    "option_contract_list": ("part", ["p_partkey", "p_type"], "p_type", ["ECONOMY"], None, None, None),
    "option_daily_market_data": ("lineitem", ["l_partkey", "l_shipdate", "l_discount"], "l_partkey", [7], "l_shipdate", None, "1998-01-01"),
    "pm_subfund_nav": ("orders", ["o_custkey", "o_orderdate", "o_totalprice"], "o_custkey", [13], "o_orderdate", None, "1998-08-01"),
    "pm_info_list": ("customer", ["c_custkey", "c_name", "c_nationkey"], "c_nationkey", [1, 3], None, None, None),
    "pm_strategy_benchmark": ("nation", ["n_nationkey", "n_name"], "n_regionkey", [1], None, None, None),
    "spot_hist_sge": ("events", ["user_id", "ts", "value"], "user_id", [1], None, None, None),
    "stock_list": ("part", ["p_partkey", "p_name"], None, None, None, None, None),
    "stock_daily_quote": ("lineitem", ["l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"], "l_partkey", [11, 12], "l_shipdate", "1995-01-01", "1995-12-31"),
    "stock_industry": ("part", ["p_partkey", "p_type"], "p_partkey", [1, 2, 3], None, None, None),
    "industry_list": ("region", ["r_name"], None, None, None, None, None),
    "security_master": ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], None, None, None, None, None),
    "index_list": ("nation", ["n_nationkey", "n_name"], "n_nationkey", [0, 1, 2, 3], None, None, None),
}
_DAYS = {"o_orderdate", "l_shipdate", "ts"}


def _scan(name: str):
    tab, columns, key, keys, day, start, end = SCANS[name]

    def run(spark, sf):
        t = M.fetched(table(spark, sf, tab), key, keys, day, start, end, columns)
        return t.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in _DAYS else F.col(c) for c in columns])

    rules = [f"{key} IN ({', '.join(map(repr, keys))})"] if keys else []
    rules += [f"{day} >= DATE '{start}'"] if start else []
    rules += [f"{day} <= DATE '{end}'"] if end else []
    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(f'''strftime({c}, '%Y-%m-%d') AS {c}''' if c in _DAYS else c for c in columns)} FROM {tab}" + (f" WHERE {' AND '.join(rules)}" if rules else "")


for _name in SCANS:
    _scan(_name)

_D = "strftime({}, '%Y-%m-%d')"


@query(f"SELECT DISTINCT {_D.format('ts')} AS day FROM events")
def trading_calendar(spark, sf):
    return rounded(V.calendar(spark, sf))


@query(f"WITH {V.NAV} SELECT series, {_D.format('''date_trunc('week', day)''')} AS period, round(arg_max(nav, day), 6) AS nav FROM nav WHERE series IN (1, 2, 3) AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' GROUP BY series, date_trunc('week', day)")
def fund_nav(spark, sf):
    return rounded(S.resampled(M.fetched(V.nav(spark, sf), "series", [1, 2, 3], "day", "2024-01-03", "2024-01-27"), 2).select("series", "period", "nav"))


_LATEST = "SELECT {k} AS code, arg_max({v}, ({d}, {t})) AS value, strftime(max({d}), '%Y-%m-%d') AS day FROM {f} WHERE {k} IN ({i}) GROUP BY 1"


@query(_LATEST.format(k="l_partkey", v="l_extendedprice", d="l_shipdate", t="l_orderkey * 10 + l_linenumber", f="lineitem", i="1, 2, 3, 5, 8"))
def stock_valuation(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"), F.struct(F.to_date("l_shipdate").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t")).alias("at"), F.col("l_extendedprice").alias("value"))
    return M.latest_rows(t, "code", [1, 2, 3, 5, 8], "at").select("code", "value", F.date_format("at.d", "yyyy-MM-dd").alias("day"))


@query(_LATEST.format(k="o_orderpriority", v="o_totalprice", d="o_orderdate", t="o_orderkey", f="orders", i="'1-URGENT', '5-LOW'"))
def industry_valuation(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code"), F.struct(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("t")).alias("at"), F.col("o_totalprice").alias("value"))
    return M.latest_rows(t, "code", ["1-URGENT", "5-LOW"], "at").select("code", "value", F.date_format("at.d", "yyyy-MM-dd").alias("day"))


@query("""WITH s AS (SELECT o_custkey AS code, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS scale, count(*) AS scales FROM orders WHERE o_orderdate BETWEEN DATE '1998-01-01' - 365 AND DATE '1998-01-01' GROUP BY 1),
m AS (SELECT o_custkey AS code, string_agg(DISTINCT o_clerk, ', ' ORDER BY o_clerk) AS managers FROM (SELECT o_custkey, o_orderpriority AS o_clerk FROM orders) GROUP BY 1)
SELECT c_custkey AS code, c_name AS name, managers, scale, scales FROM customer LEFT JOIN m ON c_custkey = m.code LEFT JOIN s ON c_custkey = s.code WHERE c_custkey IN (1, 2, 3, 4, 5, 6)""")
def fund_information(spark, sf):
    o = table(spark, sf, "orders").withColumn("code", F.col("o_custkey"))
    scales = o.select("code", F.to_date("o_orderdate").alias("day0"), "o_orderkey", F.col("o_totalprice").alias("scale"))
    scales = scales.groupBy("code", F.col("day0").alias("day")).agg(F.max_by("scale", "o_orderkey").alias("scale"), F.count(F.lit(1)).alias("n"))
    got = M.fund_information(table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")), o.select("code", F.col("o_orderpriority").alias("manager")), scales.drop("n"), [1, 2, 3, 4, 5, 6], "1998-01-01")
    return got.select("code", "name", "managers", "scale", "scales")


SQL["fund_information"] = SQL["fund_information"].replace("count(*) AS scales", "count(DISTINCT o_orderdate) AS scales")


def _dated(spark, sf, value: str):
    """One value a part and day of shipping, that of the last line."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("code"), F.to_date("l_shipdate").alias("day"))
    return t.agg(F.max_by(value, F.struct("l_orderkey", "l_linenumber")).alias("value"))


def _last(value: str) -> str:
    return f"SELECT l_partkey AS code, CAST(l_shipdate AS DATE) AS day, arg_max({value}, (l_orderkey, l_linenumber)) AS value FROM lineitem GROUP BY 1, 2"


@query(f"""WITH i AS ({_last('l_shipmode')}), c AS ({_last('l_extendedprice')})
SELECT code, industry, cap, strftime(cap_day, '%Y-%m-%d') AS cap_day FROM (SELECT code, arg_max(value, day) AS industry FROM i WHERE day <= DATE '1996-01-01' GROUP BY 1) JOIN (SELECT code, arg_max(value, day) AS cap, max(day) AS cap_day FROM c WHERE day <= DATE '1996-01-01' GROUP BY 1) USING (code) WHERE code IN (1, 2, 3, 5, 8, 13)""".replace("l_shipmode", "l_returnflag"))
def stock_latest(spark, sf):
    i, c = _dated(spark, sf, "l_returnflag").withColumnRenamed("value", "industry"), _dated(spark, sf, "l_extendedprice").withColumnRenamed("value", "cap")
    return rounded(M.stock_latest(i, c, [1, 2, 3, 5, 8, 13], "1996-01-01"))


@query(f"""WITH s AS ({_last('l_discount')}), b AS ({_last('l_tax')}), u AS (SELECT *, 'style' AS kind FROM s UNION ALL SELECT *, 'barra' FROM b)
SELECT code, kind, 'f' || code % 2 AS factor, round(avg(value), 6) AS mean, arg_max(value, day) AS last, count(*) AS n FROM u WHERE code IN (1, 2, 3, 5) AND day BETWEEN DATE '1997-01-01' - 720 AND DATE '1997-01-01' GROUP BY 1, 2""")
def stock_style(spark, sf):
    part = lambda v: _dated(spark, sf, v).select("code", "day", F.concat(F.lit("f"), F.col("code") % 2).alias("factor"), F.col("value").alias("price"))
    return rounded(M.style_window(part("l_discount"), part("l_tax"), [1, 2, 3, 5], "1997-01-01", 24))


@query(f"""WITH e AS ({_last('l_discount')}), s AS ({_last('l_quantity')})
SELECT code, strftime(day, '%Y-%m-%d') AS day, 'event' AS kind, value FROM e WHERE code IN (1, 2, 3) AND day BETWEEN DATE '1997-01-01' - 730 AND DATE '1997-01-01'
UNION ALL SELECT code, strftime(day, '%Y-%m-%d'), 'shares', value FROM s WHERE code IN (1, 2, 3) AND day BETWEEN DATE '1997-01-01' - 730 AND DATE '1997-01-01'""")
def corporate_actions(spark, sf):
    return rounded(M.corporate_actions(_dated(spark, sf, "l_discount"), _dated(spark, sf, "l_quantity"), [1, 2, 3], "1997-01-01"))


# --- indexes and stocks go through the funds' functions

_RET = "SELECT series AS code, round(arg_max(nav, day) / arg_min(nav, day) - 1, 6) AS return, count(*) AS n, strftime(max(day), '%Y-%m-%d') AS last_day FROM {} WHERE {} GROUP BY series"


def _factor(spark, sf):
    return V.factor(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))


@query(f"WITH {V.FACTOR} {_RET.format('factor', '''day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' ''')}")
def index_ytd_quote(spark, sf):
    return rounded(M.total_return(M.ytd(_factor(spark, sf), None, "2024-01-20")))


@query(f"WITH {V.FACTOR} {_RET.format('factor', '''day BETWEEN DATE '2024-01-20' - 10 AND DATE '2024-01-20' ''')}")
def index_recent_quote(spark, sf):
    return rounded(M.total_return(M.recent(_factor(spark, sf), None, "2024-01-20", 10)))


_BLOCKS = ", ".join(f"round(arg_max(nav, day) / arg_min(nav, day) FILTER (day >= DATE '2000-06-30' - {30 * m}) - 1, 6) AS return_{m}m" for m in (1, 3, 6, 12))


@query(f"WITH {V.MONTHLY} SELECT series AS code, {_BLOCKS} FROM monthly WHERE day <= DATE '2000-06-30' AND series IN (1, 2, 3, 4) GROUP BY series")
def index_return_analysis(spark, sf):
    q = V.monthly(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))
    return rounded(M.performance(q, [1, 2, 3, 4], "2000-06-30", (1, 3, 6, 12)))


SQL["stock_returns"] = SQL["index_return_analysis"].replace("1, 2, 3, 4)", "5, 6, 7)")


def stock_returns(spark, sf):
    q = V.monthly(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))
    return rounded(M.performance(q, [5, 6, 7], "2000-06-30", (1, 3, 6, 12)))


QUERIES["stock_returns"] = stock_returns


@query(f"WITH {V.NAV} SELECT series AS code, {_D.format('day')} AS day, round(nav, 6) AS price FROM nav WHERE series IN (1, 2, 3) AND day BETWEEN DATE '2024-01-25' - 30 AND DATE '2024-01-25'")
def stock_price_history(spark, sf):
    q = V.nav(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))
    return rounded(M.recent(q, [1, 2, 3], "2024-01-25", 30))


# --- portfolios

_HOLD = "SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"


@query("""WITH g AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS track, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, track, round(value, 2) AS value, round(value / sum(value) OVER (PARTITION BY day), 4) AS share FROM g""")
def pm_track_allocation(spark, sf):
    t = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("track"), F.col("o_totalprice").alias("value"))
    g = M.shares_by_day(t, "track")
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "track", F.round("value", 2).alias("value"), F.round("share", 4).alias("share"))


@query("""WITH g AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS track, sum(o_totalprice) AS pnl FROM orders GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, track, round(pnl, 2) AS pnl, round(sum(pnl) OVER (PARTITION BY track ORDER BY day), 2) AS cum_pnl FROM g""")
def pm_track_revenue(spark, sf):
    t = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("track"), F.col("o_totalprice").alias("value"))
    return rounded(M.running_pnl(t, "track"), 2)


_HELD = f"""h AS ({_HOLD}), a AS (SELECT code, max(day) AS last_day FROM h WHERE day <= DATE '1998-11-01' GROUP BY 1), f AS (SELECT code, last_day, last_day = (SELECT max(last_day) FROM a) AS held FROM a)"""


def _held(spark, sf):
    return M.held_at(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("day")), "1998-11-01")


_STATS = f"""WITH {V.MONTHLY}, {_HELD}, r AS (SELECT series, day, nav, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM monthly WINDOW w AS (PARTITION BY series ORDER BY day)),
g AS (SELECT series, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win_rate, avg(ret) AS mean_return, min(dd) AS max_drawdown, arg_max(nav, day) / arg_min(nav, day) - 1 AS total_return FROM r GROUP BY 1)
SELECT series, round(win_rate, 6) AS win_rate, round(mean_return, 6) AS mean_return, round(max_drawdown, 6) AS max_drawdown, round(total_return, 6) AS total_return FROM g JOIN f ON series = code"""


def _stats(spark, sf, held: bool):
    codes = _held(spark, sf).where(F.col("held") == held).select(F.col("code").alias("series"))
    got = S.performance(V.monthly(spark, sf).join(codes, "series", "left_semi"))
    return rounded(got.select("series", "win_rate", "mean_return", "max_drawdown", "total_return"))


@query(f"{_STATS} WHERE held")
def pm_holding_current_fund_stats(spark, sf):
    return _stats(spark, sf, True)


@query(f"{_STATS} WHERE NOT held")
def pm_holding_historical_fund_stats(spark, sf):
    return _stats(spark, sf, False)


_PERIOD = "SELECT series, round(arg_max(nav, day) / arg_min(nav, day) - 1, 6) AS return, count(*) AS n FROM monthly WHERE day BETWEEN DATE '1996-06-01' AND DATE '1998-06-30' GROUP BY 1"


@query(f"WITH {V.MONTHLY} {_PERIOD}")
def pm_holding_fund_performance(spark, sf):
    q = V.monthly(spark, sf).select(F.col("series").alias("code"), "day", F.col("nav").alias("price"))
    got = M.total_return(M.period(q, None, F.lit("1996-06-01").cast("date"), F.lit("1998-06-30").cast("date")))
    return rounded(got.select(F.col("code").alias("series"), "return", "n"))


@query(f"""WITH {V.MONTHLY} SELECT CAST(series AS VARCHAR) AS series, {_D.format('day')} AS day, round(nav, 1) AS nav FROM monthly WHERE series IN (1, 2, 3) AND day <= DATE '1998-06-30'
UNION ALL SELECT 'benchmark', {_D.format('day')}, round(avg(nav), 1) FROM monthly WHERE day <= DATE '1998-06-30' GROUP BY day""")
def pm_holding_fund_navs(spark, sf):
    m = M.fetched(V.monthly(spark, sf), day="day", end="1998-06-30")
    bench = m.groupBy("day").agg(F.avg("nav").alias("nav")).select(F.lit("benchmark").alias("series"), "day", "nav")
    return rounded(M.fetched(m, "series", [1, 2, 3]).select(F.col("series").cast("string").alias("series"), "day", "nav").unionByName(bench), 1)


@query(f"""WITH {V.NAV} SELECT {_D.format('day')} AS day, round(nav, 6) AS nav, round(nav / max(nav) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown, round(nav / first(nav) OVER (ORDER BY day) - 1, 6) AS cum_return FROM nav WHERE series = 1 AND day <= DATE '2024-01-25'""")
def pm_nav(spark, sf):
    t = S.drawdowns(M.fetched(V.nav(spark, sf), "series", [1], "day", end="2024-01-25"))
    return rounded(S.cumulative(t).select("day", "nav", "drawdown", "cum_return"))


@query(f"""WITH {V.MONTHLY}, p AS ({_PERIOD}) SELECT s_suppkey AS fund, s_name AS name, return, n FROM supplier LEFT JOIN p ON s_suppkey = series""")
def pm_subfunds(spark, sf):
    got = pm_holding_fund_performance(spark, sf)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund"), F.col("s_name").alias("name")).join(got, F.col("fund") == F.col("series"), "left").select("fund", "name", "return", "n")


@query(f"""WITH {V.MONTHLY} SELECT s_suppkey AS fund, s_name AS name, round(arg_max(nav, day), 1) AS nav, strftime(max(day), '%Y-%m-%d') AS day FROM supplier JOIN monthly ON s_suppkey = series WHERE day <= DATE '1997-12-31' GROUP BY 1, 2""")
def pm_base_info(spark, sf):
    at = M.latest_rows(M.fetched(V.monthly(spark, sf), day="day", end="1997-12-31"), "series", None, "day")
    return rounded(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("series"), F.col("s_name").alias("name")).join(at, "series").select(F.col("series").alias("fund"), "name", "nav", "day"), 1)


@query("""SELECT o_orderpriority AS track, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS fund, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders WHERE o_orderdate <= DATE '1998-01-01' GROUP BY 1""")
def pm_strategy_tracks(spark, sf):
    t = M.fetched(table(spark, sf, "orders"), day="o_orderdate", end="1998-01-01").select(F.col("o_orderpriority").alias("track"), F.col("o_custkey").alias("fund"), F.struct(F.to_date("o_orderdate").alias("d"), "o_orderkey").alias("at"))
    return M.latest_rows(t, "track", None, "at").select("track", "fund", F.date_format("at.d", "yyyy-MM-dd").alias("day"))


_CORR = f"""WITH {V.MONTHLY}, r AS (SELECT series, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM monthly WHERE {{}}) SELECT x.series AS a, y.series AS b, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n
FROM r x JOIN r y ON x.day = y.day AND x.series < y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2"""


@query(_CORR.format("series <= 6"))
def pm_adviser_correlation(spark, sf):
    return rounded(S.correlations(S.changes(V.monthly(spark, sf).where("series <= 6"))))


@query(f"""WITH {V.FACTOR}, r AS (SELECT series, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM factor) SELECT x.series AS a, y.series AS b, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n
FROM r x JOIN r y ON x.day = y.day AND x.series < y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def pm_adviser_track_correlation(spark, sf):
    return rounded(S.correlations(S.changes(V.factor(spark, sf))))


_EXPOSED = "SELECT {k} AS fund, sum(l_extendedprice) AS w, avg({a}) AS x, avg({b}) AS y FROM lineitem GROUP BY 1"


def _exposed(spark, sf, key: str, a: str, b: str):
    return table(spark, sf, "lineitem").groupBy(F.col(key).cast("string").alias("fund")).agg(F.sum("l_extendedprice").alias("w"), F.avg(a).alias("x"), F.avg(b).alias("y"))


def _exposure_sql(k: str, a: str, b: str) -> str:
    return f"WITH x AS ({_EXPOSED.format(k=k, a=a, b=b)}) SELECT CAST(fund AS VARCHAR) AS fund, round(w, 2) AS w, round(x, 5) AS x, round(y, 5) AS y FROM x UNION ALL SELECT 'weighted mean', round(sum(w), 2), round(sum(w * x) / sum(w), 5), round(sum(w * y) / sum(w), 5) FROM x"


def _with_mean(df):
    t = M.with_total_row(df, "fund", "weighted mean", "w", ["x", "y"])
    return t.select("fund", F.round("w", 2).alias("w"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(_exposure_sql("l_suppkey", "l_discount", "l_tax"))
def pm_holding_asset_exposure_by_fund(spark, sf):
    return _with_mean(_exposed(spark, sf, "l_suppkey", "l_discount", "l_tax"))


@query(_exposure_sql("l_linenumber", "l_quantity", "l_tax"))
def pm_holding_style_exposure_by_fund(spark, sf):
    return _with_mean(_exposed(spark, sf, "l_linenumber", "l_quantity", "l_tax"))


@query("""WITH h AS (SELECT l_suppkey AS code, year(l_shipdate) AS report_date, l_partkey AS asset, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2, 3),
m AS (SELECT *, max(report_date) OVER (PARTITION BY code) AS last FROM h), r AS (SELECT code, asset, value, row_number() OVER (PARTITION BY code ORDER BY value DESC, asset) AS rank FROM m WHERE report_date = last)
SELECT code, asset, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def fund_top_holdings_qreport(spark, sf):
    t = M.fetched(table(spark, sf, "lineitem"), "l_suppkey", [1, 2, 3]).groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("report_date"), F.col("l_partkey").alias("asset"))
    return M.latest_holdings(t.agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))).select("code", "asset", "value", "rank")
