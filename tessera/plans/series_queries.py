"""Queries on series of net asset values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pairs
from tessera.operators import series as S
from tessera.plans import views as V
from tessera.plans.views import BEGIN, END, rounded
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
_BASED = f"""b AS (
  SELECT *, coalesce(max(day) FILTER (day < DATE '{BEGIN}') OVER (PARTITION BY series), min(day) OVER (PARTITION BY series)) AS base
  FROM nav WHERE day <= DATE '{END}'),
k AS (
  SELECT series, day, nav, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd
  FROM b WHERE day >= base WINDOW w AS (PARTITION BY series ORDER BY day))"""


@query(f"""WITH {V.NAV}, {_BASED},
t AS (SELECT *, first(dd) OVER (PARTITION BY series ORDER BY dd, day) AS low, first(day) OVER (PARTITION BY series ORDER BY dd, day) AS trough FROM k),
g AS (
  SELECT series, arg_max(nav, day) / arg_min(nav, day) - 1 AS r, count(ret) AS n, stddev_samp(ret) * sqrt(252) AS vol, min(low) AS low, min(trough) AS trough,
    min(day) AS first_day, max(day) AS last_day FROM t GROUP BY series HAVING count(*) >= 2),
p AS (SELECT series, day FROM (SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY nav DESC, day) AS rn FROM t WHERE day <= trough) WHERE rn = 1)
SELECT series, round(r, 6) AS interval_return, round(CASE WHEN r > -1 THEN pow(1 + r, 252.0 / greatest(n, 1)) - 1 END, 4) AS annual_return, round(CASE WHEN n > 1 THEN vol END, 6) AS annual_vol,
  round(CASE WHEN n > 1 AND vol <> 0 AND r > -1 THEN (pow(1 + r, 252.0 / greatest(n, 1)) - 1) / vol END, 4) AS sharpe, round(low, 6) AS max_drawdown,
  {_D.format("p.day")} AS peak_date, {_D.format("trough")} AS trough_date, n AS n_days, {_D.format("first_day")} AS begin_used, {_D.format("last_day")} AS end_used
FROM g JOIN p USING (series)""")
def nav_kpis(spark, sf):
    got = S.nav_kpis(V.nav(spark, sf), BEGIN, END)
    return rounded(got.withColumn("annual_return", F.round("annual_return", 4)).withColumn("sharpe", F.round("sharpe", 4)))


@query(f"WITH {V.NAV} SELECT series, {_D.format('day')} AS day, round(nav / max(nav) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM nav")
def drawdown_curve(spark, sf):
    return rounded(S.drawdowns(V.nav(spark, sf)).select("series", "day", "drawdown"))


@query(f"WITH {V.NAV} SELECT series, {_D.format('day')} AS day, round(nav / first(nav) OVER (PARTITION BY series ORDER BY day) - 1, 6) AS cum_return FROM nav")
def cumulative_return(spark, sf):
    return rounded(S.cumulative(V.nav(spark, sf)).select("series", "day", "cum_return"))


@query(f"WITH {V.NAV} SELECT series, {_D.format('day')} AS day, round(nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1, 6) AS ret FROM nav")
def percent_change(spark, sf):
    return rounded(S.changes(V.nav(spark, sf)).select("series", "day", "ret"))


@query(f"""WITH {V.NAV}, c AS (SELECT series, day, CASE WHEN day_of_year % 5 <> 0 THEN nav END AS nav FROM (SELECT *, dayofyear(day) AS day_of_year FROM nav)),
f AS (SELECT series, day, last_value(nav IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS v FROM c)
SELECT series, {_D.format('day')} AS day, round(v / lag(v) OVER (PARTITION BY series ORDER BY day) - 1, 6) AS ret FROM f""")
def percent_change_padded(spark, sf):
    t = V.nav(spark, sf).withColumn("nav", F.when(F.dayofyear("day") % 5 != 0, F.col("nav")))
    return rounded(S.changes(t, pad=True).select("series", "day", "ret"))


@query(f"""WITH {V.NAV} SELECT series, round(arg_max(nav, day) / arg_min(nav, day) - 1, 6) AS period_return, count(*) AS n_days
FROM nav WHERE day BETWEEN DATE '{BEGIN}' AND DATE '{END}' GROUP BY series""")
def period_return(spark, sf):
    return rounded(S.period_return(V.nav(spark, sf), BEGIN, END))


@query(f"""WITH {V.NAV}, k AS (
  SELECT series, day, nav, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd
  FROM nav WHERE day BETWEEN DATE '{BEGIN}' AND DATE '{END}' WINDOW w AS (PARTITION BY series ORDER BY day)),
g AS (SELECT series, arg_max(nav, day) / arg_min(nav, day) - 1 AS r, stddev_samp(ret) * sqrt(252) AS vol, min(dd) AS low FROM k GROUP BY series)
SELECT series, round(r, 6) AS total_return, round(vol, 6) AS volatility, round(low, 6) AS max_drawdown, round((r - 0.03) / nullif(vol, 0), 6) AS sharpe_excess FROM g""")
def compare_series(spark, sf):
    return rounded(S.compared(V.nav(spark, sf), BEGIN, END))


def _align(mode: str, sql: str):
    def run(spark, sf):
        return rounded(S.aligned(V.nav(spark, sf), V.calendar(spark, sf), mode))

    run.__name__ = f"align_{mode}"
    return query(sql)(run)


_GRID = f"""WITH {V.NAV}, {V.CALENDAR}, span AS (SELECT series, min(day) AS lo, max(day) AS hi FROM nav GROUP BY series),
grid AS (SELECT series, c.day AS day FROM span JOIN calendar c ON c.day BETWEEN lo AND hi)"""
_align("ffill", f"""{_GRID} SELECT series, {_D.format('day')} AS day, round(last_value(nav IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS nav
FROM grid LEFT JOIN nav USING (series, day)""")
_align("nan", f"{_GRID} SELECT series, {_D.format('day')} AS day, round(nav, 6) AS nav FROM grid LEFT JOIN nav USING (series, day)")
_align("drop", f"{_GRID} SELECT series, {_D.format('day')} AS day, round(nav, 6) AS nav FROM nav SEMI JOIN calendar USING (day)")


@query(f"""WITH {V.MONTHLY} SELECT series, {_D.format("date_trunc('quarter', day)")} AS period, round(arg_max(nav, day), 6) AS nav, {_D.format('max(day)')} AS last_day
FROM monthly GROUP BY series, date_trunc('quarter', day)""")
def resample_last(spark, sf):
    return rounded(S.resampled(V.monthly(spark, sf), 4))


@query(f"""WITH {V.MONTHLY}, y AS (SELECT series, date_trunc('year', day) AS period, arg_max(nav, day) AS nav FROM monthly GROUP BY 1, 2)
SELECT series, {_D.format('period')} AS period, round(nav, 6) AS nav, round(nav / lag(nav) OVER (PARTITION BY series ORDER BY period) - 1, 6) AS ret FROM y""")
def periodic_returns(spark, sf):
    return rounded(S.periodic_returns(V.monthly(spark, sf), 5).select("series", "period", "nav", "ret"))


@query(f"""WITH {V.NAV}, r AS (SELECT series, day, round(nav, 0) AS level FROM nav)
SELECT series, {_D.format('day')} AS day, rank() OVER (PARTITION BY day ORDER BY level DESC) + (count(*) OVER (PARTITION BY day, level) - 1) / 2.0 AS rank_avg FROM r""")
def rank_average(spark, sf):
    t = V.nav(spark, sf).select("series", "day", F.round("nav", 0).alias("level"))
    return rounded(S.average_rank(t, "level", ["day"]).select("series", "day", "rank_avg"))


@query(f"""WITH {V.NAV}, e AS (SELECT day, quantile_cont(nav, [0.2, 0.4, 0.6, 0.8]) AS x FROM nav GROUP BY day)
SELECT series, {_D.format('day')} AS day, CAST(1 + len(list_filter(x, lambda v: v < nav)) AS INTEGER) AS bucket FROM nav JOIN e USING (day)""")
def quantile_bucket(spark, sf):
    t = V.nav(spark, sf)
    return rounded(S.quantile_bucket(t, "nav", ["day"]).select("series", "day", "bucket"))


@query(f"""WITH {V.FACTOR}, r AS (SELECT series, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM factor),
w AS (SELECT series, count(*) / sum(count(*)) OVER () AS weight FROM (SELECT event_type AS series FROM events) GROUP BY series)
SELECT {_D.format('day')} AS day, round(sum(ret * weight), 6) AS ret, round(sum(weight), 6) AS weight_present, (SELECT abs(sum(weight) - 1) <= 0.01 FROM w) AS weights_ok
FROM r JOIN w USING (series) GROUP BY day""")
def portfolio_return(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("series")).count()
    total = n.agg(F.sum("count").alias("total"))
    weights = n.crossJoin(F.broadcast(total)).select("series", (F.col("count") / F.col("total")).alias("weight"))
    return rounded(S.portfolio_return(S.changes(V.factor(spark, sf)), weights))


_RET = f"WITH {V.FACTOR}, r AS (SELECT series, day, nav / lag(nav) OVER (PARTITION BY series ORDER BY day) - 1 AS ret FROM factor)"


@query(f"""{_RET} SELECT x.series AS a, y.series AS b, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n
FROM r x JOIN r y ON x.day = y.day AND x.series < y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def correlation_matrix(spark, sf):
    return rounded(S.correlations(S.changes(V.factor(spark, sf))))


@query(f"""{_RET} SELECT x.series AS a, y.series AS b, round(covar_samp(x.ret, y.ret), 8) AS cov FROM r x JOIN r y ON x.day = y.day AND x.series <= y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def covariance_matrix(spark, sf):
    return rounded(pairs.covariance(S.changes(V.factor(spark, sf))), 8)


@query(f"""{_RET}, p AS (SELECT x.series AS a, y.series AS b, x.day AS day, x.ret AS x, y.ret AS y FROM r x JOIN r y ON x.day = y.day AND x.series < y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
SELECT a, b, {_D.format('day')} AS day, round(CASE WHEN count(*) OVER w = 13 THEN corr(x, y) OVER w END, 5) AS corr FROM p WINDOW w AS (PARTITION BY a, b ORDER BY day ROWS 12 PRECEDING)""")
def rolling_correlation(spark, sf):
    r = S.changes(V.factor(spark, sf)).dropna(subset=["ret"])
    pairs = r.select("day", F.col("series").alias("a"), F.col("ret").alias("x")).join(r.select("day", F.col("series").alias("b"), F.col("ret").alias("y")), "day").where("a < b")
    return rounded(S.rolling_correlation(pairs).select("a", "b", "day", "corr"), 5)


@query(f"""WITH {V.NAV}, k AS (SELECT series, day, nav, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav WINDOW w AS (PARTITION BY series ORDER BY day)),
g AS (SELECT series, avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END) AS win_rate, avg(ret) AS mean_return, sqrt(avg(least(ret, 0) ** 2)) AS downside, max(ret) AS best, min(ret) AS worst, min(dd) AS low, arg_max(nav, day) / arg_min(nav, day) - 1 AS r FROM k GROUP BY series)
SELECT series, round(win_rate, 6) AS win_rate, round(mean_return, 6) AS mean_return, round(downside, 6) AS downside, round(best, 6) AS best, round(worst, 6) AS worst, round(low, 6) AS max_drawdown, round(r, 6) AS total_return, round(r / nullif(abs(low), 0), 6) AS calmar FROM g""")
def performance_stats(spark, sf):
    low = V.nav(spark, sf)
    return rounded(S.performance(low))


@query(f"""{_RET}, p AS (SELECT x.series AS a, y.series AS b, x.ret AS x, y.ret AS y FROM r x JOIN r y ON x.day = y.day AND x.series < y.series WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
SELECT a, b, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 6) AS alpha, round(regr_r2(y, x), 6) AS r2 FROM p GROUP BY a, b""")
def factor_sensitivity(spark, sf):
    r = S.changes(V.factor(spark, sf)).dropna(subset=["ret"])
    pairs = r.select("day", F.col("series").alias("a"), F.col("ret").alias("x")).join(r.select("day", F.col("series").alias("b"), F.col("ret").alias("y")), "day").where("a < b")
    return rounded(S.sensitivity(pairs))


@query(f"""WITH {V.NAV} SELECT series, round(avg(nav), 6) AS mean, round(stddev_samp(nav), 6) AS sd, round(min(nav), 6) AS low, round(max(nav), 6) AS high, round(arg_max(nav, day), 6) AS latest FROM nav GROUP BY series""")
def group_stats(spark, sf):
    return rounded(S.group_stats(V.nav(spark, sf)))


@query(f"""WITH {V.NAV} SELECT series, {_D.format('day')} AS day, round(nav - first(nav) OVER w, 6) AS from_start, round(nav / first(nav) OVER w, 6) AS rebased FROM nav WINDOW w AS (PARTITION BY series ORDER BY day)""")
def rebased(spark, sf):
    return rounded(S.rebased(V.nav(spark, sf)).select("series", "day", "from_start", "rebased"))
