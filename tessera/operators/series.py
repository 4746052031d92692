"""Time series of net asset values, in long form: ``series, day, nav``.

A series has one row a day. All operators are windows or aggregations by
series; a panel is never pivoted to compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import TRADING_DAYS, ordered_product, period_start, ratio, soft_day, soft_double
from tessera.operators import pairs


#: Days that a calendar may have: it is one array, broadcast.
MOST_DAYS = 100_000


def cleaned(df: DataFrame) -> DataFrame:
    """Typed rows with a day and a value; of rows that repeat a day, the largest value stays."""
    t = df.select("series", soft_day(F.col("day")).alias("day"), soft_double(F.col("nav")).alias("nav"))
    return t.dropna(subset=["day", "nav"]).groupBy("series", "day").agg(F.max("nav").alias("nav"))


def _by_day() -> W:
    return W.partitionBy("series").orderBy("day")


def from_base(df: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows from each series' base day to ``end``: the last day before ``begin``, else the first from it on."""
    day, whole = F.col("day"), W.partitionBy("series")
    t = df.where(day <= F.lit(end).cast("date"))
    before = F.max(F.when(day < F.lit(begin).cast("date"), day)).over(whole)
    return t.withColumn("base", F.coalesce(before, F.min("day").over(whole))).where("day >= base").drop("base")


def changes(df: DataFrame, pad: bool = False) -> DataFrame:
    """``ret``: relative change to the previous row; with ``pad`` a missing value counts as unchanged."""
    v = F.last("nav", ignorenulls=True).over(_by_day().rowsBetween(W.unboundedPreceding, 0)) if pad else F.col("nav")
    t = df.withColumn("__v", v)
    return t.withColumn("ret", ratio(F.col("__v"), F.lag("__v").over(_by_day())) - 1).drop("__v")


def drawdowns(df: DataFrame) -> DataFrame:
    """``peak`` so far and ``drawdown`` from it."""
    t = df.withColumn("peak", F.max("nav").over(_by_day().rowsBetween(W.unboundedPreceding, 0)))
    return t.withColumn("drawdown", ratio(F.col("nav"), F.col("peak")) - 1)


def nav_kpis(df: DataFrame, begin: str, end: str) -> DataFrame:
    """Interval and annual return, volatility, Sharpe without a risk-free rate, and the deepest drawdown with its days."""
    t = drawdowns(changes(from_base(df, begin, end)))
    whole = W.partitionBy("series")
    first_trough = F.min(F.struct("drawdown", "day")).over(whole)
    t = t.withColumn("trough", first_trough)
    g = t.groupBy("series").agg(
        F.min_by("nav", "day").alias("first_nav"),
        F.max_by("nav", "day").alias("last_nav"),
        F.min("day").alias("begin_used"),
        F.max("day").alias("end_used"),
        F.count("ret").alias("n_days"),
        F.stddev_samp("ret").alias("sd"),
        F.first("trough.drawdown").alias("max_drawdown"),
        F.first("trough.day").alias("trough_date"),
        F.max(F.when(F.col("day") <= F.col("trough.day"), F.struct("nav", (-F.datediff("day", F.lit("1970-01-01"))).alias("early"), "day"))).alias("top"),
        F.count(F.lit(1)).alias("rows"),
    )
    interval = ratio(F.col("last_nav"), F.col("first_nav")) - 1
    g = g.where("rows >= 2").withColumn("interval_return", interval)
    g = g.withColumn("annual_return", F.when(F.col("interval_return") > -1, F.pow(1 + F.col("interval_return"), TRADING_DAYS / F.greatest(F.col("n_days"), F.lit(1))) - 1))
    g = g.withColumn("annual_vol", F.when(F.col("n_days") > 1, F.col("sd") * F.sqrt(F.lit(TRADING_DAYS))))
    return g.select("series", "interval_return", "annual_return", "annual_vol", F.when(F.col("annual_vol") != 0, ratio(F.col("annual_return"), F.col("annual_vol"))).alias("sharpe"), "max_drawdown", F.col("top.day").alias("peak_date"), "trough_date", "n_days", "begin_used", "end_used")


def period_return(df: DataFrame, begin: str, end: str) -> DataFrame:
    """Last over first value within the closed interval, less one."""
    t = df.where(F.col("day").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    g = t.groupBy("series").agg(F.min_by("nav", "day").alias("a"), F.max_by("nav", "day").alias("b"), F.count(F.lit(1)).alias("n_days"))
    return g.select("series", (ratio(F.col("b"), F.col("a")) - 1).alias("period_return"), "n_days")


def compared(df: DataFrame, begin: str, end: str, risk_free: float = 0.03) -> DataFrame:
    """Return, annual volatility, drawdown and the Sharpe ratio of interval return over a risk-free rate."""
    t = drawdowns(changes(df.where(F.col("day").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))))
    g = t.groupBy("series").agg((ratio(F.max_by("nav", "day"), F.min_by("nav", "day")) - 1).alias("total_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(TRADING_DAYS))).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
    return g.withColumn("sharpe_excess", ratio(F.col("total_return") - risk_free, F.col("volatility")))


def cumulative(df: DataFrame) -> DataFrame:
    """``cum_return`` since the first day, for series of positive values."""
    first = F.first("nav").over(_by_day().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("cum_return", ratio(F.col("nav"), first) - 1)


def aligned(df: DataFrame, calendar: DataFrame, mode: str = "ffill") -> DataFrame:
    """Each series on the days of ``calendar`` between its first and last: filled forward, with gaps, or present days only."""
    if mode == "drop":
        return df.join(calendar.select("day").distinct(), "day", "left_semi").select("series", "day", "nav")
    # a series' own days are known by number, so its part of the calendar is a slice of one sorted array: no nested-loop join
    days = calendar.select("day").where("day IS NOT NULL").distinct()
    if (n := days.count()) > MOST_DAYS:
        raise ValueError(f"a calendar of {n} days, more than {MOST_DAYS}")
    span = df.groupBy("series").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    one = F.broadcast(days.agg(F.array_sort(F.collect_list("day")).alias("days")))
    grid = span.crossJoin(one).select("series", F.explode(F.filter("days", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))).alias("day"))
    if mode == "nan":
        return grid.join(df, ["series", "day"], "left").select("series", "day", "nav")
    both = grid.withColumn("on", F.lit(True)).join(df, ["series", "day"], "full")
    filled = F.last("nav", ignorenulls=True).over(_by_day().rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("nav", filled).where("on").select("series", "day", "nav")


def resampled(df: DataFrame, code: int = 3) -> DataFrame:
    """Last value of each period (code as in :func:`period_start`)."""
    t = df.withColumn("period", period_start(F.col("day"), code))
    return t.groupBy("series", "period").agg(F.max_by("nav", "day").alias("nav"), F.max("day").alias("last_day"))


def periodic_returns(df: DataFrame, code: int = 3) -> DataFrame:
    """Return of each period over the end of the one before."""
    t = resampled(df, code)
    return t.withColumn("ret", ratio(F.col("nav"), F.lag("nav").over(W.partitionBy("series").orderBy("period"))) - 1)


def average_rank(df: DataFrame, value: str, by: list[str], descending: bool = True, name: str = "rank_avg") -> DataFrame:
    """Rank where ties get the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    rank = F.rank().over(W.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return df.withColumn(name, rank + (ties - 1) / 2.0)


def quantile_bucket(df: DataFrame, value: str, by: list[str], n: int = 5, name: str = "bucket") -> DataFrame:
    """Bucket 1 to ``n`` by quantile edges; a value on an edge belongs below it, equal edges raise an error upstream and collapse here."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(k / n) for k in range(1, n)])).alias("__edges"))
    place = F.size(F.filter("__edges", lambda e: e < F.col(value))) + 1
    return df.join(edges, by).withColumn(name, F.when(F.col(value).isNotNull(), place.cast("int"))).drop("__edges")


def portfolio_return(returns: DataFrame, weights: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Return by day of ``series, day, ret`` under ``series, weight``; ``weights_ok`` says if weights sum to one."""
    total = weights.agg(F.sum("weight")).select(F.col("sum(weight)").alias("whole"))
    t = returns.join(weights, "series").groupBy("day").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"), F.sum("weight").alias("weight_present"))
    return t.crossJoin(F.broadcast(total)).select("day", "ret", "weight_present", (F.abs(F.col("whole") - 1) <= tolerance).alias("weights_ok"))


def correlations(returns: DataFrame, most: int | None = None) -> DataFrame:
    """Correlation of each pair ``a < b`` over common days, with their number; see :mod:`tessera.operators.pairs`.

    More than ``most`` series are refused where that is given, as the result has their square.
    """
    if most is not None and (n := returns.dropna(subset=["ret"]).select("series").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} series ({n}): choose some, a matrix has the square of them")
    return pairs.correlations(returns)


def rolling_correlation(pairs: DataFrame, rows: int = 13) -> DataFrame:
    """Correlation of ``x, y`` of a pair ``a, b`` over the last ``rows`` periods, from the first full window on."""
    w = W.partitionBy("a", "b").orderBy("day").rowsBetween(1 - rows, 0)
    return pairs.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("corr", F.when(F.col("n") == rows, F.corr("x", "y").over(w)))


def performance(df: DataFrame, target: float = 0.0) -> DataFrame:
    """Win rate, mean, downside deviation (root mean square below ``target``), best and worst return, Calmar ratio."""
    t = drawdowns(changes(df))
    low = F.least(F.col("ret") - target, F.lit(0.0))
    g = t.groupBy("series").agg(
        F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("win_rate"),
        F.avg("ret").alias("mean_return"),
        F.sqrt(F.avg(low * low)).alias("downside"),
        F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
        F.min("drawdown").alias("max_drawdown"),
        (ratio(F.max_by("nav", "day"), F.min_by("nav", "day")) - 1).alias("total_return"),
    )
    return g.withColumn("calmar", ratio(F.col("total_return"), F.abs(F.col("max_drawdown"))))


def product_of(returns: Column, order: Column) -> Column:
    """Aggregate: compound return of rows in order."""
    rows = F.sort_array(F.collect_list(F.when(returns.isNotNull(), F.struct(order.alias("o"), returns.alias("r")))))
    return ordered_product(F.transform(rows, lambda x: 1 + x["r"])) - 1


def running_product(ret: Column, w) -> Column:
    """Product of ``1 + ret`` over a window, by logarithms with sign and zero kept apart; nulls count as no change."""
    g = 1 + ret
    size = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g)))).over(w))
    sign = 1 - 2 * F.pmod(F.count_if(g < 0).over(w), F.lit(2))
    return F.when(F.count_if(g == 0).over(w) > 0, 0.0).when(F.count(ret).over(w) > 0, size * sign)


def sensitivity(pairs: DataFrame) -> DataFrame:
    """Slope, intercept and fit of ``y`` on ``x`` for each pair ``a, b``."""
    return pairs.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"))


def group_stats(df: DataFrame) -> DataFrame:
    """Mean, deviation, bounds and last value of each series."""
    return df.groupBy("series").agg(F.avg("nav").alias("mean"), F.stddev_samp("nav").alias("sd"), F.min("nav").alias("low"), F.max("nav").alias("high"), F.max_by("nav", "day").alias("latest"))


def rebased(df: DataFrame) -> DataFrame:
    """``from_start`` and ``rebased``: difference from and ratio to a series' first value."""
    first = F.first("nav").over(_by_day().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns({"from_start": F.col("nav") - first, "rebased": ratio(F.col("nav"), first)})


def against_benchmark(df: DataFrame, benchmark: str) -> DataFrame:
    """``excess`` of each rebased series over one of them, on common days."""
    r = rebased(df).select("series", "day", "rebased")
    b = r.where(F.col("series") == benchmark).select("day", F.col("rebased").alias("__b"))
    return r.where(F.col("series") != benchmark).join(b, "day").select("series", "day", (F.col("rebased") - F.col("__b")).alias("excess"))
