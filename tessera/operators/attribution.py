"""Attribution from strategy to track to fund, and factor exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import TRADING_DAYS, previous_sunday, ratio
from tessera.operators.series import product_of, running_product

UNMAPPED = "未映射/需核对"


def interval_values(df: DataFrame, by: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """Total of a measure over an interval, whether it was given as increments or running totals.

    A series is cumulative if it has three values or more, the median of their
    absolutes is positive, and the median absolute change is under 0.7 of it.
    Gives ``total`` (difference of ends, or sum) and ``compound`` (difference of
    ends, or compound return).
    """
    t = df.where(F.col(value).isNotNull())
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(day)))
    g = t.withColumn("__step", step).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.median(F.abs(F.col(value))).alias("__size"),
        F.median("__step").alias("__move"),
        (F.max_by(value, day) - F.min_by(value, day)).alias("__diff"),
        F.sum(value).alias("__sum"),
        product_of(F.col(value), F.col(day)).alias("__product"),
    )
    cum = (F.col("n") >= 3) & (F.col("__size") > 0) & (ratio(F.col("__move"), F.col("__size")) < 0.7)
    g = g.withColumn("is_cumulative", F.coalesce(cum, F.lit(False)))
    return g.select(*by, "n", "is_cumulative", F.when(F.col("is_cumulative"), F.col("__diff")).otherwise(F.col("__sum")).alias("total"), F.when(F.col("is_cumulative"), F.col("__diff")).otherwise(F.col("__product")).alias("compound"))


def strategy_layer(panel: DataFrame, begin: Column, end: Column, by: str = "strategy") -> DataFrame:
    """Mean weight, interval return and contribution of each strategy from ``day, strategy, weight, nav``.

    Return: last value up to ``end`` over last up to ``begin``. Contribution: return
    of a day times the weight of the day before, over days after ``begin`` whose
    previous day isn't before it.
    """
    w = W.partitionBy(by).orderBy("day")
    t = panel.where(F.col("day") <= end).withColumns({"prev_day": F.lag("day").over(w), "prev_weight": F.lag("weight").over(w), "filled": F.last("nav", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))})
    t = t.withColumn("ret", ratio(F.col("filled"), F.lag("filled").over(w)) - 1)
    inside = F.col("day") > begin
    g = t.groupBy(by).agg(
        F.avg(F.when(inside, F.col("weight"))).alias("avg_weight"),
        F.max_by(F.when(F.col("day") <= begin, F.col("filled")), F.when((F.col("day") <= begin) & F.col("nav").isNotNull(), F.col("day"))).alias("a"),
        F.max_by("filled", F.when(F.col("nav").isNotNull(), F.col("day"))).alias("b"),
        F.sum(F.when(inside & (F.col("prev_day") >= begin), F.col("ret") * F.col("prev_weight"))).alias("contribution"),
    )
    return g.select(by, "avg_weight", (ratio(F.col("b"), F.col("a")) - 1).alias("interval_return"), "contribution")


def drilldown(tracks: DataFrame, name: str, value: str, by: list[str] | None = None, threshold_bp: float = 20.0, k: int = 2) -> DataFrame:
    """Rows of at least ``threshold_bp``; where a group has none, its ``k`` largest and ``k`` smallest."""
    by = by or []
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    big = F.abs(F.col(value)) * 10_000 >= threshold_bp
    t = tracks.withColumns({
        "__big": big,
        "__any": F.max(big.cast("int")).over(part) == 1,
        "__lo": F.row_number().over(part.orderBy(F.col(value).asc(), name)),
        "__hi": F.row_number().over(part.orderBy(F.col(value).desc(), name)),
    })
    t = t.where(F.when(F.col("__any"), F.col("__big")).otherwise((F.col("__lo") <= k) | (F.col("__hi") <= k)))
    return t.withColumn("reason", F.when(F.col("__any"), F.lit(f"|contrib|>={threshold_bp:g}bp")).otherwise(F.lit(f"top{k}/bottom{k}"))).drop("__big", "__any", "__lo", "__hi")


def top_and_bottom(df: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest and ``k`` smallest rows of each group, each once; ties by ``key``."""
    t = df.withColumns({"__lo": F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).asc(), key)), "__hi": F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).desc(), key))})
    return t.where((F.col("__lo") <= k) | (F.col("__hi") <= k)).drop("__lo", "__hi")


def scale_gate(target: Column, total: Column, low: float = 0.05, high: float = 5.0) -> Column:
    """``target / total`` if that is positive and within bounds, else null."""
    s = ratio(target, total)
    return F.when((s > 0) & F.abs(s).between(low, high), s)


def fund_layer(bars: DataFrame, tracks: DataFrame, weights: DataFrame, begin: Column, end: Column, contribution: float | None, avg_weight: float | None = None) -> DataFrame:
    """Funds of a strategy with weight, return, drawdown and estimated contribution.

    ``bars``: ``day, fund_id, name, nav, yield`` by week. Windows run from the Sunday
    at or before ``begin`` to that of ``end``; the first week is left out. Increments
    of yields are scaled to the strategy's contribution if the scale passes
    :func:`scale_gate`; else weight times return is, or stays as it is.
    """
    lo, hi = previous_sunday(begin), previous_sunday(end)
    w = W.partitionBy("fund_id").orderBy("day")
    t = bars.where(F.col("fund_id").isNotNull() & F.col("day").between(lo, hi)).withColumn("prev_day", F.lag("day").over(w))
    valid = (F.col("day") > lo) & (F.col("prev_day") >= lo)
    kind = interval_values(t.select("fund_id", "day", F.col("yield").alias("value")), ["fund_id"]).select("fund_id", "is_cumulative")
    t = t.join(kind, "fund_id", "left").withColumn("inc", F.when(F.col("is_cumulative"), F.col("yield") - F.lag("yield").over(w)).otherwise(F.col("yield")))
    t = t.withColumn("raw", F.when(valid, F.coalesce("inc", F.lit(0.0))).otherwise(0.0)).withColumn("ret", F.when(valid, ratio(F.col("nav"), F.lag("nav").over(w)) - 1))
    t = t.withColumn("growth", running_product(F.col("ret"), w.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("fall", ratio(F.col("growth"), F.max("growth").over(w.rowsBetween(W.unboundedPreceding, 0))) - 1)
    g = t.groupBy("fund_id").agg(F.min_by("name", "day").alias("bar_name"), F.sum("raw").alias("raw"), F.sum(F.abs("raw")).alias("abs_raw"), F.count_if(F.col("raw") != 0).alias("bar_count"), (F.max_by("growth", F.when(F.col("ret").isNotNull(), F.col("day"))) - 1).alias("fund_return"), F.min("fall").alias("fund_mdd"), F.count_if(valid).alias("valid_rows"))
    g = g.join(tracks.dropDuplicates(["fund_id"]).select("fund_id", F.col("name").alias("track_name"), "track", F.col("ratio").alias("track_weight"), F.lit(True).alias("mapped")), "fund_id", "left")
    g = g.join(weights.dropDuplicates(["fund_id"]).select("fund_id", F.col("weight").alias("own_weight")), "fund_id", "left")
    from_track = F.col("track_weight") > 0
    g = g.select(
        "fund_id",
        F.coalesce("track_name", "bar_name").alias("name"),
        F.coalesce("track", F.lit(UNMAPPED)).alias("track"),
        F.coalesce("mapped", F.lit(False)).alias("mapped"),
        F.coalesce(F.when(from_track, F.col("track_weight")), F.col("own_weight"), F.lit(0.0)).alias("weight"),
        "raw", "abs_raw", "bar_count", "fund_return", "fund_mdd", "valid_rows",
        F.coalesce(from_track, F.lit(False)).alias("__from_track"),
    )
    mult = F.when(F.col("__from_track"), F.lit(avg_weight if avg_weight is not None else 1.0)).otherwise(1.0)
    g = g.withColumn("by_return", F.coalesce("fund_return", F.lit(0.0)) * F.col("weight") * mult)
    totals = g.agg(F.sum("raw").alias("sum_raw"), F.sum("by_return").alias("sum_wr"))
    target = F.lit(contribution).cast("double")
    totals = totals.select(scale_gate(target, F.col("sum_raw")).alias("scale_raw"), scale_gate(target, F.col("sum_wr")).alias("scale_wr"))
    g = g.crossJoin(F.broadcast(totals))  # one row
    return g.withColumn("contribution", F.when(F.col("scale_raw").isNotNull(), F.col("raw") * F.col("scale_raw")).otherwise(F.col("by_return") * F.coalesce("scale_wr", F.lit(1.0)))).drop("__from_track")


def mapping_coverage(funds: DataFrame) -> DataFrame:
    """Share of rows and of absolute yield that belongs to mapped funds."""
    return funds.agg(ratio(F.sum(F.when(F.col("mapped"), F.col("valid_rows")).otherwise(0)).cast("double"), F.sum("valid_rows").cast("double")).alias("by_rows"), ratio(F.sum(F.when(F.col("mapped"), F.col("abs_raw")).otherwise(0.0)), F.sum("abs_raw")).alias("by_size"))


def weighted_exposure(df: DataFrame, by: list[str], weight: str = "weight", value: str = "exposure") -> DataFrame:
    """Weighted mean over rows with a value, and the share of weight they hold."""
    w, v = F.coalesce(weight, F.lit(0.0)), F.col(value)
    known = F.sum(F.when(v.isNotNull(), w))
    return df.groupBy(*by).agg(F.when(known > 0, ratio(F.sum(v * w), known)).alias("exposure"), F.when(F.sum(w) > 0, ratio(F.coalesce(known, F.lit(0.0)), F.sum(w))).alias("coverage"))


def portfolio_exposure(exposures: DataFrame, weights: DataFrame, group: str = "strategy") -> DataFrame:
    """Exposure of the whole by factor: sum of strategy weight times its exposure."""
    return exposures.join(weights, group).groupBy("factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("exposure"), ratio(F.sum(F.abs("weight") * F.coalesce("coverage", F.lit(0.0))), F.sum(F.abs("weight"))).alias("coverage"))


def factor_stats(returns: DataFrame) -> DataFrame:
    """Compound return, annual volatility, drawdown and sum of ``factor, day, ret``."""
    w = W.partitionBy("factor").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    t = returns.where("day IS NOT NULL AND ret IS NOT NULL")
    t = t.withColumn("growth", running_product(F.col("ret"), w))
    t = t.withColumn("fall", ratio(F.col("growth"), F.max("growth").over(w)) - 1)
    return t.groupBy("factor").agg((F.max_by("growth", "day") - 1).alias("factor_return"), F.when(F.count("ret") > 1, F.stddev_samp("ret") * F.sqrt(F.lit(TRADING_DAYS))).alias("factor_vol"), F.min("fall").alias("factor_mdd"), F.sum("ret").alias("sum_yield"))


def brinson(df: DataFrame, by: list[str]) -> DataFrame:
    """Allocation, selection and interaction of ``wp, wb, rp, rb``; the textbook form, as a definition of our own."""
    if not by:  # one row for all: no window over the whole table in one task
        whole = F.broadcast(df.agg(F.sum(F.col("wb") * F.col("rb")).alias("__rb")))
        return brinson_of(df.crossJoin(whole), F.col("__rb")).drop("__rb")
    return brinson_of(df, F.sum(F.col("wb") * F.col("rb")).over(W.partitionBy(*by)))


def brinson_of(df: DataFrame, rb_total: Column) -> DataFrame:
    return df.withColumns({"allocation": (F.col("wp") - F.col("wb")) * (F.col("rb") - rb_total), "selection": F.col("wb") * (F.col("rp") - F.col("rb")), "interaction": (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))})


def previous_window(begin: Column, end: Column) -> tuple[Column, Column]:
    """A window of the same length (a day at least) that ends the day before ``begin``."""
    last = F.date_sub(begin, 1)
    return F.date_sub(last, F.greatest(F.datediff(end, begin), F.lit(1))), last


def unnested_bars(df: DataFrame, column: str = "bar") -> DataFrame:
    """Rows of a JSON object of days to arrays of records."""
    kind = "map<string,array<struct<FundID:bigint,Name:string,Yield:double,NetValue:double>>>"
    days = df.select(F.explode(F.from_json(column, kind)).alias("key", "rows"))
    return days.select(F.col("key").try_cast("date").alias("day"), F.inline("rows"))


def period_pnl(df: DataFrame, column: str = "data") -> DataFrame:
    """``trading_day, name, pnl`` of a JSON object of names to numbers."""
    return df.select("trading_day", F.explode(F.from_json(column, "map<string,double>")).alias("name", "pnl"))


def unpivoted(df: DataFrame, keys: list[str], suffixes: dict[str, str]) -> DataFrame:
    """``name, measure, value`` of columns whose names end in a suffix that stands for a measure."""
    parts = [(c, c[: -len(s)].strip(), m) for c in df.columns for s, m in suffixes.items() if c.endswith(s)]
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("measure"), F.col(f"`{c}`").try_cast("double").alias("value")) for c, n, m in parts])
    return df.select(*keys, F.inline(items))


def largest_contribution(layer: DataFrame, name: str) -> DataFrame:
    """The row with the largest absolute contribution; of equal ones the first by name."""
    return layer.orderBy(F.abs("contribution").desc(), name).limit(1)


def named_row_sum(df: DataFrame, name: str, names: list[str] | None = None) -> DataFrame:
    """``name, total``: the sum of all numeric columns of the rows of some names."""
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, k in df.dtypes if c != name and (k in ("double", "float", "bigint", "int", "smallint", "tinyint") or k.startswith("decimal"))]
    t = df if names is None else df.where(F.col(name).isin(names))
    return t.groupBy(name).agg(F.sum(sum(numeric, F.lit(0.0))).alias("total"))
