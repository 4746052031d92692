"""Parameterised market queries on ``code, day, price`` and on holdings, calendars and masters.

Dates are parameters with the defaults of the year's start or so many days
before the last one, so a result never depends on when it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio
from tessera.operators import series as S


def named(quotes: DataFrame) -> DataFrame:
    return quotes.select(F.col("code").alias("series"), "day", F.col("price").alias("nav"))


def period(quotes: DataFrame, codes: list | None, start: Column, end: Column) -> DataFrame:
    """Quotes of some codes (or all) within a closed interval."""
    t = quotes.where(F.col("day").between(start, end))
    return t.where(F.col("code").isin(codes)) if codes is not None else t


def ytd(quotes: DataFrame, codes: list | None, today: str) -> DataFrame:
    """From 1 January of the day's year to that day."""
    d = F.lit(today).cast("date")
    return period(quotes, codes, F.trunc(d, "year"), d)


def recent(quotes: DataFrame, codes: list | None, today: str, days: int) -> DataFrame:
    d = F.lit(today).cast("date")
    return period(quotes, codes, F.date_sub(d, days), d)


def total_return(quotes: DataFrame) -> DataFrame:
    g = quotes.groupBy("code").agg((ratio(F.max_by("price", "day"), F.min_by("price", "day")) - 1).alias("return"), F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
    return g


def performance(quotes: DataFrame, codes: list | None, today: str, months: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Returns over blocks of 30 days a month up to a day, one column each."""
    d = F.lit(today).cast("date")
    t = quotes.where(F.col("day") <= d)
    t = t.where(F.col("code").isin(codes)) if codes is not None else t
    last = F.max_by("price", "day")
    first = lambda m: F.min_by(F.when(F.col("day") >= F.date_sub(d, 30 * m), F.col("price")), F.when(F.col("day") >= F.date_sub(d, 30 * m), F.col("day")))
    return t.groupBy("code").agg(*[(ratio(last, first(m)) - 1).alias(f"return_{m}m") for m in months])


def latest_holdings(holdings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest holdings of each code at its last report date."""
    t = holdings.withColumn("__last", F.max("report_date").over(W.partitionBy("code"))).where("report_date = __last").drop("__last")
    nth = F.row_number().over(W.partitionBy("code").orderBy(F.desc("value"), "asset"))
    return t.withColumn("rank", nth).where(F.col("rank") <= n)


def industry_rollup(holdings: DataFrame, industries: DataFrame) -> DataFrame:
    """Sum of weights by industry; assets without one stay, as null."""
    return holdings.join(industries, "asset", "left").groupBy("code", "industry").agg(F.sum("weight").alias("weight"))


def point_in_time(df: DataFrame, key: list[str], day: str, at: Column) -> DataFrame:
    """The last row of each key up to a date."""
    rest = [c for c in df.columns if c not in key]
    return df.where(F.col(day) <= at).groupBy(*key).agg(F.max_by(F.struct(*rest), day).alias("r")).select(*key, "r.*")


def recent_days(calendar: DataFrame, n: int) -> DataFrame:
    return calendar.select("day").distinct().orderBy(F.desc("day")).limit(n)


def name_to_code(c: Column, names: dict[str, str]) -> Column:
    """A known name's code; other values pass."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), c), c)


def reporting_dates(days: DataFrame, code: int = 4) -> DataFrame:
    """The last day present of each period (4: quarter)."""
    return S.resampled(days.select(F.lit(0).alias("series"), "day", F.lit(0.0).alias("nav")), code).select(F.col("last_day").alias("day"))


def found_by_name(df: DataFrame, column: str, text: str, n: int = 1, then: list[str] = ()) -> DataFrame:
    """Rows whose name contains the text literally: equal first, then the shortest, then by name and other columns."""
    c = F.col(column)
    return df.where(c.contains(text)).orderBy((c == text).desc(), F.length(c), c, *then).limit(n)


def search_quick(df: DataFrame, keyword: str, columns: list[str], page: int = 0, size: int = 20) -> DataFrame:
    """A page of rows any of whose columns contains the keyword."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(keyword.lower())
    return df.where(hit).orderBy(*columns).offset(page * size).limit(size)


def shares_by_day(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Allocation: each group's share of a day's total."""
    g = df.groupBy("day", by).agg(F.sum(value).alias("value"))
    return g.withColumn("share", ratio(F.col("value"), F.sum("value").over(W.partitionBy("day"))))


def running_pnl(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    g = df.groupBy("day", by).agg(F.sum(value).alias("pnl"))
    return g.withColumn("cum_pnl", F.sum("pnl").over(W.partitionBy(by).orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


def with_total_row(df: DataFrame, label: str, name: str, weight: str, values: list[str]) -> DataFrame:
    """Rows with one more that holds the weighted means."""
    total = df.agg(*[ratio(F.sum(F.col(weight) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values], F.sum(weight).alias(weight))
    return df.select(label, weight, *values).unionByName(total.select(F.lit(name).alias(label), weight, *values))


def minmax(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Score scaled to 0 to 1 within a group."""
    w = W.partitionBy(*by)
    return df.withColumn(f"{value}_norm", ratio(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def fetched(df: DataFrame, key: str | None = None, keys: list | None = None, day: str | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of some keys (all if none are given) within a closed interval of days, with some columns: filters that reach the scan."""
    t = df if keys is None else df.where(F.col(key).isin(keys))
    if day is not None:
        t = t if start is None else t.where(F.col(day) >= F.lit(start).cast("date"))
        t = t if end is None else t.where(F.col(day) <= F.lit(end).cast("date"))
    return t if columns is None else t.select(*columns)


def latest_rows(df: DataFrame, key: str, keys: list | None, day: str) -> DataFrame:
    """The last row of each key."""
    t = fetched(df, key, keys)
    rest = [c for c in df.columns if c != key]
    return t.groupBy(key).agg(F.max_by(F.struct(*rest), day).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def fund_information(ids: DataFrame, managers: DataFrame, scales: DataFrame, codes: list, today: str) -> DataFrame:
    """Identity of funds with their managers and their last scale of the year before a day; a part that is missing is null."""
    d = F.lit(today).cast("date")
    people = managers.where(F.col("code").isin(codes)).groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("manager")), ", ").alias("managers"))
    last = scales.where(F.col("code").isin(codes) & F.col("day").between(F.date_sub(d, 365), d)).groupBy("code").agg(F.max_by("scale", "day").alias("scale"), F.count(F.lit(1)).alias("scales"))
    return ids.where(F.col("code").isin(codes)).join(people, "code", "left").join(last, "code", "left")


def stock_latest(industries: DataFrame, caps: DataFrame, codes: list, today: str) -> DataFrame:
    """Industry in force and market value at a day."""
    d = F.lit(today).cast("date")
    i = point_in_time(industries.where(F.col("code").isin(codes)), ["code"], "day", d).select("code", "industry")
    c = point_in_time(caps.where(F.col("code").isin(codes)), ["code"], "day", d).select("code", "cap", F.col("day").alias("cap_day"))
    return i.join(c, "code", "full")


def style_window(styles: DataFrame, barra: DataFrame, codes: list, today: str, months: int = 12) -> DataFrame:
    """``code, factor, kind`` with mean, last value and number of days over so many months of 30 days."""
    d = F.lit(today).cast("date")
    part = lambda df, kind: recent(df, codes, today, 30 * months).withColumn("kind", F.lit(kind))
    t = part(styles, "style").unionByName(part(barra, "barra")).where(F.col("day") <= d)
    return t.groupBy("code", "kind", "factor").agg(F.avg("price").alias("mean"), F.max_by("price", "day").alias("last"), F.count(F.lit(1)).alias("n"))


def corporate_actions(events: DataFrame, shares: DataFrame, codes: list, today: str, years: int = 2) -> DataFrame:
    """Ex-right events and changes of capital within so many years of 365 days, by day."""
    d = F.lit(today).cast("date")
    part = lambda df, kind: df.where(F.col("code").isin(codes) & F.col("day").between(F.date_sub(d, 365 * years), d)).select("code", "day", F.lit(kind).alias("kind"), "value")
    return part(events, "event").unionByName(part(shares, "shares"))


def held_at(holdings: DataFrame, at: str) -> DataFrame:
    """``code`` of positions with weight at their last day up to a date, and those that have none any more: ``held``."""
    t = holdings.where(F.col("day") <= F.lit(at).cast("date"))
    whole = t.agg(F.max("day").alias("__top"))
    return t.groupBy("code").agg(F.max("day").alias("last_day")).join(F.broadcast(whole)).select("code", "last_day", (F.col("last_day") == F.col("__top")).alias("held"))
