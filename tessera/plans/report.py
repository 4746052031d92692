"""Text of attribution reports: top lists, hints and the summary. Tables are small when they get here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import bp_text, percent_text

#: Factor, phrase for a positive and for a negative exposure.
HINTS = {
    "size": ("偏大盘", "偏小盘"), "beta": ("高贝塔", "低贝塔"), "momentum": ("追随动量", "逆动量"), "value": ("偏价值", "偏成长"),
    "volatility": ("偏高波动", "偏低波动"), "liquidity": ("偏高换手", "偏低换手"), "leverage": ("偏高杠杆", "偏低杠杆"),
}


def top_text(df: DataFrame, by: list[str], name: str, value: str, k: int = 2, largest: bool = True) -> DataFrame:
    """``text``: the first ``k`` names of a group with their values in basis points, ties by name."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    t = df.where(F.col(value) > 0 if largest else F.col(value) < 0)
    t = t.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(order, name))).where(F.col("__n") <= k)
    item = F.concat(F.col(name), F.lit("（"), bp_text(F.col(value)), F.lit("）"))
    return t.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", item.alias("t")))), lambda x: x["t"]), "，").alias("text"))


def factor_hint(factor: Column, exposure: Column, least: float = 0.1) -> Column:
    """A phrase by the sign of an exposure; neutral below ``least``, plain for unknown factors."""
    up = F.create_map(*[x for k, (a, _) in HINTS.items() for x in (F.lit(k), F.lit(a))])
    down = F.create_map(*[x for k, (_, b) in HINTS.items() for x in (F.lit(k), F.lit(b))])
    phrase = F.when(exposure > 0, F.coalesce(F.element_at(up, factor), F.lit("正暴露"))).otherwise(F.coalesce(F.element_at(down, factor), F.lit("负暴露")))
    return F.when(exposure.isNull(), "-").when(F.abs(exposure) < least, "中性").otherwise(phrase)


def residual(kpis: DataFrame, strategies: DataFrame) -> DataFrame:
    """Interval return less the sum of contributions, with both."""
    total = strategies.agg(F.sum("contribution").alias("explained"))
    return kpis.crossJoin(F.broadcast(total)).withColumn("residual", F.col("interval_return") - F.col("explained"))


def summary(name: str, kpis: DataFrame, strategies: DataFrame, tracks: DataFrame) -> str:
    """The report's first paragraph, rendered on the driver from one row each."""
    k = residual(kpis, strategies).select(*[percent_text(F.col(c)).alias(c) for c in ("interval_return", "annual_return", "annual_vol", "max_drawdown", "explained", "residual")], "begin_used", "end_used").first()
    if k is None:
        return f"{name}: -"
    one = lambda largest: (top_text(tracks.withColumn("g", F.lit(0)), ["g"], "track", "contribution", 2, largest).first() or {"text": "-"})["text"]
    return "\n".join([
        f"{name} {k['begin_used']} ~ {k['end_used']}",
        f"区间收益 {k['interval_return']}，年化 {k['annual_return']}，波动 {k['annual_vol']}，最大回撤 {k['max_drawdown']}",
        f"策略贡献合计 {k['explained']}，残差 {k['residual']}",
        f"正贡献赛道 {one(True)}",
        f"负贡献赛道 {one(False)}",
    ])
