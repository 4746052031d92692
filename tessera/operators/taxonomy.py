"""Strategy classification of texts against a fixed taxonomy, within each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import match_key, text_key

# Code, name, aliases.
PRIMARY = [
    ("EQ_LONG", "股票多头", "股票多头 主观多头 量化多头 量化多头策略 股票主题 股票策略 空气指增"),
    ("EQ_INDEX_ENH", "指数增强", "指数增强 指增 量化指增"),
    ("EQ_NEUTRAL", "市场中性", "市场中性 量化中性 股票市场中性 中性策略 对冲"),
    ("CTA", "管理期货", "CTA 管理期货 量化CTA 期货策略"),
    ("ARB", "相对价值", "相对价值 套利 统计套利 ETF套利 期货套利 转债套利 跨境套利 做市"),
    ("VOL", "期权波动率", "期权 波动率 期权波动率 期权套利 期权CTA 双卖 香草 雪球"),
    ("FI", "债券信用", "债券 固收 信用 利率 转债多头 固收增强 高收益信用"),
    ("MACRO_MULTI", "宏观多资产", "宏观 多资产 宏观对冲 ETF轮动 全球宏观 系统化宏观 风险平价"),
    ("FOF_MOM", "组合基金", "FOF MOM 组合基金 多策略组合 管理人组合"),
    ("EVENT", "事件驱动", "事件驱动 定增 并购重组 困境 打新 指数纳入"),
    ("OTHER_REVIEW", "待确认", "待确认 待定 混合 灵活对冲 无法识别"),
]
#: Code, parent, name, aliases.
SECONDARY = [
    ("IE_300", "EQ_INDEX_ENH", "300指增", "沪深300 300指增 沪深300指数增强 300增强"),
    ("IE_500", "EQ_INDEX_ENH", "500指增", "中证500 500指增 中证500指数增强 500增强"),
    ("IE_1000", "EQ_INDEX_ENH", "1000指增", "中证1000 1000指增 中证1000指数增强 1000增强 千指增"),
    ("IE_A500", "EQ_INDEX_ENH", "A500指增", "中证A500 A500指增 中证A500指数增强 A500指数增强 A500增强"),
    ("IE_2000", "EQ_INDEX_ENH", "2000指增", "中证2000 2000指增 中证2000指数增强 2000增强"),
    ("MN_300", "EQ_NEUTRAL", "300中性", "300中性 沪深300中性"),
    ("MN_500", "EQ_NEUTRAL", "500中性", "500中性 中证500中性"),
    ("MN_1000", "EQ_NEUTRAL", "1000中性", "1000中性 中证1000中性"),
    ("CTA_COMMODITY", "CTA", "商品CTA", "商品CTA 商品趋势 商品期货 商品基本面 商品期限结构"),
    ("CTA_INDEX", "CTA", "股指CTA", "股指CTA 股指期货CTA 金融CTA"),
    ("CTA_TREND", "CTA", "趋势CTA", "趋势CTA 短周期趋势CTA 中周期趋势CTA 长周期趋势CTA 趋势跟踪"),
    ("CTA_FUNDAMENTAL", "CTA", "基本面CTA", "基本面CTA 产业逻辑 库存 仓单"),
    ("VOL_OPTION_CTA", "VOL", "期权CTA", "期权CTA 期权方向 期权趋势"),
    ("VOL_SHORT_VOL", "VOL", "期权双卖", "双卖 卖波 卖出波动率 时间价值"),
    ("ARB_ETF", "ARB", "ETF套利", "ETF套利 ETF做市 ETF价差"),
    ("ARB_CONVERTIBLE", "ARB", "转债套利", "转债套利 可转债套利 转债中性"),
    ("FI_CREDIT", "FI", "信用债", "信用债 短期信用 中长期信用 中高收益信用 高收益信用"),
    ("FI_RATE", "FI", "利率债", "利率债 久期 中短期利率 中长期利率"),
    ("MACRO_ETF_ROTATION", "MACRO_MULTI", "ETF轮动", "ETF轮动 大类资产轮动"),
]
#: Axis, value, aliases.
FACETS = [
    ("benchmark", "沪深300", "沪深300 300"), ("benchmark", "中证500", "中证500 500"), ("benchmark", "中证A500", "中证A500 A500"), ("benchmark", "中证1000", "中证1000 1000 千指"), ("benchmark", "中证2000", "中证2000 2000"),
    ("decision_mode", "量化", "量化 系统化 模型"), ("decision_mode", "主观", "主观 人工"), ("decision_mode", "混合", "主观+量化 混合"),
    ("instrument", "股票", "股票 A股"), ("instrument", "商品期货", "商品期货 商品"), ("instrument", "股指期货", "股指期货 股指"), ("instrument", "国债期货", "国债期货"), ("instrument", "场内期权", "ETF期权 股指期权 场内期权"), ("instrument", "场外期权", "场外期权 香草 雪球"), ("instrument", "可转债", "可转债 转债"),
    ("horizon", "日内", "日内 T0"), ("horizon", "短周期", "短周期 高频"), ("horizon", "中周期", "中周期 中短周期"), ("horizon", "长周期", "长周期 长期"),
    ("return_engine", "alpha", "alpha 阿尔法 超额"), ("return_engine", "trend", "trend 趋势 动量"), ("return_engine", "carry", "carry 期限结构 展期"), ("return_engine", "volatility", "volatility 波动率 波动"), ("return_engine", "convergence", "convergence 回归 收敛 价差"), ("return_engine", "credit_spread", "信用利差 利差"),
    ("risk_shape", "低波", "低波 低波动"), ("risk_shape", "高杠杆", "高杠杆 杠杆"), ("risk_shape", "尾部保护", "尾部保护 买权保护"), ("risk_shape", "尾部卖方", "尾部卖方 卖波"), ("risk_shape", "高换手", "高换手"),
    ("portfolio_role", "权益进攻", "权益进攻"), ("portfolio_role", "低波底仓", "低波底仓 底仓"), ("portfolio_role", "现金增强", "现金增强"), ("portfolio_role", "分散化", "分散化 分散"),
]
CANDIDATE_STEMS = ("CTA", "套利", "中性", "指增")


def rule_table(rows: list[tuple[str, str, str, str]]) -> Column:
    """A literal array of ``code, parent, name, keys``."""
    return F.array(*[F.struct(F.lit(c).alias("code"), F.lit(p).alias("parent"), F.lit(n).alias("name"), F.array(*[F.lit(text_key(a)) for a in [n, *names.split()]]).alias("keys")) for c, p, n, names in rows])


def hits(key: Column, rules: Column) -> Column:
    """Rules any of whose keys is contained, with the number of keys that are."""
    counted = F.transform(rules, lambda r: F.struct(r["code"].alias("code"), r["parent"].alias("parent"), r["name"].alias("name"), F.size(F.filter(r["keys"], lambda k: key.contains(k))).alias("n")))
    return F.filter(counted, lambda r: r["n"] > 0)


def classified(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds primary and secondary codes and names, facets, candidate terms, confidence and review status.

    A secondary tag gives its parent four points and one for each alias found, a
    primary tag two and one for each; the best code wins, the first in the
    taxonomy's order on a tie. Nothing found, or only the class for review: that class.
    """
    secondary, primary = rule_table(SECONDARY), rule_table([(c, c, n, a) for c, n, a in PRIMARY])
    t = df.withColumn("__key", match_key(F.col(text)))
    t = t.withColumn("__s", hits(F.col("__key"), secondary)).withColumn("__p", hits(F.col("__key"), primary))
    score = lambda code: F.aggregate(F.filter("__s", lambda r: r["parent"] == code), F.lit(0), lambda a, r: a + 4 + r["n"]) + F.aggregate(F.filter("__p", lambda r: r["code"] == code), F.lit(0), lambda a, r: a + 2 + r["n"])
    scores = F.array(*[F.struct(score(F.lit(c)).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("code"), F.lit(n).alias("name")) for i, (c, n, _) in enumerate(PRIMARY)])
    # the best score over all classes; the class for review never wins against another one
    t = t.withColumn("__scores", scores).withColumn("__top", F.array_max("__scores"))
    second_best = F.array_max(F.filter("__scores", lambda s: (s["score"] == F.col("__top.score")) & (s["code"] != "OTHER_REVIEW")))
    none = F.struct(F.lit(0).alias("score"), F.lit(0).alias("order"), F.lit("OTHER_REVIEW").alias("code"), F.lit("待确认").alias("name"))
    t = t.withColumn("__best", F.when(F.col("__top.score") > 0, F.coalesce(second_best, none)).otherwise(none))
    mine = F.filter("__s", lambda r: r["parent"] == F.col("__best.code"))
    facet = lambda a: F.transform(hits(F.col("__key"), rule_table([(x, x, v, n) for x, v, n in FACETS if x == a])), lambda r: r["name"])
    axes = list(dict.fromkeys(a for a, _, _ in FACETS))
    facets = F.map_filter(F.create_map(*[x for a in axes for x in (F.lit(a), facet(a))]), lambda k, v: F.size(v) > 0)
    span = r"[一-鿿A-Za-z0-9]{0,12}"
    terms = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({span}{s}{span})"), F.lit(1)) for s in CANDIDATE_STEMS]))
    others = F.transform(F.filter("__s", lambda r: r["parent"] != F.col("__best.code")), lambda r: r["name"])
    t = t.withColumns({
        "primary_code": F.col("__best.code"),
        "primary_tag": F.col("__best.name"),
        "secondary_codes": F.when(F.col("__top.score") > 0, F.transform(mine, lambda r: r["code"])).otherwise(F.array().cast("array<string>")),
        "secondary_tags": F.transform(mine, lambda r: r["name"]),
        "facets": facets,
        "candidate_tags": F.array_distinct(F.concat(others, terms)),
    })
    unsure = F.col("primary_code") == "OTHER_REVIEW"
    t = t.withColumn("tag_confidence", F.when(unsure, "low").when((F.size("secondary_codes") > 0) & (F.size("facets") > 0), "high").otherwise("medium"))
    return t.withColumn("tag_review_status", F.when(unsure, "needs_review").otherwise("confirmed")).drop("__key", "__s", "__p", "__scores", "__top", "__best")


def expanded_terms(query: str) -> list[str]:
    """Names and aliases of every tag that a query mentions, with those of its parent."""
    key, out = text_key(query), []
    by_code = {c: [c, n, *a.split()] for c, n, a in PRIMARY}
    for c, n, a in PRIMARY:
        if any(text_key(x) in key for x in [c, n, *a.split()]):
            out += by_code[c]
    for c, p, n, a in SECONDARY:
        if any(text_key(x) in key for x in [c, n, *a.split()]):
            out += [c, n, *a.split(), *by_code[p]]
    seen: dict[str, str] = {}
    for x in out:
        seen.setdefault(text_key(x), x)
    return list(seen.values())
