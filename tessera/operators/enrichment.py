"""Derived fields of profiles: benchmark guardrails, product lines, scoped evidence, positioning, backgrounds, groups and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import fold_key, match_key, wikilink
from tessera.operators.knowledge import ordered_distinct
from tessera.operators.text import without_bullet

# Benchmark, what in a name stands for it (in order), its tag, its facet value.
BENCHMARKS = [
    ("2000", ["2000"], "2000指增", "中证2000"),
    ("1000", ["1000", "千指"], "1000指增", "中证1000"),
    ("A500", ["a500"], "A500指增", "中证A500"),
    ("500", ["500"], "500指增", "中证500"),
    ("300", ["300"], "300指增", "沪深300"),
]
#: Line, what stands for it.
PRODUCT_LINES = [
    ("指数增强", "指数增强 指增"), ("2000指增", "中证2000 2000指增 2000增强"), ("1000指增", "中证1000 1000指增 1000增强"), ("A500指增", "中证A500 A500指增"),
    ("500指增", "中证500 500指增 500增强"), ("300指增", "沪深300 300指增 300增强"), ("量化多头", "量化多头 空气指增"), ("市场中性", "市场中性 量化中性"),
    ("CTA", "CTA 管理期货"), ("期权", "期权"), ("套利", "套利"),
]
#: Background or constraint, its words.
BACKGROUNDS = [("WorldQuant背景", "worldquant 世坤"), ("Millennium背景", "千禧 millennium"), ("GSA背景", "gsa")]
#: Group, words of its texts; the first that is contained counts.
GROUPS = [
    ("多元CTA", "多元cta"), ("标准CTA", "标准cta"), ("商品CTA", "商品cta"), ("期权CTA", "期权cta"), ("趋势CTA", "趋势cta"), ("基本面CTA", "基本面cta"), ("金融CTA", "金融cta"), ("工具化CTA", "工具化cta"),
    ("CTA其他", "cta"), ("市场中性", "市场中性"), ("股票多头", "空气指增 量化多头"), ("指数增强", "指数增强 指增"),
]
OTHER_GROUP = "其他策略"
INDEX_TAGS = [t for _, _, t, _ in BENCHMARKS]


def _has(text: Column, words: str) -> Column:
    hit = F.lit(False)
    for w in words.split():
        hit = hit | text.contains(w)
    return hit


def benchmark_of(*names: Column) -> Column:
    """The benchmark that a product's names mention: the longer numbers first, so ``A500`` isn't ``500``; empty for none."""
    key = match_key(F.concat_ws("\n", *names))
    pick = F.lit("")
    for code, words, _, _ in reversed(BENCHMARKS):
        pick = F.when(_has(key, " ".join(words)), code).otherwise(pick)
    return pick


def guarded(df: DataFrame, names: list[str]) -> DataFrame:
    """Tags, lines and facets of index benchmarks stay only if the product's own names mention that benchmark.

    Adds ``benchmark``; works on ``secondary_tags``, ``product_lines`` and ``facets``. What is taken
    away goes to ``rejected_tags``.
    """
    t = df.withColumn("benchmark", benchmark_of(*[F.col(c) for c in names]))
    tag = F.element_at(F.create_map(*[x for c, _, v, _ in BENCHMARKS for x in (F.lit(c), F.lit(v))]), F.col("benchmark"))
    value = F.element_at(F.create_map(*[x for c, _, _, v in BENCHMARKS for x in (F.lit(c), F.lit(v))]), F.col("benchmark"))
    known = F.array(*[F.lit(x) for x in INDEX_TAGS])
    keep = lambda c: F.filter(c, lambda x: ~F.array_contains(known, x) | F.coalesce(x == tag, F.lit(False)))
    facets = F.transform_values("facets", lambda k, v: F.when(k == "benchmark", F.filter(v, lambda x: F.coalesce(x == value, F.lit(False)))).otherwise(v))
    before = F.col("secondary_tags")
    t = t.withColumn("rejected_tags", F.array_except(before, keep(before)))
    t = t.withColumns({"secondary_tags": keep(before), "facets": F.map_filter(facets, lambda k, v: F.size(v) > 0)})
    return t.withColumn("product_lines", keep(F.col("product_lines"))) if "product_lines" in t.columns else t


def product_lines(*texts: Column) -> Column:
    """Lines whose words the texts mention."""
    text = F.lower(F.concat_ws("\n", *texts))
    return F.filter(F.array(*[F.when(_has(text, words.lower()), F.lit(line)) for line, words in PRODUCT_LINES]), lambda x: x.isNotNull())


def scoped_evidence(evidence: Column, aliases: Column, n: int = 6) -> Column:
    """Lines that name the product by an alias of three characters or more."""
    keys = F.filter(F.transform(aliases, fold_key), lambda k: F.length(k) >= 3)
    hit = F.filter(F.transform(evidence, without_bullet), lambda x: F.exists(keys, lambda k: fold_key(x).contains(k)))
    return F.slice(F.array_distinct(hit), 1, n)


def evidence_summary(evidence: Column, strategies: Column, words: list[str], n: int = 5) -> Column:
    """Lines that mention a strategy or one of the words, then the first others."""
    lines = F.filter(F.transform(evidence, without_bullet), lambda x: x != "")
    marks = F.concat(F.transform(strategies, wikilink), F.array(*[F.lit(w) for w in words]))
    preferred = F.filter(lines, lambda x: F.exists(marks, lambda m: (m != "") & F.lower(x).contains(F.lower(m))))
    return F.slice(F.array_distinct(F.concat(F.slice(preferred, 1, n), F.slice(lines, 1, n))), 1, n)


def positioning(primary: Column, secondary: Column, lines: Column, strategies: Column, evidence: Column) -> Column:
    """One sentence of tags, lines, strategies and the first evidence."""
    part = lambda head, xs, n: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(F.slice(xs, 1, n), "、")))
    text = F.concat_ws("；", part("一级策略：", primary, 9), part("二级策略：", secondary, 6), part("产品线：", lines, 99), part("策略标签：", F.transform(strategies, wikilink), 8), part("代表证据：", F.transform(evidence, without_bullet), 1))
    return F.when(text != "", text).otherwise("材料未提及明确策略定位")


def scope_split(direct: Column, mentioned: Column) -> Column:
    """``direct`` and what is only ``mentioned``, compared by key."""
    keys = F.transform(direct, fold_key)
    return F.struct(ordered_distinct(direct, fold_key).alias("direct"), F.filter(ordered_distinct(mentioned, fold_key), lambda x: ~F.array_contains(keys, fold_key(x))).alias("mentioned"))


def backgrounds(text: Column) -> Column:
    t = F.lower(text)
    return F.filter(F.array(*[F.when(_has(t, words), F.lit(label)) for label, words in BACKGROUNDS]), lambda x: x.isNotNull())


def exposure_constraints(text: Column) -> Column:
    t = F.lower(text)
    three = t.contains("行业") & (t.contains("3%") | t.contains("3％")) & (t.contains("偏离") | t.contains("暴露"))
    return F.filter(F.array(F.when(three, F.lit("行业暴露3%以内")), F.when(t.contains("barra"), F.lit("Barra风险约束"))), lambda x: x.isNotNull())


def group_of(secondary: Column, primary: Column, text: Column) -> Column:
    """The first tag, else the first group whose words the text mentions."""
    t = F.lower(text)
    pick = F.lit(OTHER_GROUP)
    for name, words in reversed(GROUPS):
        pick = F.when(_has(t, words), name).otherwise(pick)
    full = lambda xs: F.try_element_at(F.filter(xs, lambda x: x != ""), F.lit(1))
    return F.coalesce(full(secondary), full(primary), pick)


def group_rank(name: Column) -> Column:
    """Place of a group: the fixed ones in order, unknown ones after them, the rest last."""
    order = {g: i for i, (g, _) in enumerate(GROUPS)} | {OTHER_GROUP: 99}
    return F.coalesce(F.element_at(F.create_map(*[x for g, i in order.items() for x in (F.lit(g), F.lit(i))]), name), F.lit(98))


def grouped(results: DataFrame) -> DataFrame:
    """Results by group, in order, each with its products by score."""
    t = results.withColumn("group", group_of(F.col("secondary_tags"), F.col("primary_tags"), F.col("profile_text")))
    item = F.struct((-F.col("score")).alias("s"), "product_name")
    g = t.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x["product_name"]).alias("products"))
    return g.orderBy(group_rank(F.col("group")), "group")


def snippet(lines: Column, terms: Column, otherwise: Column) -> Column:
    """The first line that holds the first matched term that any line holds, else the first line, else a text."""
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^[- ]+|[- ]+$", "")), lambda x: x != "")
    by_term = F.transform(terms, lambda t: F.try_element_at(F.filter(clean, lambda x: F.lower(x).contains(F.lower(t))), F.lit(1)))
    return F.coalesce(F.try_element_at(F.filter(by_term, lambda x: x.isNotNull()), F.lit(1)), F.try_element_at(clean, F.lit(1)), otherwise)


def external_issues(profiles: DataFrame) -> DataFrame:
    """Issues of external evidence: it conflicts, stands alone, or is of a low tier."""
    found = F.array(
        F.when(F.col("conflict_status") == "conflict", F.struct(F.lit("high").alias("severity"), F.lit("external_conflict").alias("kind"))),
        F.when((F.size("external_evidence") > 0) & (F.size("evidence") == 0), F.struct(F.lit("warning").alias("severity"), F.lit("external_only").alias("kind"))),
        F.when(F.exists("external_evidence", lambda e: F.lower(e["tier"]).isin("third_party_public", "search_discovery_only")), F.struct(F.lit("info").alias("severity"), F.lit("low_tier_source").alias("kind"))),
    )
    return profiles.select("manager", "product_name", F.inline(F.filter(found, lambda x: x.isNotNull())))


def merged_external(a: Column, b: Column) -> Column:
    """Two arrays of maps, each item once by url, title, claim and publisher."""
    key = lambda m: F.concat_ws("|", *[F.coalesce(m[k], F.lit("")) for k in ("url", "title", "claim", "publisher")])
    seen = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<map<string,string>>").alias("v"))
    return F.aggregate(F.concat(a, b), seen, lambda s, m: F.when(F.array_contains(s["k"], key(m)), s).otherwise(F.struct(F.concat(s["k"], F.array(key(m))).alias("k"), F.concat(s["v"], F.array(m)).alias("v"))))["v"]


def by_external_identity(profiles: DataFrame, ids: str = "external_ids") -> DataFrame:
    """``canonical_key, target_key``: profiles that share an external id go to the last one that has it.

    One pass, not carried on from target to target: chains stay apart.
    """
    e = profiles.select("canonical_key", F.explode(ids).alias("id")).where("id <> ''").distinct()
    target = e.groupBy("id").agg(F.max("canonical_key").alias("target_key"))
    return e.join(target, "id").groupBy("canonical_key").agg(F.max("target_key").alias("target_key"))

