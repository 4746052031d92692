"""Names, profiles and notes derived from parts, as one SQL text that Spark and DuckDB both run.

The texts below only make input: what a name or profile means is worked out by the
operators, and by other SQL in the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread, table


def pick(words: list[str], step: int, shift: int = 0) -> str:
    """One of the words by the part's key; a new one after every ``step`` keys."""
    return f"split_part('{'|'.join(words)}', '|', CAST(1 + (floor(k / {step}) + {shift}) % {len(words)} AS INT))"


CORE = pick(["明汯", "灵均", "九坤", "衍复", "宽德", "幻方", "金锝", "世纪前沿"], 1)
PRODUCTS = f"""SELECT k AS id, manager, product_name,
  CASE k % 5 WHEN 0 THEN '[[' || product_name || ']]' WHEN 1 THEN ' ' || product_name || '， ' WHEN 2 THEN '"' || product_name || '"' WHEN 3 THEN '见[[' || product_name || ']]等' ELSE product_name END AS raw
FROM (SELECT p_partkey AS k,
  {pick(["", "10023_", "上海", "深圳市", "", "（北京）"], 1)} || {CORE} || {pick(["私募基金管理有限公司", "投资管理有限公司", "（上海）基金", "", "私募", "资产管理合伙企业（有限合伙）"], 3)} AS manager,
  CASE WHEN p_partkey % 3 = 0 THEN {CORE} ELSE '' END || {pick(["中证500指数增强", "量化多头", "市场中性", "商品CTA", "1000指增", "稳健", "领航", "A500增强"], 2)}
    || {pick(["1号", "二号", "3期", "", "代表产品", "系列产品", "产品线", "十号"], 5)} || {pick(["", "私募证券投资基金", "", "基金"], 7)} AS product_name
  FROM {{part}}) AS p"""

#: Plain columns of profiles; an empty string stands for a missing tag.
PROFILES = f"""SELECT k AS id, {pick(["明汯投资", "灵均投资", "上海九坤基金", "衍复私募", "宽德投资管理有限公司"], 1)} AS manager,
  {pick(["中证500指数增强", "中证2000指增", "量化多头", "市场中性", "商品CTA", "多元CTA"], 1)} || {pick(["1号", "2号", "代表产品", "产品线", "3号", "系列"], 6)} || CAST(floor(k / 36) AS INT) AS product_name,
  {pick(["管理期货", "指数增强", "股票多头", ""], 1)} AS primary_tag, {pick(["商品CTA", "500指增", "2000指增", "市场中性", "", "300指增", "1000指增"], 1)} AS secondary_tag,
  {pick(["策略以多因子模型为主", "行业偏离≤±3%，用Barra约束", "WorldQuant背景的团队", "期权策略与波动率交易", "商品期货CTA，回撤较小", "收益稳定"], 1)} AS evidence_line,
  {pick(["指增产品线", "日内与T0", "股指期货对冲", "趋势与套利", ""], 2)} AS profile_text,
  {pick(["product", "product", "strategy_line", ""], 3)} AS entity_type, {pick(["confirmed", "weak_line", "needs_review", ""], 5)} AS quality_status,
  {pick(["product_specific", "suspicious_short_name", "strategy_product_line"], 7)} AS name_reason, {pick(["high", "medium", "low"], 4)} AS entity_confidence,
  {pick(["high", "low", "medium"], 8)} AS tag_confidence, {pick(["confirmed", "needs_review"], 9)} AS tag_review_status,
  {pick(["300指增", "", "", "管理期货"], 11)} AS rejected_tag, {pick(["", "", "回撤风险"], 2)} AS risk_point, {pick(["a.md", "", "b.md"], 3)} AS source_note,
  {pick(["", "cross_manager_candidates_only", "matched"], 13)} AS external_match_status,
  CASE WHEN p_partkey % 2 = 0 THEN 'name=x | manager=' || {pick(["明汯投资", "灵均", "九坤基金", "衍复私募", "宽德"], 1)} ELSE 'manager=某某投资' END AS candidate,
  {pick(["一级策略：管理期货", "", "材料未提及明确策略定位"], 17)} AS positioning
FROM (SELECT p_partkey AS k, p_partkey FROM {{part}}) AS p"""

NOTES = f"""SELECT 'note' || k || '.md' AS path,
  '---' || chr(10) || 'entity_type: ' || {pick(["product", "manager", "unknown_kind", ""], 1)} || chr(10) || 'primary_entity: "[[' || {CORE} || {pick(["1号", "二号", "产品线"], 8)} || ']]"' || chr(10) || 'manager: ' || {CORE} || '投资' || chr(10)
    || CASE k % 3 WHEN 0 THEN 'mentioned_products_simple: [甲1号, 乙2号]' WHEN 1 THEN 'mentioned_products_simple:' || chr(10) || '  - 甲1号' || chr(10) || '  - 丙3号' ELSE 'other: x' END || chr(10) || 'main_strategies: [' || {pick(["指数增强", "管理期货, 套利", "中性"], 3)} || ']' || chr(10) || '---' || chr(10)
    || '# ' || {CORE} || chr(10) || chr(10) || '## 策略' || chr(10) || '- ' || {pick(["策略以多因子模型为主", "收益与回撤都好", "没有说明"], 1)} || chr(10) || '* 风控严格' || chr(10) || '1. 持仓分散' || chr(10) || '## 表格' || chr(10) || '| 名称 | 说明 |' || chr(10) || '| --- | :-: |' || chr(10) || '| 甲 | 标签' || k || ' |' || chr(10) || '| 乙 | 丙 |' || chr(10)
    || CASE k % 4 WHEN 0 THEN '<!-- SYSTEM_MENTIONED_PRODUCTS' || chr(10) || '[{{{{"name": "[[丁4号]]", "confidence": "low", "main_strategies": ["CTA"], "evidence_quote": "丁的收益"}}}}]' || chr(10) || '-->' WHEN 1 THEN '<!-- SYSTEM_MENTIONED_PRODUCTS oops -->' ELSE '' END || chr(10) AS content
FROM (SELECT p_partkey AS k FROM {{part}}) AS p"""


def view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text, part=spread(table(spark, sf, "part"), "p_partkey"))


def cte(name: str, text: str) -> str:
    return f"{name} AS ({text.replace('{part}', 'part').replace('{{', '{').replace('}}', '}')})"


def products(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, PRODUCTS)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, NOTES)


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles with lists in place of single tags and lines."""
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    return view(spark, sf, PROFILES).select(
        "*", one("primary_tag").alias("primary_tags"), one("secondary_tag").alias("secondary_tags"), one("evidence_line").alias("evidence"), one("evidence_line").alias("evidence_summary"), F.lit("").alias("search_text"),
        one("rejected_tag").alias("rejected_tags"), one("risk_point").alias("risk_points"), one("source_note").alias("source_notes"), F.array("candidate").alias("rejected_candidates"), one("profile_text").alias("product_lines"),
        F.array().cast("array<string>").alias("source_files"), F.array().cast("array<string>").alias("direct_tags"), F.lit("").alias("path"),
    )


PRODUCTS_CTE, PROFILES_CTE, NOTES_CTE = cte("products", PRODUCTS), cte("profiles", PROFILES), cte("notes", NOTES)
