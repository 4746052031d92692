"""Rules on the audited fields, evidence and notes of a Markdown report, one row for each broken rule.

A report's field table has a row for each audited field: name, value, conclusion, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.text import section, table_rows

# Headings, fields, words of conclusions, and what marks evidence as indirect.
FIELDS_AT, EVIDENCE_AT, NOTES_AT, PORTRAIT_AT = "### 字段审核", "### 关键证据", "### 口径说明", "### 策略画像"
FIELDS = ["strategyType", "raceName", "fundType"]
PORTRAIT_ROWS = ["一级赛道", "细分赛道", "策略属性", "收益来源", "投资范围", "风险画像", "标签映射"]
NEEDS_SUGGESTION = r"需补充|需修正|需复核补充"
UNSURE = "待人工确认"
INDIRECT = r"同系列推断|间接证据|无直接证据|缺少直接|依赖同系列|全部来自同.*系列|基准体系不一致|杠杆.*不一致|波动特征未直接验证"
BOUNDARY, CHAIN = "推论边界风险", "证据链小结"


def _row(rows: Column, field: str) -> Column:
    """Cells of a field's row, null if there is none."""
    own = F.filter(rows, lambda r: (F.size(r) >= 4) & (F.regexp_replace(F.try_element_at(r, F.lit(1)), r"[`*\s]", "") == field))
    return F.try_element_at(own, F.lit(1))


def field_issues(reports: DataFrame, strict: bool = False) -> DataFrame:
    """``path, level, rule, detail`` for reports ``path, content``."""
    text = F.coalesce("content", F.lit(""))
    t = reports.select("path", F.coalesce(table_rows(section(text, FIELDS_AT)), F.array().cast("array<array<string>>")).alias("rows"), F.coalesce(section(text, NOTES_AT), F.lit("")).alias("notes"), F.coalesce(section(text, EVIDENCE_AT), F.lit("")).alias("evidence"), F.coalesce(section(text, PORTRAIT_AT), F.lit("")).alias("portrait"))
    t = t.withColumns({f: _row(F.col("rows"), f) for f in FIELDS})
    race, kind = F.array_join("raceName", "|"), F.array_join("fundType", "|")
    asked = F.try_element_at("raceName", F.lit(3)).rlike(NEEDS_SUGGESTION)
    given = F.regexp_extract_all(race, F.lit(r"建议\s*[:：]\s*([^<|)）]+)"), F.lit(1))
    first = F.regexp_replace(F.coalesce(F.try_element_at(given, F.lit(1)), F.lit("")), r"^[ *`。；;，,]+|[ *`。；;，,]+$", "")
    t = t.withColumns({"asked": F.coalesce(asked, F.lit(False)), "given": F.coalesce(given, F.array().cast("array<string>")), "first": first, "indirect": F.coalesce(kind.rlike(INDIRECT), F.lit(False)), "kind": kind})
    lines = F.filter(F.transform(F.split("notes", "\n"), lambda x: F.trim(x)), lambda x: ~x.isin("", "---"))
    t = t.withColumn("note", F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))
    proofs = F.size(F.filter(F.split("evidence", "\n"), lambda x: F.trim(x).startswith("**P")))
    absent = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    no_row = F.filter(F.array(*[F.when(~F.col("portrait").contains(r), F.lit(r)) for r in PORTRAIT_ROWS]), lambda x: x.isNotNull())
    soft = "error" if strict else "warning"

    def rule(broken: Column, level: str, name: str, detail: Column | str) -> Column:
        return F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))

    found = F.array(
        rule(F.size(absent) > 0, soft, "audit_rows", F.array_join(absent, ", ")),
        rule((F.col("portrait") != "") & (F.size(no_row) > 0), soft, "portrait_rows", F.array_join(no_row, ", ")),
        rule((F.col("portrait") != "") & F.col("portrait").contains("```"), "error", "portrait_code", "a code block"),
        rule(F.col("asked") & (F.size("given") == 0), "error", "race_suggestion", "none given"),
        rule(F.col("asked") & (F.size("given") > 1), "error", "race_suggestion", "more than one given"),
        rule(F.col("asked") & (F.size("given") == 1) & F.col("first").isin("", UNSURE, "人工确认"), "error", "race_suggestion", "no value"),
        rule(F.col("asked") & (F.size("given") == 1) & F.col("first").rlike(r"(?i)[、，,；;]|\s(?:或|or)\s"), "error", "race_suggestion", "several values in one"),
        rule(F.col("indirect") & ~F.col("kind").contains(UNSURE), "error", "fund_type", "indirect evidence needs confirmation"),
        rule(F.col("indirect") & F.try_element_at("fundType", F.lit(3)).rlike(r"建议\s*[:：]"), "error", "fund_type", "a value in spite of indirect evidence"),
        rule((F.col("notes") != "") & ~F.col("note").startswith("- "), "error", "boundary_first", "not a list"),
        rule(F.col("note").startswith("- ") & ~F.col("note").contains(f"**{BOUNDARY}**"), "error", "boundary_first", "another item comes first"),
        rule((proofs >= 3) & ~F.col("evidence").contains(CHAIN), "warning", "evidence_chain", "three or more items without a summary"),
    )
    return t.select("path", F.inline(F.filter(found, lambda x: x.isNotNull())))
