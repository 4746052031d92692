"""Queries on notes, reports, files and scalar formats, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as C
from tessera.functions.names import match_key
from tessera.operators import enrichment as X
from tessera.operators import geometry as G
from tessera.operators import joins as J
from tessera.operators import knowledge as K
from tessera.operators import layout as LY
from tessera.operators import report_rules as RR
from tessera.operators import retrieval as R
from tessera.operators import text as TX
from tessera.plans import knowledge_views as V
from tessera.plans import profiles as P
from tessera.plans.name_queries import sql_key, sql_link
from tessera.session import table
from tessera.sources import io

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HEAD = r"regexp_extract(content, '(?s)^---[ \t]*\n(.*?)\n---', 1)"
_HEADS = f"h AS (SELECT path, content, {_HEAD} AS head FROM notes)"


def _value(key: str) -> str:
    return f"nullif({sql_link(rf'''regexp_extract(head, '(?m)^{key}:[ \t]*(\S.*)$', 1)''')}, '')"


_FLOW = r"regexp_extract(head, '(?m)^{}:\s*\[(.*?)\]', 1)"
_BLOCK = r"regexp_extract(chr(10) || head || chr(10), '\n{}:\s*\n((?:\s*- .*\n)+)', 1)"


def _list(key: str) -> str:
    flow, block = _FLOW.format(key), _BLOCK.format(key)
    return rf"CASE WHEN {flow} <> '' THEN list_transform(string_split({flow}, ','), lambda x: trim(x)) WHEN {block} <> '' THEN list_transform(string_split(trim({block}, chr(10) || ' '), chr(10)), lambda x: regexp_replace(x, '^\s*- ', '')) ELSE [] END"


@query(f"""WITH {V.NOTES_CTE}, {_HEADS} SELECT path, nullif(head, '') AS head, {_value('entity_type')} AS entity_type, {_value('primary_entity')} AS primary_entity, {_value('manager')} AS manager,
array_to_string({_list('mentioned_products_simple')}, '|') AS mentioned, array_to_string({_list('main_strategies')}, '|') AS main_strategies FROM h""")
def note_heads(spark, sf):
    t = P.notes(V.notes(spark, sf))
    return t.select("path", "head", "entity_type", "primary_entity", "manager", F.array_join("mentioned", "|").alias("mentioned"), F.array_join("main_strategies", "|").alias("main_strategies"))


_JSON = r"regexp_extract(content, '(?s)<!--\s*SYSTEM_MENTIONED_PRODUCTS\s*(.*?)-->', 1)"


@query(f"""WITH {V.NOTES_CTE}, {_HEADS}, n AS (SELECT path, {_value('entity_type')} AS kind, {_value('primary_entity')} AS own, {_list('mentioned_products_simple')} AS plain, starts_with({_JSON}, '[') AS listed, array_to_string({_list('main_strategies')}, '|') AS strategies FROM h),
f AS (SELECT path, 0 AS ordinal, own AS product_name, 'medium' AS confidence, strategies FROM n WHERE kind = 'product'
  UNION ALL SELECT path, CAST(kind = 'product' AS INTEGER), '丁4号', 'low', 'CTA' FROM n WHERE listed
  UNION ALL SELECT path, CAST(coalesce(kind = 'product', false) AS INTEGER) + CAST(i - 1 AS INTEGER), p, 'medium', strategies FROM (SELECT path, kind, listed, strategies, unnest(plain) AS p, generate_subscripts(plain, 1) AS i FROM n) WHERE NOT listed)
SELECT path, ordinal, product_name, confidence, strategies FROM f""")
def note_fragments(spark, sf):
    t = P.fragments(P.notes(V.notes(spark, sf)))
    return t.select("path", "ordinal", "product_name", "confidence", F.array_join("strategies", "|").alias("strategies"))


@query(f"""WITH {V.NOTES_CTE}, {_HEADS}, n AS (SELECT path, content, {_value('entity_type')} AS kind, {_value('primary_entity')} AS own, {_value('manager')} AS manager FROM h)
SELECT path, 'missing_fields' AS kind, concat_ws(', ', CASE WHEN n.kind IS NULL THEN 'entity_type' END, CASE WHEN own IS NULL THEN 'primary_entity' END, CASE WHEN manager IS NULL THEN 'manager' END) AS detail FROM n WHERE n.kind IS NULL OR own IS NULL OR manager IS NULL
UNION ALL SELECT path, 'unknown_entity_type', n.kind FROM n WHERE n.kind NOT IN ('product', 'manager', 'product_series', 'strategy')
UNION ALL SELECT path, 'unreadable_products', 'SYSTEM_MENTIONED_PRODUCTS' FROM n WHERE contains(content, 'PRODUCTS oops')""")
def note_checks(spark, sf):
    return P.note_issues(P.notes(V.notes(spark, sf)), ["entity_type", "primary_entity", "manager"])


_SECTION = r"trim(regexp_extract(chr(10) || content, '(?s)\n## 策略[ \t]*\n(.*?)\n## 表格', 1), ' ' || chr(10))"


@query(rf"""WITH {V.NOTES_CTE}, s AS (SELECT path, content, {_SECTION} AS section FROM notes), l AS (SELECT path, unnest(string_split(section, chr(10))) AS line, generate_subscripts(string_split(section, chr(10)), 1) AS i FROM s)
SELECT s.path AS path, section, (SELECT string_agg(trim(regexp_replace(line, '^\s*(?:[-*+•]|\d+[.)])\s+', '')), '|' ORDER BY i) FROM l WHERE l.path = s.path) AS bare,
  (SELECT string_agg(trim(line), '|' ORDER BY i) FROM (SELECT * FROM l WHERE (contains(line, '风控') OR contains(line, '收益') OR contains(line, '持仓')) AND l.path = s.path ORDER BY i LIMIT 2)) AS found FROM s""")
def note_sections(spark, sf):
    sec = TX.section(F.col("content"), "## 策略")
    return V.notes(spark, sf).select("path", sec.alias("section"), F.array_join(F.transform(F.split(sec, "\n"), TX.without_bullet), "|").alias("bare"), F.array_join(TX.lines_with(sec, ["风控", "收益", "持仓"], 2), "|").alias("found"))


@query(f"""WITH {V.NOTES_CTE} SELECT path, '甲' AS name, regexp_extract(content, '(标签[0-9]+)', 1) AS label FROM notes UNION ALL SELECT path, '乙', '丙' FROM notes""")
def note_vocabulary(spark, sf):
    return P.vocabulary(V.notes(spark, sf), "## 表格", ["name", "label"])


@query(f"""WITH {V.NOTES_CTE} SELECT path, '| 名称 | 说明 |' || chr(10) || '| --- | --- |' || chr(10) || '| 甲 | ' || regexp_extract(content, '(标签[0-9]+)', 1) || ' |' || chr(10) || '| 乙 | 丙 |' AS markdown FROM notes""")
def table_markdown(spark, sf):
    return V.notes(spark, sf).select("path", TX.to_markdown(TX.table_rows(TX.section(F.col("content"), "## 表格"))).alias("markdown"))


@query(f"""WITH {V.NOTES_CTE}, l AS (SELECT DISTINCT regexp_extract(content, '(标签[0-9]+)', 1) AS label FROM notes) SELECT label FROM l WHERE contains(label, '签1')""")
def label_search(spark, sf):
    words = P.vocabulary(V.notes(spark, sf), "## 表格", ["name", "label"]).where("name = '甲'").select("label").distinct()
    return P.labels_like(words, "签1")


@query(f"""WITH {V.PROFILES_CTE} SELECT manager, '# ' || manager || chr(10) || chr(10) || string_agg('- [[' || product_name || ']] ' || primary_tag, chr(10) ORDER BY product_name, primary_tag) AS markdown FROM profiles GROUP BY manager""")
def manager_pages(spark, sf):
    return P.manager_pages(V.profiles(spark, sf))


@query(f"""WITH {V.PROFILES_CTE}, s AS (SELECT quality_status, product_name, row_number() OVER (PARTITION BY quality_status ORDER BY product_name) AS r FROM profiles)
SELECT quality_status, count(*) AS n, coalesce(string_agg(product_name, '|' ORDER BY product_name) FILTER (r <= 20 AND quality_status <> 'confirmed'), '') AS names FROM s GROUP BY 1""")
def quality_report(spark, sf):
    return P.quality_report(V.profiles(spark, sf)).withColumn("names", F.array_join("names", "|"))


@query(f"""WITH {V.PROFILES_CTE} SELECT count(*) AS profiles, count(DISTINCT manager) AS managers, count(DISTINCT product_name) AS products, count(*) FILTER (quality_status = 'confirmed') AS confirmed FROM profiles""")
def profile_overview(spark, sf):
    return P.overview(V.profiles(spark, sf))


_MANIFEST = """m AS (SELECT 's' || o_custkey || '.pdf' AS source_path, strftime(o_orderdate, '%Y-%m-%d') AS parsed_at, o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status, 'n' || (o_orderkey % 50) || '.md' AS source_note_path, 'h' || (o_orderkey % 97) AS sha256 FROM orders),
here AS (SELECT 's' || c_custkey || '.pdf' AS path, 'h' || (c_custkey % 120) AS sha256 FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT 'n' || n_nationkey || '.md', 'x' FROM nation)"""


def _manifest(spark, sf):
    m = table(spark, sf, "orders").selectExpr("'s' || o_custkey || '.pdf' AS source_path", "date_format(o_orderdate, 'yyyy-MM-dd') AS parsed_at", "o_orderkey AS run_id", "CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status", "'n' || (o_orderkey % 50) || '.md' AS source_note_path", "'h' || (o_orderkey % 97) AS sha256")
    here = table(spark, sf, "customer").where("c_custkey % 5 > 0").selectExpr("'s' || c_custkey || '.pdf' AS path", "'h' || (c_custkey % 120) AS sha256").unionByName(table(spark, sf, "nation").selectExpr("'n' || n_nationkey || '.md' AS path", "'x' AS sha256"))
    return m, here


@query(f"""WITH {_MANIFEST}, l AS (SELECT source_path, arg_max(status, (parsed_at, run_id)) AS status, arg_max(source_note_path, (parsed_at, run_id)) AS note FROM m GROUP BY 1),
k AS (SELECT source_path, CASE WHEN source_path NOT IN (SELECT path FROM here) THEN 'source_missing' WHEN status = 'failed' THEN 'parse_failed' WHEN status = 'success' AND note NOT IN (SELECT path FROM here) THEN 'note_missing' END AS kind FROM l)
SELECT source_path, kind FROM k WHERE kind IS NOT NULL""")
def lifecycle_checks(spark, sf):
    m, here = _manifest(spark, sf)
    return P.lifecycle_issues(m.drop("sha256"), here)


@query(f"WITH {_MANIFEST} SELECT path FROM here WHERE sha256 NOT IN (SELECT sha256 FROM m WHERE status = 'success')")
def changed_files(spark, sf):
    m, here = _manifest(spark, sf)
    return P.changed_only(here, m).select("path")


_RUNS = "SELECT c_custkey AS id, c_custkey % 3 AS sources, c_custkey % 5 AS profiles, c_custkey % 4 + c_custkey % 2 * 2 AS indexed, CAST(c_custkey % 7 = 0 AS INTEGER) AS failed, c_custkey % 2 AS processed, c_custkey % 6 AS skipped FROM customer"


@query(f"""WITH c AS ({_RUNS}) SELECT id, CASE WHEN sources = 0 THEN CASE WHEN failed > 0 THEN 'failed' ELSE 'no_sources' END WHEN profiles = 0 THEN 'no_profiles' WHEN indexed < profiles THEN 'index_incomplete' WHEN failed > 0 THEN 'partial' WHEN processed = 0 AND skipped > 0 THEN 'unchanged' ELSE 'success' END AS status FROM c""")
def run_statuses(spark, sf):
    return K.run_status(spark.sql(_RUNS.replace("customer", "{customer}"), customer=table(spark, sf, "customer"))).select("id", "status")


_FILES = """SELECT k, stem || CASE k % 3 WHEN 0 THEN '2024-' || (1 + k % 14) || '-' || (1 + k % 31) WHEN 1 THEN '2023' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + k % 33 AS VARCHAR), 2, '0') ELSE '' END || ext AS name
FROM (SELECT p_partkey AS k, split_part('尽调笔记|路演纪要|路演材料|月报|随笔|净值表', '|', CAST(1 + p_partkey % 6 AS INT)) AS stem, split_part('.md|.PDF|.png|.xyz|.docx|.txt|.mp3', '|', CAST(1 + p_partkey % 7 AS INT)) AS ext FROM part)"""


@query(f"""WITH f AS ({_FILES}), c AS (SELECT k, name, CASE WHEN contains(name, '尽调笔记') THEN 'diligence_note' WHEN contains(name, '路演纪要') THEN 'meeting_or_interview' WHEN contains(name, '月报') OR contains(name, '净值') THEN 'product_report' WHEN contains(name, '路演') OR contains(name, '材料') THEN 'presentation'
  WHEN ends_with(lower(name), '.pdf') OR ends_with(name, '.docx') THEN 'raw_pdf' WHEN ends_with(name, '.mp3') OR ends_with(name, '.png') THEN 'audio_or_low_signal' WHEN ends_with(name, '.md') OR ends_with(name, '.txt') THEN 'text_note' ELSE 'other' END AS category,
  CASE WHEN k % 3 = 0 THEN try_cast('2024-' || lpad(CAST(1 + k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + k % 31 AS VARCHAR), 2, '0') AS DATE)
    WHEN k % 3 = 1 THEN coalesce(try_cast('2023-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + k % 33 AS VARCHAR), 2, '0') AS DATE), NULL) END AS d FROM f)
SELECT k, category, strftime(d, '%Y-%m-%d') AS hint FROM c""")
def file_catalogue(spark, sf):
    t = spark.sql(_FILES.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return t.select("k", io.file_category(F.col("name"))["category"].alias("category"), C.day_text(io.date_hint(F.col("name"))).alias("hint"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN '-' ELSE printf('%.2f%%', floor(s_acctbal) / 10) END AS percent, CASE WHEN s_acctbal < 0 THEN '-' ELSE printf('%.1fbp', floor(s_acctbal) * 10) END AS bp, CASE WHEN s_acctbal < 0 THEN '-' ELSE printf('%.4f', floor(s_acctbal) / 1000) END AS fixed,
  CASE s_suppkey % 4 WHEN 0 THEN '2024-01-05' WHEN 1 THEN NULL WHEN 2 THEN '1998-12-31' END AS day, CASE s_suppkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  CASE s_suppkey % 3 WHEN 0 THEN 'a|b' ELSE '' END AS listed, CASE s_suppkey % 3 WHEN 0 THEN '40 bad request it failed' WHEN 1 THEN 'plain text' ELSE 'x: ' || repeat('y', 26) || '…' END AS error FROM supplier""")
def scalar_formats(spark, sf):
    v = F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal") / 1000)
    day = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '2024-01-05' WHEN 1 THEN 'soon' WHEN 2 THEN '1998-12-31 10:00:00' END")
    text = F.expr("""CASE s_suppkey % 3 WHEN 0 THEN '["a", " ", null, "b"]' WHEN 1 THEN 'oops' ELSE '{"a": 1}' END""")
    error = F.expr("""CASE s_suppkey % 3 WHEN 0 THEN '{"code": 40, "msg": "bad request", "detail": "it failed"}' WHEN 1 THEN ' plain \n text ' ELSE 'x: ' || repeat('y', 40) END""")
    low = K.lower_confidence(F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'low' ELSE 'high' END"), F.expr("CASE s_suppkey % 3 WHEN 1 THEN 'medium' ELSE 'high' END"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.percent_text(v).alias("percent"), C.bp_text(v).alias("bp"), C.fixed_text(v).alias("fixed"), C.day_text(C.soft_day(day)).alias("day"), low.alias("confidence"), F.array_join(C.json_list(text), "|").alias("listed"), C.short_error(error, 30).alias("error"))


@query("""WITH s AS (SELECT s_suppkey AS id, split_part('Internal|official public|search_only|unheard|regulatory', '|', CAST(1 + s_suppkey % 5 AS INT)) AS a, split_part('website|internal|third party|search only', '|', CAST(1 + s_suppkey % 4 AS INT)) AS b,
  split_part('verified|missing|conflicted|', '|', CAST(1 + s_suppkey % 4 AS INT)) AS c, split_part('not_checked|external only|supported', '|', CAST(1 + s_suppkey % 3 AS INT)) AS d, split_part('none|partial conflict|unknown|odd', '|', CAST(1 + s_suppkey % 4 AS INT)) AS e, split_part('unknown|conflict|no conflict', '|', CAST(1 + s_suppkey % 3 AS INT)) AS f FROM supplier),
r AS (SELECT id, least(CASE a WHEN 'official public' THEN 2 WHEN 'search_only' THEN 5 WHEN 'regulatory' THEN 1 ELSE 0 END, CASE b WHEN 'website' THEN 3 WHEN 'third party' THEN 4 WHEN 'search only' THEN 5 ELSE 0 END) AS s,
  least(CASE c WHEN 'verified' THEN 2 WHEN 'missing' THEN 3 WHEN 'conflicted' THEN 0 ELSE 4 END, CASE d WHEN 'external only' THEN 1 WHEN 'supported' THEN 2 ELSE 4 END) AS x, least(CASE e WHEN 'partial conflict' THEN 1 WHEN 'unknown' THEN 3 ELSE 2 END, CASE f WHEN 'unknown' THEN 3 WHEN 'conflict' THEN 0 ELSE 2 END) AS k FROM s)
SELECT id, ['internal_due_diligence', 'regulatory_public', 'official_public', 'manager_website', 'third_party_public', 'search_discovery_only'][s + 1] AS source, ['conflict', 'external_only', 'supported', 'not_found', 'not_checked'][x + 1] AS external, ['conflict', 'partial_conflict', 'none', 'unknown'][k + 1] AS conflict FROM r""")
def evidence_states(spark, sf):
    part = lambda words, n: F.expr(f"split_part('{words}', '|', cast(1 + s_suppkey % {n} AS int))")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), K.first_state(part("Internal|official public|search_only|unheard|regulatory", 5), part("website|internal|third party|search only", 4), K.EVIDENCE_SOURCES).alias("source"),
        K.first_state(part("verified|missing|conflicted|", 4), part("not_checked|external only|supported", 3), K.EXTERNAL_STATUS).alias("external"), K.first_state(part("none|partial conflict|unknown|odd", 4), part("unknown|conflict|no conflict", 3), K.CONFLICT_STATUS).alias("conflict"),
    )


@query("""WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey % 20 + 0.5 AS DOUBLE) AS fee FROM supplier)
SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE fee END AS low, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 0 THEN 20.0 + fee ELSE fee END AS high, CASE id % 4 WHEN 0 THEN 'excess' WHEN 1 THEN 'performance' WHEN 2 THEN 'management' ELSE 'other' END AS kind, CASE WHEN id % 3 = 0 THEN fee WHEN id % 3 = 1 THEN -fee END AS score FROM s""")
def fee_texts(spark, sf):
    text = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '超额计提 ' || fee || '%，另收 ' || (20 + fee) || ' ％' WHEN 1 THEN '业绩报酬' || fee || '%' WHEN 2 THEN '管理费 ' || fee || '%' ELSE '无' END")
    row = F.expr("CASE s_suppkey % 3 WHEN 0 THEN '| 回撤得分 | ' || fee || ' |' WHEN 1 THEN '回撤得分：-' || fee ELSE '其他 5' END")
    t = table(spark, sf, "supplier").withColumn("fee", F.expr("cast(s_suppkey % 20 + 0.5 AS double)"))
    fees = TX.fee_rates(text)
    return t.select(F.col("s_suppkey").alias("id"), fees["low"].alias("low"), fees["high"].alias("high"), fees["kind"].alias("kind"), C.score_after(row, "回撤得分").alias("score"))


# --- reports

_REPORT = """SELECT p_partkey AS path, '## 结论' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '| a | b |' WHEN 1 THEN '| a | b' ELSE 'text' END || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '| c | d | e |' ELSE '-' END || chr(10) || split_part('P1 P2|P1 P3|P9', '|', CAST(1 + p_partkey % 3 AS INT)) || ' 证据强度：' || split_part('高|强|中', '|', CAST(1 + p_partkey % 3 AS INT)) || chr(10)
  || split_part('大概|明确|猜测可能是', '|', CAST(1 + p_partkey % 3 AS INT)) || chr(10) || CASE p_partkey % 5 WHEN 0 THEN '```' ELSE '## 证据' END AS content FROM part"""


@query(f"""WITH r AS ({_REPORT}) SELECT path, 'error' AS level, 'sections' AS rule, '## 证据' AS detail FROM r WHERE path % 5 = 0
UNION ALL SELECT path, 'error', 'table_breaks', '| a | b' FROM r WHERE path % 4 = 1
UNION ALL SELECT path, 'warning', 'table_width', CASE WHEN path % 4 = 0 THEN '4, 5' ELSE '3, 5' END FROM r WHERE path % 3 = 0 AND path % 4 IN (0, 1)
UNION ALL SELECT path, 'error', 'evidence_priority', CASE path % 3 WHEN 1 THEN 'P3' ELSE 'P9' END FROM r WHERE path % 3 > 0
UNION ALL SELECT path, 'warning', 'evidence_strength', '强' FROM r WHERE path % 3 = 1
UNION ALL SELECT path, 'warning', 'speculation', CASE path % 3 WHEN 0 THEN '大概' ELSE '可能是, 猜测' END FROM r WHERE path % 3 <> 1
UNION ALL SELECT path, 'warning', 'code_block', 'a code block' FROM r WHERE path % 5 = 0""")
def report_checks(spark, sf):
    return K.report_issues(spark.sql(_REPORT.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part")), ["## 结论", "## 证据"])


_AUDIT = """SELECT k AS path, '### 字段审核' || chr(10) || '| 字段 | 值 | 结论 | 理由 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| strategyType | a | 通过 | - |' || chr(10)
  || CASE k % 5 WHEN 0 THEN '' ELSE '| raceName | a | ' || split_part('需修正|通过|需补充', '|', CAST(1 + k % 3 AS INT)) || ' | ' || split_part('建议：甲|建议：甲、乙|建议：甲 建议：乙|无|建议：待人工确认', '|', CAST(1 + k % 5 AS INT)) || ' |' || chr(10) END
  || '| fundType | a | ' || split_part('通过|待人工确认|建议：乙', '|', CAST(1 + k % 3 AS INT)) || ' | ' || split_part('直接证据|间接证据', '|', CAST(1 + k % 2 AS INT)) || ' |' || chr(10)
  || '### 关键证据' || chr(10) || '**P1** a' || chr(10) || '**P1** b' || chr(10) || CASE k % 3 WHEN 0 THEN '**P2** c' || chr(10) ELSE '' END || CASE k % 4 WHEN 0 THEN '证据链小结' || chr(10) ELSE '' END
  || '### 口径说明' || chr(10) || split_part('- **推论边界风险** x|- 其他|文字', '|', CAST(1 + k % 3 AS INT)) || chr(10) || '### 策略画像' || chr(10) || CASE k % 7 WHEN 0 THEN '一级赛道' ELSE '一级赛道 细分赛道 策略属性 收益来源 投资范围 风险画像 标签映射' END || chr(10) AS content FROM (SELECT p_partkey AS k FROM part) AS q"""


@query(f"""WITH r AS (SELECT path, path % 5 > 0 AND path % 3 <> 1 AS asked, path % 5 AS g, path % 2 = 1 AS indirect, path % 3 AS t FROM ({_AUDIT}))
SELECT path, 'warning' AS level, 'audit_rows' AS rule, 'raceName' AS detail FROM r WHERE g = 0
UNION ALL SELECT path, 'warning', 'portrait_rows', '细分赛道, 策略属性, 收益来源, 投资范围, 风险画像, 标签映射' FROM r WHERE path % 7 = 0
UNION ALL SELECT path, 'error', 'race_suggestion', CASE g WHEN 1 THEN 'several values in one' WHEN 3 THEN 'none given' ELSE 'no value' END FROM r WHERE asked AND g > 0 AND g <> 2
UNION ALL SELECT path, 'error', 'fund_type', 'indirect evidence needs confirmation' FROM r WHERE indirect AND t <> 1
UNION ALL SELECT path, 'error', 'fund_type', 'a value in spite of indirect evidence' FROM r WHERE indirect AND t = 2
UNION ALL SELECT path, 'error', 'boundary_first', CASE t WHEN 2 THEN 'not a list' ELSE 'another item comes first' END FROM r WHERE t > 0
UNION ALL SELECT path, 'warning', 'evidence_chain', 'three or more items without a summary' FROM r WHERE t = 0 AND path % 4 > 0""")
def report_fields(spark, sf):
    # a suggestion list such as "甲 建议" reads as one value up to the next mark, so the case of two is left to the tests
    return RR.field_issues(spark.sql(_AUDIT.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part")).where("NOT (path % 5 = 2 AND path % 3 <> 1)"))


SQL["report_fields"] = f"SELECT * FROM ({SQL['report_fields']}) WHERE NOT (path % 5 = 2 AND path % 3 <> 1)"


@query("""WITH s AS (SELECT o_custkey AS fund, 'r' || o_orderkey AS path, o_orderdate AS stamp FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT fund, arg_max(path, (stamp, path)) AS report FROM s GROUP BY 1)
SELECT c_custkey AS fund, report, CASE WHEN report IS NULL OR c_custkey IN (1, 2, 3) THEN 'audit' ELSE 'reuse' END AS action FROM customer LEFT JOIN b ON c_custkey = fund""")
def audit_plan(spark, sf):
    r = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("fund"), F.concat(F.lit("r"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("stamp"))
    return P.audit_plan(table(spark, sf, "customer").select(F.col("c_custkey").alias("fund")), r, refresh=[1, 2, 3])


# --- places on pages

_SPANS = "SELECT p_partkey % 7 + 7 * CAST(floor(p_partkey / 700) AS INT) AS page, 100.0 AS page_height, p_partkey % 5 * 20.0 AS x0, p_partkey % 5 * 20.0 + CASE p_partkey % 3 WHEN 0 THEN 19.0 ELSE 10.0 END AS x1, CAST(floor(p_partkey / 35) AS INT) % 20 * 5.0 + 1 AS y0, 'w' || p_partkey AS text FROM part"


@query(f"""WITH s AS ({_SPANS}), f AS (SELECT * FROM s WHERE y0 BETWEEN 10 AND 90), g AS (SELECT page, CAST(round(y0) AS BIGINT) AS line, x0, CASE WHEN x0 - lag(x1) OVER w > 3 THEN ' ' ELSE '' END || text AS piece FROM f WINDOW w AS (PARTITION BY page, CAST(round(y0) AS BIGINT) ORDER BY x0))
SELECT page, line, string_agg(piece, '' ORDER BY x0) AS text FROM g GROUP BY 1, 2""")
def layout_lines(spark, sf):
    t = spark.sql(_SPANS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return TX.layout_lines(t.select("page", *[F.col(c).cast("double").alias(c) for c in ("page_height", "x0", "x1", "y0")], "text"))


@query("""SELECT p_partkey AS id, [p_partkey % 9 * 0.5, 400 - (p_partkey % 7 + 4) * 0.8, (p_partkey % 9 + 3) * 0.5, 400 - p_partkey % 7 * 0.8] AS box FROM part""".replace("SELECT p_partkey AS id, [", "SELECT id, round(b[1], 6) AS x0, round(b[2], 6) AS y0, round(b[3], 6) AS x1, round(b[4], 6) AS y1 FROM (SELECT p_partkey AS id, CAST([").replace("] AS box FROM part", "] AS DOUBLE[]) AS b FROM part)"))
def affine_boxes(spark, sf):
    box = F.array(*[F.expr(e).cast("double") for e in ("p_partkey % 9", "p_partkey % 7", "p_partkey % 9 + 3", "p_partkey % 7 + 4")])
    got = G.to_pdf(box, F.lit(1000.0), F.lit(500.0), F.lit(500.0), F.lit(400.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[F.round(got[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 7 AS page, p_partkey % 50 AS x, p_size AS y FROM part), b AS (SELECT s_suppkey % 7 AS page, s_suppkey % 40 AS x0, s_suppkey % 40 + 8 AS x1, s_suppkey % 30 AS y0, s_suppkey % 30 + 9 AS y1 FROM supplier)
SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""")
def outside_boxes(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 7 AS page", "p_partkey % 50 AS x", "p_size AS y")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey % 7 AS page", "s_suppkey % 40 AS x0", "s_suppkey % 40 + 8 AS x1", "s_suppkey % 30 AS y0", "s_suppkey % 30 + 9 AS y1")
    return J.point_in_boxes(p, b, "page").select("id")


@query(f"""WITH {V.PRODUCTS_CTE}, h AS (SELECT id, regexp_replace(product_name, '[^一-鿿]', '', 'g') AS han FROM products) SELECT term, count(DISTINCT id) AS n FROM (SELECT id, unnest(list_transform(range(1, length(han)), lambda i: substr(han, i, 2))) AS term FROM h) GROUP BY 1""")
def bigram_index(spark, sf):
    t = V.products(spark, sf).select(F.col("id").alias("product_name"), F.col("product_name").alias("profile_text"))
    return R.bigram_index(t).groupBy("term").agg(F.count_distinct("product_name").alias("n"))


@query(f"""WITH {V.PROFILES_CTE}, p AS (SELECT id, manager, product_name, CASE id % 4 WHEN 0 THEN 'conflict' ELSE 'none' END AS conflict_status, id % 3 > 0 AS has_external, CASE id % 5 WHEN 0 THEN 'third_party_public' ELSE 'official_public' END AS tier, evidence_line FROM profiles)
SELECT manager, product_name, 'high' AS severity, 'external_conflict' AS kind FROM p WHERE conflict_status = 'conflict'
UNION ALL SELECT manager, product_name, 'warning', 'external_only' FROM p WHERE has_external AND contains(evidence_line, '稳定')
UNION ALL SELECT manager, product_name, 'info', 'low_tier_source' FROM p WHERE has_external AND tier = 'third_party_public'""")
def external_checks(spark, sf):
    item = F.expr("map('tier', CASE id % 5 WHEN 0 THEN 'third_party_public' ELSE 'official_public' END, 'url', 'u' || id)")
    t = V.profiles(spark, sf).withColumns({"conflict_status": F.expr("CASE id % 4 WHEN 0 THEN 'conflict' ELSE 'none' END"), "external_evidence": F.when(F.col("id") % 3 > 0, F.array(item)).otherwise(F.array().cast("array<map<string,string>>")), "evidence": F.filter("evidence", lambda x: ~x.contains("稳定"))})
    return X.external_issues(t)


_LINES = "SELECT p_partkey % 5 AS page, 600.0 AS page_width, CAST(floor(p_partkey / 10) AS INT) % 40 * 10.0 AS y0, CASE WHEN p_partkey % 5 < 3 AND p_partkey % 2 = 0 THEN 330.0 ELSE 30.0 END + p_partkey % 3 AS x0, CASE WHEN p_partkey % 11 = 0 THEN '| a | b |' ELSE 'line' || p_partkey END AS text FROM part"


@query(f"""WITH l AS ({_LINES}), p AS (SELECT *, trim(text) <> '' AND NOT starts_with(text, '|') AS plain FROM l),
s AS (SELECT page, list_sort(list(x0) FILTER (plain AND x0 < 300)) AS a, list_sort(list(x0) FILTER (plain AND x0 >= 300)) AS b FROM p GROUP BY 1),
g AS (SELECT page, CASE WHEN coalesce(len(a), 0) + coalesce(len(b), 0) >= 30 AND len(a) >= 12 AND len(b) >= 12 AND b[len(b) // 2 + 1] - a[len(a) // 2 + 1] >= 108 THEN (a[len(a) // 2 + 1] + b[len(b) // 2 + 1]) / 2 END AS cut FROM s)
SELECT l.page AS page, text, CAST(row_number() OVER (PARTITION BY l.page ORDER BY CASE WHEN cut IS NOT NULL AND x0 >= cut THEN 1 ELSE 0 END, y0, x0, text) AS INTEGER) AS place FROM l JOIN g ON l.page = g.page""")
def reading_order(spark, sf):
    t = spark.sql(_LINES.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return TX.reading_order(t.select("page", *[F.col(c).cast("double").alias(c) for c in ("page_width", "y0", "x0")], "text")).select("page", "text", "place")


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 100 AS y0, p_partkey % 100 + 8 AS y1, 2 + p_partkey % 4 AS n FROM part)
SELECT id, '| a | b|c | d |'.replace('b|c', 'b\\|c') || chr(10) || '| --- | --- | --- |' || repeat(chr(10) || '| x' || id || ' |  | y z |', CAST(n - 1 AS INTEGER)) AS markdown FROM t WHERE y1 > 10 AND y0 < 90 AND n * 3 >= 12""".replace("'| a | b|c | d |'.replace('b|c', 'b\\\\|c')", "'| a | b\\|c | d |'"))
def table_items(spark, sf):
    rows = F.expr("concat(array(array('a', 'b|c', 'd')), array_repeat(array('x' || p_partkey, cast(null as string), 'y\nz'), cast(1 + p_partkey % 4 as int)))")
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(100.0).alias("page_height"), (F.col("p_partkey") % 100).alias("y0"), (F.col("p_partkey") % 100 + 8).alias("y1"), rows.alias("rows"))
    return TX.table_items(t).select("id", "markdown")


_SHAPES = "SELECT p_partkey AS id, p_partkey % 6 AS slide, CAST(p_partkey * 7 % 50 AS DOUBLE) / 10 AS top, CAST(p_partkey * 13 % 90 AS DOUBLE) AS left_edge FROM part"


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY top, left_edge, id) AS i FROM ({_SHAPES})),
w AS (SELECT slide, id, i, top, left_edge, top AS start, 1 AS row FROM s WHERE i = 1 UNION ALL SELECT s.slide, s.id, s.i, s.top, s.left_edge, CASE WHEN s.top - w.start > 0.5 THEN s.top ELSE w.start END, CASE WHEN s.top - w.start > 0.5 THEN w.row + 1 ELSE w.row END FROM w JOIN s ON s.slide = w.slide AND s.i = w.i + 1)
SELECT slide, id, CAST(row AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY slide ORDER BY row, left_edge, id) AS INTEGER) AS place FROM w""")
def row_groups(spark, sf):
    t = spark.sql(_SHAPES.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part")).withColumnRenamed("left_edge", "left")
    return LY.row_groups(t, "slide")


@query("""SELECT p_brand AS name, round(sum(p_size + p_retailprice + p_partkey), 2) AS total FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1""")
def named_row_sum(spark, sf):
    from tessera.operators.attribution import named_row_sum as total

    t = total(table(spark, sf, "part").select(F.col("p_brand").alias("name"), "p_size", "p_retailprice", "p_partkey"), "name", ["Brand#1", "Brand#2", "Brand#3"])
    return t.select("name", F.round("total", 2).alias("total"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '2024-01-05' WHEN s_suppkey % 3 > 0 THEN '2023-12-31' ELSE '2024-02-01' END AS day FROM supplier""")
def end_days(spark, sf):
    config = F.expr("""CASE s_suppkey % 4 WHEN 0 THEN '{"end_date": "2024-01-05"}' WHEN 1 THEN '{"end_date": "0001-01-01"}' WHEN 2 THEN 'oops' END""")
    base = F.expr("CASE WHEN s_suppkey % 3 > 0 THEN '2023-12-31' ELSE 'unknown' END")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.day_text(C.end_day(config, base, F.lit("2024-02-01"))).alias("day"))


@query("""WITH n AS (SELECT event_type, event_id, value, ln(1 + row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS x FROM events) SELECT event_type, round(regr_slope(value, x), 4) AS slope, count(*) AS n FROM n GROUP BY 1""")
def grouped_apply(spark, sf):
    """A slope by a fold of the user's own: counts, means and centred products of parts, merged."""
    import numpy as np

    from tessera.operators.custom import grouped_fold, numbered

    def part(g):
        x, y = np.log1p(g["number"].to_numpy()), g["value"].to_numpy()
        return {"n": len(g), "mx": x.mean(), "my": y.mean(), "sxx": ((x - x.mean()) ** 2).sum(), "sxy": ((x - x.mean()) * (y - y.mean())).sum()}

    def merge(s):
        n, mx, my = (s[c].to_numpy() for c in ("n", "mx", "my"))
        x, y = np.average(mx, weights=n), np.average(my, weights=n)
        return {"n": n.sum(), "mx": x, "my": y, "sxx": (s["sxx"] + n * (mx - x) ** 2).sum(), "sxy": (s["sxy"] + n * (mx - x) * (my - y)).sum()}

    t = numbered(table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"])
    got = grouped_fold(t.select("event_type", "value", "number"), ["event_type"], part, merge, "n long, mx double, my double, sxx double, sxy double")
    return got.select("event_type", F.round(F.col("sxy") / F.col("sxx"), 4).alias("slope"), "n")


#: Words on pages: two tables of three columns, on every fifth page a paragraph.
_WORDS = """SELECT page, x0, x0 + 40 AS x1, y0, y0 + 8 AS y1, text FROM (SELECT CAST(floor(p_partkey / 60) AS INT) AS page,
  CASE WHEN floor(p_partkey / 60) % 5 = 4 THEN 0 ELSE p_partkey % 3 * 100 + p_partkey % 7 END AS x0, floor(p_partkey % 60 / 3) * 10 + CASE WHEN p_partkey % 60 >= 30 THEN 40 ELSE 0 END AS y0,
  CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN 'a|b  ' || p_partkey ELSE 'w' || p_partkey END AS text FROM part) AS w"""


def _swept(source: str, by: str, low: str, high: str, gap: float, name: str) -> str:
    order = ", ".join([low, high, *[c for c in ("y0", "y1", "x0", "x1", "text") if c not in (low, high)]])
    before = f"max({high}) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = f"SELECT *, CASE WHEN {low} > {before} + {gap} OR {before} IS NULL THEN 1 ELSE 0 END AS fresh FROM {source}"
    return f"(SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY {by} ORDER BY {order}, fresh DESC ROWS UNBOUNDED PRECEDING) AS INTEGER) AS {name} FROM ({marked}))"


@query(rf"""WITH w AS (SELECT * REPLACE (replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '|', '\|') AS text) FROM ({_WORDS}) WHERE trim(text) <> ''),
s AS (SELECT * FROM {_swept(_swept(_swept('w', 'page', 'y0', 'y1', 12.0, 'tab'), 'page, tab', 'y0', 'y1', 0.0, 'rw'), 'page, tab', 'x0', 'x1', 8.0, 'col')}),
b AS (SELECT page, tab, max(rw) AS rows, max(col) AS columns FROM s GROUP BY 1, 2 HAVING max(rw) > 1 AND max(col) > 1),
c AS (SELECT page, tab, rw, col, string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM s GROUP BY 1, 2, 3, 4),
l AS (SELECT b.page AS page, b.tab AS tab, r.rw AS rw, '| ' || string_agg(coalesce(c.text, ''), ' | ' ORDER BY k) || ' |' AS line FROM b JOIN (SELECT DISTINCT page, tab, rw FROM c) r ON r.page = b.page AND r.tab = b.tab, LATERAL (SELECT unnest(range(1, b.columns + 1)) AS k) LEFT JOIN c ON c.page = b.page AND c.tab = b.tab AND c.rw = r.rw AND c.col = k GROUP BY 1, 2, 3)
SELECT b.page AS page, CAST(b.tab AS INTEGER) AS "table", CAST(b.rows AS INTEGER) AS rows, CAST(b.columns AS INTEGER) AS columns, (SELECT string_agg(CASE WHEN rw = 1 THEN line || chr(10) || '|' || repeat(' --- |', b.columns) ELSE line END, chr(10) ORDER BY rw) FROM l WHERE l.page = b.page AND l.tab = b.tab) AS markdown FROM b""")
def span_tables(spark, sf):
    t = spark.sql(_WORDS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return LY.tables_of(t.select("page", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")], "text"))


#: What a tag or manager leads to; tags of two levels lead to each other.
_PAIRS = """SELECT DISTINCT manager AS term, primary_tag AS synonym FROM profiles WHERE primary_tag <> '' UNION SELECT primary_tag, secondary_tag FROM profiles WHERE primary_tag <> '' AND secondary_tag <> ''
UNION SELECT secondary_tag, primary_tag FROM profiles WHERE primary_tag <> '' AND secondary_tag <> '' AND id % 3 = 0 UNION SELECT secondary_tag, profile_text FROM profiles WHERE secondary_tag <> '' AND profile_text <> ''"""
_CLOSED = f"{V.PROFILES_CTE}, p AS ({_PAIRS}), c AS (SELECT term, synonym FROM p UNION SELECT c.term, p.synonym FROM c JOIN p ON c.synonym = p.term)"


@query(f"WITH RECURSIVE {_CLOSED} SELECT term, synonym FROM c")
def synonym_closure(spark, sf):
    return LY.closure(spark.sql(_PAIRS.replace("FROM profiles", "FROM {profiles}"), profiles=V.profiles(spark, sf)))


@query(f"""WITH RECURSIVE {_CLOSED}, q AS (SELECT DISTINCT {sql_key('evidence_line || product_name || secondary_tag')} AS query FROM profiles), t AS (SELECT DISTINCT term, {sql_key('term')} AS key FROM c)
SELECT DISTINCT query, s.synonym AS synonym FROM q JOIN t ON contains(query, key) JOIN (SELECT term, synonym FROM c UNION SELECT term, term FROM t) s ON s.term = t.term""")
def synonym_expansion(spark, sf):
    p = V.profiles(spark, sf)
    closed = LY.closure(spark.sql(_PAIRS.replace("FROM profiles", "FROM {profiles}"), profiles=p))
    return LY.expanded(p.select(match_key(F.concat("evidence_line", "product_name", "secondary_tag")).alias("query")), closed, match_key(F.col("term")))
