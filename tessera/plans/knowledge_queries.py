"""Queries on profiles: relations, health, review, scoring, roll-up, packing, classification, derived fields; with SQL of their own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.names import text_key
from tessera.operators import enrichment as X
from tessera.operators import knowledge as K
from tessera.operators import postings, recognition
from tessera.operators import retrieval as R
from tessera.operators import taxonomy as T
from tessera.plans import knowledge_views as V
from tessera.plans.knowledge_views import pick
from tessera.plans.name_queries import core_steps, sql_key
from tessera.session import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_PREDICATES = {"manager": "belongs_to_manager", "primary_tags": "has_primary_strategy", "secondary_tags": "has_secondary_strategy", "product_lines": "has_product_line", "risk_points": "has_risk_point", "source_notes": "has_source_note", "rejected_tags": "rejects_strategy_tag", "backgrounds": "has_people_background", "constraints": "has_exposure_constraint"}
_BACKGROUND = "CASE WHEN contains(lower(evidence_line), 'worldquant') OR contains(evidence_line, '世坤') THEN 'WorldQuant背景' ELSE '' END"
_CONSTRAINT = "CASE WHEN contains(evidence_line, '行业') AND contains(evidence_line, '3%') AND (contains(evidence_line, '偏离') OR contains(evidence_line, '暴露')) THEN '行业暴露3%以内' ELSE '' END"
_COLUMN = {"manager": "manager", "primary_tags": "primary_tag", "secondary_tags": "secondary_tag", "product_lines": "profile_text", "risk_points": "risk_point", "source_notes": "source_note", "rejected_tags": "rejected_tag", "backgrounds": _BACKGROUND, "constraints": _CONSTRAINT}
_PAIRS = [("product_name", p, _COLUMN[c]) for c, p in _PREDICATES.items()] + [("product_name", "has_exposure_constraint", "CASE WHEN contains(lower(evidence_line), 'barra') THEN 'Barra风险约束' ELSE '' END"), ("manager", "has_product", "product_name"), ("manager", "has_people_background", _BACKGROUND)]


@query(f"WITH {V.PROFILES_CTE} " + "SELECT DISTINCT subject, predicate, object, manager, product_name FROM (" + " UNION ALL ".join(f"SELECT {s} AS subject, '{p}' AS predicate, {o} AS object, manager, product_name FROM profiles" for s, p, o in _PAIRS) + ") WHERE subject <> '' AND object <> ''")
def relations_build(spark, sf):
    p = V.profiles(spark, sf).withColumns({"backgrounds": X.backgrounds(F.col("evidence_line")), "constraints": X.exposure_constraints(F.col("evidence_line"))})
    return K.relations(p, _PREDICATES, {"product_name": "has_product", "backgrounds": "has_people_background"}, {"risk_points": 5})


_MANAGER_OF = "regexp_extract(candidate, 'manager=([^|]+)', 1)"
_HEALTH = f"""{V.PROFILES_CTE}, mm AS (SELECT manager FROM profiles UNION SELECT {_MANAGER_OF} FROM profiles), {core_steps('mm', 'manager', 'm')},
h AS (SELECT p.*, coalesce({sql_key('a.core')} = {sql_key('b.core')} AND {sql_key('a.core')} <> '', false) AS own, p.entity_type = 'product' AND entity_confidence <> 'low' AND (primary_tag <> '' OR secondary_tag <> '' OR profile_text <> '') AND quality_status IN ('', 'confirmed') AS expected
  FROM profiles p LEFT JOIN m a ON a.manager = p.manager LEFT JOIN m b ON b.manager = {_MANAGER_OF}),
issues AS (
  SELECT manager, product_name, 'warning' AS severity, 'non_product_entity_profile' AS kind FROM h WHERE entity_type NOT IN ('', 'product')
  UNION ALL SELECT manager, product_name, 'warning', 'low_entity_confidence' FROM h WHERE entity_confidence = 'low'
  UNION ALL SELECT manager, product_name, 'warning', CASE WHEN name_reason = 'suspicious_short_name' THEN 'profile_quality_short_name' WHEN entity_type NOT IN ('', 'product') THEN 'profile_quality_entity_review' ELSE 'profile_quality_warning' END FROM h WHERE quality_status NOT IN ('', 'confirmed')
  UNION ALL SELECT manager, product_name, CASE WHEN expected THEN 'info' ELSE 'warning' END, CASE WHEN expected THEN 'strategy_tag_rejected_expected' ELSE 'strategy_tag_rejected_conflict' END FROM h WHERE rejected_tag <> ''
  UNION ALL SELECT manager, product_name, CASE WHEN own THEN 'info' ELSE 'warning' END, CASE WHEN own THEN 'zm_cross_manager_candidates_normal' ELSE 'zm_cross_manager_candidates_suspicious' END FROM h WHERE external_match_status = 'cross_manager_candidates_only'
  UNION ALL SELECT manager, product_name, 'warning', 'missing_strategy_positioning' FROM h WHERE positioning = '' OR contains(positioning, '材料未提及')
  UNION ALL SELECT manager, product_name, 'warning', 'missing_sources' FROM h WHERE source_note = ''
  UNION ALL SELECT manager, product_name, 'info', 'missing_risk_points' FROM h WHERE risk_point = ''
  UNION ALL SELECT manager, line, 'warning', 'duplicate_canonical_product' FROM (SELECT manager, regexp_replace(product_name, '[0-9]+$', '') AS line, count(DISTINCT product_name) AS n FROM h GROUP BY 1, 2) WHERE n > 1)"""


def _issues(spark, sf):
    return K.health(V.profiles(spark, sf).withColumn("canonical_name", F.regexp_replace("product_name", "[0-9]+$", "")))


@query(f"WITH {_HEALTH} SELECT manager, product_name, severity, kind FROM issues")
def health_checks(spark, sf):
    return _issues(spark, sf).drop("detail")


@query(f"""WITH {_HEALTH} SELECT CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'error' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) AS issues FROM issues""")
def health_status(spark, sf):
    return K.status_of(_issues(spark, sf))


@query(f"""WITH {V.PROFILES_CTE}, n AS (SELECT '丙资本' || s_nationkey % 3 AS manager, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT '灵均私募', 5)
SELECT manager, 'high' AS severity, 'source_notes_without_index_records' AS kind, n || ' notes' AS detail FROM n WHERE manager <> '灵均私募'
UNION ALL SELECT '', 'high', 'profile_index_record_mismatch', (SELECT count(*) FROM profiles) || ' profiles, ' || (SELECT count(*) FROM profiles WHERE id % 3 > 0) || ' indexed'""")
def index_checks(spark, sf):
    from tessera.session import table

    p = V.profiles(spark, sf)
    notes = table(spark, sf, "supplier").select(F.concat(F.lit("丙资本"), F.col("s_nationkey") % 3).alias("manager")).unionByName(spark.range(5).select(F.lit("灵均私募").alias("manager")))
    return K.index_issues(notes, p, p.where("id % 3 > 0"))


_ITEM = "substr(sha256(lower(kind || '|' || manager || '|' || product_name)), 1, 16)"
_QUEUE = f"""{_HEALTH}, n AS (SELECT DISTINCT {_ITEM} AS item_id, kind, manager, product_name, severity FROM issues WHERE severity IN ('high', 'warning')),
o(kind, manager, status, priority) AS (VALUES ('low_entity_confidence', NULL, 'suppressed', 1), (NULL, '灵均投资', 'accepted', 2), ('missing_sources', '衍复私募', 'open', 3)),
w AS (SELECT n.*, o.status AS set_to, row_number() OVER (PARTITION BY item_id ORDER BY priority NULLS LAST) AS r FROM n LEFT JOIN o ON (o.kind IS NULL OR o.kind = n.kind) AND (o.manager IS NULL OR o.manager = n.manager)),
q AS (SELECT item_id, kind, manager, product_name, severity, CASE WHEN substr(item_id, 1, 1) < '4' THEN '2023-01-01' ELSE '2024-02-01' END AS created_at, '2024-02-01' AS updated_at,
  coalesce(set_to, CASE WHEN substr(item_id, 1, 1) < '4' THEN 'in_review' ELSE 'open' END) AS status FROM w WHERE r = 1)"""


def _queue(spark, sf):
    issues = stored(_issues(spark, sf), "issues")  # read twice
    old = K.review_queue(issues, spark.createDataFrame([], "item_id string, created_at string, status string"), _no_overrides(spark), F.lit("2023-01-01")).where("substr(item_id, 1, 1) < '4'").select("item_id", "created_at", F.lit("in_review").alias("status"))
    overrides = spark.createDataFrame([("low_entity_confidence", None, None, "suppressed", 1), (None, "灵均投资", None, "accepted", 2), ("missing_sources", "衍复私募", None, "open", 3)], "kind string, manager string, product_name string, status string, priority int")
    return K.review_queue(issues, old, overrides, F.lit("2024-02-01")).drop("detail")


def _no_overrides(spark):
    return spark.createDataFrame([], "kind string, manager string, product_name string, status string, priority int")


@query(f"WITH {_QUEUE} SELECT * FROM q WHERE status <> 'suppressed'")
def review_queue(spark, sf):
    return _queue(spark, sf)


@query(f"""WITH {_QUEUE} SELECT kind, manager, product_name, severity FROM q WHERE status <> 'suppressed' ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, manager, product_name, kind LIMIT 25""")
def review_order(spark, sf):
    return K.in_review_order(_queue(spark, sf), 25).select("kind", "manager", "product_name", "severity")


@query(f"""WITH {_QUEUE} SELECT item_id, created_at FROM q WHERE status <> 'suppressed' ORDER BY created_at DESC, item_id LIMIT 20""")
def review_latest(spark, sf):
    return K.latest_items(_queue(spark, sf), "created_at").select("item_id", "created_at")


@query(f"""WITH {V.PROFILES_CTE}, c AS (SELECT manager, regexp_replace(product_name, '[0-9]+$', '') AS c, count(*) AS n, count(*) FILTER (quality_status NOT IN ('', 'confirmed')) AS bad FROM profiles GROUP BY 1, 2),
s AS (SELECT manager, product_name, row_number() OVER (PARTITION BY manager ORDER BY product_name) AS r FROM profiles WHERE quality_status NOT IN ('', 'confirmed'))
SELECT c.manager AS manager, CAST(sum(n) AS BIGINT) AS profiles, count(*) AS canonical_products, CAST(sum(bad) AS BIGINT) AS unconfirmed, count(*) FILTER (n > 1) AS duplicate_groups, any_value(x.names) AS suspicious,
  CASE WHEN sum(bad) > 0 OR count(*) FILTER (n > 1) > 0 THEN 'warning' ELSE 'ok' END AS status
FROM c LEFT JOIN (SELECT manager, string_agg(product_name, '|' ORDER BY product_name) AS names FROM s WHERE r <= 20 GROUP BY 1) x ON c.manager = x.manager GROUP BY c.manager""")
def manager_quality(spark, sf):
    return K.manager_quality(V.profiles(spark, sf).withColumn("canonical_name", F.regexp_replace("product_name", "[0-9]+$", ""))).withColumn("suspicious", F.array_join("suspicious", "|"))


@query(f"WITH {V.PROFILES_CTE} SELECT id FROM profiles WHERE contains({sql_key('''manager || ' ' || product_name''')}, '灵均')")
def manager_records(spark, sf):
    return K.manager_records(V.profiles(spark, sf), "灵 均").select("id")


# --- search

TERMS = ["500指增", "CTA", "多因子", "行业偏离", "WorldQuant", "灵均"]
CONDITIONS = [("商品CTA", ["商品期货", "商品CTA", "商品期货CTA"]), ("行业暴露", ["行业暴露", "行业偏离", "行业偏离≤±3%"])]


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def _index(spark, sf) -> postings.Index:
    """The index of the profiles, built once in an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = postings.build(V.profiles(spark, sf))
    return _INDEXES[key]


def _intent(**how):
    return R.Intent("", terms=TERMS, conditions=CONDITIONS, **how)


_GENERIC = f"(trim(product_name) = '' OR regexp_matches(product_name, '系列|产品线|工具化|策略体系') OR NOT contains(product_name, '号') AND (ends_with(product_name, '产品') OR ends_with({sql_key('product_name')}, 'cta')))"
_WEIGHT = {"500指增": 3.0, "CTA": 3.0, "多因子": 1.5, "行业偏离": 2.5, "WorldQuant": 5.0, "灵均": 1.5}
_TERM = " + ".join(f"CASE WHEN contains(pk, '{text_key(t)}') THEN 8.0 WHEN contains(mk, '{text_key(t)}') THEN 6.0 WHEN contains(tags, '{t.lower()}') THEN 4.5 WHEN contains(txt, '{t.lower()}') THEN {_WEIGHT[t]} ELSE 0 END" for t in TERMS)
_CONDITION = " + ".join(f"CASE WHEN {contains_any('tagk', [text_key(n) for n in names])} THEN 5.5 WHEN {contains_any('txtk', [text_key(n) for n in names])} THEN 4.0 ELSE -2.5 END" for _, names in CONDITIONS)
_MET = [f"({contains_any('tagk', [text_key(n) for n in names])} OR {contains_any('txtk', [text_key(n) for n in names])})" for _, names in CONDITIONS]
_BY_TAG = " OR ".join([f"contains(tags, '{t.lower()}') AND NOT contains(pk, '{text_key(t)}') AND NOT contains(mk, '{text_key(t)}')" for t in TERMS] + [contains_any("tagk", [text_key(n) for n in names]) for _, names in CONDITIONS])
_TAGGED = "primary_tag IN ({0}) OR secondary_tag IN ({0})"
_IS_FUTURES, _IS_INDEX = (_TAGGED.format(", ".join(f"'{x}'" for x in tags)) for tags in (["管理期货", "商品CTA", "股指CTA", "趋势CTA", "基本面CTA"], ["指数增强", "300指增", "500指增", "1000指增", "2000指增"]))
_SEARCH = f"""{V.PROFILES_CTE}, t AS (SELECT *, {sql_key('product_name')} AS pk, {sql_key('manager')} AS mk, lower(primary_tag || chr(10) || secondary_tag) AS tags,
  lower(concat_ws(chr(10), product_name, manager, primary_tag, secondary_tag, evidence_line, profile_text)) AS txt FROM profiles),
k AS (SELECT *, {sql_key('tags')} AS tagk, {sql_key('txt')} AS txtk FROM t),
r AS (SELECT *, {_TERM} + {_CONDITION} + 0.25
  - CASE quality_status WHEN 'weak_line' THEN 6.0 WHEN 'needs_review' THEN 4.0 ELSE 0 END - CASE WHEN entity_type IN ('', 'product') THEN 0 ELSE 5.0 END - CASE entity_confidence WHEN 'medium' THEN 1.5 WHEN 'low' THEN 3.0 ELSE 0 END
  - CASE WHEN name_reason = 'strategy_product_line' THEN 2.0 ELSE 0 END - CASE WHEN {_GENERIC} THEN 2.0 ELSE 0 END AS score,
  concat_ws('|', {', '.join(f"CASE WHEN NOT {m} THEN '{label}' END" for m, (label, _) in zip(_MET, CONDITIONS))}) AS missing FROM k WHERE {' OR '.join(_MET)}),
s AS (SELECT *, CASE WHEN missing = '' THEN 'satisfied' ELSE 'unsatisfied' END AS satisfied,
  NOT ({_BY_TAG}) AS weak, ({_IS_FUTURES}) AND ({_IS_INDEX}) AS mixed FROM r WHERE score > 0)"""
_ORDER = f"score DESC, quality_status <> 'confirmed', entity_type <> 'product', {_GENERIC}, product_name, id"


@query(f"WITH {_SEARCH} SELECT id, CAST(score AS DOUBLE) AS score, missing, satisfied FROM s")
def profile_scoring(spark, sf):
    return R.scored(_index(spark, sf).profiles, _intent()).select("id", F.col("score").cast("double").alias("score"), F.array_join("missing", "|").alias("missing"), "satisfied")


@query(f"WITH {_SEARCH} SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM s ORDER BY {_ORDER} LIMIT 15)")
def profile_ranking(spark, sf):
    return R.ranked(R.scored(_index(spark, sf).profiles, _intent()), 15).select("id", F.col("score").cast("double").alias("score"))


@query(f"""WITH {_SEARCH}, mm AS (SELECT manager FROM profiles), {core_steps('mm', 'manager', 'm')}, j AS (SELECT s.*, {sql_key('core')} AS mkey, {_GENERIC} AS gen, CASE tag_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rk FROM s JOIN m ON s.manager = m.manager),
p AS (SELECT mkey, product_name, row_number() OVER (PARTITION BY mkey ORDER BY gen, quality_status <> 'confirmed', rk, score DESC, length(pk), product_name) AS n FROM j),
g AS (SELECT mkey, max(score) AS best, count(*) AS n, count(*) FILTER (tag_confidence = 'high' OR tag_review_status = 'confirmed') AS sure, bool_or(weak) AS weak, bool_or(mixed) AS mixed, arg_max(manager, (length(manager), manager)) AS manager FROM j GROUP BY 1)
SELECT manager, CAST(best + least(n, 6) * 1.5 + sure * 0.5 - CASE WHEN mixed THEN 2.0 ELSE 0 END - CASE WHEN weak AND n = 1 THEN 1.0 ELSE 0 END AS DOUBLE) AS score, n AS matched_products, (SELECT string_agg(product_name, '|' ORDER BY p.n) FROM p WHERE p.mkey = g.mkey AND p.n <= 3) AS representatives,
  CASE WHEN mixed THEN 'review_needed' WHEN n >= 2 OR sure > 0 THEN 'high' ELSE 'medium' END AS confidence FROM g""")
def manager_results(spark, sf):
    got = R.by_manager(R.scored(_index(spark, sf).profiles, _intent()), 50)
    return got.select("manager", F.col("score").cast("double").alias("score"), "matched_products", F.array_join("representative_products", "|").alias("representatives"), "confidence")


@query(f"""WITH {_SEARCH} SELECT id, concat_ws('|', CASE WHEN {_GENERIC} THEN 'generic_product_name' END, CASE WHEN quality_status NOT IN ('', 'confirmed') THEN 'profile_quality_review_needed' END, CASE WHEN weak THEN 'weak_text_match' END, CASE WHEN mixed THEN 'mixed_strategy_tags|tag_conflict_review_needed' END) AS flags FROM s""")
def review_flags(spark, sf):
    return R.scored(_index(spark, sf).profiles, _intent()).select("id", F.array_join("review_flags", "|").alias("flags"))


def _cut(x: str, most: int) -> str:
    return rf"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(left({x}, {most - 1}), '[\s,;:.，；：。、]+$', '') || '…' END"


@query(f"""WITH RECURSIVE {_SEARCH}, rr AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, length({_cut("repeat(profile_text, 1 + id % 9)", 30)}) + length({_cut('evidence_line', 30)}) AS n FROM s),
p AS (SELECT rank, n, n AS used, true AS kept FROM rr WHERE rank = 1 UNION ALL SELECT rr.rank, rr.n, CASE WHEN p.used + rr.n <= 90 THEN p.used + rr.n ELSE p.used END, p.used + rr.n <= 90 FROM p JOIN rr ON rr.rank = p.rank + 1 WHERE rr.rank <= 12)
SELECT CAST(rank AS INTEGER) AS rank, CAST(n AS INTEGER) AS context_chars FROM p WHERE kept""")
def profile_packing(spark, sf):
    p = _index(spark, sf).profiles.withColumn("long_text", F.expr("repeat(profile_text, cast(1 + id % 9 as int))"))
    t = R.scored(p, _intent())
    nth = F.row_number().over(W.orderBy(F.desc("score"), F.col("quality_status") != "confirmed", F.col("entity_type") != "product", R.is_generic(F.col("product_name")), "product_name", "id"))
    top = R.ranked(t, 12).withColumn("rank", nth).withColumn("profile_text", F.col("long_text"))
    return R.packed(top, budget=90, per_result=60).select("rank", "context_chars")


ASKED = ["明汯有哪些500指增产品", "哪些管理人有WorldQuant背景", "期货策略 商品期货 期权策略", "灵均投资 市场中性3号2 如何", "九坤概况", "行业暴露 3% 的1000指增", "空气指增"]


def _condition_sql(any_of: str, all_of: str) -> str:
    hit = contains_any("lower(q)", any_of.split())
    return f"{hit} AND {' AND '.join(f'''contains(lower(q), '{w}')''' for w in all_of.split())}" if all_of else hit


_CONDITIONS_SQL = ", ".join(f"CASE WHEN {_condition_sql(a, b)} THEN '{label}' END" for a, b, label, _ in R.CONDITIONS)


#: Queries made of parts: fixed ones, and names with words round them.
_ASKED = f"""SELECT DISTINCT {pick(["明汯", "灵均投资 ", "", "衍复 私募", "宽德投资", "九坤基金"], 2)} || {pick(["有哪些", "哪些管理人做", "的", "概况 ", ""], 3)}
  || {pick(["500指增", "商品期货CTA", "WorldQuant背景", "市场中性", "行业暴露 3% 的1000指增", "空气指增", "期权策略"], 5)} || CASE WHEN k % 4 = 0 THEN product_name ELSE '' END || CASE WHEN k % 9 = 0 THEN ' 如何' ELSE '' END AS query
FROM (SELECT id AS k, product_name FROM {{profiles}}) AS x UNION SELECT * FROM (VALUES {', '.join(f"('{q}')" for q in ASKED)}) AS f(query)"""


@query(f"""WITH {V.PROFILES_CTE}, mm AS (SELECT DISTINCT manager FROM profiles), {core_steps('mm', 'manager', 'm')},
al AS (SELECT DISTINCT manager, unnest([manager, mname, core, core || '基金', core || '私募', core || '私募基金', regexp_replace(mname, '^上海', ''), regexp_replace(mname, '投资管理有限公司$', '')]) AS alias FROM m),
pn AS (SELECT DISTINCT product_name, {sql_key('product_name')} AS k FROM profiles),
asked AS (SELECT query AS q, {sql_key('query')} AS k FROM ({_ASKED.replace('{profiles}', 'profiles')})),
mg AS (SELECT q, arg_min(manager, (-length(alias), manager)) AS manager FROM asked JOIN al ON length({sql_key('alias')}) >= 2 AND contains(asked.k, {sql_key('alias')}) GROUP BY 1),
pr AS (SELECT q, arg_min(product_name, (-length(pn.k), product_name)) AS product FROM asked JOIN pn ON length(pn.k) >= 3 AND contains(asked.k, pn.k) GROUP BY 1)
SELECT asked.q AS query, manager, product, concat_ws('|', {_CONDITIONS_SQL.replace('lower(q)', 'lower(asked.q)')}) AS conditions,
  CASE WHEN {contains_any('asked.q', R.MANAGER_WORDS)} AND manager IS NULL AND product IS NULL THEN 'manager_filter' WHEN product IS NOT NULL THEN 'single_product' WHEN manager IS NOT NULL AND {contains_any('asked.q', R.OVERVIEW_WORDS)} THEN 'manager_overview' WHEN manager IS NOT NULL THEN 'manager' ELSE 'search' END AS mode
FROM asked LEFT JOIN mg ON asked.q = mg.q LEFT JOIN pr ON asked.q = pr.q""")
def query_intents(spark, sf):
    p = V.profiles(spark, sf)
    asked = spark.sql(_ASKED, profiles=p)
    got = recognition.intents(asked, stored(recognition.name_keys(p), "names"))
    return got.select("query", "manager", "product", F.array_join("conditions", "|").alias("conditions"), "mode")


def _search_sql(q: str, limit: int, budget: int, per_result: int) -> str:
    """Search without a manager or product in the query: its terms and conditions, scored, ranked and packed."""
    terms, conditions = R.query_terms(q), R.conditions_of(q)
    points = " + ".join(f"CASE WHEN contains(pk, '{text_key(t)}') THEN 8.0 WHEN contains(mk, '{text_key(t)}') THEN 6.0 WHEN contains(tags, '{t.lower()}') THEN 4.5 WHEN contains(txt, '{t.lower()}') THEN {R.text_weight(t)} ELSE 0 END" for t in terms if text_key(t))
    met = [(contains_any("tagk", [text_key(n) for n in names]), contains_any("txtk", [text_key(n) for n in names])) for _, names in conditions]
    more = " + ".join(f"CASE WHEN {a} THEN 5.5 WHEN {b} THEN 4.0 ELSE -2.5 END" for a, b in met)
    half, first = per_result // 2, max(budget // 2, 120)
    return f"""WITH RECURSIVE {_SEARCH[:_SEARCH.index('r AS (SELECT *')]}
r AS (SELECT *, {points} + {more} + 0.25
  - CASE quality_status WHEN 'weak_line' THEN 6.0 WHEN 'needs_review' THEN 4.0 ELSE 0 END - CASE WHEN entity_type IN ('', 'product') THEN 0 ELSE 5.0 END - CASE entity_confidence WHEN 'medium' THEN 1.5 WHEN 'low' THEN 3.0 ELSE 0 END
  - CASE WHEN name_reason = 'strategy_product_line' THEN 2.0 ELSE 0 END - CASE WHEN {_GENERIC} THEN 2.0 ELSE 0 END AS score, {' AND '.join(f'({a} OR {b})' for a, b in met)} AS whole FROM k WHERE {' OR '.join(f'{a} OR {b}' for a, b in met)}),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, quality_status <> 'confirmed', entity_type <> 'product', {_GENERIC}, product_name) AS rank FROM r WHERE score > 0),
n AS (SELECT *, length({_cut('profile_text', half)}) + length({_cut('evidence_line', half)}) AS size FROM o WHERE rank <= {limit}),
p AS (SELECT rank, CASE WHEN size > {budget} THEN least(size, {2 * first}) ELSE size END AS used, true AS kept FROM n WHERE rank = 1
  UNION ALL SELECT n.rank, CASE WHEN p.used + size <= {budget} THEN p.used + size ELSE p.used END, p.used + size <= {budget} FROM p JOIN n ON n.rank = p.rank + 1)
SELECT CAST(n.rank AS INTEGER) AS rank, product_name, manager, CAST(score AS DOUBLE) AS score, CASE WHEN whole THEN 'satisfied' ELSE 'unsatisfied' END AS satisfied FROM n JOIN p ON n.rank = p.rank WHERE kept"""


SEARCHED = "哪些管理人有商品期货CTA策略"


@query(_search_sql(SEARCHED, 12, 150, 900))
def profile_search(spark, sf):
    index = _index(spark, sf)
    top = R.search(index.profiles, SEARCHED, 12, budget=150, index=index)
    return top.select("rank", "product_name", "manager", F.col("score").cast("double").alias("score"), "satisfied")


@query()
def profile_build(spark, sf):
    """Profiles compiled from notes of the first parts: a build is tested by its steps, which have SQL."""
    from tessera.plans.profiles import build

    return build(V.notes(spark, sf))["profiles"].select("canonical_key", "product_name", "manager", "primary_tag", "quality_status", "fragments")


# --- classification and derived fields


def _values(rows: list[tuple[str, str, str, str]]) -> str:
    return ", ".join(f"({i}, '{c}', '{p}', '{n}', [{', '.join(repr(text_key(a)) for a in [n, *names.split()])}])" for i, (c, p, n, names) in enumerate(rows))


_TEXT = "product_name || ' ' || secondary_tag || ' ' || evidence_line || ' ' || profile_text"
_TAXONOMY = f"""{V.PROFILES_CTE}, pri(i, code, parent, name, keys) AS (VALUES {_values([(c, c, n, a) for c, n, a in T.PRIMARY])}), sec(i, code, parent, name, keys) AS (VALUES {_values(T.SECONDARY)}),
fac(i, axis, parent, name, keys) AS (VALUES {_values([(a, a, v, n) for a, v, n in T.FACETS])}),
x AS (SELECT id, {sql_key(_TEXT)} AS k FROM profiles),
sh AS (SELECT id, i, code, parent, name, len(list_filter(keys, lambda y: contains(k, y))) AS n FROM x JOIN sec ON len(list_filter(keys, lambda y: contains(k, y))) > 0),
sc AS (SELECT id, code, sum(p) AS score FROM (SELECT id, parent AS code, 4 + n AS p FROM sh UNION ALL SELECT id, code, 2 + len(list_filter(keys, lambda y: contains(k, y))) FROM x JOIN pri ON len(list_filter(keys, lambda y: contains(k, y))) > 0) GROUP BY 1, 2),
best AS (SELECT x.id AS id, coalesce(arg_max(sc.code, (score, sc.code <> 'OTHER_REVIEW', -pri.i)), 'OTHER_REVIEW') AS code FROM x LEFT JOIN sc ON x.id = sc.id LEFT JOIN pri ON pri.code = sc.code GROUP BY 1),
f AS (SELECT id, string_agg(DISTINCT axis || ':' || name, '|' ORDER BY axis || ':' || name) AS facets FROM x JOIN fac ON len(list_filter(keys, lambda y: contains(k, y))) > 0 GROUP BY 1)"""


@query(f"""WITH {_TAXONOMY}, m AS (SELECT sh.id AS id, string_agg(sh.name, '|' ORDER BY sh.i) AS tags FROM sh JOIN best ON sh.id = best.id AND sh.parent = best.code GROUP BY 1)
SELECT best.id AS id, best.code AS primary_code, pri.name AS primary_tag, coalesce(tags, '') AS secondary, coalesce(facets, '') AS facet_values,
  CASE WHEN best.code = 'OTHER_REVIEW' THEN 'low' WHEN tags IS NOT NULL AND facets IS NOT NULL THEN 'high' ELSE 'medium' END AS tag_confidence, CASE WHEN best.code = 'OTHER_REVIEW' THEN 'needs_review' ELSE 'confirmed' END AS tag_review_status
FROM best JOIN pri ON best.code = pri.code LEFT JOIN m ON best.id = m.id LEFT JOIN f ON best.id = f.id""")
def taxonomy_classify(spark, sf):
    t = V.profiles(spark, sf).select("id", F.concat_ws(" ", "product_name", "secondary_tag", "evidence_line", "profile_text").alias("text"))
    t = T.classified(t)
    facets = F.flatten(F.transform(F.map_entries("facets"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    return t.select("id", "primary_code", "primary_tag", F.array_join("secondary_tags", "|").alias("secondary"), F.array_join(F.array_sort(F.array_distinct(facets)), "|").alias("facet_values"), "tag_confidence", "tag_review_status")


_NAME, _Q = "product_name", "'"
_BENCH = f"CASE {' '.join(f'WHEN {contains_any(sql_key(_NAME), words)} THEN {_Q}{c}{_Q}' for c, words, _, _ in X.BENCHMARKS)} ELSE '' END"
_BENCH_TAG = f"CASE benchmark {' '.join(f'''WHEN '{c}' THEN '{t}' ''' for c, _, t, _ in X.BENCHMARKS)} END"
_INDEX_TAGS = ", ".join(f"'{t}'" for t in X.INDEX_TAGS)
_LINES = f"concat_ws('|', {', '.join(f'''CASE WHEN {contains_any('low', [w.lower() for w in words.split()])} THEN '{line}' END''' for line, words in X.PRODUCT_LINES)})"
_GROUP = f"CASE {' '.join(f'''WHEN {contains_any('lower(profile_text)', words.split())} THEN '{g}' ''' for g, words in X.GROUPS)} ELSE '其他策略' END"


@query(f"""WITH {V.PROFILES_CTE}, b AS (SELECT *, {_BENCH} AS benchmark, lower(product_name || chr(10) || evidence_line || chr(10) || profile_text) AS low FROM profiles),
g AS (SELECT *, CASE WHEN secondary_tag = '' OR (secondary_tag IN ({_INDEX_TAGS}) AND secondary_tag IS DISTINCT FROM {_BENCH_TAG}) THEN '' ELSE secondary_tag END AS kept FROM b)
SELECT id, benchmark, kept AS secondary, CASE WHEN kept <> secondary_tag THEN secondary_tag ELSE '' END AS rejected, {_LINES} AS lines, {_BACKGROUND} AS background, coalesce(nullif(secondary_tag, ''), nullif(primary_tag, ''), {_GROUP}) AS grp,
  coalesce(nullif(concat_ws('；', CASE WHEN primary_tag <> '' THEN '一级策略：' || primary_tag END, CASE WHEN kept <> '' THEN '二级策略：' || kept END, CASE WHEN evidence_line <> '' THEN '代表证据：' || evidence_line END), ''), '材料未提及明确策略定位') AS sentence,
  CASE WHEN contains(evidence_line, 'CTA') THEN evidence_line WHEN contains(profile_text, '期货') THEN profile_text ELSE evidence_line END AS snippet FROM g""")
def derived_fields(spark, sf):
    t = V.profiles(spark, sf).withColumns({"facets": F.create_map().cast("map<string,array<string>>"), "tag0": F.col("secondary_tags"), "rejected_tags": F.array().cast("array<string>")})
    t = X.guarded(t.drop("product_lines"), ["product_name"])
    none = F.array().cast("array<string>")
    return t.select(
        "id", "benchmark", F.array_join("secondary_tags", "|").alias("secondary"), F.array_join("rejected_tags", "|").alias("rejected"), F.array_join(X.product_lines(F.col("product_name"), F.col("evidence_line"), F.col("profile_text")), "|").alias("lines"),
        F.array_join(X.backgrounds(F.col("evidence_line")), "|").alias("background"), X.group_of(F.col("tag0"), F.col("primary_tags"), F.col("profile_text")).alias("grp"),
        X.positioning(F.col("primary_tags"), F.col("secondary_tags"), none, none, F.col("evidence")).alias("sentence"), X.snippet(F.array("evidence_line", "profile_text"), F.array(F.lit("CTA"), F.lit("期货")), F.lit("-")).alias("snippet"),
    )


@query(f"""WITH {V.PROFILES_CTE}, g AS (SELECT coalesce(nullif(secondary_tag, ''), nullif(primary_tag, ''), {_GROUP}) AS grp, product_name, id % 17 AS score FROM profiles)
SELECT grp AS "group", count(*) AS n, string_agg(product_name, '|' ORDER BY score DESC, product_name) AS products FROM g GROUP BY 1""")
def result_groups(spark, sf):
    return X.grouped(V.profiles(spark, sf).withColumn("score", F.col("id") % 17)).withColumn("products", F.array_join("products", "|"))


@query(f"""WITH {V.PROFILES_CTE}, s AS (SELECT id, list_filter([primary_tag, secondary_tag], lambda x: x <> '') AS a, list_filter([secondary_tag, rejected_tag, lower(profile_text), 'cta'], lambda x: x <> '') AS b FROM profiles),
e AS (SELECT id, 'd' AS side, x, {sql_key('x')} AS k, o FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS o FROM s) UNION ALL SELECT id, 'm', x, {sql_key('x')}, o FROM (SELECT id, unnest(b) AS x, generate_subscripts(b, 1) AS o FROM s)),
f AS (SELECT id, side, k, min(o) AS o, arg_min(x, o) AS x FROM e GROUP BY 1, 2, 3)
SELECT s.id AS id, coalesce((SELECT string_agg(x, '|' ORDER BY o) FROM f WHERE f.id = s.id AND side = 'd'), '') AS direct,
  coalesce((SELECT string_agg(x, '|' ORDER BY o) FROM f WHERE f.id = s.id AND side = 'm' AND k NOT IN (SELECT k FROM f d WHERE d.id = s.id AND d.side = 'd')), '') AS mentioned FROM s""")
def tag_scope(spark, sf):
    full = lambda *cs: F.filter(F.array(*cs), lambda x: x != "")
    t = V.profiles(spark, sf)
    s = X.scope_split(full("primary_tag", "secondary_tag"), full(F.col("secondary_tag"), F.col("rejected_tag"), F.lower("profile_text"), F.lit("cta")))
    return t.select("id", F.array_join(s["direct"], "|").alias("direct"), F.array_join(s["mentioned"], "|").alias("mentioned"))


@query(f"""WITH {V.PROFILES_CTE}, x AS (SELECT id % 40 AS k, id, product_name, evidence_line, entity_confidence FROM profiles WHERE id % 3 > 0),
l AS (SELECT k, evidence_line AS v, min(id) AS o FROM x GROUP BY 1, 2), c AS (SELECT k, count(*) AS fragments, arg_min(product_name, id) AS product_name, min(CASE entity_confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS r FROM x GROUP BY 1)
SELECT c.k AS k, fragments, product_name, CASE r WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, (SELECT string_agg(v, '|' ORDER BY o) FROM l WHERE l.k = c.k) AS lines FROM c""")
def fragment_merge(spark, sf):
    t = V.profiles(spark, sf).where("id % 3 > 0").select((F.col("id") % 40).alias("k"), "id", "product_name", F.col("evidence").alias("lines"), F.col("entity_confidence").alias("confidence"))
    return K.merged_fragments(t, ["k"], ["id"], ["product_name"], ["lines"], {"confidence": K.CONFIDENCE}).select("k", "fragments", "product_name", "confidence", F.array_join("lines", "|").alias("lines"))


@query(f"""WITH {V.PROFILES_CTE}, e AS (SELECT 'p' || lpad(CAST(id AS VARCHAR), 6, '0') AS canonical_key, unnest(['f' || (id % 50), 'c' || (id % 70)]) AS ext FROM profiles WHERE id % 4 = 0), t AS (SELECT ext, max(canonical_key) AS target FROM e GROUP BY 1)
SELECT canonical_key, max(target) AS target_key FROM e JOIN t ON e.ext = t.ext GROUP BY 1""")
def identity_merge(spark, sf):
    t = V.profiles(spark, sf).where("id % 4 = 0").select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("canonical_key"), F.array(F.concat(F.lit("f"), F.col("id") % 50), F.concat(F.lit("c"), F.col("id") % 70)).alias("external_ids"))
    return X.by_external_identity(t)


@query(f"""WITH {V.PROFILES_CTE}, i AS (SELECT id, unnest(['a', 'b', 'c', 'd', 'v', 'w']) AS item FROM profiles),
j AS (SELECT id, item, CASE item WHEN 'a' THEN 15 WHEN 'b' THEN 15 WHEN 'c' THEN 12 WHEN 'd' THEN 10 ELSE 0 END AS points, item IN ('v', 'w') AS veto, CASE WHEN (id + ascii(item)) % 5 = 0 THEN NULL WHEN item IN ('v', 'w') THEN (id + ascii(item)) % 7 > 0 ELSE (id * 3 + ascii(item)) % 4 > 0 END AS met FROM i)
SELECT id, CAST(CASE WHEN bool_or(veto AND met IS FALSE) THEN 0 ELSE greatest(0, 100 - sum(CASE WHEN NOT veto AND met IS NOT TRUE THEN points ELSE 0 END)) END AS BIGINT) AS score, bool_or(veto AND met IS FALSE) AS vetoed, coalesce(string_agg(item, '|' ORDER BY item) FILTER (NOT veto AND met IS NULL), '') AS to_ask FROM j GROUP BY 1""")
def deduction_score(spark, sf):
    t = V.profiles(spark, sf).select("id", F.explode(F.array(*[F.lit(x) for x in "abcdvw"])).alias("item"))
    t = t.selectExpr("id", "item", "CASE item WHEN 'a' THEN 15 WHEN 'b' THEN 15 WHEN 'c' THEN 12 WHEN 'd' THEN 10 ELSE 0 END AS points", "item IN ('v', 'w') AS veto", "CASE WHEN (id + ascii(item)) % 5 = 0 THEN NULL WHEN item IN ('v', 'w') THEN (id + ascii(item)) % 7 > 0 ELSE (id * 3 + ascii(item)) % 4 > 0 END AS met")
    return K.deduction_score(t, "id").select("id", F.col("score").cast("long").alias("score"), "vetoed", F.array_join("to_ask", "|").alias("to_ask"))
