"""Queries on names of managers and products, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import knowledge as K
from tessera.plans import knowledge_views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def alternatives(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))).replace("(", r"\(").replace(")", r"\)") + ")"


EDGE = r"[ \-_，,。；;：:（）()\[\]【】]"


def sql_key(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'))"


def sql_link(x: str) -> str:
    return rf"""regexp_replace(regexp_replace({x}, '(?s)^.*?\[\[([^\]]+)\]\].*$', '\1'), '^[''"\s]+|[''"\s]+$', '', 'g')"""


def sql_clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({sql_link(x)}, '\s+', '', 'g'), '^{EDGE}+|{EDGE}+$', '', 'g')"


def sql_tail(x: str, words: list[str]) -> str:
    return f"regexp_replace({sql_clean(x)}, '{alternatives(words)}+$', '')"


def sql_city(x: str) -> str:
    return f"regexp_replace({sql_clean(x)}, '^{alternatives(N.CITIES)}+', '')"


def sql_numbers(x: str) -> str:
    for k, n in enumerate(N.NUMERALS, 1):
        x = f"replace({x}, '{n}号', '{k}号')"
    return x


def sql_synonyms(x: str) -> str:
    for old, new in N.SYNONYMS:
        x = f"replace({x}, '{old.lower()}', '{new.lower()}')"
    return x


def sql_family(x: str, part: int) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'''contains({x}, '{a.lower()}')''' for a in names.split())} THEN '{(code, label)[part]}'" for code, label, names in N.FAMILIES)
    return f"CASE {whens} ELSE '' END"


def sql_manager(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({sql_link(x)}, '\s+', '', 'g'), '^[ \-_，,。；;：:]+|[ \-_，,。；;：:]+$', '', 'g'), '^\d{{4,}}[_\-\s]*', '')"
    x = rf"regexp_replace(translate({x}, '（）', '()'), '\({alternatives(N.CITIES)}\)', '', 'g')"
    x = rf"regexp_replace({x}, '\(([^)]{{1,8}})\)', '\1', 'g')"
    return sql_clean(f"regexp_replace({x}, '(?:私募证券|私募基金|私募)$', '')")


def core_steps(source: str, column: str, name: str) -> str:
    """CTEs that take one word after the other from a manager's name, unless nothing is left."""
    out = [f"{name}0 AS (SELECT DISTINCT {column} AS manager, {sql_manager(column)} AS mname, {sql_tail(sql_city(sql_manager(column)), N.COMPANY_SUFFIXES)} AS core FROM {source})"]
    steps = [f"replace(core, '{w}', '')" for w in N.CORE_WORDS] + ["CITY"] + [f"regexp_replace(core, '{w}$', '')" for w in N.CORE_TAILS]
    for i, s in enumerate(steps):
        new = sql_city("core") if s == "CITY" else f"coalesce(nullif({s}, ''), core)"
        out.append(f"{name}{i + 1} AS (SELECT manager, mname, {new} AS core FROM {name}{i})")
    out.append(f"{name} AS (SELECT manager, mname, coalesce(nullif(core, ''), mname) AS core FROM {name}{len(steps)})")
    return ", ".join(out)


@query(f"""WITH {V.PRODUCTS_CTE}
SELECT id, {sql_link('raw')} AS linked, {sql_clean('raw')} AS cleaned, replace({sql_key('raw')}, 'ß', 'ss') AS folded, {sql_tail('manager', N.COMPANY_SUFFIXES)} AS no_company, {sql_city('manager')} AS no_city,
  {sql_tail('raw', N.FUND_SUFFIXES)} AS no_fund, {sql_tail('raw', N.GENERIC_TAILS)} AS no_tail, {sql_numbers(sql_clean('raw'))} AS numbered, {sql_synonyms(sql_key(sql_numbers(sql_clean(sql_tail('raw', N.FUND_SUFFIXES)))))} AS synonym,
  {sql_family(sql_key('raw'), 0)} AS family, {sql_family(sql_key('raw'), 1)} AS family_label, regexp_matches(raw, '{N.SPECIFIC}') AS specific FROM products""")
def name_cleaning(spark, sf):
    raw, manager = F.col("raw"), F.col("manager")
    return V.products(spark, sf).select(
        "id", N.wikilink(raw).alias("linked"), N.clean_name(raw).alias("cleaned"), N.fold_key(raw).alias("folded"), N.strip_company(manager).alias("no_company"), N.strip_city(manager).alias("no_city"), N.strip_fund(raw).alias("no_fund"),
        N.strip_tail(raw).alias("no_tail"), N.arabic_numbers(raw).alias("numbered"), N.synonym_key(raw).alias("synonym"), N.family(raw)["code"].alias("family"), N.family(raw)["label"].alias("family_label"), raw.rlike(N.SPECIFIC).alias("specific"),
    )


_MANAGERS = f"{V.PRODUCTS_CTE}, {core_steps('products', 'manager', 'm')}"
_FORMS = f"[{sql_clean('manager')}, mname, {sql_city('mname')}, {sql_tail('mname', N.COMPANY_SUFFIXES)}, {sql_tail(sql_city('mname'), N.COMPANY_SUFFIXES)}, core, core || '基金', core || '私募', core || '私募基金']"
_ALIASES = f"aliases AS (SELECT manager, alias, replace({sql_key('alias')}, 'ß', 'ss') AS k FROM (SELECT DISTINCT manager, unnest({_FORMS}) AS alias FROM m) WHERE length({sql_key('alias')}) >= 2)"


@query(f"""WITH {_MANAGERS}, {_ALIASES}, reg(alias, identity) AS (VALUES ('明汯投资', '明汯集团'), ('灵均私募基金管理有限公司', '灵均集团'), ('上海九坤（上海）基金', '九坤集团'))
SELECT m.manager AS manager, mname, core, replace({sql_key('core')}, 'ß', 'ss') AS identity, coalesce(replace({sql_key('reg.identity')}, 'ß', 'ss'), replace({sql_key('core')}, 'ß', 'ss')) AS registered, a.names AS names
FROM m LEFT JOIN reg ON replace({sql_key('m.manager')}, 'ß', 'ss') = {sql_key('reg.alias')} LEFT JOIN (SELECT manager, string_agg(alias, '|' ORDER BY length(alias) DESC, alias) AS names FROM aliases GROUP BY 1) a ON m.manager = a.manager""")
def name_identity(spark, sf):
    c = F.col("manager")
    registry = spark.createDataFrame([("明汯投资", "明汯集团"), ("灵均私募基金管理有限公司", "灵均集团"), ("上海九坤（上海）基金", "九坤集团")], "alias string, identity string")
    t = V.products(spark, sf).select("manager").distinct().select(c, N.manager_name(c).alias("mname"), N.manager_core(c).alias("core"), N.identity_key(c).alias("identity"), F.array_join(N.manager_aliases(c), "|").alias("names"))
    return N.with_identity(t, "manager", registry, "registered").select("manager", "mname", "core", "identity", "registered", "names")


_LIKE = ", ".join(f"'{k}'" for k in sorted({x.lower() for _, label, names in N.FAMILIES for x in [label, *names.split()]}))


@query(f"""WITH {_MANAGERS}, {_ALIASES},
p AS (SELECT id, products.manager AS manager, core, {sql_clean('product_name')} AS clean FROM products JOIN m ON products.manager = m.manager),
o AS (SELECT p.*, substr(clean, coalesce((SELECT max(length(alias)) FROM aliases a WHERE a.manager = p.manager AND starts_with({sql_key('p.clean')}, a.k)), 0) + 1) AS own FROM p),
s AS (SELECT *, {sql_tail('own', N.GENERIC_TAILS)} AS stem, {sql_family(sql_key('clean'), 0)} AS family, {sql_family(sql_key('clean'), 1)} AS label, regexp_matches(own, '{N.SPECIFIC}') AS specific FROM o),
g AS (SELECT *, CASE WHEN family <> '' AND NOT specific AND own <> stem THEN 'strategy_product_line' WHEN own <> stem AND NOT specific THEN 'generic_product_tail' WHEN {sql_key('stem')} IN ({_LIKE}) THEN 'pure_strategy_name' END AS generic,
  {sql_tail(sql_city('manager'), N.COMPANY_SUFFIXES)} AS short FROM s),
c AS (SELECT *, CASE WHEN generic IS NULL THEN clean WHEN family <> '' THEN short || label ELSE clean END AS canonical_name, generic IS NULL AND NOT specific AND family = '' AND regexp_matches(stem, '^[一-鿿]{{2,3}}$') AS odd FROM g),
k AS (SELECT *, {sql_synonyms(sql_key(sql_numbers(sql_clean(sql_tail('canonical_name', N.FUND_SUFFIXES)))))} AS key FROM c),
al AS (SELECT manager, alias, {sql_synonyms(sql_key(sql_numbers(sql_clean(sql_tail('alias', N.FUND_SUFFIXES)))))} AS ak FROM aliases),
h AS (SELECT id, arg_max(length(ak), (length(alias), -ord)) AS cut FROM (SELECT k.id AS id, alias, ak, row_number() OVER (ORDER BY alias) AS ord FROM k JOIN al ON k.manager = al.manager AND ak <> '' AND starts_with(key, ak)) GROUP BY id)
SELECT k.id AS id, canonical_name, family, generic IS NOT NULL AS is_generic, CASE WHEN generic IS NOT NULL THEN 'weak_line' WHEN odd THEN 'needs_review' ELSE 'confirmed' END AS quality_status,
  coalesce(generic, CASE WHEN odd THEN 'suspicious_short_name' ELSE 'product_specific' END) AS name_reason,
  CASE WHEN generic IS NULL THEN 'product' WHEN regexp_matches(own, '(?:系列|系列产品)$') THEN 'product_series' WHEN generic = 'generic_product_tail' THEN 'generic_bucket' ELSE 'strategy_line' END AS entity_type,
  CASE WHEN generic IS NOT NULL THEN 'low' WHEN odd THEN 'medium' ELSE 'high' END AS entity_confidence,
  {sql_key('core')} || '|' || CASE WHEN generic IS NULL THEN 'product' ELSE 'generic' END || '|' || substr(key, coalesce(cut, 0) + 1) AS canonical_key
FROM k LEFT JOIN h ON k.id = h.id""")
def name_analysis(spark, sf):
    return N.analyzed(V.products(spark, sf)).select("id", "canonical_name", "family", "is_generic", "quality_status", "name_reason", "entity_type", "entity_confidence", "canonical_key")


def sql_without(x: str, words: list[str]) -> str:
    x = sql_key(x)
    for w in words:
        x = f"replace({x}, '{w}', '')"
    return x


def sql_product_key(x: str) -> str:
    return sql_numbers(sql_without(x, ["私募证券投资基金", "证券投资基金", "私募基金", "资产管理计划", "资管计划"]))


def sql_manager_key(x: str) -> str:
    return sql_without(x, ["私募基金管理有限公司", "资产管理有限公司", "投资管理有限公司", "投资有限公司", "资本管理有限公司", "资本有限公司", "基金管理有限公司", "有限公司"])


@query(f"""WITH {V.PRODUCTS_CTE}, a AS (SELECT DISTINCT product_name, manager, {sql_product_key('product_name')} AS p, {sql_manager_key('manager')} AS m FROM products WHERE id % 2 = 0),
c AS (SELECT id AS candidate_id, product_name AS candidate_name, {sql_product_key('product_name')} AS c, {sql_manager_key('manager')} AS cm FROM products WHERE id % 7 = 1),
j AS (SELECT product_name, manager, candidate_id, candidate_name, CASE WHEN m = cm THEN 4 ELSE 2 END + CASE WHEN p = c THEN 4 WHEN contains(p, c) OR contains(c, p) THEN 2 ELSE 0 END AS score
  FROM a JOIN c ON m <> '' AND cm <> '' AND (starts_with(m, cm) OR starts_with(cm, m)))
SELECT product_name, manager, candidate_id, candidate_name, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_name, manager ORDER BY score DESC, length({sql_product_key('candidate_name')}), candidate_id) AS INTEGER) AS place FROM j) WHERE place <= 3""")
def candidate_matches(spark, sf):
    p = V.products(spark, sf)
    c = p.where("id % 7 = 1").select(F.col("id").alias("candidate_id"), F.col("product_name").alias("candidate_name"), F.col("manager").alias("candidate_manager"))
    return K.best_candidates(K.candidate_matches(p.where("id % 2 = 0").select("product_name", "manager").distinct(), K.first_alike(c, 3)), 3)


_FOLDER = "CASE WHEN length(n) = 0 THEN 0 ELSE CASE WHEN f = n THEN 100 ELSE 0 END + CASE WHEN ends_with(f, '_' || n) OR ends_with(f, '-' || n) THEN 90 ELSE 0 END + CASE WHEN contains(f, n) THEN 70 ELSE 0 END + CAST(floor(20 * len(list_filter(cs, lambda x: contains(f, x))) / len(cs)) AS INTEGER) END"


@query(f"""WITH {V.PRODUCTS_CTE}, d AS (SELECT DISTINCT manager AS name FROM products), q(query) AS (VALUES ('明汯'), ('灵均 投资'), ('九坤私募'), ('Abc')),
j AS (SELECT query, name, regexp_extract(name, '^(\\d{{4,}})[_\\-\\s]', 1) AS code, lower(regexp_replace(name, '\\s+', '', 'g')) AS f, lower(regexp_replace(query, '\\s+', '', 'g')) AS n FROM d, q),
s AS (SELECT query, name, code, {_FOLDER} AS score FROM (SELECT *, list_distinct(list_filter(string_split(n, ''), lambda x: x <> '')) AS cs FROM j)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS place FROM s)
SELECT query, name, code, score, CAST(place AS INTEGER) AS place, place = 1 OR score >= 30 AS shown FROM r WHERE place <= 10""")
def folder_matches(spark, sf):
    d, q = V.products(spark, sf).select(F.col("manager").alias("name")).distinct(), spark.createDataFrame([("明汯",), ("灵均 投资",), ("九坤私募",), ("Abc",)], "query string")
    t = d.join(F.broadcast(q)).select("query", "name", K.folder_code(F.col("name")).alias("code"), K.folder_score(F.col("name"), F.col("query")).alias("score"))
    return K.visible(t, ["query"], 30, 10).select("query", "name", "code", "score", "place", "shown")


@query("""WITH s AS (SELECT s_nationkey AS query, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '00' || (s_nationkey + 10) || '_' ELSE '' END || split_part('明汯|灵均|九坤', '|', CAST(1 + s_suppkey % 3 AS INT)) || split_part('私募基金管理有限公司|投资有限公司||有限公司', '|', CAST(1 + s_suppkey % 4 AS INT)) AS name,
  CASE WHEN s_nationkey % 2 = 0 THEN '00' || (s_nationkey + 10) ELSE '' END AS code, CAST(s_suppkey % 5 * 4 + CASE WHEN s_suppkey % 11 = 0 THEN 30 ELSE 0 END AS INTEGER) AS score FROM supplier),
d AS (SELECT query, name, code, max(score) AS score FROM s GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS n, lead(score) OVER (PARTITION BY query ORDER BY score DESC, name) AS nxt, max(score) OVER (PARTITION BY query) AS top,
  regexp_replace(name, '^\\d{4,}[_\\-\\s]*', '') AS bare FROM d),
l AS (SELECT *, CASE WHEN contains(bare, '私募基金管理有限公司') THEN 7 WHEN contains(bare, '证券投资基金管理有限公司') THEN 6 WHEN contains(bare, '基金管理有限公司') THEN 5 WHEN contains(bare, '资产管理有限公司') THEN 4 WHEN contains(bare, '投资管理有限公司') THEN 3 WHEN contains(bare, '投资有限公司') THEN 2 WHEN contains(bare, '有限公司') THEN 1 ELSE 0 END AS legal FROM w),
u AS (SELECT query, bool_or(n = 1 AND (nxt IS NULL OR score >= nxt + 10)) AS sure, count(DISTINCT CASE WHEN top - score <= 10 AND code <> '' THEN code END) AS codes FROM l GROUP BY 1),
r AS (SELECT l.*, sure, codes, row_number() OVER (PARTITION BY l.query ORDER BY top - score <= 10 DESC, legal DESC, score DESC, length(bare) DESC, bare DESC) AS pref FROM l JOIN u ON l.query = u.query)
SELECT query, name, code, score FROM r WHERE CASE WHEN sure THEN n = 1 ELSE codes = 1 AND pref = 1 END""")
def folder_choice(spark, sf):
    from tessera.session import table

    t = table(spark, sf, "supplier").selectExpr(
        "s_nationkey AS query", "CASE WHEN s_suppkey % 3 = 0 THEN '00' || (s_nationkey + 10) || '_' ELSE '' END || split_part('明汯|灵均|九坤', '|', CAST(1 + s_suppkey % 3 AS INT)) || split_part('私募基金管理有限公司|投资有限公司||有限公司', '|', CAST(1 + s_suppkey % 4 AS INT)) AS name",
        "CASE WHEN s_nationkey % 2 = 0 THEN '00' || (s_nationkey + 10) ELSE '' END AS code", "CAST(s_suppkey % 5 * 4 + CASE WHEN s_suppkey % 11 = 0 THEN 30 ELSE 0 END AS INT) AS score",
    )
    return K.chosen_folder(t.groupBy("query", "name", "code").agg(F.max("score").alias("score")), ["query"])


@query(f"""WITH {V.PRODUCTS_CTE}, a AS (SELECT id, [product_name, raw, ' ' || manager] AS xs, [manager, product_name || '增强', 'x'] AS ys FROM products),
k AS (SELECT id, list_transform(xs, lambda x: {sql_key('x')}) AS ks, list_transform(ys, lambda x: {sql_key('x')}) AS ls FROM a),
n AS (SELECT id, {sql_key('x')} AS k, min(ord) AS ord, arg_min(trim(x), ord) AS x FROM (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS ord FROM a) WHERE length({sql_key('x')}) >= 2 GROUP BY 1, 2)
SELECT k.id AS id, CASE WHEN list_has_any(ks, ls) THEN 4 WHEN len(list_filter(ks, lambda x: len(list_filter(ls, lambda y: x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)))) > 0)) > 0 THEN 2 ELSE 0 END AS score, c.names AS names
FROM k LEFT JOIN (SELECT id, string_agg(x, '|' ORDER BY length(k) DESC, x) AS names FROM n GROUP BY 1) c ON k.id = c.id""")
def alias_scores(spark, sf):
    xs, ys = F.array("product_name", "raw", F.concat(F.lit(" "), "manager")), F.array("manager", F.concat("product_name", F.lit("增强")), F.lit("x"))
    return V.products(spark, sf).select("id", N.overlap_score(xs, ys).alias("score"), F.array_join(N.clean_aliases(xs), "|").alias("names"))


@query(f"""WITH {V.PRODUCTS_CTE}, h AS (SELECT id, regexp_replace(raw, '[^一-鿿]', '', 'g') AS han, raw || ' Alpha-1 x B_2&c' AS t FROM products)
SELECT id, array_to_string(list_transform(range(1, length(han)), lambda i: substr(han, i, 2)), '|') AS pairs, array_to_string(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_&.\\-]+'), '|') AS latin FROM h""")
def name_terms(spark, sf):
    c = F.col("raw")
    return V.products(spark, sf).select("id", F.array_join(N.bigrams(c), "|").alias("pairs"), F.array_join(N.latin_words(F.concat(c, F.lit(" Alpha-1 x B_2&c"))), "|").alias("latin"))


_STAMPED = "(SELECT id, product_name AS title, manager || '-' || CASE WHEN id % 3 = 0 THEN '2024010' || (1 + id % 9) || '-10203' || id % 6 ELSE 'x' END || '.md' AS filename FROM products WHERE product_name <> '')"


@query(f"""WITH {V.PRODUCTS_CTE}, r AS (SELECT *, {sql_key('title')} AS tk, {sql_key('filename')} AS fk FROM {_STAMPED}),
s AS (SELECT id, title, filename, CASE WHEN tk = '市场中性明汯' THEN 1000 WHEN contains(tk, '市场中性明汯') THEN 700 WHEN contains(fk, '市场中性明汯') THEN 500 ELSE 0 END + CASE WHEN contains(tk, '市场中性') OR contains(fk, '市场中性') THEN 80 ELSE 0 END + CASE WHEN contains(tk, '明汯') OR contains(fk, '明汯') THEN 80 ELSE 0 END AS score,
  try_strptime(regexp_extract(filename, '(\\d{{8}}-\\d{{6}})', 1), '%Y%m%d-%H%M%S') AS stamp FROM r)
SELECT id, score, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS stamp FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, stamp DESC NULLS LAST, filename, id LIMIT 20)""")
def report_search(spark, sf):
    t = V.products(spark, sf).where("product_name <> ''").selectExpr("id", "product_name AS title", "manager || '-' || CASE WHEN id % 3 = 0 THEN '2024010' || (1 + id % 9) || '-10203' || id % 6 ELSE 'x' END || '.md' AS filename")
    return K.found_reports(t, "市场中性 明汯", 20).select("id", "score", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
