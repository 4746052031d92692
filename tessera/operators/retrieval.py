"""Keyword search over product profiles: intent, scoring, ranking, roll-up by manager, packing.

A profile has ``product_name, manager``, tags, texts and quality columns;
:func:`with_defaults` fills those that are missing. A query's intent is
worked out on the driver (it is one short text) and becomes literals, so scoring
is one projection over the profiles; relations are joined by product only where
a condition needs them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.names import bigrams, fold_key, identity_key, manager_aliases, match_key, text_key
from tessera.functions.scalar import ellipsis
from tessera.operators.taxonomy import expanded_terms

# Fixed values.
KNOWN_TERMS = "中证2000 2000指增 2000增强 中证1000 1000指增 1000增强 中证500 500指增 500增强 沪深300 300指增 300增强 红利 指增 指数增强 量化指增 行业暴露 行业偏离 风格暴露 WorldQuant worldquant 世坤 Barra BARRA 市场中性 多元CTA 标准CTA 商品CTA 期权CTA 金融CTA 趋势CTA 基本面CTA CTA".split()
MANAGER_WORDS = "哪些管理人 有哪些管理人 哪些公司 有哪些公司 哪些私募 有哪些私募 哪些基金公司 有哪些基金公司 哪些投顾 有哪些投顾 哪几家".split()
OVERVIEW_WORDS = "策略体系 产品线 有哪些策略 哪些策略 有哪些产品线 概览 概况".split()
#: Any of the words, all of the words, label, what satisfies the condition.
CONDITIONS = [
    ("期货策略 管理期货", "", "管理期货", "管理期货 期货策略 商品期货 商品CTA 股指期货 股指CTA 量化CTA"),
    ("商品期货", "", "商品CTA", "商品期货 商品CTA 商品期货CTA"),
    ("股指期货", "", "股指CTA", "股指期货 股指CTA 股指期货CTA 金融CTA"),
    ("期权策略", "", "期权策略", "期权策略 期权CTA 期权波动率 期权套利"),
    ("指增 增强", "2000", "2000指增", "中证2000 2000指增 2000增强"),
    ("指增 增强", "1000", "1000指增", "中证1000 1000指增 1000增强"),
    ("指增 增强", "500", "500指增", "中证500 500指增 500增强"),
    ("指增 增强", "300", "300指增", "沪深300 300指增 300增强"),
    ("暴露 偏离", "行业", "行业暴露", "行业暴露 行业偏离 行业偏离≤±3% 行业偏离<=±3% 行业暴露3%以内"),
    ("3% 3％", "", "行业暴露3%以内", "行业偏离≤±3% 行业偏离<=±3% 行业偏离≤3% 行业暴露3%以内"),
    ("worldquant 世坤", "", "WorldQuant背景", "worldquant 世坤"),
]
RELATION_CONDITIONS = {"WorldQuant背景": "has_people_background", "行业暴露": "has_exposure_constraint", "行业暴露3%以内": "has_exposure_constraint"}
GENERIC_NAME = "系列|产品线|工具化|策略体系"
#: Tags that don't go together.
FUTURES_TAGS = "管理期货 商品CTA 股指CTA 趋势CTA 基本面CTA".split()
INDEX_TAGS = "指数增强 300指增 500指增 1000指增 2000指增".split()


@dataclass
class Intent:
    """What a query asks for."""

    query: str
    terms: list[str] = field(default_factory=list)
    conditions: list[tuple[str, list[str]]] = field(default_factory=list)
    manager: str | None = None
    product: str | None = None
    mode: str = "search"


def query_terms(query: str) -> list[str]:
    """Known terms, tags with their aliases, Latin words, and neighbouring Han characters; each once."""
    low = query.lower()
    air = "空气指增" in query
    out = [t for t in KNOWN_TERMS if t.lower() in low and not (t == "指增" and air and query.count("指增") == query.count("空气指增"))]
    out += expanded_terms(query)
    out += re.findall(r"[A-Za-z][A-Za-z0-9_&.\-]+", query)
    han = re.sub(r"[^一-鿿]", "", query)
    out += [a + b for a, b in zip(han, han[1:])]
    seen: dict[str, str] = {}
    for t in out:
        if t.strip():
            seen.setdefault(t.lower(), t)
    return list(seen.values())


def conditions_of(query: str) -> list[tuple[str, list[str]]]:
    low = query.lower()
    return [(label, names.split()) for any_of, all_of, label, names in CONDITIONS if any(w in low for w in any_of.split()) and all(w in low for w in all_of.split())]


def intent_of(profiles: DataFrame, query: str) -> Intent:
    """Terms and conditions, and the manager and product whose longest name the query contains."""
    names = profiles.select("manager").where("manager <> ''").distinct().select("manager", F.explode(manager_aliases(F.col("manager"))).alias("alias"))
    names = names.select(F.lit("manager").alias("kind"), fold_key("alias").alias("key"), F.length("alias").alias("size"), F.col("manager").alias("name")).where(F.length("key") >= 2)
    products = profiles.select(F.lit("product").alias("kind"), match_key(F.col("product_name")).alias("key"), F.col("product_name").alias("name")).where(F.length("key") >= 3)
    return asked(query, names.unionByName(products.withColumn("size", F.length("key"))))


def asked(query: str, names: DataFrame) -> Intent:
    """Intent of a query by a table of names: ``kind, key, size, name``."""
    got = Intent(query, query_terms(query), conditions_of(query))
    best = names.where(F.lit(text_key(query)).contains(F.col("key"))).groupBy("kind").agg(F.min(F.struct(-F.col("size"), F.col("name"))).alias("x")).select("kind", "x.name")
    found = {r["kind"]: r["name"] for r in best.collect()}
    got.manager, got.product = found.get("manager"), found.get("product")
    lists = any(w in query for w in MANAGER_WORDS)
    got.mode = "manager_filter" if lists and not got.manager and not got.product else "single_product" if got.product else "manager_overview" if got.manager and any(w in query for w in OVERVIEW_WORDS) else "manager" if got.manager else "search"
    return got


#: What a term found in the text is worth by the words in it; the first that fits counts, other terms are worth 1.5.
TEXT_WEIGHTS = [(5.0, ["worldquant", "世坤"], True), (3.0, ["cta", "2000", "1000", "500", "300", "指增", "指数增强"], False), (2.5, ["行业", "暴露", "偏离"], False)]


def text_weight(term: str) -> float:
    low = term.lower()
    return next((w for w, words, whole in TEXT_WEIGHTS if (low in words if whole else any(x in low for x in words))), 1.5)


def is_generic(name: Column) -> Column:
    """Whether a name stands for a line of products: by its words, or by its end if it has no number."""
    n = F.trim(F.coalesce(name, F.lit("")))
    unnumbered = ~n.contains("号")
    return (n == "") | n.rlike(GENERIC_NAME) | unnumbered & (n.endswith("产品") | match_key(n).endswith("cta"))


def quality_penalty() -> Column:
    """What weak names, entities and confidence cost."""
    s, c = F.coalesce("quality_status", F.lit("confirmed")), F.col("entity_confidence")
    weak = F.col("name_reason").isin("pure_strategy_name", "strategy_product_line", "manager_strategy_line", "generic_product_tail")
    zero = F.lit(0.0)
    return (
        F.when(s == "weak_line", 6.0).when(s == "needs_review", 4.0).when(s.isin("confirmed", ""), 0.0).otherwise(3.0)
        + F.when(F.col("entity_type").isin("product", ""), 0.0).otherwise(F.when(F.col("entity_type").isNull(), 0.0).otherwise(5.0))
        + F.when(c == "medium", 1.5).when(c == "low", 3.0).otherwise(zero)
        + F.when(weak, 2.0).otherwise(zero)
        + F.when(is_generic(F.col("product_name")), 2.0).otherwise(zero)
    )


def review_flags(by_tag: Column) -> Column:
    """What in a result needs review; ``by_tag`` says whether a tag matched."""
    keys = F.transform(F.concat("primary_tags", "secondary_tags"), match_key)
    any_of = lambda tags: F.arrays_overlap(keys, F.array(*[F.lit(text_key(x)) for x in tags]))
    mixed = any_of(FUTURES_TAGS) & any_of(INDEX_TAGS)
    flags = [(is_generic(F.col("product_name")), "generic_product_name"), (~F.coalesce("quality_status", F.lit("")).isin("", "confirmed"), "profile_quality_review_needed"), (~by_tag, "weak_text_match"), (mixed, "mixed_strategy_tags"), (mixed, "tag_conflict_review_needed")]
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in flags]), lambda x: x.isNotNull())


#: What words are looked for in: keys and lower-case texts.
FIELDS = ["__product", "__manager", "__tags", "__text", "__rel", "__tagkey", "__textkey", "__relkey"]


def with_fields(profiles: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Profiles with the fields that are searched, worked out once; relations are joined by product."""
    t = profiles
    if relations is not None:
        text = F.concat_ws("\n", F.collect_list(F.concat_ws(" ", "subject", "predicate", "object", F.concat_ws(" ", "evidence"))))
        t = t.join(relations.groupBy("product_name").agg(text.alias("__rel")), "product_name", "left")
    else:
        t = t.withColumn("__rel", F.lit(""))
    t = t.withColumns({
        "__product": match_key(F.col("product_name")),
        "__manager": match_key(F.col("manager")),
        "__tags": F.lower(F.concat_ws("\n", F.concat_ws(" ", "primary_tags"), F.concat_ws(" ", "secondary_tags"))),
        "__text": F.lower(F.concat_ws("\n", "product_name", "manager", F.concat_ws(" ", "primary_tags"), F.concat_ws(" ", "secondary_tags"), F.concat_ws(" ", "evidence"), "profile_text", "search_text")),
        "__rel": F.lower(F.coalesce("__rel", F.lit(""))),
    })
    return t.withColumns({"__tagkey": match_key(F.col("__tags")), "__textkey": match_key(F.col("__text")), "__relkey": match_key(F.col("__rel"))})


def base_score() -> Column:
    """The part of a score that doesn't hang on the query."""
    return F.least(F.size("evidence"), F.lit(3)) * 0.25 - quality_penalty()


def boost(intent: Intent) -> float:
    return 3.0 if intent.mode in ("manager_overview", "single_product") else 0.0


def scored(profiles: DataFrame, intent: Intent, relations: DataFrame | None = None) -> DataFrame:
    """Profiles with a signal, with ``score, matched, missing, satisfied, review_flags``.

    Per term the first field that contains it counts: product, manager, tags, text,
    relations. Conditions add 5.5 (tags or relations) or 4 (text), or cost 2.5.
    """
    t = profiles if relations is None and "__relkey" in profiles.columns else with_fields(profiles.drop(*FIELDS), relations)
    score, matched = F.lit(0.0), []
    if intent.manager:
        t = t.where(identity_key(F.col("manager")) == identity_key(F.lit(intent.manager)))
        score, matched = score + 20.0, [F.lit(f"manager={intent.manager}")]
    if intent.product:
        t = t.where(F.col("__product").contains(text_key(intent.product)))
        score, matched = score + 15.0, [*matched, F.lit(f"product={intent.product}")]

    def literal(rows: list[tuple], kind: str) -> Column:
        return F.from_json(F.lit(json.dumps([dict(zip(("name", "key", "low", "weight", "keys"), r)) for r in rows], ensure_ascii=False)), f"array<struct<{kind}>>")

    # terms and conditions are arrays, folded within the row, so the plan doesn't grow with the query
    terms = literal([(t, text_key(t), t.lower(), text_weight(t)) for t in intent.terms if text_key(t)], "name:string,key:string,low:string,weight:double")
    has = lambda c, x: F.col(c).contains(x)
    weight = lambda x: F.when(has("__product", x["key"]), 8.0).when(has("__manager", x["key"]), 6.0).when(has("__tags", x["low"]), 4.5).when(has("__text", x["low"]), x["weight"]).when(has("__rel", x["low"]), 4.5)
    t = t.withColumn("__hits", F.filter(F.transform(terms, lambda x: F.struct(x["name"].alias("name"), weight(x).alias("w"), (~has("__product", x["key"]) & ~has("__manager", x["key"]) & has("__tags", x["low"])).alias("tag"))), lambda x: x["w"].isNotNull()))
    inside = lambda c, x: F.exists(x["keys"], lambda k: has(c, k))
    worth = lambda x: F.when(inside("__tagkey", x) | inside("__relkey", x), 5.5).when(inside("__textkey", x), 4.0).otherwise(-2.5)
    asked = literal([(label, "", "", 0.0, [text_key(n) for n in names]) for label, names in intent.conditions], "name:string,keys:array<string>")
    t = t.withColumn("__met", F.transform(asked, lambda x: F.struct(x["name"].alias("name"), worth(x).alias("w"))))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"])
    score = score + add(F.col("__hits")) + add(F.col("__met"))
    named = lambda c, cond: F.transform(F.filter(c, cond), lambda x: x["name"])
    met = named(F.col("__met"), lambda x: x["w"] > 0)
    hit_any = F.lit(True) if not intent.conditions or intent.manager or intent.product else F.size(met) > 0
    static = F.array(*matched) if matched else F.array().cast("array<string>")
    t = t.withColumns({"matched": F.array_distinct(F.concat(static, F.transform("__hits", lambda x: x["name"]), met)), "missing": F.array_distinct(named(F.col("__met"), lambda x: x["w"] < 0)), "__any": hit_any})
    t = t.where(F.col("__any") & (F.size("matched") > 0))
    total = score + boost(intent) + base_score()
    wanted = bool(intent.conditions or intent.manager or intent.product)
    by_tag = F.exists("__hits", lambda x: x["tag"]) | F.exists("__met", lambda x: x["w"] == 5.5)
    t = t.withColumn("review_flags", review_flags(by_tag))
    t = t.withColumns({"score": total, "satisfied": F.when(F.lit(wanted), F.when(F.size("missing") == 0, "satisfied").otherwise("unsatisfied")).otherwise("not_applicable")})
    return t.where("score > 0").drop(*FIELDS, "__any", "__hits", "__met")


def ranked(results: DataFrame, limit: int) -> DataFrame:
    """The best results in order: score, quality, entity, generic names last, name."""
    return results.orderBy(F.col("score").desc(), F.col("quality_status") != "confirmed", F.col("entity_type") != "product", is_generic(F.col("product_name")), "product_name").limit(limit)


def by_manager(results: DataFrame, limit: int) -> DataFrame:
    """Managers of the results: best score plus 1.5 for up to six products and 0.5 for each with sure tags."""
    weak = F.array_contains("review_flags", "weak_text_match")
    sure = (F.col("tag_confidence") == "high") | (F.col("tag_review_status") == "confirmed")
    rank = F.when(F.col("tag_confidence") == "high", 0).when(F.col("tag_confidence") == "medium", 1).when(F.col("tag_confidence") == "low", 2).otherwise(3)
    mixed = F.array_contains("review_flags", "tag_conflict_review_needed")
    t = results.where("manager <> ''").withColumn("manager_key", identity_key(F.col("manager")))
    order = F.struct(is_generic(F.col("product_name")).alias("a"), (F.col("quality_status") != "confirmed").alias("b"), rank.alias("c"), (-F.col("score")).alias("d"), F.length(match_key(F.col("product_name"))).alias("e"), "product_name")
    g = t.groupBy("manager_key").agg(
        F.max_by("manager", F.struct(F.length("manager"), "manager")).alias("manager"),
        F.max("score").alias("best"),
        F.count(F.lit(1)).alias("matched_products"),
        F.count_if(sure).alias("sure"),
        F.max(mixed).alias("mixed"),
        F.max(weak).alias("weak"),
        F.slice(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["product_name"]), 1, 3).alias("representative_products"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.concat("primary_tags", "secondary_tags"))))).alias("matched_tags"),
    )
    score = F.col("best") + F.least("matched_products", F.lit(6)) * 1.5 + F.col("sure") * 0.5 - F.when(F.col("mixed"), 2.0).otherwise(0.0) - F.when(F.col("weak") & (F.col("matched_products") == 1), 1.0).otherwise(0.0)
    conf = F.when(F.col("mixed"), "review_needed").when((F.col("matched_products") >= 2) | (F.col("sure") > 0), "high").otherwise("medium")
    return g.select("manager", score.alias("score"), "matched_products", "representative_products", "matched_tags", conf.alias("confidence")).orderBy(F.col("score").desc(), F.col("matched_products").desc(), "manager").limit(limit)


def packed(results: DataFrame, budget: int = 8_000, per_result: int = 900) -> DataFrame:
    """Of ranked results (column ``rank``), those whose texts fit a budget of characters.

    Greedy in order: a result that doesn't fit is left out and later ones are still
    tried; the first is cut to half the budget rather than left out. Works on a
    page of results, as ranking has a limit.
    """
    half = per_result // 2
    t = results.withColumns({"__p": ellipsis(F.coalesce("profile_text", F.lit("")), half), "__e": ellipsis(F.concat_ws("\n", "evidence"), half)})
    t = t.withColumn("__n", F.length("__p") + F.length("__e"))
    page = F.sort_array(F.collect_list(F.struct("rank", F.col("__n").alias("n"))).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    first = F.lit(max(budget // 2, 120))

    def step(a: Column, x: Column) -> Column:
        empty = F.size(a["kept"]) == 0
        n = F.when(empty & (x["n"] > budget), F.least(x["n"], first * 2)).otherwise(x["n"])
        take = empty | (a["used"] + x["n"] <= budget)
        return F.when(take, F.struct((a["used"] + n).alias("used"), F.concat(a["kept"], F.array(x["rank"])).alias("kept"))).otherwise(a)

    kept = F.aggregate(page, F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept")), step)["kept"]
    whole = t.withColumn("__kept", kept).where(F.array_contains("__kept", F.col("rank"))).drop("__kept")
    cut = (F.col("rank") == 1) & (F.col("__n") > budget)
    short = lambda c: F.when(cut, ellipsis(F.col(c), max(budget // 2, 120))).otherwise(F.col(c))
    return whole.withColumns({"packed_profile": short("__p"), "packed_evidence": short("__e")}).withColumn("context_chars", F.length("packed_profile") + F.length("packed_evidence")).drop("__p", "__e", "__n")


def search(profiles: DataFrame, query: str, limit: int = 10, relations: DataFrame | None = None, budget: int = 8_000, index=None) -> DataFrame:
    """Ranked, packed results of a query; relations are read only if a condition asks for them.

    With an ``index`` of the profiles (``postings.Index``) only profiles are scored that can be among the results.
    """
    intent = index.intent(query) if index else intent_of(profiles, query)
    needed = {RELATION_CONDITIONS[c] for c, _ in intent.conditions if c in RELATION_CONDITIONS}
    rel = relations.where(F.col("predicate").isin(sorted(needed) + ["has_strategy", "has_product_line"])) if relations is not None and needed else None
    top = ranked(scored(index.candidates(intent, limit, rel) if index else profiles, intent, rel), limit)
    nth = F.row_number().over(W.orderBy(F.col("score").desc(), F.col("quality_status") != "confirmed", F.col("entity_type") != "product", is_generic(F.col("product_name")), "product_name"))
    return packed(top.withColumn("rank", nth), budget)


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Profiles with every column that search needs."""
    strings = {"profile_text": "", "search_text": "", "entity_type": "product", "entity_confidence": "high", "quality_status": "confirmed", "name_reason": "", "tag_confidence": "low", "tag_review_status": "needs_review", "path": ""}
    t = profiles
    for c, v in strings.items():
        t = t.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in t.columns else F.lit(v))
    for c in ("primary_tags", "secondary_tags", "evidence"):
        empty = F.array().cast("array<string>")
        t = t.withColumn(c, F.coalesce(F.col(c), empty) if c in t.columns else empty)
    return t


def bigram_index(profiles: DataFrame) -> DataFrame:
    """Inverted index: each Han bigram of a profile's text with its product."""
    return profiles.select("product_name", F.explode(F.array_distinct(bigrams(F.col("profile_text")))).alias("term"))


def index_candidates(profiles: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """Profiles that share a Han pair with the query by an inverted index (:func:`bigram_index`): what a search need look at, if it has any."""
    han = re.sub(r"[^一-鿿]", "", query)
    pairs = sorted({a + b for a, b in zip(han, han[1:])})
    return profiles.join(index.where(F.col("term").isin(pairs)).select("product_name").distinct(), "product_name", "left_semi") if pairs else profiles
