"""The knowledge base: merging fragments, relations, health checks, review queue, manifests, report rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.names import fold_key, identity_key, manager_alias_key, match_key, product_alias_key, stable_id, text_key
from tessera.functions.scalar import mapped
from tessera.operators.joins import dealt, every_pair, first_override

SEVERITY = ["ok", "info", "warning", "high", "error"]
CONFIDENCE = ["low", "medium", "high"]


def rank_of(c: Column, order: list[str]) -> Column:
    """Place in a list, 0 for what isn't in it."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]), c), F.lit(0))


def lower_confidence(a: Column, b: Column) -> Column:
    return F.when(rank_of(a, CONFIDENCE) <= rank_of(b, CONFIDENCE), a).otherwise(b)


def ordered_distinct(c: Column, key=lambda x: x) -> Column:
    """The first of array elements with the same key, in order."""
    kept = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("v"))
    step = lambda a, x: F.when(x.isNull() | (x == "") | F.array_contains(a["k"], key(x)), a).otherwise(F.struct(F.concat(a["k"], F.array(key(x))).alias("k"), F.concat(a["v"], F.array(x)).alias("v")))
    return F.aggregate(c, kept, step)["v"]


def merged_fragments(fragments: DataFrame, by: list[str], order: list[str], texts: list[str], lists: list[str], ranked: dict[str, list[str]] | None = None, most: int = 20) -> DataFrame:
    """One row a key: the first non-empty text, lists joined in order without repeats, ranked values at their lowest.

    Fragments are folded by an explicit order, so the result doesn't depend on partitions. Of a list's values only the first place is kept
    and of a key's values the first ``most``, before any list is made, so a key with very many fragments isn't one task's.
    """
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*order))).alias(c) for c in texts]
    aggs += [F.min(F.struct(rank_of(F.col(c), o).alias("r"), F.col(c).alias("v"))).alias(c) for c, o in (ranked or {}).items()]
    g = fragments.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("fragments"))
    columns = [c for c in g.columns if c != "fragments"]
    for c in lists:
        values = fragments.select(*by, F.struct(*order, F.col(c).alias("__v")).alias("__at"), F.posexplode(c).alias("__i", "__x")).where("__x <> ''")
        firsts = values.groupBy(*by, "__x").agg(F.min(F.struct("__at", "__i")).alias("__at"))
        firsts = firsts.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy("__at"))).where(F.col("__n") <= most)
        found = firsts.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__x"))), lambda x: x["__x"]).alias(c))
        g = g.join(found, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], "left").drop(*[f"__{b}" for b in by]).withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    for c in ranked or {}:
        g = g.withColumn(c, F.col(c)["v"])
    at = columns.index(next(iter(ranked), None)) if ranked else len(columns)
    return g.select(*columns[:at], *lists, *columns[at:], "fragments")


def attached(generic: DataFrame, real: DataFrame, by: list[str], rows: int = 20_000_000) -> DataFrame:
    """Generic fragments go to every real product of their manager and family; lists of both meet, so no key is one task's. Each task makes about ``rows``, up to 2,000 tasks."""
    rest = [c for c in generic.columns if c not in by]
    real = real.select(*by, F.col("canonical_key").alias("target_key"))
    n = lambda t, name: t.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias(name))
    made = n(generic, "g").join(n(real, "r"), by).agg(F.sum(F.col("g") * F.col("r"))).first()[0] or 0
    got = every_pair(generic.select(*by).distinct(), dealt(generic, by), dealt(real, by, 512), by, by, min(2_000, int(made // rows) + 1))
    return got.select(*by, *[F.col(f"l.{c}").alias(c) for c in rest], "r.target_key")


def relations(profiles: DataFrame, predicates: dict[str, str], of_manager: dict[str, str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """``subject, predicate, object, manager, product_name``: a row for each value of the listed columns, each once.

    ``predicates`` maps a column (text or list) to its predicate with the product as subject, ``of_manager``
    to one with the manager as subject; ``limits`` says how many values of a list count.
    """
    kinds = dict(profiles.dtypes)

    def pairs_of(column: str, predicate: str, subject: str) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(column)
        values = F.slice(values, 1, limits[column]) if limits and column in limits else values
        return F.transform(values, lambda x: F.struct(F.trim(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.trim(x).alias("object")))

    pairs = [pairs_of(c, p, "product_name") for c, p in predicates.items()] + [pairs_of(c, p, "manager") for c, p in (of_manager or {}).items()]
    t = profiles.select("product_name", "manager", F.explode(F.concat(*[F.coalesce(p, F.array().cast("array<struct<subject:string,predicate:string,object:string>>")) for p in pairs])).alias("r"))
    t = t.where("coalesce(r.subject, '') <> '' AND coalesce(r.object, '') <> ''")
    return t.select("r.subject", "r.predicate", "r.object", "manager", "product_name").distinct()


#: Severity, kind, what must hold for an issue, what it says; kind and severity may be expressions.
HEALTH_RULES = [
    ("'high'", "'missing_manager'", "coalesce(manager, '') = ''", "no manager"),
    ("'warning'", "'non_product_entity_profile'", "coalesce(entity_type, '') NOT IN ('', 'product')", "the entity is no product"),
    ("'warning'", "'low_entity_confidence'", "entity_confidence = 'low'", "low confidence"),
    ("'warning'", "CASE WHEN name_reason LIKE '%suspicious_short_name%' THEN 'profile_quality_short_name' WHEN coalesce(entity_type, '') NOT IN ('', 'product') THEN 'profile_quality_entity_review' ELSE 'profile_quality_warning' END", "coalesce(quality_status, '') NOT IN ('', 'confirmed')", "the name needs review"),
    ("IF(expected, 'info', 'warning')", "IF(expected, 'strategy_tag_rejected_expected', 'strategy_tag_rejected_conflict')", "size(rejected_tags) > 0", "tags were rejected"),
    ("IF(own_candidates, 'info', 'warning')", "IF(own_candidates, 'zm_cross_manager_candidates_normal', 'zm_cross_manager_candidates_suspicious')", "external_match_status = 'cross_manager_candidates_only'", "candidates of other managers only"),
    ("'warning'", "'missing_strategy_positioning'", "coalesce(positioning, '') = '' OR positioning LIKE '%材料未提及%'", "no positioning"),
    ("'warning'", "'missing_evidence_summary'", "size(evidence_summary) = 0", "no evidence"),
    ("'warning'", "'missing_sources'", "size(source_files) = 0 AND size(source_notes) = 0", "no sources"),
    ("'info'", "'missing_risk_points'", "size(risk_points) = 0", "no risk points"),
]
_HEALTH_COLUMNS = {c: "string" for c in ("entity_type", "entity_confidence", "quality_status", "name_reason", "external_match_status", "positioning", "canonical_name")} | {c: "array<string>" for c in ("rejected_tags", "direct_tags", "primary_tags", "secondary_tags", "product_lines", "rejected_candidates", "evidence_summary", "source_files", "source_notes", "risk_points")}


def health(profiles: DataFrame, rules: list[tuple[str, str, str, str]] = HEALTH_RULES) -> DataFrame:
    """A row for each broken rule of each profile, and a warning for each canonical name that several products of a manager share.

    A column that the profiles lack counts as empty.
    """
    t = profiles.withColumns({c: F.coalesce(F.col(c), F.array().cast(k)) if k != "string" else F.col(c) for c, k in _HEALTH_COLUMNS.items() if c in profiles.columns})
    t = t.withColumns({c: F.array().cast(k) if k != "string" else F.lit(None).cast(k) for c, k in _HEALTH_COLUMNS.items() if c not in profiles.columns})
    tagged = F.size(F.concat("direct_tags", "primary_tags", "secondary_tags", "product_lines")) > 0
    expected = (F.col("entity_type") == "product") & (F.coalesce("entity_confidence", F.lit("")) != "low") & tagged & F.coalesce("quality_status", F.lit("")).isin("", "confirmed")
    own = (F.col("__own") != "") & F.exists("rejected_candidates", lambda x: identity_key(F.trim(F.regexp_extract(x, r"manager=([^|]+)", 1))) == F.col("__own"))
    t = t.withColumn("__own", identity_key(F.col("manager"))).withColumns({"expected": F.coalesce(expected, F.lit(False)), "own_candidates": F.coalesce(own, F.lit(False))})
    found = F.array(*[F.when(F.expr(cond), F.struct(F.expr(sev).alias("severity"), F.expr(kind).alias("kind"), F.lit(text).alias("detail"))) for sev, kind, cond, text in rules])
    own = t.select("manager", "product_name", F.inline(F.filter(found, lambda x: x.isNotNull()))).select("manager", "product_name", "severity", "kind", "detail")
    named = t.select("manager", "product_name", F.coalesce(F.nullif("canonical_name", F.lit("")), "product_name").alias("canonical_name"))
    shared = named.groupBy("manager", "canonical_name").agg(F.sort_array(F.collect_set("product_name")).alias("names")).where("size(names) > 1")
    return own.unionByName(shared.select("manager", F.col("canonical_name").alias("product_name"), F.lit("warning").alias("severity"), F.lit("duplicate_canonical_product").alias("kind"), F.concat_ws(", ", F.slice("names", 1, 8)).alias("detail")))


def index_issues(notes: DataFrame, profiles: DataFrame, indexed: DataFrame) -> DataFrame:
    """High issues: managers (``manager``) with notes but no indexed profile, by identity; fewer indexed profiles than there are."""
    known = indexed.select(identity_key(F.col("manager")).alias("__k")).where("__k <> ''").distinct()
    n = notes.groupBy("manager").agg(F.count(F.lit(1)).alias("n")).withColumn("__k", identity_key(F.col("manager"))).join(known, "__k", "left_anti")
    a = n.select("manager", F.lit("high").alias("severity"), F.lit("source_notes_without_index_records").alias("kind"), F.concat("n", F.lit(" notes")).alias("detail"))
    both = profiles.agg(F.count(F.lit(1)).alias("p")).crossJoin(F.broadcast(indexed.agg(F.count(F.lit(1)).alias("i")))).where("i < p")  # one row each
    return a.unionByName(both.select(F.lit("").alias("manager"), F.lit("high").alias("severity"), F.lit("profile_index_record_mismatch").alias("kind"), F.concat("p", F.lit(" profiles, "), "i", F.lit(" indexed")).alias("detail")))


def manager_records(records: DataFrame, manager: str) -> DataFrame:
    """Records whose manager, product or manager's aliases hold a name."""
    key = fold_key(F.lit(manager))
    text = F.concat_ws(" ", F.coalesce("manager", F.lit("")), F.coalesce("product_name", F.lit("")), F.concat_ws(" ", "manager_aliases")) if "manager_aliases" in records.columns else F.concat_ws(" ", F.coalesce("manager", F.lit("")), F.coalesce("product_name", F.lit("")))
    return records.where((key != "") & fold_key(text).contains(key))


def manager_quality(records: DataFrame, most: int = 20) -> DataFrame:
    """One row a manager: how many profiles, canonical names, unconfirmed ones and shared canonical names, with the first names of unconfirmed ones."""
    t = records.withColumns({"__c": F.trim(F.coalesce(F.nullif("canonical_name", F.lit("")), "product_name", F.lit(""))), "__bad": F.coalesce(F.nullif("quality_status", F.lit("")), F.lit("confirmed")) != "confirmed"})
    by_name = t.groupBy("manager", "__c").agg(F.count(F.lit(1)).alias("n"), F.count_if("__bad").alias("bad"), F.slice(F.sort_array(F.collect_list(F.when(F.col("__bad"), F.col("product_name")))), 1, most).alias("names"))
    g = by_name.groupBy("manager").agg(
        F.sum("n").alias("profiles"), F.count(F.lit(1)).alias("canonical_products"), F.sum("bad").alias("unconfirmed"), F.count_if((F.col("__c") != "") & (F.col("n") > 1)).alias("duplicate_groups"),
        F.slice(F.sort_array(F.flatten(F.collect_list("names"))), 1, most).alias("suspicious"),
    )
    return g.withColumn("status", F.when((F.col("unconfirmed") > 0) | (F.col("duplicate_groups") > 0), "warning").otherwise("ok"))


def status_of(issues: DataFrame) -> DataFrame:
    """``error`` if an issue is high or an error, ``warning`` if one is a warning, else ``ok``."""
    worst = F.max(rank_of(F.col("severity"), SEVERITY))
    return issues.agg(F.when(worst >= 3, "error").when(worst == 2, "warning").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("issues"))


def review_queue(issues: DataFrame, old: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """High issues and warnings as review items: an id from what they are about, the creation time of an old item, the first override that fits; suppressed ones go.

    The order of a queue is :func:`in_review_order`.
    """
    new = issues.where(F.col("severity").isin("high", "warning")).withColumn("item_id", stable_id(F.col("kind"), F.col("manager"), F.col("product_name"))).dropDuplicates(["item_id"])
    t = new.join(old.select("item_id", F.col("created_at").alias("__made"), F.col("status").alias("__was")), "item_id", "left")
    t = t.withColumns({"created_at": F.coalesce("__made", now), "updated_at": now, "status": F.coalesce("__was", F.lit("open"))}).drop("__made", "__was")
    o = overrides.withColumnRenamed("status", "__set")
    t = first_override(t, o, ["kind", "manager", "product_name"], "priority", ["item_id"])
    return t.withColumn("status", F.coalesce("__set", "status")).where("status <> 'suppressed'").drop("__set", "priority")


def in_review_order(items: DataFrame, n: int | None = None) -> DataFrame:
    """The worst first, then by manager, product and kind; the first ``n``, if given."""
    t = items.orderBy(F.desc(rank_of(F.col("severity"), SEVERITY)), "manager", "product_name", "kind")
    return t if n is None else t.limit(n)


def latest_items(items: DataFrame, at: str, n: int = 20) -> DataFrame:
    """The last ``n`` by a time column, the newest first."""
    return items.orderBy(F.desc_nulls_last(at), *[c for c in ("item_id", "path") if c in items.columns]).limit(n)


def deduction_score(items: DataFrame, by: str) -> DataFrame:
    """100 less the points of items that aren't met (``by, item, points, veto, met``); 0 if a veto item is known to be broken.

    A missing answer costs an ordinary item's points and leaves a veto item standing.
    """
    lost = F.when(~F.col("veto") & ~F.coalesce("met", F.lit(False)), F.col("points")).otherwise(0)
    broken = F.col("veto") & ~F.coalesce("met", F.lit(True))
    g = items.groupBy(by).agg(F.sum(lost).alias("deducted"), F.max(broken).alias("vetoed"), F.sort_array(F.collect_list(F.when(~F.col("veto") & F.col("met").isNull(), F.col("item")))).alias("to_ask"))
    return g.select(by, F.when(F.col("vetoed"), 0).otherwise(F.greatest(F.lit(0), 100 - F.col("deducted"))).alias("score"), "vetoed", "to_ask")


def latest(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in a log."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def counter_top(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The most frequent values; of those as frequent the one seen first."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen", value).limit(n)


def candidate_matches(left: DataFrame, candidates: DataFrame) -> DataFrame:
    """Products (``product_name, manager``, lists ``product_aliases, manager_aliases``) with candidates of their manager, and scores.

    A manager counts 4 if a key is equal, 2 if one key begins with the other; products add 4 for an equal key, 2 if one
    contains the other. Managers meet by equality of a key and a prefix, so no product meets candidates of others.
    ``candidates``: ``candidate_id, candidate_name, candidate_manager``, list ``candidate_aliases``.
    """
    none = F.array().cast("array<string>")
    keys = lambda key, *cs: F.filter(F.array_distinct(F.transform(F.filter(F.concat(*cs), lambda x: x.isNotNull()), key)), lambda x: x != "")
    optional = lambda df, c: F.coalesce(F.col(c), none) if c in df.columns else none
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n))
    a = left.select("product_name", "manager", keys(product_alias_key, F.array("product_name"), optional(left, "product_aliases")).alias("__p"), F.explode(keys(manager_alias_key, F.array("manager"), optional(left, "manager_aliases"))).alias("__m"))
    b = candidates.select("candidate_id", "candidate_name", keys(product_alias_key, F.array("candidate_name"), optional(candidates, "candidate_aliases")).alias("__c"), manager_alias_key(F.col("candidate_manager")).alias("__cm")).where("__cm <> ''")
    forward = a.join(b.withColumn("__m", F.explode(prefixes(F.col("__cm")))), "__m").withColumn("__s", F.when(F.col("__m") == F.col("__cm"), 4).otherwise(2))
    back = a.withColumn("__cm", F.explode(prefixes(F.col("__m")))).where("__cm <> __m").join(b, "__cm").withColumn("__s", F.lit(2))
    p, c = F.col("__p"), F.col("__c")
    inside = F.exists(p, lambda x: F.exists(c, lambda y: x.contains(y) | y.contains(x)))
    both = forward.select("product_name", "manager", "candidate_id", "candidate_name", "__p", "__c", "__s").unionByName(back.select("product_name", "manager", "candidate_id", "candidate_name", "__p", "__c", "__s"))
    scored = both.withColumn("score", F.col("__s") + F.when(F.arrays_overlap(p, c), 4).when(inside, 2).otherwise(0))
    return scored.groupBy("product_name", "manager", "candidate_id", "candidate_name").agg(F.max("score").alias("score"))


def first_alike(candidates: DataFrame, n: int) -> DataFrame:
    """Of candidates with the same name, manager and aliases the first ``n`` by id: they score alike, so no other is among the best ``n`` of a product."""
    alike = [c for c in ("candidate_name", "candidate_manager", "candidate_aliases") if c in candidates.columns]
    return candidates.withColumn("__n", F.row_number().over(W.partitionBy(*alike).orderBy("candidate_id"))).where(F.col("__n") <= n).drop("__n")


def best_candidates(matches: DataFrame, n: int = 1) -> DataFrame:
    """The best ``n`` of each product: by score, then the shorter name, then id."""
    w = W.partitionBy("product_name", "manager").orderBy(F.desc("score"), F.length(product_alias_key(F.col("candidate_name"))), "candidate_id", "candidate_name")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


#: Marks of a legal name, the fullest first.
LEGAL_NAMES = ["私募基金管理有限公司", "证券投资基金管理有限公司", "基金管理有限公司", "资产管理有限公司", "投资管理有限公司", "投资有限公司", "有限公司"]


def chosen_folder(matches: DataFrame, by: list[str], lead: int = 10) -> DataFrame:
    """One folder (``name, code, score``) a key: the best, if it stands alone or leads the next by ``lead``.

    Else, if all within ``lead`` of the best share one code, of these the one with the fullest legal name, then
    score and length; else none, as the choice isn't clear.
    """
    w = W.partitionBy(*by)
    bare = F.regexp_replace("name", r"^\d{4,}[_\-\s]*", "")
    legal = F.coalesce(*[F.when(bare.contains(x), len(LEGAL_NAMES) - i) for i, x in enumerate(LEGAL_NAMES)], F.lit(0))
    t = matches.withColumns({"__n": F.row_number().over(w.orderBy(F.desc("score"), "name")), "__next": F.lead("score").over(w.orderBy(F.desc("score"), "name")), "__top": F.max("score").over(w)})
    t = t.withColumn("__close", F.col("__top") - F.col("score") <= lead)
    squeezed = F.regexp_replace(bare, r"\s+", "")
    t = t.withColumns({
        "__codes": F.size(F.collect_set(F.when(F.col("__close") & (F.col("code") != ""), F.col("code"))).over(w)),
        "__like": F.row_number().over(w.orderBy(F.desc("__close"), F.desc(legal), F.desc("score"), F.desc(F.length(squeezed)), F.desc(squeezed))),
        "__sure": F.max(F.when(F.col("__n") == 1, F.col("__next").isNull() | (F.col("score") >= F.col("__next") + lead))).over(w),
    })
    chosen = F.when(F.col("__sure"), F.col("__n") == 1).otherwise((F.col("__codes") == 1) & (F.col("__like") == 1))
    return t.where(chosen).select(*matches.columns)


def folder_key(c: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def folder_score(folder: Column, query: Column) -> Column:
    """Added up: 100 for equal names, 90 for one that ends in the query after a dash or underscore, 70 for one that contains it, and up to 20 for shared characters."""
    a, b = folder_key(folder), folder_key(query)
    chars = F.array_distinct(F.filter(F.split(b, ""), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    shared = F.size(F.filter(chars, lambda x: a.contains(x)))
    points = F.when(a == b, 100).otherwise(0) + F.when(a.endswith(F.concat(F.lit("_"), b)) | a.endswith(F.concat(F.lit("-"), b)), 90).otherwise(0) + F.when(a.contains(b), 70).otherwise(0)
    return F.when(b == "", 0).otherwise(points + F.floor(20 * F.coalesce(F.try_divide(shared, F.size(chars)), F.lit(0.0))).cast("int"))


def folder_code(c: Column) -> Column:
    """The leading number of a folder's name."""
    return F.regexp_extract(F.trim(c), r"^(\d{4,})[_\-\s]", 1)


#: States of evidence, the one that wins first; what else stands for a state; what an unknown value counts as.
EVIDENCE_SOURCES = ["internal_due_diligence", "regulatory_public", "official_public", "manager_website", "third_party_public", "search_discovery_only"], {"internal": "internal_due_diligence", "regulatory": "regulatory_public", "official": "official_public", "website": "manager_website", "thirdparty": "third_party_public", "searchonly": "search_discovery_only"}, "internal_due_diligence"
EXTERNAL_STATUS = ["conflict", "external_only", "supported", "not_found", "not_checked"], {"unchecked": "not_checked", "verified": "supported", "searchonly": "external_only", "missing": "not_found", "conflicted": "conflict"}, "not_checked"
CONFLICT_STATUS = ["conflict", "partial_conflict", "none", "unknown"], {"noconflict": "none", "conflicted": "conflict"}, "none"


def state(c: Column, kind: tuple[list[str], dict[str, str], str]) -> Column:
    """The state that a value stands for, by its letters and digits."""
    order, others, default = kind
    return mapped(match_key(c), {text_key(x): x for x in order} | others, default)


def first_state(a: Column, b: Column, kind: tuple[list[str], dict[str, str], str]) -> Column:
    """Of two states the one that wins."""
    return F.when(rank_of(state(a, kind), kind[0]) <= rank_of(state(b, kind), kind[0]), state(a, kind)).otherwise(state(b, kind))


#: Phrases that don't belong into a report.
SPECULATION = ["可能是", "大概", "也许", "猜测", "推测认为", "估计是"]


def report_issues(reports: DataFrame, required: list[str], strict: bool = False) -> DataFrame:
    """``path, level, rule, detail`` of Markdown reports: missing sections, broken tables, wrong priorities and strengths, speculation."""
    text, lines = F.col("content"), F.split("content", "\n")
    missing = F.filter(F.array(*[F.lit(s) for s in required]), lambda s: ~text.contains(s))
    table_lines = F.filter(lines, lambda x: F.trim(x).startswith("|"))
    widths = F.array_distinct(F.transform(table_lines, lambda x: F.size(F.split(F.trim(x), r"(?<!\\)\|"))))
    open_rows = F.filter(table_lines, lambda x: ~F.trim(x).endswith("|"))
    priority = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(P\d)\b"), F.lit(1))), lambda p: ~p.isin("P1", "P2"))
    strength = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"证据强度[:：]\s*([^\s|，。]+)"), F.lit(1))), lambda p: ~p.isin("高", "中", "低"))
    phrases = F.filter(F.array(*[F.lit(s) for s in SPECULATION]), lambda s: text.contains(s))
    soft = "error" if strict else "warning"
    rule = lambda cond, level, name, detail: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"), detail.alias("detail")))
    found = F.array(
        rule(F.size(missing) > 0, "error", "sections", F.array_join(missing, ", ")),
        rule(F.size(open_rows) > 0, "error", "table_breaks", F.try_element_at(open_rows, F.lit(1))),
        rule(F.size(widths) > 1, soft, "table_width", F.array_join(F.transform(widths, lambda n: n.cast("string")), ", ")),
        rule(F.size(priority) > 0, "error", "evidence_priority", F.array_join(priority, ", ")),
        rule(F.size(strength) > 0, soft, "evidence_strength", F.array_join(strength, ", ")),
        rule(F.size(phrases) > 0, soft, "speculation", F.array_join(phrases, ", ")),
        rule(text.contains("```"), soft, "code_block", F.lit("a code block")),
    )
    return reports.select("path", F.inline(F.filter(found, lambda x: x.isNotNull())))


def found_reports(reports: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Saved reports by score (1000 for the title, 700 or 500 if contained, 80 for each part), then by the time in the name."""
    key = fold_key(F.lit(query))
    title, name = fold_key("title"), fold_key("filename")
    parts = [p for p in query.replace("-", " ").replace("_", " ").split() if len(p) >= 2]
    per_part = sum((F.when(title.contains(fold_key(F.lit(p))) | name.contains(fold_key(F.lit(p))), 80).otherwise(0) for p in parts), F.lit(0))
    s = F.when(title == key, 1000).when(title.contains(key), 700).when(name.contains(key), 500).otherwise(0) + per_part
    stamp = F.try_to_timestamp(F.regexp_extract("filename", r"(\d{8}-\d{6})", 1), F.lit("yyyyMMdd-HHmmss"))
    return reports.withColumns({"score": s, "stamp": stamp}).where("score > 0").orderBy(F.desc("score"), F.desc_nulls_last("stamp"), "filename", *[c for c in ("id", "path") if c in reports.columns]).limit(limit)


def visible(matches: DataFrame, by: list[str], least: int = 30, most: int = 20) -> DataFrame:
    """Matches in order with ``shown``: the first of a group, and others of at least ``least``; at most ``most`` a group."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "name")
    t = matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return t.withColumn("shown", (F.col("place") == 1) | (F.col("score") >= least))


def run_status(counts: DataFrame) -> DataFrame:
    """``status`` of ingest runs from ``sources, profiles, indexed, failed, processed, skipped``: the first rule that holds."""
    c = F.col
    status = (
        F.when((c("sources") == 0) & (c("failed") > 0), "failed")
        .when(c("sources") == 0, "no_sources")
        .when(c("profiles") == 0, "no_profiles")
        .when(c("indexed") < c("profiles"), "index_incomplete")
        .when(c("failed") > 0, "partial")
        .when((c("processed") == 0) & (c("skipped") > 0), "unchanged")
        .otherwise("success")
    )
    return counts.withColumn("status", status)


def product_mentions(text: Column, most: int = 12) -> Column:
    """Names in a text that look like products: some Han characters or letters before a number and its counter, each once."""
    names = F.regexp_extract_all(text, F.lit(r"([一-鿿A-Za-z0-9]{2,16}?(?:\d+|[一二三四五六七八九十]+)(?:号|期))"), F.lit(1))
    return F.slice(F.array_distinct(names), 1, most)


def strategy_mentions(text: Column, names: list[str]) -> Column:
    """Strategies whose names a text holds, as links, in the order given."""
    return F.filter(F.array(*[F.when(F.lower(text).contains(n.lower()), F.lit(f"[[{n}]]")) for n in names]), lambda x: x.isNotNull())


def repeated_keys(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Keys with more than one row: ``rows`` and the number of distinct values."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("values")).where("rows > 1")


def listed_by(df: DataFrame, by: list[str], value: str, separator: str = "\n") -> DataFrame:
    """The values of each key in order, as one text."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias("listed"))


def sessions_of(df: DataFrame, by: str, at: str, order: str, gap_seconds: int) -> DataFrame:
    """``session``: a new number after each gap of more than so many seconds."""
    w = W.partitionBy(by).orderBy(at, order)
    time = F.col(at).cast("timestamp").cast("double")
    t = df.withColumn("__new", F.when(time - F.lag(time).over(w) <= gap_seconds, 0).otherwise(1))
    return t.withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
