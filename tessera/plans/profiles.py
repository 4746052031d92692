"""Building the knowledge base: notes to fragments, profiles, relations and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.names import analyzed, fold_key, manager_aliases, wikilink
from tessera.operators import enrichment as X
from tessera.operators import knowledge as K
from tessera.operators.taxonomy import classified
from tessera.operators.text import embedded_json, frontmatter, lines_with, section, table_rows
from tessera.session import stored

PRODUCTS = "array<struct<name:string,main_strategies:array<string>,sub_strategies:array<string>,entity_type:string,confidence:string,evidence_quote:string,manager_name:string>>"
MARK = "SYSTEM_MENTIONED_PRODUCTS"
PREDICATES = {
    "manager": "belongs_to_manager", "product_aliases": "has_product_alias", "mentioned_tags": "mentions_strategy_tag", "rejected_tags": "rejects_strategy_tag", "risk_points": "has_risk_point", "source_files": "has_source_file", "canonical_name": "has_canonical_product_name", "primary_tag": "has_primary_strategy", "secondary_tags": "has_secondary_strategy", "candidate_tags": "has_candidate_strategy",
    "direct_tags": "has_direct_strategy_tag", "strategies": "has_strategy", "product_lines": "has_product_line", "facet_values": "has_strategy_facet", "backgrounds": "has_people_background",
    "constraints": "has_exposure_constraint", "source_notes": "has_source_note",
}
MANAGER_PREDICATES = {"product_name": "has_product", "manager_aliases": "has_manager_alias", "backgrounds": "has_people_background"}
#: Words that mark a risk.
RISK_WORDS = ["风险", "回撤", "亏损", "波动"]
#: Keywords that mark evidence.
EVIDENCE_WORDS = ["策略", "收益", "回撤", "风控", "持仓", "因子", "模型"]


def yaml_list(head: Column, key: str) -> Column:
    """A list of a YAML head, in flow or block style; plain values only. Empty if the key is absent."""
    flow = F.regexp_extract(head, rf"(?m)^{key}:\s*\[(.*?)\]", 1)
    block = F.regexp_extract(F.concat(F.lit("\n"), head, F.lit("\n")), rf"\n{key}:\s*\n((?:\s*- .*\n)+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).when(block != "", F.split(F.regexp_replace(F.trim(block), r"(?m)^\s*- ", ""), "\n")).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: wikilink(x)), lambda x: x != "")


def yaml_value(head: Column, key: str) -> Column:
    got = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(\S.*)$", 1)
    return F.when(got != "", wikilink(got))


def notes(files: DataFrame) -> DataFrame:
    """``path, content`` of Markdown notes with their head's fields; a head that can't be read gives nulls."""
    head = frontmatter(F.col("content"))
    return files.withColumns({"head": head}).withColumns({
        "entity_type": yaml_value(F.col("head"), "entity_type"), "primary_entity": yaml_value(F.col("head"), "primary_entity"), "manager": yaml_value(F.col("head"), "manager"),
        "mentioned": yaml_list(F.coalesce("head", F.lit("")), "mentioned_products_simple"), "main_strategies": yaml_list(F.coalesce("head", F.lit("")), "main_strategies"),
        "products": embedded_json(F.col("content"), MARK, PRODUCTS),
    })


def fragments(parsed: DataFrame) -> DataFrame:
    """A row for each product of each note: from the embedded list, else the head's; the primary entity first."""
    listed = F.transform("products", lambda p: F.struct(wikilink(p["name"]).alias("name"), p["confidence"].alias("confidence"), p["main_strategies"].alias("strategies"), p["evidence_quote"].alias("quote")))
    plain = lambda xs: F.transform(xs, lambda n: F.struct(n.alias("name"), F.lit("medium").alias("confidence"), F.col("main_strategies").alias("strategies"), F.lit(None).cast("string").alias("quote")))
    own = F.when(F.col("entity_type") == "product", plain(F.array("primary_entity"))).otherwise(plain(F.array().cast("array<string>")))
    rest = F.when(F.size("products") > 0, listed).otherwise(plain(F.col("mentioned")))
    t = parsed.select("path", "manager", F.col("content").alias("__c"), "main_strategies", F.posexplode(F.concat(own, rest)).alias("ordinal", "p"))
    t = t.where("p.name IS NOT NULL AND p.name <> ''").select("path", "manager", "ordinal", F.col("p.name").alias("product_name"), F.col("p.confidence").alias("confidence"), F.coalesce("p.strategies", F.array().cast("array<string>")).alias("strategies"), F.col("p.quote").alias("quote"), "__c")
    return t.withColumn("evidence", F.filter(F.concat(F.array("quote"), lines_with(F.col("__c"), EVIDENCE_WORDS, 5)), lambda x: x.isNotNull())).drop("__c", "quote")


def compiled(rows: DataFrame) -> DataFrame:
    """One profile a canonical key; fragments with generic names also go to the real products of their manager and family."""
    a = stored(analyzed(rows), "named")
    generic, real = a.where("is_generic"), a.where("NOT is_generic")
    spread = generic.select("manager", "family", "path", "ordinal", "strategies", "evidence").join(real.select("manager", "family", "canonical_key", "canonical_name", "product_name", "quality_status", "name_reason", "entity_type", "entity_confidence").dropDuplicates(["manager", "canonical_key"]), ["manager", "family"])
    spread = spread.withColumn("confidence", F.lit("low"))
    together = a.withColumn("own", F.lit(0)).unionByName(spread.where("family <> ''").withColumn("own", F.lit(1)), allowMissingColumns=True)
    g = K.merged_fragments(together, ["canonical_key"], ["own", "path", "ordinal"], ["product_name", "manager", "canonical_name", "path", "family", "quality_status", "name_reason", "entity_type", "entity_confidence"], ["strategies", "evidence"], {"confidence": K.CONFIDENCE})
    text = F.concat_ws("\n", "product_name", "canonical_name", F.concat_ws(" ", "strategies"), F.concat_ws("\n", "evidence"))
    t = classified(g.withColumn("profile_text", text), "profile_text")
    t = X.guarded(t.withColumn("product_lines", X.product_lines(F.col("profile_text"))), ["product_name", "canonical_name"])
    split = X.scope_split(F.concat(F.array("primary_tag"), F.col("secondary_tags"), F.col("product_lines")), F.concat("strategies", "candidate_tags"))
    return t.withColumns({
        "primary_tags": F.array("primary_tag"),
        "direct_tags": split["direct"],
        "mentioned_tags": split["mentioned"],
        "facet_values": F.flatten(F.transform(F.map_entries("facets"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v)))),
        "backgrounds": X.backgrounds(F.col("profile_text")),
        "constraints": X.exposure_constraints(F.col("profile_text")),
        "evidence_summary": X.evidence_summary(F.col("evidence"), F.col("strategies"), EVIDENCE_WORDS),
        "positioning": X.positioning(F.array("primary_tag"), F.col("secondary_tags"), F.col("product_lines"), F.col("strategies"), F.col("evidence")),
        "search_text": F.col("profile_text"),
        "risk_points": lines_with(F.array_join("evidence", "\n"), RISK_WORDS, 5),
        "manager_aliases": manager_aliases(F.col("manager")),
        "product_aliases": F.array_distinct(F.array(F.col("product_name"), F.col("canonical_name"))),
        "source_notes": F.array("path"),
        "source_files": F.array().cast("array<string>"),
    })


def build(files: DataFrame) -> dict[str, DataFrame]:
    """Profiles (stored, as everything else reads them), relations, issues and the review status of a folder of notes."""
    p = stored(compiled(stored(fragments(notes(files)), "fragments")), "profiles")
    issues = K.health(p)
    return {"profiles": p, "relations": K.relations(p, PREDICATES, MANAGER_PREDICATES), "issues": issues, "status": K.status_of(issues)}


def quality_report(profiles: DataFrame, most: int = 20) -> DataFrame:
    """Number of profiles by status, with the first names of those that aren't confirmed.

    Names are cut to the first in parts of each status, then over the parts, so that no task sorts a whole status.
    """
    part = F.pmod(F.xxhash64("product_name"), F.lit(256))
    first = lambda xs: F.slice(F.sort_array(xs), 1, most)
    nth = F.row_number().over(W.partitionBy("quality_status", "__part").orderBy("product_name"))
    t = profiles.withColumn("__part", part).withColumn("__n", nth)
    parts = t.groupBy("quality_status", "__part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when((F.col("__n") <= most) & (F.col("quality_status") != "confirmed"), F.col("product_name"))).alias("names"))
    return parts.groupBy("quality_status").agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("names"))).alias("names"))


def overview(profiles: DataFrame) -> DataFrame:
    """How many profiles, managers, products and confirmed names there are."""
    return profiles.agg(F.count(F.lit(1)).alias("profiles"), F.count_distinct("manager").alias("managers"), F.count_distinct("product_name").alias("products"), F.count_if(F.col("quality_status") == "confirmed").alias("confirmed"))


def note_issues(parsed: DataFrame, required: list[str]) -> DataFrame:
    """Missing fields and unknown entity types of notes, and embedded lists that can't be read."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    marked = F.col("content").contains(f"<!-- {MARK}")
    found = F.array(
        F.when(F.size(missing) > 0, F.struct(F.lit("missing_fields").alias("kind"), F.array_join(missing, ", ").alias("detail"))),
        F.when(~F.col("entity_type").isin("product", "manager", "product_series", "strategy"), F.struct(F.lit("unknown_entity_type").alias("kind"), F.col("entity_type").alias("detail"))),
        F.when(marked & F.col("products").isNull(), F.struct(F.lit("unreadable_products").alias("kind"), F.lit(MARK).alias("detail"))),
    )
    return parsed.select("path", F.inline(F.filter(found, lambda x: x.isNotNull())))


def lifecycle_issues(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Sources that are gone or failed, and successes whose note is gone, by the last record of each path."""
    last = K.latest(manifest, ["source_path"], ["parsed_at", "run_id"])
    t = last.join(present.select(F.col("path").alias("source_path"), F.lit(True).alias("__here")), "source_path", "left").join(present.select(F.col("path").alias("source_note_path"), F.lit(True).alias("__note")), "source_note_path", "left")
    kind = F.when(F.col("__here").isNull(), "source_missing").when(F.col("status") == "failed", "parse_failed").when((F.col("status") == "success") & F.col("__note").isNull(), "note_missing")
    return t.select("source_path", kind.alias("kind")).where("kind IS NOT NULL")


def changed_only(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content no successful run has seen."""
    return files.join(manifest.where("status = 'success'").select("sha256").distinct(), "sha256", "left_anti")


def vocabulary(files: DataFrame, heading: str, columns: list[str]) -> DataFrame:
    """Rows of the Markdown table under a heading, by position."""
    t = files.select("path", F.posexplode(table_rows(section(F.col("content"), heading))).alias("at", "r")).where("at > 0")
    return t.select("path", *[F.try_element_at("r", F.lit(i)).alias(c) for i, c in enumerate(columns, 1)])


def labels_like(words: DataFrame, query: str, least: int = 3) -> DataFrame:
    """Labels of at least ``least`` characters that hold the query, or equal it."""
    k, q = fold_key("label"), fold_key(F.lit(query))
    return words.where((k == q) | (k.contains(q) & (F.length("label") >= least)))


def audit_plan(funds: DataFrame, reports: DataFrame, refresh_all: bool = False, refresh: list[str] = ()) -> DataFrame:
    """Funds with their latest saved report, and whether a new one is due."""
    best = reports.groupBy("fund").agg(F.max_by("path", F.struct("stamp", "path")).alias("report"))
    due = F.col("report").isNull() | F.lit(refresh_all) | F.col("fund").isin(list(refresh))
    return funds.join(best, "fund", "left").withColumn("action", F.when(due, "audit").otherwise("reuse"))


def manager_pages(profiles: DataFrame) -> DataFrame:
    """``manager, markdown``: a page for each manager with its products in order."""
    line = F.concat(F.lit("- [["), F.col("product_name"), F.lit("]] "), F.coalesce("primary_tag", F.lit("-")))
    return profiles.groupBy("manager").agg(F.concat(F.lit("# "), F.first("manager"), F.lit("\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("product_name", line.alias("l")))), lambda x: x["l"]), "\n")).alias("markdown"))


def documented_calls(files: DataFrame) -> DataFrame:
    """Names of calls in the headings of Markdown pages."""
    names = F.regexp_extract_all("content", F.lit(r"(?m)^#{2,4}\s+.*?`?([a-z][a-z0-9_]+)\([^)]*\)`?"), F.lit(1))
    return files.select("path", F.explode(F.array_distinct(names)).alias("call"))
