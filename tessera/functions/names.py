"""Names of managers and products as column expressions: keys, stripping, families, analysis.

Java's word classes are ASCII, so letters and digits are matched by Unicode property.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What results depend on, as published.
COMPANY_SUFFIXES = """
私募基金管理有限责任公司 基金管理有限责任公司 资产管理有限责任公司 投资管理有限责任公司 投资有限责任公司 资本管理有限责任公司 资本有限责任公司
私募基金管理合伙企业有限合伙 基金管理合伙企业有限合伙 管理合伙企业有限合伙 合伙企业有限合伙
私募基金管理合伙企业（有限合伙） 基金管理合伙企业（有限合伙） 管理合伙企业（有限合伙） 合伙企业（有限合伙）
私募基金管理合伙企业 基金管理合伙企业 管理合伙企业 合伙企业
私募基金管理有限公司 资产管理有限公司 投资管理有限公司 投资有限公司 资本管理有限公司 资本有限公司 基金管理有限公司 有限责任公司 有限公司
""".split()
CITIES = "上海 北京 深圳市 深圳 广州 杭州 萧山 宁波 南京 苏州 珠海 天津 青岛 厦门 三亚 海南 广东 浙江 江苏 安徽 福建 山东 四川 重庆".split()
FUND_SUFFIXES = "私募证券投资基金 证券投资基金 私募基金 基金".split()
GENERIC_TAILS = "代表产品 策略产品 系列产品 产品线 产品系列 产品".split()
CORE_WORDS = "私募基金管理 基金管理 资产管理 投资管理 投资 资产 资本".split()
CORE_TAILS = "私募证券 私募基金 私募 基金".split()
SPECIFIC = r"(\d+\s*号|[一二三四五六七八九十]+\s*号|\d+\s*期|集合资产管理计划|资产管理计划|资管计划|私募证券投资基金|证券投资基金|私募基金|基金)"
NUMERALS = "一 二 三 四 五 六 七 八 九 十".split()
#: code, label, aliases; the first that is contained counts.
FAMILIES = [
    ("quant_long", "量化多头", "量化多头 量化多头策略 空气指增"),
    ("2000_index_enhancement", "中证2000指数增强", "中证2000指数增强 中证2000指增 2000指增 2000增强"),
    ("1000_index_enhancement", "中证1000指数增强", "中证1000指数增强 中证1000指增 1000指增 1000增强"),
    ("a500_index_enhancement", "中证A500指数增强", "中证A500指数增强 中证A500指增 A500指增 A500增强"),
    ("500_index_enhancement", "中证500指数增强", "中证500指数增强 中证500指增 500指增 500增强"),
    ("300_index_enhancement", "沪深300指数增强", "沪深300指数增强 沪深300指增 300指增 300增强"),
    ("index_enhancement", "指数增强", "指数增强 量化指增 指增"),
    ("market_neutral", "市场中性", "市场中性 量化中性"),
    ("multi_cta", "多元CTA", "多元CTA"),
    ("standard_cta", "标准CTA", "标准CTA 通用CTA"),
    ("commodity_cta", "商品CTA", "商品CTA 商品趋势 商品截面 商品基本面"),
    ("index_futures_cta", "股指CTA", "股指CTA 股指期货CTA"),
    ("option_cta", "期权CTA", "期权CTA 50ETF期权 300ETF期权"),
    ("cta", "CTA", "CTA 管理期货"),
]
#: Old and new, in order; a later one also meets what an earlier one wrote.
SYNONYMS = [
    ("中证2000指增", "中证2000指数增强"), ("2000指增", "中证2000指数增强"), ("2000增强", "中证2000指数增强"),
    ("中证1000指增", "中证1000指数增强"), ("1000指增", "中证1000指数增强"), ("1000增强", "中证1000指数增强"),
    ("中证500指增", "中证500指数增强"), ("500指增", "中证500指数增强"), ("500增强", "中证500指数增强"),
    ("沪深300指增", "沪深300指数增强"), ("300指增", "沪深300指数增强"), ("300增强", "沪深300指数增强"),
]

_EDGE = r"[ \-_，,。；;：:（）()\[\]【】]"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


@functools.lru_cache(100_000)
def text_key(s: str) -> str:
    """:func:`match_key` of a literal."""
    return re.sub(r"[\W_]+", "", s).lower()


def match_key(c: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}]+", ""))


def fold_key(c: Column) -> Column:
    """As :func:`match_key`, with the sharp s folded too."""
    return F.replace(match_key(c), F.lit("ß"), F.lit("ss"))


def wikilink(c: Column) -> Column:
    """What stands in the first double brackets, else the text, without outer spaces and quotes."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^.*?\[\[([^\]]+)\]\].*$", "$1")
    return F.regexp_replace(inner, r"^['\"\s]+|['\"\s]+$", "")


def clean_name(c: Column) -> Column:
    """Unlinked, without spaces and outer punctuation."""
    return F.regexp_replace(F.regexp_replace(wikilink(c), r"\s+", ""), rf"^{_EDGE}+|{_EDGE}+$", "")


def strip_company(c: Column) -> Column:
    return F.regexp_replace(clean_name(c), rf"{_any(COMPANY_SUFFIXES)}+$", "")


def strip_city(c: Column) -> Column:
    return F.regexp_replace(clean_name(c), rf"^{_any(CITIES)}+", "")


def strip_fund(c: Column) -> Column:
    return F.regexp_replace(clean_name(c), rf"{_any(FUND_SUFFIXES)}+$", "")


def strip_tail(c: Column) -> Column:
    """Without words that make a name generic."""
    return F.regexp_replace(clean_name(c), rf"{_any(GENERIC_TAILS)}+$", "")


def manager_name(c: Column) -> Column:
    """Without a leading number, a city in brackets, brackets round short words, and marks of a private fund."""
    t = F.regexp_replace(F.regexp_replace(wikilink(c), r"\s+", ""), r"^[ \-_，,。；;：:]+|[ \-_，,。；;：:]+$", "")
    t = F.regexp_replace(t, r"^\d{4,}[_\-\s]*", "")
    t = F.translate(t, "（）", "()")
    t = F.regexp_replace(t, rf"\({_any(CITIES)}\)", "")
    t = F.regexp_replace(t, r"\(([^)]{1,8})\)", "$1")
    return clean_name(F.regexp_replace(t, r"(?:私募证券|私募基金|私募)$", ""))


def manager_core(c: Column) -> Column:
    """The distinguishing part of a manager's name; the whole where nothing else is left.

    A fold over the words keeps the expression small: each step refers to the one before once.
    """
    less = lambda a, w, pattern: F.coalesce(F.nullif(F.regexp_replace(a, F.concat(w, F.lit(pattern)), F.lit("")), F.lit("")), a)
    core = F.aggregate(F.array(*[F.lit(w) for w in CORE_WORDS]), strip_company(strip_city(manager_name(c))), lambda a, w: less(a, w, ""))
    core = F.aggregate(F.array(*[F.lit(w) for w in CORE_TAILS]), strip_city(core), lambda a, w: less(a, w, "$"))
    return F.coalesce(F.nullif(core, F.lit("")), manager_name(c))


def identity_key(c: Column) -> Column:
    return fold_key(manager_core(c))


def with_identity(df: DataFrame, manager: str, registry: DataFrame | None = None, name: str = "manager_key") -> DataFrame:
    """Identity of a manager: the registered one (``alias, identity``) where there is one, else by name."""
    own = df.withColumn(name, identity_key(F.col(manager)))
    if registry is None:
        return own
    r = registry.select(fold_key("alias").alias("__k"), fold_key("identity").alias("__id")).dropDuplicates(["__k"])
    return own.withColumn("__k", fold_key(F.col(manager))).join(r, "__k", "left").withColumn(name, F.coalesce("__id", name)).drop("__k", "__id")


def manager_aliases(c: Column) -> Column:
    """Names a manager goes by, longest first."""
    name, core = manager_name(c), manager_core(c)
    forms = F.array(clean_name(c), name, strip_city(name), strip_company(name), strip_company(strip_city(name)), core, *[F.concat(core, F.lit(t)) for t in ("基金", "私募", "私募基金")])
    kept = F.array_distinct(F.filter(forms, lambda x: F.length(fold_key(x)) >= 2))
    return F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _without_all(c: Column, words: list[str]) -> Column:
    return F.aggregate(F.array(*[F.lit(text_key(w)) for w in words]), match_key(c), lambda a, w: F.replace(a, w, F.lit("")))


def product_alias_key(c: Column) -> Column:
    """A product's key for matching: without fund suffixes anywhere, numbers in digits."""
    t = _without_all(c, ["私募证券投资基金", "证券投资基金", "私募基金", "资产管理计划", "资管计划"])
    for k, n in enumerate(NUMERALS, 1):
        t = F.replace(t, F.lit(f"{n}号"), F.lit(f"{k}号"))
    return t


def manager_alias_key(c: Column) -> Column:
    """A manager's key for matching: without company suffixes anywhere."""
    return _without_all(c, ["私募基金管理有限公司", "资产管理有限公司", "投资管理有限公司", "投资有限公司", "资本管理有限公司", "资本有限公司", "基金管理有限公司", "有限公司"])


def clean_aliases(c: Column) -> Column:
    """Names of at least two letters or digits, the first of each key, longest first."""
    kept = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("v"))
    step = lambda a, x: F.when((F.length(match_key(x)) < 2) | F.array_contains(a["k"], match_key(x)), a).otherwise(F.struct(F.concat(a["k"], F.array(match_key(x))).alias("k"), F.concat(a["v"], F.array(F.trim(x))).alias("v")))
    names = F.aggregate(F.filter(c, lambda x: x.isNotNull()), kept, step)["v"]
    size = lambda x: F.length(match_key(x))
    return F.array_sort(names, lambda a, b: F.when(size(a) != size(b), size(b) - size(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def without_manager(product: Column, aliases: Column) -> Column:
    """A product's name without the longest manager's name it begins with."""
    name = clean_name(product)
    hit = F.try_element_at(F.filter(aliases, lambda a: fold_key(name).startswith(fold_key(a))), F.lit(1))
    return F.coalesce(F.substr(name, F.length(hit) + 1), name)


def arabic_numbers(c: Column) -> Column:
    """Numbered products in digits; one numeral after the other, so compound numerals change in their last part only."""
    t = clean_name(c)
    for k, n in enumerate(NUMERALS, 1):
        t = F.replace(t, F.lit(f"{n}号"), F.lit(f"{k}号"))
    return t


def synonym_key(c: Column) -> Column:
    t = fold_key(arabic_numbers(strip_fund(c)))
    for old, new in SYNONYMS:
        t = F.replace(t, F.lit(text_key(old)), F.lit(text_key(new)))
    return t


def family(c: Column) -> Column:
    """``code, label`` of the first strategy family whose name is contained; empty strings for none."""
    key = fold_key(c)
    pick = F.struct(F.lit("").alias("code"), F.lit("").alias("label"))
    for code, label, names in reversed(FAMILIES):
        inside = F.lit(False)
        for a in names.split():
            inside = inside | key.contains(text_key(a))
        pick = F.when(inside, F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))).otherwise(pick)
    return pick


_FAMILY_KEYS = sorted({text_key(x) for _, label, names in FAMILIES for x in [label, *names.split()]})


def analyzed(df: DataFrame, product: str = "product_name", manager: str = "manager") -> DataFrame:
    """Adds canonical name and key, family, and whether a name stands for one product or for a line of them."""
    t = df.withColumn("__clean", clean_name(F.col(product))).withColumn("__aliases", manager_aliases(F.col(manager))).withColumn("__own", without_manager(F.col(product), F.col("__aliases")))
    t = t.withColumns({"__family": family(F.col("__clean")), "__specific": F.col("__own").rlike(SPECIFIC), "__stem": strip_tail(F.col("__own"))})
    like = F.coalesce(fold_key(F.col("__stem")).isin(_FAMILY_KEYS), F.lit(False))
    has_family, tailed = F.col("__family.code") != "", F.col("__own") != F.col("__stem")
    plain = ~F.col("__specific")
    generic = F.when(has_family & plain & tailed, "strategy_product_line").when(tailed & plain, "generic_product_tail").when(like, "pure_strategy_name")
    t = t.withColumn("__generic", generic).withColumn("is_generic", F.col("__generic").isNotNull())
    short = strip_company(strip_city(F.col(manager)))
    canonical = F.when((short != "") & has_family, F.concat(short, F.col("__family.label"))).when(has_family, F.col("__family.label")).otherwise(F.col("__clean"))
    t = t.withColumn("canonical_name", F.when(F.col("is_generic"), canonical).otherwise(F.col("__clean")))
    suspicious = ~F.col("is_generic") & plain & ~has_family & F.col("__stem").rlike(r"^[一-鿿]{2,3}$")
    t = t.withColumn("__key", synonym_key(F.col("canonical_name"))).withColumn("__cuts", F.transform("__aliases", synonym_key))
    key, hit = F.col("__key"), F.try_element_at(F.filter("__cuts", lambda a: (a != "") & F.col("__key").startswith(a)), F.lit(1))
    return t.withColumns({
        "family": F.col("__family.code"),
        "quality_status": F.when(F.col("is_generic"), "weak_line").when(suspicious, "needs_review").otherwise("confirmed"),
        "name_reason": F.coalesce("__generic", F.when(suspicious, "suspicious_short_name").otherwise("product_specific")),
        "entity_type": F.when(~F.col("is_generic"), "product").when(F.col("__own").rlike("(?:系列|系列产品)$"), "product_series").when(F.col("__generic") == "generic_product_tail", "generic_bucket").otherwise("strategy_line"),
        "entity_confidence": F.when(F.col("is_generic"), "low").when(suspicious, "medium").otherwise("high"),
        "canonical_key": F.concat_ws("|", identity_key(F.col(manager)), F.when(F.col("is_generic"), "generic").otherwise("product"), F.coalesce(F.substr(key, F.length(hit) + 1), key)),
    }).drop("__clean", "__aliases", "__own", "__family", "__specific", "__stem", "__generic", "__key", "__cuts")


def bigrams(c: Column) -> Column:
    """Neighbouring pairs of Han characters after all else is taken out."""
    han = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^一-鿿]", "")
    return F.when(F.length(han) >= 2, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substr(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def latin_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9_&.\-]+)"), F.lit(1))


def stable_id(*cols: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.concat_ws("|", *cols)), 256), 1, 16)


def overlap_score(names: Column, others: Column) -> Column:
    """4 if two lists of names share a key, 2 if a key is contained in another, else 0."""
    a, b = F.transform(names, fold_key), F.transform(others, fold_key)
    inside = F.exists(a, lambda x: F.exists(b, lambda y: (x != "") & (y != "") & (x.contains(y) | y.contains(x))))
    return F.when(F.arrays_overlap(a, b), 4).when(inside, 2).otherwise(0)
