"""Managers and products that queries name, for whole tables of queries.

Names are dealt over blocks of bounded size and queries over parts; a block meets a part in one
task, which builds an automaton of the block's keys once and runs each query through it. Every block gives its longest match for a
query, and the longest of these counts, so neither names nor queries need fit on one machine and no pair of a
name and a query is made that doesn't match.
"""

from __future__ import annotations

import functools
import math

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import fold_key, manager_aliases, match_key, text_key
from tessera.operators import retrieval as R

BLOCK, PART = 200_000, 50_000
FOUND = "query string, kind string, size int, name string"


def name_keys(profiles: DataFrame) -> DataFrame:
    """``kind, key, name``: keys of two letters or more of managers' aliases and of three or more of products; each name is worked out once."""
    managers = profiles.select("manager").where("manager <> ''").distinct().select(F.col("manager").alias("name"), F.explode(manager_aliases(F.col("manager"))).alias("alias"))
    managers = managers.select(F.lit("manager").alias("kind"), fold_key(F.col("alias")).alias("key"), F.length("alias").alias("size"), "name").where(F.length("key") >= 2)
    products = profiles.select(F.col("product_name").alias("name")).distinct().select(F.lit("product").alias("kind"), match_key(F.col("name")).alias("key"), "name").where(F.length("key") >= 3)
    products = products.select("kind", "key", F.length("key").alias("size"), "name")
    # of names with one key only the first can win; the longest alias of a manager stands for its key
    return managers.unionByName(products).groupBy("kind", "key").agg(F.max("size").alias("size"), F.min_by("name", F.struct(-F.col("size"), F.col("name"))).alias("name"))


def recognised(queries: DataFrame, names: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``query, kind, name`` of the longest name of each kind that a query contains; equal lengths go by name. Null queries contain none."""
    n, asked = names.count(), queries.select("query").where("query IS NOT NULL").distinct()
    blocks, parts = max(1, math.ceil(n / block)), max(1, math.ceil(asked.count() / part))

    def meet(names: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(names) and len(asked):
            hits_of: dict[str, list[tuple]] = {}
            for key, *hit in zip(names["key"], names["kind"], names["size"], names["name"], strict=True):
                hits_of.setdefault(key, []).append(hit)
            automaton = ahocorasick.Automaton()
            for key, hits in hits_of.items():
                automaton.add_word(key, hits)
            automaton.make_automaton()
            for q in asked["query"]:
                best: dict[str, tuple] = {}
                for _, hits in automaton.iter(text_key(q)):
                    for kind, size, name in hits:
                        if kind not in best or (-size, name) < best[kind]:
                            best[kind] = -size, name
                found += [(q, kind, -size, name) for kind, (size, name) in best.items()]
        return pd.DataFrame(found, columns=["query", "kind", "size", "name"])

    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = names.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    got = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(meet, FOUND)
    return got.groupBy("query", "kind").agg(F.min_by("name", F.struct(-F.col("size"), F.col("name"))).alias("name"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def terms_of(query: pd.Series) -> pd.Series:
    return query.map(lambda q: R.query_terms(q or ""))


def any_word(text: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def intents(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Each distinct ``query`` with its manager, product, conditions, terms and mode, in one plan."""
    found = recognised(queries, names).groupBy("query").agg(*[F.max(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in ("manager", "product")])
    low, q = F.lower("query"), F.col("query")
    conditions = [F.when(functools.reduce(lambda a, w: a & low.contains(w), all_of.split(), any_word(low, any_of.split())), F.lit(label)) for any_of, all_of, label, _ in R.CONDITIONS]
    t = queries.select("query").where("query IS NOT NULL").distinct().join(found, "query", "left")
    manager, product = F.col("manager").isNotNull(), F.col("product").isNotNull()
    mode = F.when(any_word(q, R.MANAGER_WORDS) & ~manager & ~product, "manager_filter").when(product, "single_product").when(manager & any_word(q, R.OVERVIEW_WORDS), "manager_overview").when(manager, "manager").otherwise("search")
    return t.select("query", "manager", "product", F.array_compact(F.array(*conditions)).alias("conditions"), terms_of("query").alias("terms"), mode.alias("mode"))
