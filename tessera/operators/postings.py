"""Full-text index of profiles, and the candidates of a search from it.

A word is contained in a text only if all its pairs of neighbouring characters are. So the index keeps, for
each pair, a list of the profiles that have it in any field, sorted by id, with the fields as bits and the part of the score that doesn't hang
on the query. Lists are cut into chunks, so that a common pair isn't one row, and lie in folders by a hash of the pair: a search
reads the folders and row groups of its own pairs.

A search intersects the lists of each word's pairs, which gives the most that a profile can score, a few
best are scored in full, and only profiles whose bound reaches the last of these are read and scored. Results are those
of a full scan: a bound is never below the score.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import identity_key, text_key
from tessera.operators import recognition
from tessera.operators import retrieval as R
from tessera.session import fresh_path, stored

FOLDERS, CHUNK = 32, 8_192
#: Profiles of a file of the index.
ROWS = 10_000
#: Candidates up to this number are named in the filter of the scan of profiles; more are joined.
NAMED = 1_000
#: Bits of the fields.
BIT = {c: 1 << k for k, c in enumerate(R.FIELDS)}


@dataclass
class Index:
    """Stored tables: ``profiles`` with normalised fields, ``postings`` by pair, ``names`` that queries may mention."""

    profiles: DataFrame
    postings: DataFrame
    names: DataFrame
    id: str

    def intent(self, query: str) -> R.Intent:
        return R.asked(query, self.names)

    def candidates(self, intent: R.Intent, limit: int, relations: DataFrame | None = None) -> DataFrame:
        return candidates(self, intent, limit, relations)


def build(profiles: DataFrame, id: str = "id", relations: DataFrame | None = None) -> Index:
    """Index of profiles whose ``id`` (a long) is unique; ``relations`` must hold all that searches will be given."""
    spark = profiles.sparkSession
    n = profiles.count()
    whole = R.with_fields(R.with_defaults(profiles.repartitionByRange(-(-n // ROWS) or 1, id).sortWithinPartitions(id)))
    path = fresh_path(spark, "indexed-profiles")
    whole.write.parquet(path)
    whole = spark.read.schema(whole.schema).parquet(path)
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.struct(F.substr(F.col(c), i, F.lit(2)).alias("pair"), F.lit(BIT[c]).alias("bit")))
    found = F.concat(*[F.when(F.length(c) > 1, pairs(c)).otherwise(F.array().cast("array<struct<pair:string,bit:int>>")) for c in R.FIELDS])
    own = F.array(F.struct(F.concat(F.lit("\0"), F.col("manager_key")).alias("pair"), F.lit(0).alias("bit")))
    searched = whole if relations is None else R.with_fields(whole.drop(*R.FIELDS), relations)
    # profiles are dealt by chunk before they are taken to pairs, and both groupings are by chunk too: pairs are never shuffled
    chunks = 1 + n // CHUNK
    searched = searched.withColumn("chunk", F.pmod(F.xxhash64(id), F.lit(chunks))).repartitionByRange(max(min(chunks, 64), -(-chunks // 2)), "chunk")
    rows = searched.withColumn("manager_key", identity_key(F.col("manager"))).select("chunk", F.col(id).alias("id"), R.base_score().alias("base"), F.explode(F.concat(found, own)).alias("x"))
    rows = rows.select("chunk", "x.pair", "id", "x.bit", "base").groupBy("chunk", "pair", "id").agg(F.bit_or("bit").alias("fields"), F.first("base").alias("base"))
    lists = rows.groupBy("chunk", "pair").agg(F.sort_array(F.collect_list(F.struct("id", "fields", "base"))).alias("entries"))
    lists = lists.select("pair", "chunk", "entries", folder("pair").alias("folder"))
    path = fresh_path(spark, "postings")
    lists.sortWithinPartitions("folder", "pair", "chunk").write.partitionBy("folder").parquet(path)
    schema = lists.schema
    return Index(whole, spark.read.schema(schema).parquet(path), stored(recognition.name_keys(whole), "names"), id)


def folder(pair: str) -> Column:
    return (F.crc32(F.col(pair).cast("binary")) % FOLDERS).cast("int")


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan: no job is needed to make them."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':') for c in schema.split(', '))}>>")))


def pairs_of(word: str) -> set[str]:
    return {word[k:k + 2] for k in range(len(word) - 1)}


def words_of(intent: R.Intent) -> list[tuple]:
    """``unit, word, field, weight``: what a word found in a field is worth at most; a unit counts its best word. Units below zero are conditions."""
    out = []
    for u, t in enumerate(t for t in intent.terms if text_key(t)):
        out += [(u, text_key(t), "__product", 8.0), (u, text_key(t), "__manager", 6.0), (u, t.lower(), "__tags", 4.5), (u, t.lower(), "__text", R.text_weight(t)), (u, t.lower(), "__rel", 4.5)]
    for u, (_, names) in enumerate(intent.conditions, 1):
        out += [(-u, text_key(n), f, w + 2.5) for n in names for f, w in (("__tagkey", 5.5), ("__relkey", 5.5), ("__textkey", 4.0))]  # a condition that isn't met costs 2.5
    return out


def read(index: Index, pairs: set[str]) -> DataFrame:
    """``pair, id, fields, base`` of the lists of the pairs; other folders aren't opened."""
    folders = sorted({zlib.crc32(p.encode()) % FOLDERS for p in pairs})
    return index.postings.where(F.col("folder").isin(folders) & F.col("pair").isin(sorted(pairs))).select("pair", F.inline("entries"))


def bounds(index: Index, intent: R.Intent) -> DataFrame | None:
    """``id, bound`` of the profiles that a search can find; ``None`` if the index can't tell, as a word has one character only."""
    words = words_of(intent)
    must = [("\0" + _identity(index.postings.sparkSession, intent.manager), None)] if intent.manager else []
    product = text_key(intent.product) if intent.product else None
    if any(len(w) < 2 for _, w, _, _ in words) or product is not None and len(product) < 2:
        return None
    spark = index.postings.sparkSession
    needed = {p for p, _ in must} | (pairs_of(product) if product else set()) | {p for _, w, _, _ in words for p in pairs_of(w)}
    if not needed:
        return None
    lists = read(index, needed)
    rows = sorted({(p, u, w, BIT[f], weight, len(pairs_of(w))) for u, w, f, weight in words for p in pairs_of(w)})
    wanted = table_of(spark, rows, "pair string, unit int, word string, bit int, weight double, of int")
    hits = lists.join(F.broadcast(wanted), "pair").where(F.col("fields").bitwiseAND(F.col("bit")) > 0)
    hits = hits.groupBy("id", "unit", "word", "bit", "weight").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"), F.first("base").alias("base")).where("n = of")
    units = hits.groupBy("id", "unit").agg(F.max("weight").alias("weight"), F.first("base").alias("base"))
    found = units.groupBy("id").agg(F.sum("weight").alias("worth"), F.first("base").alias("base"), F.max(F.col("unit") < 0).alias("met"))
    fixed = F.lit(-2.5 * len(intent.conditions) + (20.0 if intent.manager else 0.0) + (15.0 if product else 0.0) + R.boost(intent))
    only = []
    if intent.manager:
        only.append(lists.where(F.col("pair") == must[0][0]).select("id", "base"))
    if product:
        whole = lists.where(F.col("pair").isin(sorted(pairs_of(product))) & (F.col("fields").bitwiseAND(BIT["__product"]) > 0))
        only.append(whole.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base")).where(F.col("n") == len(pairs_of(product))).select("id", "base"))
    if only:
        named = reduce(lambda a, b: a.join(b.select("id"), "id", "left_semi"), only)
        return named.join(found.select("id", "worth"), "id", "left").select("id", (F.coalesce("worth", F.lit(0.0)) + F.col("base") + fixed).alias("bound"))
    return (found.where("met") if intent.conditions else found).select("id", (F.col("worth") + F.col("base") + fixed).alias("bound"))


def _identity(spark: SparkSession, manager: str) -> str:
    return spark.range(1).select(identity_key(F.lit(manager))).first()[0]


def candidates(index: Index, intent: R.Intent, limit: int, relations: DataFrame | None = None) -> DataFrame:
    """The profiles of the index that can be among the ``limit`` best, and no others where the index can tell."""
    found = bounds(index, intent)
    if found is None:
        return index.profiles
    found = stored(found, "bounds")
    first = [r["id"] for r in found.orderBy(F.desc("bound"), "id").limit(4 * limit).collect()]
    best = R.scored(index.profiles.where(F.col(index.id).isin(first)), intent, relations).select("score").orderBy(F.desc("score")).limit(limit).collect()
    left = found.where(F.col("bound") >= best[-1]["score"]) if len(best) == limit else found.where("bound > 0")
    ids = [r["id"] for r in left.select("id").limit(NAMED + 1).collect()]
    if len(ids) <= NAMED:
        return index.profiles.where(F.col(index.id).isin(ids))
    return index.profiles.join(left.select(F.col("id").alias(index.id)), index.id, "left_semi")
