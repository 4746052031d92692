"""Approximate nearest neighbours by collision counting on sorted projections.

Every vector is projected on ``m`` random directions; each projection's values are a sorted
array. A query's own projection is the centre of a window on each array, and a vector that lies
in a window collides with the query there. For a radius ``R`` the half-width is ``width * R``;
a vector within distance ``R`` collides with a known probability in each array, so those that
collide in at least a threshold of the ``m`` arrays, two standard deviations below what is
expected at ``R``, are verified, and nothing else. Windows start at a part of the data's radius; the
best of what collides most there gives an upper bound on the distance of the last neighbour that is wanted,
and the same arrays are read again in windows widened to that radius (virtual rehashing).
So no hash table is made for a radius, and a neighbour is missed only where it falls
short of the threshold.

Largest inner products are nearest points once each vector has one more entry,
``sqrt(M**2 - |x|**2)`` with ``M`` the longest vector, and each query is scaled to length ``M``.

Distribution: vectors that are equal are indexed once, with their ``k + 1`` smallest ids, which
is all that a result can hold, and equal queries are searched once; both are limited before they are shuffled. The vectors are
dealt at random over shards of at most ``shard_rows``, each indexed in a task; queries are dealt over
parts. A shard meets a part of the queries in one task, so memory is bounded by one
shard's index and one part. Each gives its ``k + 1`` best for a query, and these are merged.

Defined cases: rows with a null id, and vectors that are null, empty, zero, of another
length than the commonest or hold null or non-finite entries, take no part; rows equal in id and vector are one; rows that
repeat an id with other vectors are candidates each (for queries of other ids) and queries each;
equal scores go by the smaller id; with fewer candidates than ``k`` all are returned; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored, table

from .common import salted_left_join
from .vectors import usable

ARRAYS, WIDTH, SLACK, SEED = 64, 1.0, 2.0, 13
#: Bytes of vectors in a shard, and rows, as ranks are numbers of 16 bits.
SHARD_BYTES, SHARD_ROWS, LEAST_SHARD, PART_ROWS = 32 << 20, 60_000, 16_384, 8_192
INDEX = "shard int, i int, a binary, b binary"
FOUND = "rep long, id long, score double"


def directions(d: int, m: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d + 1, m))


def build(members: DataFrame, longest: float, d: int, m: int = ARRAYS) -> DataFrame:
    """The index of a table ``shard, v, ids``: for each shard a row of its vectors (-1), of their ids (-2), and of each sorted array with the rank of each vector."""

    def shard(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p["v"].to_list())
        ids = [np.asarray(i, dtype=np.int64) for i in p["ids"]]
        more = np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))
        at = np.hstack([x, more[:, None]]) @ directions(d, m)
        rows = [(-1, x.tobytes(), b""), (-2, np.concatenate(ids).tobytes(), np.cumsum([0, *map(len, ids)], dtype=np.int64).tobytes())]
        for i in range(m):
            order = np.argsort(at[:, i], kind="stable")
            rank = np.empty(len(order), dtype=np.uint16 if len(order) < 1 << 16 else np.uint32)
            rank[order] = np.arange(len(order), dtype=rank.dtype)
            rows.append((i, at[order, i].astype(np.float32).tobytes(), rank.tobytes()))
        return pd.DataFrame(rows, columns=["i", "a", "b"]).assign(shard=p["shard"].iloc[0])[["shard", "i", "a", "b"]]

    return members.groupBy("shard").applyInPandas(shard, INDEX)


class Shard:
    """One shard's arrays in memory; ``seek`` gives a query's best."""

    def __init__(self, rows: pd.DataFrame, longest: float, d: int, m: int):
        part = {i: (a, b) for i, a, b in zip(rows["i"], rows["a"], rows["b"], strict=True)}
        self.x = np.frombuffer(part[-1][0]).reshape(-1, d)
        self.ids, self.start = (np.frombuffer(y, dtype=np.int64) for y in part[-2])
        self.n, self.m, self.longest = len(self.x), m, longest
        self.sorted = [np.frombuffer(part[i][0], dtype=np.float32) for i in range(m)]
        self.rank = [np.frombuffer(part[i][1], dtype=np.uint16 if self.n < 1 << 16 else np.uint32) for i in range(m)]
        self.along = directions(d, m)[:d]
        p = math.erf(WIDTH / math.sqrt(2))
        self.least = max(1, math.floor(m * p - SLACK * math.sqrt(m * p * (1 - p))))

    def windows(self, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of each query's window on each array."""
        half = (WIDTH * radius).astype(np.float32)
        lo = np.stack([np.searchsorted(s, centre[:, i] - half, "left") for i, s in enumerate(self.sorted)], axis=1)
        hi = np.stack([np.searchsorted(s, centre[:, i] + half, "right") for i, s in enumerate(self.sorted)], axis=1)
        return lo, hi - lo

    def collisions(self, lo: np.ndarray, many: np.ndarray) -> np.ndarray:
        """In how many windows each vector lies."""
        kind = self.rank[0].dtype
        hits, place, within = np.zeros(self.n, dtype=np.uint16), np.empty(self.n, dtype=kind), np.empty(self.n, dtype=bool)
        for rank, a, k in zip(self.rank, lo.astype(kind), many.astype(kind), strict=True):
            np.subtract(rank, a, out=place)  # wraps around below the window
            np.less(place, k, out=within)
            np.add(hits, within, out=hits)
        return hits

    def best(self, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best of the vectors at places ``at``, ties to the smaller id."""
        x = self.x[at]
        rough = x @ q
        if len(at) > k:
            near = rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9 * self.longest * np.sqrt(q @ q)
            at, x = at[near], x[near]
        score = (x * q).sum(axis=1)  # each row by itself, so equal vectors have equal scores
        many = self.start[at + 1] - self.start[at]
        ids = self.ids[np.repeat(self.start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        score = np.repeat(score, many)
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]

    def seek(self, queries: np.ndarray, k: int):
        """For each query the ids and scores of its ``k`` best candidates."""
        length = np.sqrt((queries * queries).sum(axis=1))
        centre = ((queries * (self.longest / length)[:, None]) @ self.along).astype(np.float32)
        lo, many = self.windows(centre, np.full(len(queries), 0.6 * self.longest))
        first = min(self.n, max(4 * k, self.n // 32))
        radius = np.empty(len(queries))
        for j, q in enumerate(queries):
            hits = self.collisions(lo[j], many[j])
            got = self.best(np.argpartition(hits, self.n - first)[self.n - first:], q, k)[1]
            apart = 2 * self.longest**2 - 2 * (self.longest / length[j]) * got[-1] if len(got) == k else np.inf
            radius[j] = np.sqrt(max(0.0, apart)) + 1e-5 * self.longest
        lo, many = self.windows(centre, radius)
        for j, q in enumerate(queries):
            yield self.best(np.flatnonzero(self.collisions(lo[j], many[j]) >= self.least), q, k)


def search(index: DataFrame, queries: DataFrame, shards: int, parts: int, k: int, longest: float, d: int, m: int = ARRAYS) -> DataFrame:
    """``rep, id, score``: for each query ``rep, v`` the ``k`` best of each shard."""

    def meet(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"rep": [], "id": [], "score": []})
        found = list(Shard(rows, longest, d, m).seek(np.stack(q["v"].to_list()), k))
        return pd.DataFrame({"rep": np.repeat(q["rep"].to_numpy(), [len(i) for i, _ in found]), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"), every(shards).alias("shard"))
    told = index.withColumn("part", every(parts))
    return asked.groupBy("shard", "part").cogroup(told.groupBy("shard", "part")).applyInPandas(meet, FOUND)


def nearest(df: DataFrame, asked: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", m: int = ARRAYS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product for each row whose id fulfils ``asked`` (a condition on ``id``)."""
    rows = usable(df.where(F.col(id).isNotNull()), id, vector).where(F.exists("v", lambda x: x != 0)).withColumn("id", F.col("id").cast("long")).distinct()
    own = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = stored(members, "members")
    of = members.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top"), F.max(F.size("v")).alias("d")).first()
    queries = stored(rows.where(asked).groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()), "queries")
    many = queries.count()
    if not of["n"] or not many:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest, d = math.sqrt(of["top"]), of["d"]
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * d)))
    shards = math.ceil(of["n"] / min(most, max(LEAST_SHARD, of["n"] // 16)))
    parts = math.ceil(max(many / PART_ROWS, min(2 * df.sparkSession.sparkContext.defaultParallelism / shards, many / 64)))
    index = stored(build(members.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int")), longest, d, m), "index")
    found = search(index, queries, shards, parts, k + 1, longest, d, m)
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    found = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    told = stored(queries.join(found, "rep").select("v", "found", "n"), "found")
    each = salted_left_join(rows.where(asked), told, ["v"], ["id"])
    left = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(left).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
