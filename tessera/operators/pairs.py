"""Sums over all pairs of series, tile by tile.

Series are dealt over tiles and days over chunks, both by hash. Two tiles meet in one task for a chunk of days, as dense
matrices of values and of what is there, and four matrix products give the sums of every pair over the days
both have. A value is sent once for each tile, not once for each series it meets, and no group is larger than two tiles by one chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, DAYS = 256, 1_024
SUMS = "n double, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(returns: DataFrame, tile: int = TILE, days: int = DAYS) -> DataFrame:
    """``a, b, n`` and the sums of ``x, y`` of each pair ``a <= b`` of ``day, series, ret`` over common days; values are less their series' mean.

    Missing values are no days; of several values of a series on a day the mean counts; pairs without a common day have no row.
    """
    t = returns.select("day", "series", "ret").dropna().groupBy("day", "series").agg(F.avg("ret").alias("ret"))
    of = t.agg(F.count_distinct("series").alias("series"), F.count_distinct("day").alias("days")).first()
    tiles, chunks = max(1, math.ceil(of["series"] / tile)), max(1, math.ceil(of["days"] / days))
    kind = returns.schema["series"].dataType.simpleString()
    mean = t.groupBy("series").agg(F.avg("ret").alias("mean"))
    t = t.join(mean, "series").select("day", "series", (F.col("ret") - F.col("mean")).alias("ret"))
    t = t.withColumn("own", F.pmod(F.xxhash64("series"), F.lit(tiles)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("day"), F.lit(chunks)).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("series", "ret", "own", F.xxhash64("day").alias("day"), "chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def dense(p: pd.DataFrame, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, at = np.unique(p["series"].to_numpy(), return_inverse=True)
        x, there = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        row = np.searchsorted(days, p["day"].to_numpy())
        x[row, at], there[row, at] = p["ret"].to_numpy(), 1.0
        return names, x, there

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iloc[0], p["j"].iloc[0]
        days = np.unique(p["day"].to_numpy())
        if not (p["own"] == i).any() or not (p["own"] == j).any():
            return pd.DataFrame(columns=["a", "b", *[c.split()[0] for c in SUMS.split(", ")]])
        a, x, mx = dense(p[p["own"] == i], days)
        b, y, my = dense(p[p["own"] == j], days)
        got = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
        kept = got["n"] > 0
        if i == j:
            kept &= np.arange(len(a))[:, None] <= np.arange(len(b))[None, :]
        r, c = np.nonzero(kept)
        first, second = a[r], b[c]
        turn = first > second  # tiles are hashed, pairs are named in order
        out = pd.DataFrame({"a": np.where(turn, second, first), "b": np.where(turn, first, second), "n": got["n"][r, c], "sxy": got["sxy"][r, c]})
        for one, two in (("sx", "sy"), ("sxx", "syy")):
            out[one], out[two] = np.where(turn, got[two][r, c], got[one][r, c]), np.where(turn, got[one][r, c], got[two][r, c])
        return out[["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"]]

    parts = t.groupBy("i", "j", "chunk").applyInPandas(meet, f"a {kind}, b {kind}, {SUMS}")
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).withColumn("n", F.col("n").cast("long"))


def correlations(returns: DataFrame, tile: int = TILE, days: int = DAYS) -> DataFrame:
    """``a, b, corr, n`` of each pair ``a < b``; null for a single day or a series without variance."""
    s = pair_sums(returns, tile, days).where("a < b")
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select("a", "b", F.when((F.col("n") > 1) & (spread > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("corr"), "n")


def covariance(returns: DataFrame, tile: int = TILE, days: int = DAYS) -> DataFrame:
    """``a, b, cov``: sample covariance of each pair ``a <= b``; null for a single day."""
    return pair_sums(returns, tile, days).select("a", "b", F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("cov"))
