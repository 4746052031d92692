"""Risk parity weights by block descent over stored tiles of the covariance matrix.

Long weights with equal shares of risk are where ``x'Cx / 2 - sum(ln x) / n`` is least, scaled to sum to one. Series are
dealt over blocks by hash and the matrix is stored as dense tiles. For a block, tasks multiply its row of tiles with the
weights of the other blocks, and one task, which has the block's own tile, descends by coordinates. Only
weights (8 bytes a series) go through the driver.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.operators.pairs import covariance
from tessera.session import stored

BLOCK = 1_024


def descend(cov: np.ndarray, rest: np.ndarray, x: np.ndarray, n: int, rounds: int = 500, tolerance: float = 1e-13) -> np.ndarray:
    """``x`` of a block after cyclical coordinate descent; ``rest`` is what other blocks add to ``cov @ x``, ``n`` the number of all assets."""
    x, own = x.copy(), np.diag(cov)
    for _ in range(rounds):
        before = x.copy()
        for i in range(len(x)):
            r = rest[i] + cov[i] @ x - own[i] * x[i]
            root = math.sqrt(r * r + 4 * own[i] / n)
            x[i] = (root - r) / (2 * own[i]) if r < 0 else 2 / n / (root + r)  # no cancellation
        if np.abs(x / before - 1).max() < tolerance:
            break
    return x


def parity_weights(cov: np.ndarray, rounds: int = 500, tolerance: float = 1e-13) -> np.ndarray:
    """Weights of one matrix in memory."""
    n = len(cov)
    x = descend(cov, np.zeros(n), 1 / np.sqrt(n * np.diag(cov)), n, rounds, tolerance)
    return x / x.sum()


def tiled(cov: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Stored ``series, i, p, var`` (block and place) and stored ``i, j, tile`` of ``a, b, cov`` with ``a <= b``; absent or null covariances are zeros."""
    own = cov.where("a = b AND cov > 0").select(F.col("a").alias("series"), F.col("cov").alias("var"))
    blocks = max(1, math.ceil(own.count() / block))
    own = own.withColumn("i", F.pmod(F.xxhash64("series"), F.lit(blocks)).cast("int"))
    index = stored(own.withColumn("p", F.row_number().over(W.partitionBy("i").orderBy("series")) - 1), "parity-index")
    size = {r["i"]: r["count"] for r in index.groupBy("i").count().collect()}
    both = cov.where("cov IS NOT NULL").select("a", "b", "cov")
    both = both.unionByName(both.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    cells = both.join(index.select(F.col("series").alias("a"), "i", "p"), "a").join(index.select(F.col("series").alias("b"), F.col("i").alias("j"), F.col("p").alias("q")), "b")

    def dense(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        m = np.zeros((size[i], size[j]))
        m[g["p"].to_numpy(), g["q"].to_numpy()] = g["cov"].to_numpy()
        return pd.DataFrame({"i": [i], "j": [j], "tile": [m.tobytes()]})

    return index, stored(cells.select("i", "p", "j", "q", "cov").groupBy("i", "j").applyInPandas(dense, "i int, j int, tile binary"), "parity-tiles")


def _products(tiles: DataFrame, x: dict[int, np.ndarray], keep: int | None = None) -> DataFrame:
    """``i, j, tile`` of each tile times its block of ``x``; the diagonal tile of block ``keep`` stays as it is."""

    def f(batches):
        for b in batches:
            held = [t if i == j == keep else (np.frombuffer(t).reshape(-1, len(x[j])) @ x[j]).tobytes() for i, j, t in zip(b["i"], b["j"], b["tile"], strict=True)]
            yield pd.DataFrame({"i": b["i"], "j": b["j"], "tile": held})

    return tiles.mapInPandas(f, "i int, j int, tile binary")


def _solver(k: int, x: np.ndarray, n: int):
    """Descends in block ``k`` from products with the other blocks and its own tile."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        rest, own = np.zeros(len(x)), None
        for j, t in zip(g["j"], g["tile"], strict=True):
            if j == k:
                own = np.frombuffer(t).reshape(len(x), -1)
            else:
                rest += np.frombuffer(t)
        return pd.DataFrame({"x": [descend(own, rest, x, n)]})

    return solve


def risk_parity(returns: DataFrame, block: int = BLOCK, sweeps: int = 200, tolerance: float = 1e-10, max_assets: int = 1_000_000) -> DataFrame:
    """``series, weight, risk_share`` of ``day, series, ret``.

    Series without variance, or with one day only, have no row; two series without common days count as uncorrelated.
    ``max_assets`` bounds the weights that the driver holds.
    """
    index, tiles = tiled(covariance(returns), block)
    n = index.count()
    if n > max_assets:
        raise ValueError(f"{n} series, more than {max_assets}: their weights aren't held on the driver")
    start = index.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "var"))), lambda s: s["var"]).alias("var")).collect()
    x = {r["i"]: 1 / np.sqrt(n * np.array(r["var"])) for r in start}
    for _ in range(sweeps):
        change = 0.0
        for k in sorted(x):
            mine = x[k]
            x[k] = np.array(_products(tiles.where(F.col("i") == k), x, k).groupBy("i").applyInPandas(_solver(k, mine, n), "x array<double>").first()["x"])
            change = max(change, float(np.abs(x[k] / mine - 1).max()))
        if len(x) < 2 or change < tolerance:
            break
    else:
        warnings.warn(f"weights still changed by {change:.1e} in the last of {sweeps} sweeps", stacklevel=2)
    total = sum(v.sum() for v in x.values())

    def shares(g: pd.DataFrame) -> pd.DataFrame:
        i = int(g["i"].iloc[0])
        return pd.DataFrame({"i": i, "p": np.arange(len(x[i])), "weight": x[i] / total, "risk": x[i] * sum(np.frombuffer(t) for t in g["tile"])})

    risk = stored(_products(tiles, x).groupBy("i").applyInPandas(shares, "i int, p int, weight double, risk double"), "parity-risk")
    whole = risk.agg(F.sum("risk")).first()[0]
    return index.join(risk, ["i", "p"]).select("series", "weight", (F.col("risk") / F.lit(whole)).alias("risk_share"))
