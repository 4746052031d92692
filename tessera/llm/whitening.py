"""Whitening of embeddings: a compensated covariance, its eigenvectors, and rows in their coordinates.

Sums and centred outer products are kept as pairs of doubles, a high and a low part.
A block of centred rows is split without error into slices of ``BITS`` bits below each
column's largest exponent, so that every product of two slices, summed over a block of
``BLOCK`` rows, is exact in a double; these exact matrices are added to the pair by
error-free sums. Each task gives its pair once, a row of the matrix at a time, and pairs
are merged by the same sums in two steps, groups of 64 tasks first, so what meets in one
group doesn't grow with rows and the driver gets one ``d`` x ``d`` matrix. The eigen-solver is
LAPACK's (``eigh``): reduction to a tridiagonal matrix, then divide and conquer; its vectors are
corrected once more in pairs, so that small components beside large ones are right, too.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries
are dropped, and so are those of another length than the commonest; repeated rows and
ids count as often as they occur; equal eigenvalues keep the solver's order; components whose
eigenvalue is zero to working precision are left out, so one row, or rows that are all
equal, give no rows, as does an empty table; entries beyond 2**46 are taken as 2**46;
a ``deviation`` beyond the range of long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import stored, table

from .common import arrow_map, map_batches
from .vectors import matrix, usable

BITS, SLICES, BLOCK = 20, 4, 4_096
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**46
PAIR = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("task", T.LongType()), T.StructField("hi", T.BinaryType()), T.StructField("lo", T.BinaryType())])

Pair = tuple[np.ndarray, np.ndarray]


def exact(c: np.ndarray) -> Pair:
    return c, np.zeros_like(c)


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """``a + b`` and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def slices(c: Pair) -> list[np.ndarray]:
    """Parts of ``BITS`` bits whose sum is ``c``, each a multiple of a power of two that a column has in common."""
    top = np.abs(c[0]).max(axis=0, initial=0.0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 1 - BITS)
    rest, low, out = c[0], c[1], []
    for k in range(SLICES):
        if k == 2:  # what is left of the high part is as small as the low part
            rest = rest + low
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest = rest - part
        unit = unit * 2.0**-BITS
    return out


def outer(c: Pair) -> Pair:
    """Sum of the outer products of the rows of a block."""
    s = slices(c)
    got = (np.zeros((c[0].shape[1],) * 2),) * 2
    for i, j in ((1, 2), (0, 3), (1, 1), (0, 2), (0, 1), (0, 0)):
        p = s[i].T @ s[j]
        got = added(got, exact(p))
        if i != j:
            got = added(got, exact(p.T))
    return got


def product(a: Pair, b: Pair) -> Pair:
    """``a.T @ b`` for up to ``BLOCK`` rows."""
    s, t = slices(a), slices(b)
    got = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for k in range(SLICES - 1, -1, -1):
        for i in range(k + 1):
            got = added(got, exact(s[i].T @ t[k - i]))
    return got


def column_sums(c: Pair) -> Pair:
    """Sum of the rows of a block, and as a last entry their number."""
    s = slices(c)
    got = (np.zeros(c[0].shape[1]),) * 2
    for part in reversed(s):
        got = added(got, (part.sum(axis=0), np.zeros(c[0].shape[1])))
    return np.append(got[0], len(c[0])), np.append(got[1], 0.0)


def summed(df: DataFrame, rows: Callable[[np.ndarray], Pair], f: Callable[[Pair], Pair]) -> dict[int, Pair]:
    """``f`` of the blocks of ``rows(v)``, added up over all rows of ``df``: the pair of each row of the resulting matrix."""
    arrow = to_arrow_schema(PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = None
        for b in batches:
            v = matrix(b.column(0))
            for at in range(0, len(v), BLOCK):
                got = f(rows(v[at:at + BLOCK]))
                total = got if total is None else added(total, got)
        if total is not None:
            hi, lo = np.atleast_2d(total[0]), np.atleast_2d(total[1])
            n = len(hi)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array([x.tobytes() for x in hi], pa.binary()), pa.array([x.tobytes() for x in lo], pa.binary())], schema=arrow)

    def merged(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("task")
        total = None
        for hi, lo in zip(p["hi"], p["lo"], strict=True):
            one = np.frombuffer(hi), np.frombuffer(lo)
            total = one if total is None else added(total, one)
        return pd.DataFrame({"k": p["k"].iloc[:1], "task": p["task"].iloc[:1], "hi": [total[0].tobytes()], "lo": [total[1].tobytes()]})

    parts = arrow_map(df.select("v"), run, PAIR, BLOCK)
    parts = parts.groupBy("k", F.floor(F.col("task") / 64).alias("part")).applyInPandas(merged, PAIR)
    parts = parts.groupBy("k").applyInPandas(merged, PAIR)
    return {r["k"]: (np.frombuffer(r["hi"]), np.frombuffer(r["lo"])) for r in parts.collect()}


def scaled(v: np.ndarray) -> np.ndarray:
    """Whole numbers ``floor(64 * c) + 1000000`` of entries ``c``; they fit a double."""
    return np.floor(SCALE * np.clip(v, -LIMIT, LIMIT)) + SHIFT


@dataclass
class Centre:
    """``n`` rows with sums ``n * whole + rest`` of each dimension, ``0 <= rest < n``; ``part`` is ``rest / n`` as a pair."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    part: Pair

    def __call__(self, x: np.ndarray) -> Pair:
        """``x`` less the mean."""
        s, e = two_sum(x - self.whole, -self.part[0])
        return two_sum(s, e - self.part[1])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - S)**2`` over the dimensions."""
        y = x - self.whole
        if self.n * (np.abs(y).max(initial=0.0) + 1) < np.sqrt(2.0**62 / max(1, y.shape[1])):
            u = self.n * y.astype(np.int64) - self.rest
            return (u * u).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        all_ = (sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in y)
        return [d if d < 2**63 else None for d in all_]


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def eigen(cov: Pair, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix given as a pair.

    The solver's error is that of the largest eigenvalue, which may be large beside small ones; so its vectors are corrected
    by their residuals, computed in pairs (the Newton step of Ogita and Aishima).
    """
    values, unit = np.linalg.eigh((cov[0] + cov[0].T) / 2)
    values, unit = values[::-1], unit[:, ::-1]
    for _ in range(steps):
        u = exact(unit)
        square, turned = product(u, u), product(u, product(cov, u))
        off = (np.eye(len(values)) - square[0]) - square[1]
        s = turned[0] + turned[1]
        values = np.diag(s) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        wanted = s + values[None, :] * off
        apart = np.abs(wanted) < 0.01 * np.abs(gap)  # others are as good as equal, and any basis of theirs will do
        unit = unit + unit @ np.where(apart, wanted / np.where(apart, gap, 1.0), off / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], unit[:, order]


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """Mean and leading components of the scaled vectors ``v``; ``None`` where nothing varies."""
    total = summed(vectors, lambda v: exact(scaled(v)), column_sums).get(0)
    if total is None:
        return None
    sums = [int(h) + int(e) for h, e in zip(*total, strict=True)]
    n = sums.pop()
    rest = [s % n for s in sums]
    part = [Fraction(r, n) for r in rest]
    hi = [float(p) for p in part]
    centre = Centre(n, np.array([float(s // n) for s in sums]), np.array(rest, dtype=np.int64), (np.array(hi), np.array([float(p - Fraction(h)) for p, h in zip(part, hi, strict=True)])))
    rows = summed(vectors, lambda v: centre(scaled(v)), outer)
    total = tuple(np.stack([rows[k][part] for k in range(len(sums))]) for part in (0, 1))
    values, unit = eigen(total)
    trace = float(np.trace(total[0])) / n
    values = values / n
    used = int((values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    if not used:
        return None
    unit = unit * np.where(unit[np.abs(unit).argmax(axis=0), np.arange(len(sums))] < 0, -1.0, 1.0)
    used = min(used, components)
    return Whitening(centre, values[:used], unit[:, :used], trace)


def transform(vectors: DataFrame, w: Whitening) -> DataFrame:
    """``id, deviation, v`` of each row of ``id, v``: the whitened vector. A map, no shuffle."""
    schema = T.StructType([vectors.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType(), False))])
    project = w.vectors / np.sqrt(w.values)

    def factory():
        def f(b: pa.RecordBatch) -> dict:
            x = scaled(matrix(b.column(1)))
            got = w.centre(x)[0] @ project if len(x) else np.empty((0, project.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * project.shape[1]), pa.array(got.ravel()))
            return {"id": b.column(0), "deviation": w.centre.deviation(x) if len(x) else [], "v": lists}

        return f

    return map_batches(vectors.select("id", "v"), factory, schema)


def identity_error(white: DataFrame) -> float:
    """Largest absolute entry of the covariance of the rows of ``v`` less the identity."""
    hi, lo = summed(white, exact, column_sums)[0]
    n = hi[-1]
    mean = hi[:-1] / n, lo[:-1] / n
    rows = summed(white, lambda v: two_sum(v - mean[0], -mean[1]), outer)
    cov = np.stack([rows[k][0] + rows[k][1] for k in range(len(rows))]) / n
    return float(np.abs(cov - np.eye(len(cov))).max())


def whitened(df: DataFrame, components: int = 32, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row of each usable vector and component: its coordinate, the share of variance, and how far the result is from white."""
    vectors = usable(df, id, vector)
    w = fit(vectors, components)
    if w is None:
        names = f"{id} {df.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], names)
    white = stored(transform(vectors, w), "whitened")
    share = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    rows = white.select(F.col("id").alias(id), "deviation", F.posexplode("v").alias("at", "whitened"))
    return rows.select(id, (F.col("at") + 1).alias("component"), F.lit(w.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(white)).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
