"""Functions of a user's own over groups, and numbers of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.session import stored


def grouped_apply(df: DataFrame, by: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most_rows: int = 1_000_000) -> DataFrame:
    """``function`` on each group's rows, in Arrow batches; a group must fit one task, so its size is checked first."""
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if top > most_rows:
        raise ValueError(f"a group of {top} rows, more than {most_rows}: use grouped_fold, write it with built-in aggregates or split the key")
    return df.groupBy(*by).applyInPandas(function, schema)


def grouped_fold(df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], dict], merge: Callable[[pd.DataFrame], dict], state: str, salts: int = 64) -> DataFrame:
    """One row of ``by`` and ``state`` a group of any size.

    ``partial`` makes a state of some of a group's rows, in any order; ``merge`` makes one of several. Rows don't move: each Arrow batch
    gives a state for each of its groups; these are merged in each partition, by salts and then by group. Null keys are a group.
    """
    kinds = dict(df.select(*by).dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), state])

    def folded(p: pd.DataFrame, f: Callable[[pd.DataFrame], dict]) -> pd.DataFrame:
        rows = [dict(zip(by, key, strict=True)) | f(g) for key, g in p.groupby(by, dropna=False, sort=False)]
        return pd.DataFrame(rows).astype({c: object for c in by})

    def states(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            if len(b):
                held.append(folded(b, partial))
                n += len(held[-1])
            if len(held) > 1 and n > 10_000:  # many groups, or many batches
                one = folded(pd.concat(held), merge)
                if len(one) > 5_000:
                    yield one
                    one = one.iloc[:0]
                held, n = ([one] if len(one) else []), len(one)
        if held:
            yield folded(pd.concat(held), merge)

    def merged(p: pd.DataFrame) -> pd.DataFrame:
        return folded(p[[c for c in p.columns if c != "__salt"]], merge)

    few = df.mapInPandas(states, schema).withColumn("__salt", (F.rand(7) * salts).cast("int"))
    few = few.groupBy(*by, "__salt").applyInPandas(merged, schema)
    return few.groupBy(*by).applyInPandas(merged, schema)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` and each row's number, from 1, in its group's order; no group is one task's, as rows are dealt by ranges of group and order.

    Rows equal in ``by`` and ``order`` share a task and are numbered in any order. ``df`` is stored once, so ranges stay as they are.
    """
    t = stored(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    key = [*by, "__range"]
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    at = t.groupBy(*key).count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    at = at.select(*[F.col(c).alias(f"__{k}_at") for k, c in enumerate(key)], "__before")
    t = t.withColumn("__own", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    for k, c in enumerate(key):
        on = F.col(c).eqNullSafe(F.col(f"__{k}_at")) if k == 0 else on & F.col(c).eqNullSafe(F.col(f"__{k}_at"))
    return t.join(at, on).select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))
