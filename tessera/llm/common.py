"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one hot key are dealt over so many tasks.
SALTS = 32

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def arrow_map(df: DataFrame, run, schema: T.StructType, most_rows: int = 1_000) -> DataFrame:
    """``mapInArrow`` with batches of at most ``most_rows`` rows (and of the bytes that the session allows).

    Texts may be long, and a worker holds a batch several times over, so the session's
    larger default is lowered; a lower one stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= most_rows:
        conf.set(key, str(most_rows))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, factory: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType) -> DataFrame:
    """Arrow map: ``factory()`` runs once in a task, what it returns turns each batch into columns of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f = factory()
        for b in batches:
            got = f(b)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := got[a.name], pa.Array) and x.type == a.type else pa.array(x, type=a.type) if not isinstance(x, pa.Array) else x.cast(a.type) for a in arrow], schema=arrow)

    return arrow_map(df, run, schema)


def filter_batches(df: DataFrame, factory: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """Arrow map that keeps all columns: for each text, ``None`` drops the row, else the value replaces the text.

    The function gets the list of texts and returns a list of ``(keep, text)``; no
    shuffle is needed, whatever other columns there are.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f = factory()
        for b in batches:
            got = f(b.column(at).to_pylist())
            b = b.set_column(at, b.schema.field(at), pa.array([t for _, t in got], type=b.schema.field(at).type))
            yield b.filter(pa.array([k for k, _ in got], type=pa.bool_()))

    return arrow_map(df, run, df.schema)


def salt_of(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts)).cast("int")


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], n: str = "n", salts: int = SALTS) -> DataFrame:
    """Left join to at most one row of ``right`` a key, where a key may hold any share of ``left``.

    ``right`` is a stored table whose column ``n`` says how many rows of ``left`` have
    the key. Keys with more than a hundred-thousandth of all rows (and over 1,000)
    are hot: there can be 100,000 of them at most, so their list is safe to broadcast.
    Rows of a hot key are dealt over ``salts`` by a hash of ``spread``, and its row of
    ``right`` is repeated for each salt; ``n`` isn't part of the result.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(1_000, total // 100_000)
    marked = left.join(F.broadcast(right.where(hot).select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    a = marked.withColumn("__salt", F.when(F.col("__hot"), salt_of(*spread, salts=salts)).otherwise(F.lit(0))).drop("__hot")
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(hot, salts - 1).otherwise(0)))).drop(n)
    return a.join(b, [*keys, "__salt"], "left").drop("__salt")


def training_part(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows whose ``crc32(doc_id as text)`` isn't divisible by ``folds``."""
    return df.where(F.col("doc_id").isNotNull() & ~held_out(folds))


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(df: DataFrame, stratum: str, rows: int, order: str = "doc_id", max_strata: int = 1_000, max_rows: int = 100_000) -> list:
    """About ``rows`` rows of each stratum, at most twice that, on the driver; the same rows on every run.

    Counts come first; then rows whose hash is below a stratum's share pass a filter,
    so no stratum is sorted and only the sample moves. Of more than ``max_strata`` strata the
    largest are sampled; where ``rows`` of each would be over ``max_rows``, each gets fewer.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(max_strata).collect()}
    if not counts:
        return []
    rows = max(1, min(rows, max_rows // len(counts)))
    h = F.pmod(F.xxhash64(order, F.lit(17)), F.lit(1 << 32))
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, rows / n) * (1 << 32))))])
    got = df.where(h < F.element_at(limit, F.col(stratum))).withColumn("__h", h).orderBy("__h", *[c for c in df.columns if c != "__h"]).limit(2 * rows * len(counts)).collect()
    out, seen = [], dict.fromkeys(counts, 0)
    for r in got:
        seen[r[stratum]] += 1
        if seen[r[stratum]] <= 2 * rows:
            out.append(r)
    return out
