"""Streams over files: idempotent appends, upserts to a latest table, windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.keyed import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; :func:`insert_batches` remembers for good."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def upsert_batches(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, buckets: int = 64):
    """Starts a query that keeps the latest row of each key in a keyed table; a batch that is run again changes nothing."""
    held = KeyedTable(stream.sparkSession, path, key, order, buckets)

    def write(batch: DataFrame, epoch: int) -> None:
        held.upsert(batch, (checkpoint, epoch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_batches(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, repeats: str, buckets: int = 64):
    """Starts a query that writes each key once, whenever its day is run again, and keeps what came again in a folder ``repeats`` by batch.

    Other than a watermark this forgets nothing: whether a key is known is read from its bucket of the table.
    """
    held = KeyedTable(stream.sparkSession, path, key, order, buckets)

    def write(batch: DataFrame, epoch: int) -> None:
        again = held.insert(batch, (checkpoint, epoch))
        again.write.mode("overwrite").parquet(f"{repeats}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
