"""What the operators on embeddings share: usable vectors, their dimension, batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` of rows whose vector is not null and holds only finite entries, as doubles; of several lengths only the commonest (then longest) counts.

    Only one row, the length, comes to the driver. Empty vectors are not usable.
    """
    got = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    got = got.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    commonest = got.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got.where(F.size("v") == (commonest["d"] if commonest else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of a column of equally long lists as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
