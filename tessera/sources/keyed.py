"""Tables that are upserted by key: rows lie in buckets by a hash of the key, and a version names the folder of each bucket.

A write reads and replaces only the buckets that its keys fall into, so what it costs follows the batch, not the table. Data
files come first and the version's manifest, one small file, last: readers follow the newest manifest and see the old version or
the new one, and a write that broke off leaves no trace but files that :meth:`KeyedTable.expire` deletes. Two writers
can't both make the same version; the later one gets an error and may try again.

A batch may carry the name of its run and a number; a number that was written before is passed over, so streams can repeat a
batch. Independent of that, :meth:`KeyedTable.insert` writes only keys that the table doesn't have and tells which ones were there,
so a day that is run again, however much later, adds nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knowledge import latest
from tessera.session import stored

#: Rows of a file that a write aims at.
FILE_ROWS = 1_000_000


@dataclass
class Version:
    number: int
    buckets: int
    key: list[str]
    order: list[str]
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    runs: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """A table at ``path``, in any file system that Spark reads.

    ``order`` names the columns that say which of a key's rows is the latest; among equal ones the row written last wins.
    ``buckets`` is fixed when the table is made: about as many as rows / 1,000,000 at its final size, times
    what a batch should be able to leave alone.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), list(key), list(order), buckets

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._list(f"{self.path}/_versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or the one of that number."""
        known = self.versions()
        if not known:
            return None
        fs, p = self._fs(f"{self.path}/_versions/{known[-1] if number is None else number:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        v = Version(**json.loads(text))
        if v.key != self.key or v.order != self.order:
            raise ValueError(f"{self.path} is kept by {v.key} in the order of {v.order}")
        return v

    def _commit(self, v: Version) -> None:
        fs, draft = self._fs(f"{self.path}/_versions/.draft-{self.spark._jvm.java.util.UUID.randomUUID()}")
        out = fs.create(draft, True)
        out.write(json.dumps(v.__dict__, ensure_ascii=False).encode())
        out.close()
        _, final = self._fs(f"{self.path}/_versions/{v.number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {v.number} of {self.path} was written by someone else")

    # --- reading

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.hash(*[F.col(k) for k in self.key]), F.lit(buckets))

    def _rows(self, v: Version, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(v.schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        if v is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        return self._rows(v, sorted(v.folders.values()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the table with one of the keys; only the buckets that hold them are opened."""
        v = self.version()
        if v is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(v.schema)}
        keys = keys.select(*[F.col(k).cast(kinds[k]).alias(k) for k in self.key]).distinct()
        touched = [str(r[0]) for r in keys.select(self.bucket(v.buckets)).distinct().collect()]
        return self._rows(v, [v.folders[b] for b in touched if b in v.folders]).join(keys, self.key, "left_semi")

    # --- writing

    def _begin(self, batch: DataFrame, run: tuple[str, int] | None) -> tuple[Version, bool]:
        v = self.version() or Version(-1, self.buckets, self.key, self.order, json.loads(batch.schema.json()))
        return v, bool(run and v.runs.get(run[0], -1) >= run[1])

    def _write(self, v: Version, rows: DataFrame, batch: DataFrame, run: tuple[str, int] | None) -> Version:
        """``rows`` replace the buckets of ``batch``, both with a column ``__b``."""
        number = v.number + 1
        runs = v.runs | ({run[0]: run[1]} if run else {})
        touched = [r[0] for r in batch.select("__b").distinct().collect()]
        folders, counts = dict(v.folders), dict(v.rows)
        if touched:
            old = sum(counts.get(str(b), 0) for b in touched)
            files = math.ceil((old + batch.count()) / FILE_ROWS / len(touched))
            at = f"{self.path}/data/v={number}"
            rows.repartition(max(1, len(touched) * files), "__b", F.pmod(F.xxhash64(*self.key), F.lit(files))).write.mode("overwrite").partitionBy("__b").parquet(at)
            written = {r["__b"]: r["n"] for r in self.spark.read.parquet(at).groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}
            for b, n in written.items():
                folders[str(b)], counts[str(b)] = f"data/v={number}/__b={b}", n
        new = Version(number, v.buckets, v.key, v.order, v.schema, folders, counts, runs)
        self._commit(new)
        return new

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        return latest(rows, [*self.key, "__b"], order) if order else rows.dropDuplicates(self.key)

    def _shaped(self, v: Version, batch: DataFrame) -> DataFrame:
        schema = T.StructType.fromJson(v.schema)
        return batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def upsert(self, batch: DataFrame, run: tuple[str, int] | None = None) -> Version:
        """The latest row of each key of the table and the batch. A batch of a run that was written before changes nothing."""
        v, seen = self._begin(batch, run)
        if seen:
            return v
        b = stored(self._last(self._shaped(v, batch).withColumn("__b", self.bucket(v.buckets)), self.order), "keyed-batch")
        touched = [str(r[0]) for r in b.select("__b").distinct().collect()]
        old = self._rows(v, [v.folders[t] for t in touched if t in v.folders]).withColumn("__b", self.bucket(v.buckets))
        both = old.withColumn("__new", F.lit(0)).unionByName(b.withColumn("__new", F.lit(1)))
        return self._write(v, latest(both, [*self.key, "__b"], [*self.order, "__new"]).drop("__new"), b, run)

    def insert(self, batch: DataFrame, run: tuple[str, int] | None = None) -> DataFrame:
        """Writes rows whose key is new, the first by ``order`` of each; gives back the others, with ``same`` telling whether the row that is kept is equal.

        Equal rows of one batch count once.
        """
        v, seen = self._begin(batch, run)
        shaped = self._shaped(v, batch).withColumn("__b", self.bucket(v.buckets))
        if seen:
            return shaped.drop("__b").where("false").withColumn("same", F.lit(True))
        rest = [c for c in shaped.columns if c not in (*self.key, "__b")]
        mine = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
        given = stored(shaped.withColumn("__h", mine).distinct(), "keyed-batch")
        touched = [str(r[0]) for r in given.select("__b").distinct().collect()]
        old = self._rows(v, [v.folders[t] for t in touched if t in v.folders]).withColumn("__b", self.bucket(v.buckets)).withColumn("__h", mine)
        first = F.min(F.struct(F.col("__old"), *self.order, *[c for c in (*rest, "__h") if c not in self.order])).alias("r")
        held = old.withColumn("__old", F.lit(0)).unionByName(given.withColumn("__old", F.lit(1))).groupBy(*self.key, "__b").agg(first).select(*self.key, "__b", "r.*")
        held = stored(held, "keyed-held")
        new = held.where("__old = 1")
        kept = held.join(new.select("__b").distinct(), "__b", "left_semi")
        self._write(v, kept.select(*self.key, *rest, "__b"), new, run)
        mark = held.select(*[F.col(k).alias(f"__key_{k}") for k in self.key], F.col("__h").alias("__kept"), "__old")
        on = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in self.key])
        met = given.join(mark, on).withColumn("same", F.col("__h") == F.col("__kept"))
        return met.where("__old = 0 OR NOT same").select(*self.key, *rest, "same")

    def expire(self, keep: int = 2) -> int:
        """Deletes versions before the last ``keep`` and folders that none of these names; gives back the number of folders."""
        known = self.versions()
        held = {f for n in known[-keep:] for f in self.version(n).folders.values()}
        gone = 0
        for name in self._list(f"{self.path}/data"):
            if int(name.split("=")[1]) > known[-1]:
                continue  # someone may be writing it
            for bucket in self._list(f"{self.path}/data/{name}"):
                if bucket.startswith("__b=") and f"data/{name}/{bucket}" not in held:
                    fs, p = self._fs(f"{self.path}/data/{name}/{bucket}")
                    gone += fs.delete(p, True)
        for n in known[:-keep]:
            fs, p = self._fs(f"{self.path}/_versions/{n:012d}.json")
            fs.delete(p, False)
        return gone
