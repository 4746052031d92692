"""Joins that need a composition: as-of, last value at a date, marked left joins, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, payload: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are united and sorted once; a window carries the last right row
    forward. Right rows that share a time are ordered by ``tie``.
    """
    body = [c for c in left.columns if c not in by and c != at]
    a = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__tie"), F.struct(*body).alias("__l"))
    b = right.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(None)).alias("__tie"), F.struct(F.col(at).alias("__time"), *payload).alias("__r"))
    u = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("__at", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    got = u.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return got.select(*by, F.col("__at").alias(at), "__l.*", F.col("__m.__time").alias("matched_at"), *[F.col(f"__m.{c}").alias(c) for c in payload])


def last_at(df: DataFrame, by: list[str], day: str, value: str, limit: Column) -> DataFrame:
    """The last known value of each key at or before a date."""
    t = df.where((F.col(day) <= limit) & F.col(value).isNotNull())
    return t.groupBy(*by).agg(F.max_by(value, day).alias(value), F.max(day).alias(day))


def marked_left(left: DataFrame, right: DataFrame, on: list[str], name: str = "matched") -> DataFrame:
    """Left join with a flag that tells whether the key was found; keys of ``right`` are made unique first."""
    return left.join(right.dropDuplicates(on).withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unseen(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key; ``new`` has a key once."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_override(items: DataFrame, overrides: DataFrame, fields: list[str], order: str, item_key: list[str]) -> DataFrame:
    """Each item with the first override all of whose given (non-null) fields equal it.

    Overrides that give the same set of fields are joined by equality of these, a join for each set that occurs; the first over all sets is kept.
    """
    rest = [c for c in overrides.columns if c not in fields]
    given = F.array(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(fields)])
    given = F.array_compact(given) if fields else F.array().cast("array<int>")
    sets = sorted(tuple(r[0]) for r in overrides.select(given).distinct().collect())  # of few fields
    t, held = items, [F.lit(None)]
    for k, chosen in enumerate(sets):
        on = [fields[i] for i in chosen]
        body = F.struct(F.col(order).alias("__order"), F.lit(k).alias("__k"), *[F.col(c).alias(f"__{c}") for c in rest])
        o = overrides.where(given == F.lit(list(chosen)).cast("array<int>")).groupBy(*on).agg(F.min_by(body, F.struct(F.col(order).isNull(), order)).alias(f"__set{k}"))
        t = t.join(o, on, "left") if on else t.join(F.broadcast(o), how="left")  # one row
        held.append(f"__set{k}")
    if not sets:
        t = t.withColumn("__set0", F.lit(None).cast(overrides.select(F.struct(F.col(order).alias("__order"), F.lit(0).alias("__k"), *[F.col(c).alias(f"__{c}") for c in rest])).schema[0].dataType))
        held.append("__set0")
    first = F.try_element_at(F.array_sort(F.filter(F.array(*held), lambda x: x.isNotNull()), lambda a, b: F.when(a["__order"].isNull() & b["__order"].isNotNull(), 1).when(a["__order"].isNotNull() & b["__order"].isNull(), -1).when(a["__order"] < b["__order"], -1).when(a["__order"] > b["__order"], 1).otherwise(a["__k"] - b["__k"])), F.lit(1))
    t = t.withColumn("__first", first).drop(*held[1:])
    t = t.withColumn("__i", F.row_number().over(W.partitionBy(*item_key).orderBy(F.col("__first")["__order"].asc_nulls_last()))).where("__i = 1")
    return t.select(*items.columns, *[F.col("__first")[f"__{c}"].alias(c) for c in rest])


def point_in_boxes(points: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Points inside no box of their page."""
    b = boxes.select(F.col(page).alias("__p"), "x0", "y0", "x1", "y1")
    inside = (F.col(page) == F.col("__p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.join(b, inside, "left_anti")


def dealt(rows: DataFrame, on: list[str], most: int = 256) -> DataFrame:
    """``on, part, items``: the rows of each key in lists of about ``most``, by a hash of the columns that aren't in ``on``.

    Lists meet in :func:`every_pair`, so a key's rows needn't be one task's. The hash can't part rows that are equal in all columns.
    """
    rest = [c for c in rows.columns if c not in on]
    largest = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64(*rest), F.lit(-(-largest // most))).alias("part")
    return rows.groupBy(*on, part).agg(F.collect_list(F.struct(*rest)).alias("items"))


def every_pair(pairs: DataFrame, left: DataFrame, right: DataFrame, on_left: list[str], on_right: list[str], tasks: int = 1) -> DataFrame:
    """Each row of ``pairs`` with every two items of its keys, as structs ``l`` and ``r``; both sides come from :func:`dealt`.

    What grows with the square of a key is the number of pairs of lists, and these are dealt over all tasks. A left list is taken to rows before these
    meet right lists, as Spark holds all that a row is taken to at once: so it holds a list, not the product of two. The rows aren't sorted for it;
    a task holds the right lists of its share, each once. Rows are few beside what they make, so Spark would give them to few tasks: ``tasks`` above 1 sets how many.
    """
    a = left.select(*on_left, F.col("part").alias("__p"), F.col("items").alias("__l"))
    b = right.select(*on_right, F.col("part").alias("__q"), F.col("items").alias("__r"))
    t = pairs.join(a.drop("__l"), on_left).join(b.drop("__r"), on_right)
    t = t.join(a.hint("merge"), [*on_left, "__p"]).select(*pairs.columns, "__q", F.explode("__l").alias("l"))  # here and below a broadcast would leave all pairs to the few tasks that hold one side
    if tasks > 1:
        t, b = (x.repartition(tasks, *on_right, "__q") for x in (t, b))
    return t.join(b.hint("shuffle_hash"), [*on_right, "__q"]).select(*pairs.columns, "l", F.explode("__r").alias("r"))
