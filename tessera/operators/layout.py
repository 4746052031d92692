"""Tables found in the positions of words, and rows of shapes, by sweeps over sorted positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.session import release, spread, stored


def swept(df: DataFrame, by: list[str], low: str, high: str, gap: float, name: str) -> DataFrame:
    """Numbers the groups of intervals that a sweep finds: a new one begins where an interval starts more than ``gap`` after all before it have ended."""
    order = [low, high, *[c for c in ("y0", "y1", "x0", "x1", "text") if c not in (low, high)]]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col(low) > F.max(high).over(w) + gap, F.lit(True)).cast("int")
    upto = W.partitionBy(*by).orderBy(*order, F.desc("__new")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(upto).cast("int")).drop("__new")


def cells(spans: DataFrame, row_gap: float = 0.0, column_gap: float = 8.0, table_gap: float = 12.0) -> DataFrame:
    """``page, table, row, column, text`` of spans ``page, x0, x1, y0, y1, text`` (y down); what has one row or one column is no table.

    Rows and blocks are groups of intervals of y, columns groups of intervals of x within a block; the texts of a cell are joined in the order of y and x.
    Spans without text or position are left out; a span over two columns makes them one.
    """
    t = spans.where("trim(text) <> '' AND x0 <= x1 AND y0 <= y1").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    t = swept(t, ["page"], "y0", "y1", table_gap, "table")
    t = swept(t, ["page", "table"], "y0", "y1", row_gap, "row")
    t = swept(t, ["page", "table"], "x0", "x1", column_gap, "column")
    whole = W.partitionBy("page", "table")
    t = t.withColumn("__rows", F.max("row").over(whole)).withColumn("__columns", F.max("column").over(whole)).where("__rows > 1 AND __columns > 1")
    words = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"])
    return t.groupBy("page", "table", "row", "column").agg(F.array_join(words, " ").alias("text"), F.first("__columns").alias("columns"))


def tables_of(spans: DataFrame, **gaps: float) -> DataFrame:
    """``page, table, rows, columns, markdown`` of the tables in spans, the first row as the head; ``table`` counts blocks of a page."""
    c = cells(spans, **gaps).withColumn("text", F.replace("text", F.lit("|"), F.lit("\\|")))
    line = F.map_from_entries(F.collect_list(F.struct("column", "text")))
    rows = c.groupBy("page", "table", "row").agg(F.first("columns").alias("columns"), line.alias("cells"))
    text = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("columns")), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(""))), " | "), F.lit(" |"))
    rows = rows.select("page", "table", "columns", F.struct("row", text.alias("line")).alias("r"))
    g = rows.groupBy("page", "table").agg(F.first("columns").alias("columns"), F.count(F.lit(1)).cast("int").alias("rows"), F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]).alias("lines"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("columns")))
    return g.select("page", "table", "rows", "columns", F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))), "\n").alias("markdown"))


def next_rows(tops: DataFrame, page: str, tolerance: float) -> DataFrame:
    """``page, top, next``: for each distinct top of a page the first one more than ``tolerance`` below it, by one sweep from the bottom."""
    own = W.partitionBy(page).orderBy("top")
    t = tops.select(page, "top", F.struct(F.lag("top").over(own).alias("before"), F.col("top").alias("at"), F.lead("top").over(own).alias("after")).alias("d"))
    asked = t.select(page, (F.col("top") + tolerance).alias("pos"), F.lit(1).alias("kind"), F.col("top").alias("of"), F.lit(None).cast(t.schema["d"].dataType).alias("d"))
    sweep = W.partitionBy(page).orderBy(F.desc("pos"), "kind").rowsBetween(W.unboundedPreceding, 0)
    both = t.select(page, F.col("top").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("of"), "d").unionByName(asked)
    found = both.withColumn("d", F.last("d", ignorenulls=True).over(sweep)).where("kind = 1")
    # the sum above may be rounded, so the neighbours of the place found are held against the difference itself
    last = t.groupBy(page).agg(F.max("top").alias("last"))
    found = found.join(last, page)
    apart = lambda c: c - F.col("of") > tolerance
    nearest = F.coalesce(*[F.when(apart(F.col(f"d.{c}")), F.col(f"d.{c}")) for c in ("before", "at", "after")])
    return found.select(page, F.col("of").alias("top"), F.coalesce(nearest, F.when(F.col("d").isNull() & apart(F.col("last")), F.col("last"))).alias("next"))


def row_groups(shapes: DataFrame, page: str, tolerance: float = 0.5) -> DataFrame:
    """``page, id, row, place``: shapes from the top, in rows that begin with a shape and take those within ``tolerance`` of its top; each row from the left.

    Where a row begins follows from where the one before began. So every top points to the first one out of its reach, and pointers are
    doubled: after ``k`` rounds the first ``2**k`` rows of all pages are known, with no list of a page's shapes anywhere. Shapes without
    a top are left out.
    """
    shapes = shapes.where("top IS NOT NULL")
    tops = stored(shapes.select(page, F.col("top").cast("double").alias("top")).distinct(), "tops")
    jump = stored(next_rows(tops, page, tolerance).where("next IS NOT NULL"), "jumps")
    begun = stored(tops.groupBy(page).agg(F.min("top").alias("top")), "begun")
    known = begun.count()
    while True:
        ahead = begun.join(jump, [page, "top"]).select(page, F.col("next").alias("top"))
        more = stored(begun.unionByName(ahead).distinct(), "begun")
        release(begun)
        begun, n = more, more.count()
        if n == known:
            break
        known = n
        twice = stored(jump.join(jump.select(page, F.col("top").alias("next"), F.col("next").alias("beyond")), [page, "next"]).select(page, "top", F.col("beyond").alias("next")), "jumps")
        release(jump)
        jump = twice
    order = W.partitionBy(page).orderBy("top").rowsBetween(W.unboundedPreceding, 0)
    rows = tops.join(begun.withColumn("first", F.lit(1)), [page, "top"], "left").withColumn("row", F.count("first").over(order).cast("int")).select(page, "top", "row")
    placed = shapes.withColumn("top", F.col("top").cast("double")).join(rows, [page, "top"])
    return placed.select(page, "id", "row", F.row_number().over(W.partitionBy(page).orderBy("row", "left", "id")).alias("place"))


def closure(pairs: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """``term, synonym``: what each term leads to over one or more of the pairs ``term, synonym``; a term leads to itself only over a circle.

    Semi-naive: each round joins only what the round before found anew with the pairs.
    """
    pairs = stored(pairs.select("term", "synonym").where("term IS NOT NULL AND synonym IS NOT NULL").distinct(), "pairs")
    found = new = pairs
    step = pairs.select(F.col("term").alias("synonym"), F.col("synonym").alias("further"))
    parts = [pairs]
    for _ in range(most_rounds):
        new = stored(new.join(step, "synonym").select("term", F.col("further").alias("synonym")).distinct().join(found, ["term", "synonym"], "left_anti"), "closure")
        if new.isEmpty():
            release(new)
            return found
        parts.append(new)
        found = found.unionByName(new)
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def expanded(queries: DataFrame, closed: DataFrame, key: Column) -> DataFrame:
    """``query`` with every term of a closure that it names by ``key`` (a column of ``term``) and what these lead to.

    Terms are found by equality of the query's substrings with the keys, so only terms that match are made. Substrings
    are made of the lengths that keys have and aren't made distinct: what a query names twice goes with the last step.
    """
    terms = stored(closed.select("term").distinct().withColumn("key", key).where("key <> ''"), "terms")
    sizes = [r["n"] for r in terms.select(F.length("key").alias("n")).distinct().orderBy("n").collect()]
    q = spread(stored(queries.select("query").where("query IS NOT NULL").distinct(), "queries"), "query")
    starts = q.select("query", F.length("query").alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("query"), F.lit(1)))).alias("at"))
    cut = starts.withColumn("k", F.explode(F.lit(sizes).cast("array<int>"))).where("at + k - 1 <= n").select("query", F.expr("substr(query, at, k)").alias("key"))
    named = cut.join(terms, "key").select("query", "term")
    return named.select("query", F.col("term").alias("synonym")).unionByName(named.join(closed, "term").select("query", "synonym")).distinct()
