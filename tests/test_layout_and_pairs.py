"""Tiles of series, tables from spans, rows of shapes and closures against plain computations."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import layout, pairs


def test_tiles_give_what_single_pairs_give(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{d}", f"s{k}", None if rng.random() < 0.1 else float(rng.normal() + 100 * k)) for k in range(23) for d in range(70) if rng.random() < 0.7]
    rows += [("d1", "flat", 1.0), ("d2", "flat", 1.0), ("d3", "once", 2.0), ("never", "alone", 3.0)]
    df = spark.createDataFrame(rows, "day string, series string, ret double")
    wide = pd.DataFrame(rows, columns=["day", "series", "ret"]).pivot(index="day", columns="series", values="ret")
    cov, corr = wide.cov(min_periods=2), wide.corr(min_periods=2)
    for sizes in ({}, {"tile": 5, "days": 16}):
        got = {(r["a"], r["b"]): r["cov"] for r in pairs.covariance(df, **sizes).collect()}
        both = {(a, b) for a, b in itertools.combinations_with_replacement(sorted(wide.columns), 2) if (wide[a].notna() & wide[b].notna()).any()}
        assert set(got) == both
        assert all(got[p] is None if np.isnan(cov.loc[p]) else abs(got[p] - cov.loc[p]) < 1e-9 for p in both)
        got = {(r["a"], r["b"]): r["corr"] for r in pairs.correlations(df, **sizes).collect()}
        assert all(v is None if np.isnan(corr.loc[p]) else abs(v - corr.loc[p]) < 1e-9 for p, v in got.items()) and len(got) == sum(a < b for a, b in both)
    assert pairs.covariance(df.limit(0)).count() == 0
    twice = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "x", 4.0)], df.schema)
    assert pairs.covariance(twice).first()["cov"] == 2.0


def test_tables_from_spans(spark):
    spans = []
    for r, line in enumerate([["Name", "Share", "Note"], ["alpha fund", "1|2", ""], ["beta", "", "two words"]]):
        spans += [(1, 100.0 * c, 100.0 * c + 40, 20.0 * r, 20.0 * r + 10, t) for c, t in enumerate(line)]
    spans += [(1, 142.0, 150.0, 20.0, 30.0, " more ")]  # so close that it belongs to the cell before
    spans += [(1, 0.0, 300.0, 200.0, 210.0, "a paragraph"), (1, 0.0, 280.0, 212.0, 222.0, "of two lines"), (2, 0.0, 10.0, 0.0, 5.0, "one"), (2, 50.0, 60.0, 0.0, 5.0, "row"), (3, None, 1.0, 0.0, 1.0, "x"), (3, 0.0, 1.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(spans, "page int, x0 double, x1 double, y0 double, y1 double, text string")
    got = layout.tables_of(df).collect()
    assert [(r["page"], r["rows"], r["columns"]) for r in got] == [(1, 3, 3)]
    assert got[0]["markdown"] == "| Name | Share | Note |\n| --- | --- | --- |\n| alpha fund | 1\\|2 more |  |\n| beta |  | two words |"
    assert layout.tables_of(df.limit(0)).count() == 0


def folded(shapes, tolerance):
    out, start, row = {}, None, 0
    for top, left, k in sorted(shapes):
        if start is None or top - start > tolerance:
            start, row = top, row + 1
        out[k] = row, left
    order = sorted(out, key=lambda k: (*out[k], k))
    return {k: (out[k][0], place) for place, k in enumerate(order, 1)}


def test_rows_of_shapes(spark):
    rng = np.random.default_rng(2)
    rows = [(p, k + 1000 * p, round(float(rng.integers(0, 60)) / 10, 1), float(rng.integers(0, 5))) for p in range(4) for k in range([1, 7, 90, 200][p])] + [(9, 9_000, None, 1.0)]
    df = spark.createDataFrame(rows, "page int, id long, top double, left double")
    for tolerance in (0.5, 0.3, 0.0, 100.0):
        got = {r["id"]: (r["row"], r["place"]) for r in layout.row_groups(df, "page", tolerance).collect()}
        want = {}
        for p in range(4):
            want |= folded([(t, x, k) for q, k, t, x in rows if q == p], tolerance)
        assert got == want
    assert layout.row_groups(df.limit(0), "page").count() == 0


def test_a_page_of_very_many_shapes(spark):
    df = spark.range(300_000).select(F.lit(1).alias("page"), "id", (F.col("id") % 60_000 * 0.25).alias("top"), (F.col("id") % 7).cast("double").alias("left"))
    got = layout.row_groups(df, "page").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("rows"), F.max("place").alias("places")).first()
    assert tuple(got) == (300_000, 20_000, 300_000)


def test_closure_and_expansion(spark):
    given = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("a", "b"), (None, "q"), ("q", None)] + [(f"n{k}", f"n{k + 1}") for k in range(20)]
    closed = layout.closure(spark.createDataFrame(given, "term string, synonym string"))
    got = sorted(map(tuple, closed.collect()))
    want = {p for p in given if None not in p}
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert got == sorted(want)
    asked = spark.createDataFrame([("has x and n19 ",), ("nothing",), ("",), (None,)], "query string")
    assert sorted((r["query"], r["synonym"]) for r in layout.expanded(asked, closed.where("term IN ('x', 'n19', 'b')"), F.col("term")).collect()) == [("has x and n19 ", s) for s in ("n19", "n20", "x", "y", "z")]
    assert layout.closure(spark.createDataFrame([], "term string, synonym string")).count() == 0
