"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token counts of the
cells are raked: the cells' weights are scaled to the target of each margin in
turn, over and over, until all margins fit. What comes out is a factor for each
cell; a document's sampling probability is its cell's factor, scaled so that a
wanted number of tokens is expected: ``tokens_wanted``, or without targets the
share ``keep`` of all tokens. As nothing can be taken more than once, a cell's
probability ends at 1 and the others are fitted to what it leaves, so a tiny
source is taken whole and doesn't lower the rate of the rest. With targets but
no wanted tokens the largest probability is 1. Whether a document is taken
depends on a hash of its id and text alone, so any number of runs and executors
gives the same sample.

Tokens are counted once for each cell, with map-side sums, so a source may hold
any share of the rows. Cells are counted before they reach the driver; beyond
``max_cells`` the fitting runs as aggregations over a stored table of cells
instead, with the same result. Margins that the cells can't fit, or not within
``rounds``, give a warning with the largest miss; :func:`margins` tells what came out. Factors go back to documents by a join that
broadcasts only up to that many cells.

The topic is one of the text's form, as the data have no subject; ``topic`` takes any other column.

Defined cases: an empty table gives no rows; very long texts are counted to their end; null or empty text has no tokens, and a cell without any tokens
has probability 0; null source and language are values of their own (written ``?``);
targets for values that don't occur are left out and the others scaled to sum to
one; values without a target are dropped from the sample (probability 0) if a
margin has targets; a margin with too many values for the driver keeps its
targets as a table; repeated rows are treated alike; :func:`sample` keeps all
columns of ``docs`` but such as begin with ``mix_``, which it replaces by its own.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import release, stored, table

MARGINS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic from the text's form, as the data have no subject: table, marked up, shouted, licensed, short or long prose."""
    n = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.regexp_count(text, F.lit(r" \| ")) * 40 > n, "table")
        .when(F.regexp_count(text, F.lit(r"[#*$%&]{3}")) * 60 > n, "markup")
        .when(F.regexp_count(text, F.lit("!!")) * 40 > n, "shouted")
        .when(text.rlike(r"(?i)licensed under|all rights reserved|copyright"), "licensed")
        .when(n < 1_000, "short")
        .otherwise("long")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with ``mix_source, mix_lang, mix_topic, mix_tokens``."""
    return docs.select(*[c for c in docs.columns if not c.startswith("mix_")]).withColumns({
        "mix_source": F.coalesce(F.col("source"), F.lit("?")),
        "mix_lang": F.coalesce(F.col("lang"), F.lit("?")),
        "mix_topic": topic_of(F.col("text")) if topic is None else F.coalesce(topic.cast("string"), F.lit("?")),
        "mix_tokens": token_count(F.col("text")),
    })


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Tokens and documents of each cell, stored."""
    return stored(with_cells(docs, topic).groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")


def tempered(cells: DataFrame, margin: str, power: float, max_values: int = 100_000) -> dict[str, float] | DataFrame:
    """Targets of a margin: its shares of tokens to a power, so that small values get more.

    A dictionary for up to ``max_values`` values, else a table ``value, target`` that stays distributed.
    """
    sums = cells.groupBy(F.col(f"mix_{margin}").alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    if sums.limit(max_values + 1).count() > max_values:
        total = sums.agg(F.sum("tokens")).first()[0]
        raw = sums.select("value", F.pow(F.col("tokens") / total, power).alias("raw"))
        return stored(raw.select("value", (F.col("raw") / raw.agg(F.sum("raw")).first()[0]).alias("target")), "targets")
    rows = sums.collect()
    total = sum(r[1] for r in rows)
    raw = {r[0]: (r[1] / total) ** power for r in sorted(rows)}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()}


def _reachable(sums, cap: float) -> float:
    """By how much targets are scaled so that, each cut at ``cap`` times what there is of its value, they sum to one.

    ``sums(scale)`` gives what there is of the values that are cut at that scale, and the other values' targets, in all.
    """
    scale = 1.0
    while True:
        full, rest = sums(scale)
        higher = (1 - full * cap) / rest if rest > 0 else scale
        if higher <= scale * (1 + 1e-12):
            return scale
        scale = higher


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9, cap: float | None = None) -> np.ndarray:
    """Factors of cells, none above ``cap``: margins of ``tokens * factor``, as shares, fit the targets, as far as they can under the cap."""
    w = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    factor, before = np.ones(len(w)), np.inf
    if cap is not None:
        there = [np.bincount(code, weights=w, minlength=len(t)) for code, t in zip(codes, targets, strict=True)]
        scales = [_reachable(lambda s, t=t, h=h: (h[s * t >= h * cap].sum(), t[s * t < h * cap].sum()), cap) for t, h in zip(targets, there, strict=True)]
        targets = [np.minimum(t * s, h * cap) for t, h, s in zip(targets, there, scales, strict=True)]
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weights=w * factor, minlength=len(target))
            scale = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            worst = max(worst, float(np.abs(have - target)[have > 0].max(initial=0.0)))
            factor *= scale[code]
            if cap is not None:
                factor = np.minimum(factor, cap)
        if worst < tolerance or cap is not None and abs(before - worst) < tolerance:  # the cap can keep margins from a fit
            break
        before = worst
    _missed(worst, tolerance)
    return factor


def _missed(worst: float, tolerance: float) -> None:
    """Says so where a margin is off by more than a thousandth of all tokens."""
    if worst > max(tolerance, 1e-3):
        warnings.warn(f"margins don't fit their targets: a value is off by {worst:.4f} of all tokens", stacklevel=3)


def _cap(total: float, tokens_wanted: float | None) -> float | None:
    """The factor at which all of a cell is taken, where ``tokens_wanted`` of ``total`` are expected."""
    return None if tokens_wanted is None else max(1.0, float(total) / tokens_wanted) if tokens_wanted > 0 else None


def _sums_of(t: DataFrame, cap: float):
    def sums(scale: float) -> tuple[float, float]:
        full = F.col("target") * scale >= F.col("there") * cap
        return tuple(t.agg(F.coalesce(F.sum(F.when(full, F.col("there"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("target"))), F.lit(0.0))).first())

    return sums


def factors(cells: DataFrame, targets: dict[str, dict[str, float] | DataFrame], max_cells: int = 200_000, rounds: int = 200, tolerance: float = 1e-9, tokens_wanted: float | None = None) -> DataFrame:
    """``mix_source, mix_lang, mix_topic, factor`` of each cell; the largest factor is 1.

    With ``tokens_wanted`` factors are fitted under the cap at which that many tokens are expected with no probability above 1.

    Up to ``max_cells`` cells with targets given as dictionaries are fitted on the driver, all others by aggregations.
    """
    keys, spark = [f"mix_{m}" for m in MARGINS], cells.sparkSession
    live = cells.where("tokens > 0")
    if all(isinstance(t, dict) for t in targets.values()) and live.limit(max_cells + 1).count() <= max_cells:
        rows = sorted(live.select(*keys, "tokens").collect())
        for m, t in targets.items():
            rows = [r for r in rows if t.get(r[f"mix_{m}"], 0) > 0]
        codes, goals = [], []
        for m, t in targets.items():
            names = sorted({r[f"mix_{m}"] for r in rows})
            at = {n: i for i, n in enumerate(names)}
            whole = sum(t[n] for n in names)
            codes.append(np.array([at[r[f"mix_{m}"]] for r in rows], dtype=np.int64))
            goals.append(np.array([t[n] / whole for n in names]))
        f = rake(np.array([r["tokens"] for r in rows], dtype=float), codes, goals, rounds, tolerance, _cap(sum(r["tokens"] for r in rows), tokens_wanted)) if rows else np.zeros(0)
        top = f.max(initial=0.0) or 1.0
        return spark.createDataFrame([(*[r[k] for k in keys], float(x / top)) for r, x in zip(rows, f, strict=True)], ", ".join(f"{k} string" for k in keys) + ", factor double")
    tables = {m: (spark.createDataFrame(list(t.items()), "value string, target double") if isinstance(t, dict) else t).where("target > 0").select(F.col("value").alias(f"mix_{m}"), "target") for m, t in targets.items()}
    for m, t in tables.items():
        live = live.join(t.select(f"mix_{m}"), f"mix_{m}", "left_semi")
    live = stored(live, "live-cells")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", factor double")
    cap, before = _cap(total, tokens_wanted), float("inf")
    for m, t in tables.items():
        t = t.join(live.groupBy(f"mix_{m}").agg((F.sum("tokens") / total).alias("there")), f"mix_{m}")
        t = stored(t.withColumn("target", F.col("target") / t.agg(F.sum("target")).first()[0]), "targets")
        if cap is not None:
            t = t.withColumn("target", F.least(F.col("target") * _reachable(_sums_of(t, cap), cap), F.col("there") * cap))
        tables[m] = t.drop("there")
    now, last = live.select(*keys, (F.col("tokens") / total).alias("w"), F.lit(1.0).alias("factor")), None
    for _ in range(rounds):
        now = now.withColumn("worst", F.lit(0.0))
        for m, t in tables.items():
            have = now.groupBy(f"mix_{m}").agg(F.sum(F.col("w") * F.col("factor")).alias("have")).join(t, f"mix_{m}")
            scale = have.select(f"mix_{m}", (F.col("target") / F.col("have")).alias("scale"), F.abs(F.col("have") - F.col("target")).alias("off"))
            fitted = F.col("factor") * F.col("scale")
            now = now.join(scale, f"mix_{m}").select(*keys, "w", (fitted if cap is None else F.least(fitted, F.lit(cap))).alias("factor"), F.greatest("worst", "off").alias("worst"))
        now = stored(now, "raking")
        if last is not None:
            release(last)
        last = now
        worst = now.agg(F.max("worst")).first()[0]
        if worst < tolerance or cap is not None and abs(before - worst) < tolerance:
            break
        before = worst
    _missed(worst, tolerance)
    top = now.agg(F.max("factor")).first()[0]
    return now.select(*keys, (F.col("factor") / top).alias("factor"))


def with_probability(docs: DataFrame, cells: DataFrame, cell_factors: DataFrame, tokens_wanted: float | None = None, seed: int = 1, max_cells: int = 200_000, topic: Column | None = None) -> DataFrame:
    """``docs`` with cell columns, ``mix_weight`` (the factor), ``mix_probability`` and ``mix_sampled``."""
    scale = F.lit(1.0)
    if tokens_wanted is not None:
        expected = cells.join(cell_factors, [f"mix_{m}" for m in MARGINS]).agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0] or 1.0
        scale = F.lit(float(tokens_wanted / expected))
    right = cell_factors.withColumnRenamed("factor", "mix_weight")
    right = F.broadcast(right) if cell_factors.limit(max_cells + 1).count() <= max_cells else right
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.coalesce(F.col("text"), F.lit("")), F.lit(seed)), F.lit(1 << 48)) / float(1 << 48)
    got = with_cells(docs, topic).join(right, [f"mix_{m}" for m in MARGINS], "left")
    got = got.withColumn("mix_weight", F.coalesce("mix_weight", F.lit(0.0))).withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_weight") * scale))
    return got.withColumn("mix_sampled", u < F.col("mix_probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, tokens_wanted: int | None = None, seed: int = 1, keep: float = 0.5, topic: Column | None = None) -> DataFrame:
    """All rows of ``docs`` with their probabilities and verdicts.

    Without targets, those of :func:`tempered` shares; without ``tokens_wanted`` too, the share ``keep`` of all tokens is expected in the sample.
    """
    cells = cells_of(docs, topic)
    if not targets and tokens_wanted is None:
        tokens_wanted = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    targets = targets or {m: tempered(cells, m, p) for m, p in (powers or {"source": 0.7, "lang": 0.7, "topic": 0.9}).items()}
    return with_probability(docs, cells, factors(cells, targets, tokens_wanted=tokens_wanted), tokens_wanted, seed, topic=topic)


def margins(mixed: DataFrame) -> DataFrame:
    """``margin, value, tokens, expected``: what each value of a margin has, and what the sample is expected to have of it."""
    each = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"mix_{m}").alias("value")) for m in MARGINS])
    cells = mixed.groupBy(*[f"mix_{m}" for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("expected"))
    return cells.select(F.explode(each).alias("m"), "tokens", "expected").groupBy("m.margin", "m.value").agg(F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The sampled rows of ``docs``, with ``mix_weight`` and ``mix_probability`` beside its columns."""
    return mix(docs, **how).where("mix_sampled").select(*[c for c in docs.columns if not c.startswith("mix_")], "mix_weight", "mix_probability")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 9).alias("weight"), F.round("mix_probability", 9).alias("probability"), F.col("mix_sampled").alias("sampled"))
