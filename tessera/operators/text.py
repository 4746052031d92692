"""Text of documents: compaction, validity, masking, sections, tables, layout lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def compacted(c: Column) -> Column:
    """Without NUL, runs of spaces, blank lines and lines equal to the one before."""
    t = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit("")), r"[ \t\r\f\x0B]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    before = F.concat(F.array(F.lit("")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("a"), before.alias("b")), lambda z: z["a"] != z["b"]), lambda z: z["a"]), "\n")


def repeated_line_ratio(df: DataFrame, key: str, text: str = "text", low: int = 2, high: int = 24, times: int = 3) -> DataFrame:
    """Share of short lines that occur ``times`` or more in their document."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line").between(low, high))
    n = lines.groupBy(key, "line").count()
    return n.groupBy(key).agg((F.sum(F.when(F.col("count") >= times, F.col("count")).otherwise(0)) / F.sum("count")).alias("ratio"), F.sum("count").alias("short_lines"))


def valid_ratio(c: Column) -> Column:
    """Share of letters, digits, spaces and common punctuation."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}\s.,;:!?%()\-，。；：！？（）、]")) / F.greatest(F.length(c), F.lit(1))


def is_valid(c: Column, pages: Column | None = None, least: int = 50, per_page: int = 30, least_valid: float = 0.30, most_repeated: float = 0.28) -> Column:
    """Whether extracted text is usable: long enough, enough a page, mostly characters, few repeated short lines."""
    t = F.trim(F.coalesce(c, F.lit("")))
    short = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(2, 24))
    counts = F.aggregate(F.array_sort(short), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("rep")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).alias("run"), (a["rep"] + F.when(x != a["last"], 0).when(a["run"] + 1 == 3, 3).when(a["run"] + 1 > 3, 1).otherwise(0)).alias("rep")))["rep"]
    repeated = F.when(F.size(short) > 0, counts / F.size(short)).otherwise(0.0)
    n = F.length(t)
    return (n >= least) & (n / F.greatest(F.lit(1) if pages is None else F.coalesce(pages, F.lit(1)), F.lit(1)) >= per_page) & (valid_ratio(t) >= least_valid) & (repeated <= most_repeated)


def cut_at(c: Column, marks: list[str]) -> Column:
    """Text before the first of some marks."""
    places = F.array(*[F.instr(c, m) for m in marks])
    first = F.array_min(F.filter(places, lambda p: p > 0))
    return F.when(first.isNotNull(), F.substr(c, F.lit(1), first - 1)).otherwise(c)


def masked(c: Column, words: list[str], mask: str = "***") -> Column:
    """Each word replaced; longer words first, so the result doesn't depend on the order given."""
    if not words:
        return c
    return F.regexp_replace(c, "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))), mask.replace("$", "\\$"))


def section(c: Column, heading: str) -> Column:
    """Text under a Markdown heading, up to the next heading of its level or above; null if there is none."""
    level = len(heading) - len(heading.lstrip("#"))
    got = F.regexp_extract(F.concat(F.lit("\n"), c, F.lit("\n")), rf"(?s)\n{re.escape(heading)}[ \t]*\n(.*?)(?=\n#{{1,{max(level, 1)}}} |\z)", 1)
    return F.when(F.concat(F.lit("\n"), c, F.lit("\n")).contains(f"\n{heading}\n"), F.trim(got))


def lines_with(c: Column, words: list[str], n: int) -> Column:
    """The first ``n`` distinct lines that contain any of the words."""
    hit = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w)))
    return F.slice(F.array_distinct(hit), 1, n)


def without_bullet(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*(?:[-*+•]|\d+[.)])\s+", ""))


def table_rows(c: Column) -> Column:
    """Cells of the rows of a Markdown table, without the separator row."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"(?<!\\)\|"), lambda y: F.trim(y)))


def to_markdown(rows: Column) -> Column:
    """A Markdown table of rows of cells: padded to the widest, pipes escaped."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.try_element_at(rows, F.lit(1))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")


def layout_lines(spans: DataFrame, gap: float = 3.0, edge: float = 0.1) -> DataFrame:
    """Lines of a page from spans ``page, page_height, x0, x1, y0, text``: without the outer ``edge`` and bare page numbers.

    Spans whose ``y0`` round to the same number form a line, by ``x0``; a gap over ``gap`` becomes a space.
    """
    t = spans.where(F.col("y0").between(F.col("page_height") * edge, F.col("page_height") * (1 - edge)))
    t = t.withColumn("line", F.round("y0").cast("long"))
    w = W.partitionBy("page", "line").orderBy("x0")
    t = t.withColumn("piece", F.concat(F.when(F.col("x0") - F.lag("x1").over(w) > gap, " ").otherwise(""), F.col("text")))
    g = t.groupBy("page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return g.where(~F.trim("text").rlike(r"^[-–— ]*\d{1,4}[-–— ]*$"))


def reading_order(lines: DataFrame, least: int = 30, side: int = 12, gap: float = 0.18) -> DataFrame:
    """Lines ``page, page_width, y0, x0, text`` with ``place`` in reading order: by columns where a page has two, else from the top.

    A page has two columns if it has ``least`` lines outside tables, ``side`` of them begin on each half, and the
    middle starts of the halves are ``gap`` of the width apart.
    """
    plain = (F.trim("text") != "") & ~(F.trim("text").startswith("|") & (F.length("text") - F.length(F.replace("text", F.lit("|"))) >= 2))
    half = F.col("page_width") * 0.5
    starts = lambda cond: F.sort_array(F.collect_list(F.when(plain & cond, F.col("x0"))))
    g = lines.groupBy("page").agg(starts(F.col("x0") < half).alias("l"), starts(F.col("x0") >= half).alias("r"), F.max("page_width").alias("w"))
    middle = lambda c: F.try_element_at(c, F.floor(F.size(c) / 2).cast("int") + 1)
    g = g.select("page", middle(F.col("l")).alias("a"), middle(F.col("r")).alias("b"), F.size("l").alias("nl"), F.size("r").alias("nr"), "w")
    two = (F.col("w") > 0) & (F.col("nl") + F.col("nr") >= least) & (F.col("nl") >= side) & (F.col("nr") >= side) & (F.col("b") - F.col("a") >= F.col("w") * gap)
    t = lines.join(g.select("page", F.when(two, (F.col("a") + F.col("b")) * 0.5).alias("__split")), "page")
    column = F.when(F.col("__split").isNotNull() & (F.col("x0") >= F.col("__split")), 1).otherwise(0)
    return t.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(column, "y0", "x0", "text"))).drop("__split")


def table_items(tables: DataFrame, least_cells: int = 12, edge: float = 0.1) -> DataFrame:
    """Tables ``page, page_height, y0, y1, rows`` outside the page's outer ``edge`` with enough cells, as Markdown."""
    cells = F.aggregate("rows", F.lit(0), lambda a, r: a + F.coalesce(F.size(r), F.lit(0)))
    t = tables.where((F.col("y1") > F.col("page_height") * edge) & (F.col("y0") < F.col("page_height") * (1 - edge)) & (cells >= least_cells))
    return t.withColumn("markdown", to_markdown(F.col("rows"))).where(F.trim("markdown") != "")


def frontmatter(c: Column) -> Column:
    """Text between the fences at the start, or null."""
    got = F.regexp_extract(c, r"(?s)\A(?:```ya?ml\s*\n)?---[ \t]*\n(.*?)\n---", 1)
    return F.when(got != "", got)


def embedded_json(c: Column, mark: str, schema: str) -> Column:
    """Value of a JSON block in an HTML comment that begins with ``mark``; null if it can't be read."""
    return F.from_json(F.regexp_extract(c, rf"(?s)<!--\s*{re.escape(mark)}\s*(.*?)-->", 1), schema)


def fee_rates(c: Column) -> Column:
    """``low, high, kind`` of a fee text's percentages."""
    rates = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)\s*[%％]"), F.lit(1)), lambda x: x.cast("double"))
    kind = F.when(c.rlike("超额"), "excess").when(c.rlike("计提|业绩报酬"), "performance").when(c.rlike("管理费"), "management").otherwise("other")
    return F.struct(F.array_min(rates).alias("low"), F.array_max(rates).alias("high"), kind.alias("kind"))
