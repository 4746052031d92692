"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252.0


def soft_double(c: Column) -> Column:
    """A number, or null where the value isn't one or is not finite."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def soft_day(c: Column) -> Column:
    """A date, or null."""
    return c.try_cast("timestamp").cast("date")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def missing_to(c: Column, label: str) -> Column:
    """Null, empty and the words that stand for null become a label."""
    return F.coalesce(F.when(F.lower(F.trim(c)).isin("nan", "none", "null", ""), None).otherwise(c), F.lit(label))


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", c * 100)).otherwise("-")


def bp_text(c: Column, digits: int = 1) -> Column:
    """A return in basis points."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}fbp", c * 10_000)).otherwise("-")


def fixed_text(c: Column, digits: int = 4) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("-")


def previous_sunday(day: Column) -> Column:
    """The day itself if a Sunday, else the Sunday before."""
    return F.date_sub(day, F.dayofweek(day) - 1)


PERIODS = {1: "day", 2: "week", 3: "month", 4: "quarter", 5: "year"}


def period_start(day: Column, code: int) -> Column:
    """Start of the day, week, month, quarter or year (codes 1 to 5)."""
    return F.date_trunc(PERIODS[code], day).cast("date")


def ordered_product(values: Column) -> Column:
    """Product of an ordered array of growth factors; any sign, null for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(1.0), lambda a, x: a * x))


def ellipsis(c: Column, most: int) -> Column:
    """Text of at most ``most`` characters, cut with an ellipsis after trailing punctuation is trimmed."""
    cut = F.regexp_replace(F.substring(c, 1, most - 1), r"[\s,;:.，；：。、]+$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def json_list(c: Column) -> Column:
    """Strings of a JSON list; an empty array for anything else."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def mapped(c: Column, names: dict[str, str], default: str) -> Column:
    """A value's entry in a table, by its lower case; ``default`` for what isn't in it."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k.lower()), F.lit(v))]), F.lower(F.trim(c))), F.lit(default))


def short_error(c: Column, most: int = 200) -> Column:
    """Code, message and detail of a JSON error, else the text, shortened."""
    parts = F.concat_ws(" ", *[F.get_json_object(c, f"$.{k}") for k in ("code", "msg", "message", "detail")])
    return ellipsis(F.coalesce(F.nullif(F.trim(parts), F.lit("")), F.regexp_replace(F.trim(c), r"\s+", " ")), most)


def score_after(c: Column, label: str) -> Column:
    """The first number after a label in a text or table row."""
    import re

    return F.nullif(F.regexp_extract(c, rf"{re.escape(label)}[^\d\n-]{{0,20}}(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def end_day(config: Column, base: Column, today: Column) -> Column:
    """The end of a report: what a JSON configuration says, else the fund's own last day, else a given one; days before 1990 count as none."""
    given = soft_day(F.coalesce(*[F.get_json_object(config, f"$.{k}") for k in ("end_date", "endDate", "end")]))
    known = lambda d: F.when(d >= F.lit("1990-01-01").cast("date"), d)
    return F.coalesce(known(given), known(soft_day(base)), soft_day(today))
