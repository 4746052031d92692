"""Rectangles on pages: overlaps, and transforms between coordinate systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import dealt, every_pair


def overlap(a: str, b: str, tolerance: float = 0.05) -> Column:
    """Shared area of ``left, top, width, height`` of two aliases, null where a side is within ``tolerance``."""
    w = F.least(F.col(f"{a}.left") + F.col(f"{a}.width"), F.col(f"{b}.left") + F.col(f"{b}.width")) - F.greatest(F.col(f"{a}.left"), F.col(f"{b}.left"))
    h = F.least(F.col(f"{a}.top") + F.col(f"{a}.height"), F.col(f"{b}.top") + F.col(f"{b}.height")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top"))
    return F.when((w > tolerance) & (h > tolerance), F.round(w * h, 2))


def overlaps(shapes: DataFrame, cell: float = 5.0, tolerance: float = 0.05) -> DataFrame:
    """Pairs of shapes of a page that overlap.

    Shapes with the same box are one until the boxes that overlap are known. Boxes are dealt to the grid cells they touch and meet
    only within a cell; a pair is found in the cell that holds the upper left corner of what they share. Lists of a
    cell's boxes and of a box's shapes have a bound, so neither crowded cells nor repeated boxes are one task's.
    """
    box = F.struct("left", "top", "width", "height")
    cells = lambda lo, size: F.sequence(F.floor(F.col(f"box.{lo}") / cell).cast("int"), F.floor((F.col(f"box.{lo}") + F.col(f"box.{size}")) / cell).cast("int"))
    shapes = shapes.select("page", box.alias("box"), "id")
    t = shapes.select("page", "box").distinct().withColumn("cx", F.explode(cells("left", "width"))).withColumn("cy", F.explode(cells("top", "height")))
    at = ["page", "cx", "cy"]
    crowds = dealt(t, at)
    j = every_pair(crowds.select(*at).distinct(), crowds, crowds, at, at).select(*at, F.col("l.box").alias("a"), F.col("r.box").alias("b")).where("a <= b")
    home = (F.floor(F.greatest("a.left", "b.left") / cell) == F.col("cx")) & (F.floor(F.greatest("a.top", "b.top") / cell) == F.col("cy"))
    boxes = j.where(home).select("page", "a", "b", overlap("a", "b", tolerance).alias("area")).where("area IS NOT NULL")
    alike = dealt(shapes, ["page", "box"])
    got = every_pair(boxes, alike.withColumnRenamed("box", "a"), alike.withColumnRenamed("box", "b"), ["page", "a"], ["page", "b"])
    got = got.where(F.when(F.col("a") == F.col("b"), F.col("l.id") < F.col("r.id")).otherwise(F.col("l.id") != F.col("r.id")))
    return got.select("page", F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), "area")


def to_pdf(box: Column, image_width: Column, image_height: Column, pdf_width: Column, pdf_height: Column) -> Column:
    """``[x0, y0, x1, y1]`` of an image, y down, in a page's units, y up."""
    sx, sy = pdf_width / image_width, pdf_height / image_height
    return F.array(box[0] * sx, pdf_height - box[3] * sy, box[2] * sx, pdf_height - box[1] * sy)
