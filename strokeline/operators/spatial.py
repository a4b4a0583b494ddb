"""Spatial joins on one page: equi-joins on grid cells with an exact residual, so that no plan is a nested loop.

Pages are independent, so `page` is part of every key. Cells are as wide as the radius: a pair within the radius lies in
one cell or in neighbouring ones, and only the left side is replicated, to the nine cells around each of its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, page: str = "document_id") -> DataFrame:
    """Pairs (structs `l`, `r`) of points with columns page, x, y within `radius` of each other, with their squared distance `d2`."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.select(F.struct("*").alias("l"), F.col(page).alias("_p"), _cell(F.col("x"), radius).alias("_x"), _cell(F.col("y"), radius).alias("_y"))
    a = a.withColumn("_s", steps).select("l", "_p", (F.col("_x") + F.col("_s.i")).alias("_cx"), (F.col("_y") + F.col("_s.j")).alias("_cy"))
    b = right.select(F.struct("*").alias("r"), F.col(page).alias("_p"), _cell(F.col("x"), radius).alias("_cx"), _cell(F.col("y"), radius).alias("_cy"))
    d2 = G.squared(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    return a.join(b, ["_p", "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("l", "r", "d2")


def nearest(pairs: DataFrame, by: str, order: list[Column], limit: int = 1) -> DataFrame:
    """The first `limit` pairs of each value of `by` in the given order, numbered by `rank`; the order states how ties fall."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def segment_pairs(segments: DataFrame, cell: float, page: str = "document_id", ident: str = "id", reach: float = 0.0) -> DataFrame:
    """Pairs (structs `a`, `b`, a.id < b.id) of segments whose bounding boxes, widened by `reach`, share a grid cell; each pair once.

    A pair is reported in the cell of the low corner of the overlap of the two boxes, so it needs no distinct.
    """
    low = lambda c: F.least(f"{c}0", f"{c}1") - reach
    high = lambda c: F.greatest(f"{c}0", f"{c}1") + reach
    boxed = segments.select(F.struct("*").alias("s"), F.col(page).alias("_p"), *[f(c).alias(f"_{n}{c}") for n, f in (("l", low), ("h", high)) for c in ("x", "y")])
    cells = lambda c: F.explode(F.sequence(_cell(F.col(f"_l{c}"), cell), _cell(F.col(f"_h{c}"), cell)))
    placed = boxed.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    a, b = placed.alias("p"), placed.alias("q")
    met = a.join(b, (F.col("p._p") == F.col("q._p")) & (F.col("p._cx") == F.col("q._cx")) & (F.col("p._cy") == F.col("q._cy")) & (F.col(f"p.s.{ident}") < F.col(f"q.s.{ident}")))
    own = [(_cell(F.greatest(F.col(f"p._l{c}"), F.col(f"q._l{c}")), cell) == F.col(f"p._c{c}")) & (F.greatest(F.col(f"p._l{c}"), F.col(f"q._l{c}")) <= F.least(F.col(f"p._h{c}"), F.col(f"q._h{c}"))) for c in ("x", "y")]
    return met.where(own[0] & own[1]).select(F.col("p.s").alias("a"), F.col("q.s").alias("b"))


def _may_cross(a: str, b: str) -> Column:
    """Whether neither segment, made longer by 5 % at both ends, lies on one side of the other's line: a few products, before a crossing is computed."""

    def apart(s: str, t: str) -> Column:
        x0, y0 = F.col(f"{s}.x0"), F.col(f"{s}.y0")
        dx, dy = F.col(f"{s}.x1") - x0, F.col(f"{s}.y1") - y0
        u = dx * (F.col(f"{t}.y0") - y0) - dy * (F.col(f"{t}.x0") - x0)
        v = dx * (F.col(f"{t}.y1") - y0) - dy * (F.col(f"{t}.x1") - x0)
        return (1.05 * u - 0.05 * v) * (1.05 * v - 0.05 * u) > 0

    return ~apart(a, b) & ~apart(b, a)


def interior_intersections(segments: DataFrame, proximity: float, cell: float = 64.0, page: str = "document_id", ident: str = "id") -> DataFrame:
    """Crossings of segments inside both (up to 2 % beyond an end) and further than `proximity` from all four ends: a, b, x, y."""
    pairs = segment_pairs(segments, cell, page, ident, reach=proximity)
    # the crossing is long: as the one row of an array it is computed once, not in every filter that reads it
    at = F.explode(F.array(F.struct(*[c.alias(n) for n, c in G.crossing("a", "b").items()])))
    made = pairs.where(_may_cross("a", "b")).select("a", "b", at.alias("_at")).select("a", "b", "_at.x", "_at.y", "_at.ta", "_at.tb")
    made = made.where("x is not null and ta between -0.02 and 1.02 and tb between -0.02 and 1.02")
    for side in ("a", "b"):
        for end in ("0", "1"):
            made = made.where(G.squared(F.col("x"), F.col("y"), F.col(f"{side}.x{end}"), F.col(f"{side}.y{end}")) > proximity * proximity)
    return made


def points_in_boxes(points: DataFrame, boxes: DataFrame, buffer: float, cell: float = 64.0, page: str = "document_id") -> DataFrame:
    """Pairs (structs `l` of a point, `r` of a box with x, y, width, height) of a point in a box widened by `buffer`, edges included."""
    a = points.select(F.struct("*").alias("l"), F.col(page).alias("_p"), _cell(F.col("x"), cell).alias("_cx"), _cell(F.col("y"), cell).alias("_cy"))
    span = lambda c, w: F.explode(F.sequence(_cell(F.col(c) - buffer, cell), _cell(F.col(c) + F.col(w) + buffer, cell)))
    b = boxes.select(F.struct("*").alias("r"), F.col(page).alias("_p"), span("x", "width").alias("_cx"), "y", "height")
    b = b.select("r", "_p", "_cx", span("y", "height").alias("_cy"))
    inside = [(F.col(f"l.{c}") >= F.col(f"r.{c}") - buffer) & (F.col(f"l.{c}") <= F.col(f"r.{c}") + F.col(f"r.{w}") + buffer) for c, w in (("x", "width"), ("y", "height"))]
    return a.join(b, ["_p", "_cx", "_cy"]).where(inside[0] & inside[1]).select("l", "r")
