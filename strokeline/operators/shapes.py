"""Shapes of ink components: box, fill, symmetry, convex hull and least rectangle, in expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cross(a: str, b: str, c: str) -> str:
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def _chain(points: str) -> str:
    """Half a hull of sorted points: a point is put on the chain once all that don't turn left before it are taken off. On a convex chain these are the last ones."""
    first = f"array_min(filter(sequence(2, greatest(size(s), 2)), i -> size(s) >= 2 and {_cross('s[i - 2]', 's[i - 1]', 'p')} <= 0))"
    return f"aggregate({points}, cast(array() as array<struct<x: double, y: double>>), (s, p) -> concat(slice(s, 1, coalesce({first} - 1, size(s))), array(p)))"


def component_features(ink: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, width, height, area, aspect, fill and symmetry of components of ink (keys, px, py).

    symmetry is the part of the left half's pixels that equal their mirror images in the right half; 0 where a component is one column wide.
    """
    boxes = ink.groupBy(*keys).agg(F.min("px").alias("x"), F.min("py").alias("y"), (F.max("px") - F.min("px") + 1).alias("width"), (F.max("py") - F.min("py") + 1).alias("height"), F.count("*").alias("area"))
    placed = ink.join(boxes.select(*keys, "x", "width"), keys)
    half = F.expr("width div 2")
    left, right = F.col("px") - F.col("x") < half, F.col("px") - F.col("x") >= F.col("width") - half
    # both halves are laid over each other; a place that only one of them has differs
    folded = placed.where(left | right).select(*keys, "py", F.when(left, F.col("px") - F.col("x")).otherwise(F.col("width") - 1 - (F.col("px") - F.col("x"))).alias("_c"))
    places = folded.groupBy(*keys, "py", "_c").agg(F.count("*").alias("_n"))
    unlike = places.groupBy(*keys).agg(F.count_if(F.col("_n") == 1).alias("unlike"))
    made = boxes.join(unlike, keys, "left")
    symmetry = F.when(half > 0, 1.0 - F.coalesce("unlike", F.lit(0)) / (F.col("height") * half)).otherwise(0.0)
    return made.select(*keys, "x", "y", "width", "height", "area", (F.col("width") / F.col("height")).alias("aspect"), (F.col("area") / (F.col("width") * F.col("height"))).alias("fill"), symmetry.alias("symmetry"))


def hulls(ink: DataFrame, keys: list[str]) -> DataFrame:
    """keys and hull: the corners of the convex hull of each component's pixel centres.

    Only the first and the last pixel of a column can be corners, so a component's array has two points for each of its columns.
    """
    columns = ink.groupBy(*keys, "px").agg(F.min("py").alias("low"), F.max("py").alias("high"))
    ends = columns.select(*keys, F.explode(F.array(*[F.struct(F.col("px").cast("double").alias("x"), F.col(c).cast("double").alias("y")) for c in ("low", "high")])).alias("p"))
    points = ends.groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("p"))
    chains = points.select(*keys, "p", F.expr(_chain("p")).alias("lower"), F.expr(_chain("reverse(p)")).alias("upper"))
    whole = F.when(F.size("p") < 3, F.col("p")).otherwise(F.concat(F.expr("slice(lower, 1, size(lower) - 1)"), F.expr("slice(upper, 1, size(upper) - 1)")))
    return chains.select(*keys, whole.alias("hull"))


def least_rectangle(hull: str = "hull") -> Column:
    """struct area, angle (degrees, from 0 to below 90), along and across of the least rectangle around a hull; one of its sides lies on one of the hull's.

    The first by angle where several are as small. A hull of one or two points has a rectangle without area.
    """
    n = f"size({hull})"
    along = "(p.x * (b.x - a.x) + p.y * (b.y - a.y)) / l"
    across = "(p.y * (b.x - a.x) - p.x * (b.y - a.y)) / l"
    span = lambda v: f"(array_max(transform({hull}, p -> {v})) - array_min(transform({hull}, p -> {v})))"
    side = f"transform(sequence(1, {n}), i -> struct({hull}[i - 1] as a, {hull}[i % {n}] as b))"
    sized = f"transform(filter({side}, s -> s.a <> s.b), s -> struct(s.a as a, s.b as b, sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y)) as l))"
    use = lambda v: v.replace("a.x", "s.a.x").replace("a.y", "s.a.y").replace("b.x", "s.b.x").replace("b.y", "s.b.y").replace("/ l", "/ s.l")
    spans = f"transform({sized}, s -> struct({span(use(along))} as u, {span(use(across))} as v, pmod(round(degrees(atan2(s.b.y - s.a.y, s.b.x - s.a.x)), 9), 90D) as angle))"
    made = f"array_min(transform({spans}, r -> struct(round(r.u * r.v, 6) as area, r.angle as angle, r.u as along, r.v as across)))"
    return F.coalesce(F.expr(made), F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("along"), F.lit(0.0).alias("across")))
