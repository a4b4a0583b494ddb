"""Axis inference and snapping of line primitives (page, id, status, x0 to y1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROFILE, Profile
from ..functions import geometry as G

AXES = ("axis_vertical", "axis_iso_a", "axis_iso_b")


def votes(primitives: DataFrame, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """page, angle and weight (length) of accepted and uncertain primitives of the least length."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    made = primitives.where(F.col("status").isin("accepted", "uncertain"))
    return made.select(page, G.undirected(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("angle"), length.alias("weight")).where(F.col("weight") >= profile.min_primitive_length)


def axis_models(primitives: DataFrame, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """page, total, rotation and confidence: the rotation of 360 half degrees whose axes the votes fit best, the smallest of equal ones.

    Rotations 60 degrees apart fit alike, so the best of the first 120 half degrees is the smallest best one; a vote
    counts for those within 12 degrees of it, and meets no others. Scores are rounded before they are compared.
    """
    cast = votes(primitives, profile, page)
    total = cast.groupBy(page).agg(F.sum("weight").alias("total")).where(F.col("total") >= profile.min_primitive_length)
    near = F.sequence(F.ceil((F.col("angle") - 42.0) * 2), F.floor((F.col("angle") - 18.0) * 2))
    turned = cast.withColumn("step", F.explode(near)).withColumn("rotation", F.pmod("step", F.lit(120)) * F.lit(0.5))
    d = G.triad_delta(F.col("angle"), F.col("rotation"))
    scored = turned.groupBy(page, "rotation").agg(F.round(F.sum(F.when(d <= 12.0, F.col("weight") * (1 - d / 12.0)).otherwise(0.0)), 6).alias("score"))
    best = scored.groupBy(page).agg(F.max(F.struct(F.col("score"), (-F.col("rotation")).alias("turn"))).alias("best"))
    made = total.join(best, page)
    return made.select(page, "total", (-F.col("best.turn")).alias("rotation"), F.least(F.lit(1.0), F.col("best.score") / F.greatest(F.col("total"), F.lit(1.0))).alias("confidence"))


def nearest_axis(angle: Column, rotation: Column) -> Column:
    """struct of delta, place and axis_angle of the axis nearest to a line, the first of equal ones."""
    axes = G.triad(rotation)
    each = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(G.line_delta(angle, axes[k]).alias("delta"), k.alias("place"), axes[k].alias("axis_angle")))
    return F.array_min(each)


def snapped(primitives: DataFrame, models: DataFrame, dimensions: DataFrame | None = None, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """The decision for every primitive: reason, axis_id, angle_delta, displacement and the snapped ends (its own where it isn't snapped).

    The first reason that holds decides: uncertain, weak model, too short, dimension region, off axis, displacement.
    `dimensions` has page and id of primitives that overlap a dimension region.
    """
    made = primitives.join(models.select(page, "rotation", "confidence"), page, "left")
    if dimensions is None:
        made = made.withColumn("_dimension", F.lit(False))
    else:
        made = made.join(dimensions.select(page, "id", F.lit(True).alias("_dimension")).distinct(), [page, "id"], "left")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    made = made.withColumn("_axis", nearest_axis(G.undirected(dx, dy), F.coalesce("rotation", F.lit(0.0))))
    made = made.withColumn("_to", G.turned_about_midpoint(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), G.shortest_turn(G.direction(dx, dy), F.col("_axis.axis_angle"))))
    moved = F.greatest(G.distance(F.col("_to.x0"), F.col("_to.y0"), F.col("x0"), F.col("y0")), G.distance(F.col("_to.x1"), F.col("_to.y1"), F.col("x1"), F.col("y1")))
    made = made.withColumn("_moved", moved)
    reason = (
        F.when(F.col("status") == "uncertain", "preserved_uncertain")
        .when(F.coalesce("confidence", F.lit(0.0)) < profile.min_axis_confidence, "weak_axis_model")
        .when(F.hypot(dx, dy) < profile.min_primitive_length, "low_evidence")
        .when(F.coalesce("_dimension", F.lit(False)), "dimension_region")
        .when(F.col("_axis.delta") > profile.max_snap_angle, "off_axis")
        .when(F.col("_moved") > profile.max_endpoint_displacement, "endpoint_displacement")
        .otherwise("snapped_to_axis")
    )
    made = made.withColumn("reason", reason)
    yes = F.col("reason") == "snapped_to_axis"
    names = F.array(*[F.lit(a) for a in AXES])
    measured = F.col("reason").isin("off_axis", "endpoint_displacement", "snapped_to_axis")
    return made.select(
        page, "id", "reason", F.when(yes, names[F.col("_axis.place")]).alias("axis_id"), F.when(measured, F.col("_axis.delta")).otherwise(0.0).alias("angle_delta"),
        F.when(F.col("reason").isin("endpoint_displacement", "snapped_to_axis"), F.col("_moved")).otherwise(0.0).alias("displacement"),
        *[F.when(yes, F.col(f"_to.{c}")).otherwise(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")],
    )


def line_fit(samples: DataFrame, keys: list[str], profile: Profile = PROFILE) -> DataFrame:
    """Total least squares line of samples (keys, x, y): n, mean, angle, rms, r2, length, status and confidence."""
    about = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"),
        F.min("x").alias("low_x"), F.max("x").alias("high_x"), F.min("y").alias("low_y"), F.max("y").alias("high_y"),
    )
    spread = F.col("vx") + F.col("vy")
    gap = F.sqrt((F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")) + 4 * F.col("c") * F.col("c"))
    small = F.greatest(F.lit(0.0), (spread - gap) / 2)
    made = about.withColumns({"angle": F.degrees(0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))), "rms": F.sqrt(small), "r2": F.when(spread <= 0, F.lit(1.0)).otherwise(1 - small / spread)})
    made = made.withColumn("length", F.hypot(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")))
    status = F.when((F.col("length") < profile.min_line_length) | (F.col("rms") > profile.max_residual), "rejected").when(F.col("r2") < profile.min_r_squared, "uncertain").otherwise("accepted")
    return made.withColumns({"status": status, "confidence": G.clamp(F.col("r2") * (1 - F.least(F.col("rms") / 10, F.lit(0.5))))})
