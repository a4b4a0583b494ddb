"""Callout leaders: walks over ink from the notes they belong to, all leaders of all pages step by step together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .evidence import pixel_number

#: A step's reach, how many reaches away a walk may begin, and its most steps.
STEP, SEED_STEPS, MAX_STEPS = 4, 6, 32
#: Steps that one job takes before the walks are written.
STEPS_A_JOB = 8


def around(ink: DataFrame, side: int, page: str = "document_id") -> DataFrame:
    """page, bx, by and near: the ink of a block of `side` pixels and of the eight around it. An index in which a pixel's surroundings are one row."""
    spread = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    blocks = ink.groupBy(page, F.floor(F.col("px") / side).alias("x"), F.floor(F.col("py") / side).alias("y")).agg(F.collect_list(F.struct("px", "py")).alias("own"))
    each = blocks.select(page, "x", "y", "own", F.explode(F.array(*spread)).alias("s"))
    each = each.select(page, (F.col("x") + F.col("s.i")).alias("bx"), (F.col("y") + F.col("s.j")).alias("by"), "own")
    return each.groupBy(page, "bx", "by").agg(F.flatten(F.collect_list("own")).alias("near"))


def nearest_ink(near: str, x: Column, y: Column, reach: int, visited: Column | None = None) -> Column:
    """struct d2, dy, dx, px, py of the nearest pixel of `near` at most `reach` columns and rows away; the first by row and column of those as near."""
    inside = lambda p: (F.abs(p["px"] - x) <= reach) & (F.abs(p["py"] - y) <= reach)
    free = inside if visited is None else lambda p: inside(p) & ~F.array_contains(visited, pixel_number(p["px"], p["py"]))
    told = lambda p: F.struct(((p["px"] - x) * (p["px"] - x) + (p["py"] - y) * (p["py"] - y)).alias("d2"), (p["py"] - y).alias("dy"), (p["px"] - x).alias("dx"), p["px"].alias("px"), p["py"].alias("py"))
    return F.array_min(F.transform(F.filter(near, free), told))


def traced_leaders(starts: DataFrame, ink: DataFrame, page: str = "document_id", step: int = STEP, seed_steps: int = SEED_STEPS, most: int = MAX_STEPS) -> DataFrame:
    """page, id, pos, px, py: the points of the walk from each start (page, id, px, py), its own pixel first; starts without a walk have no rows.

    A start that isn't on ink goes to the nearest ink within `seed_steps` steps. Then each step goes to the nearest ink within
    `step` columns and rows that the walk hasn't taken - a start on ink takes its own pixel first -, `most` steps at most. Each
    step is one join of all walks with an index of the ink by blocks, and walks are written every few steps.
    """
    reach = step * seed_steps
    block = lambda c, side: F.floor(F.col(c) / side)
    known = starts.select(page, "id", "px", "py").join(ink.select(page, "px", "py", F.lit(True).alias("on")), [page, "px", "py"], "left")
    wide = around(ink, reach, page)
    placed = known.withColumns({"bx": block("px", reach), "by": block("py", reach)}).join(wide, [page, "bx", "by"])
    at = F.when(F.col("on"), F.struct("px", "py")).otherwise(nearest_ink("near", F.col("px"), F.col("py"), reach).dropFields("d2", "dy", "dx"))
    begun = placed.withColumn("at", at).where("at is not null")
    first = F.struct("px", "py")
    points = F.when(F.col("on"), F.array(first)).otherwise(F.array(first, F.col("at")))
    visited = F.when(F.col("on"), F.array().cast("array<bigint>")).otherwise(F.array(pixel_number(F.col("at.px"), F.col("at.py"))))
    now = stored(begun.select(page, "id", F.col("at.px").alias("px"), F.col("at.py").alias("py"), points.alias("points"), visited.alias("visited"), F.lit(True).alias("open")), "walks")
    index = stored(around(ink, step, page), "blocks")
    for done in range(0, most, STEPS_A_JOB):
        for _ in range(min(STEPS_A_JOB, most - done)):
            joined = now.withColumns({"bx": block("px", step), "by": block("py", step)}).join(index, [page, "bx", "by"], "left")
            found = F.when(F.col("open"), nearest_ink("near", F.col("px"), F.col("py"), step, F.col("visited")))
            moved = joined.select(page, "id", "px", "py", "points", "visited", found.alias("next"))
            goes = F.col("next").isNotNull()
            now = moved.select(
                page, "id", F.coalesce("next.px", "px").alias("px"), F.coalesce("next.py", "py").alias("py"), goes.alias("open"),
                F.when(goes, F.concat("points", F.array(F.struct("next.px", "next.py")))).otherwise(F.col("points")).alias("points"),
                F.when(goes, F.concat("visited", F.array(pixel_number(F.col("next.px"), F.col("next.py"))))).otherwise(F.col("visited")).alias("visited"),
            )
        now = stored(now, "walks")
        if now.where("open").isEmpty():
            break
    whole = now.select(page, "id", "points")
    return whole.where(F.size("points") >= 2).select(page, "id", F.posexplode("points").alias("pos", "p")).select(page, "id", "pos", "p.px", "p.py")
