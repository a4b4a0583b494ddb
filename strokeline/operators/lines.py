"""Polylines as tables of vertices."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def simplified(vertices: DataFrame, epsilon: float, keys: tuple[str, ...] = ("document_id", "line"), order: str = "pos") -> DataFrame:
    """The vertices (keys, order, x, y) that Douglas and Peucker's rule keeps.

    One round takes the farthest vertex of every open stretch of every polyline, first by order where several are as far;
    where it is further than `epsilon` from the line through the stretch's ends - from the point, where they coincide - it stays and parts the stretch. A
    polyline is never one group: the farthest vertex is a maximum that tasks combine, and rounds are as many as stretches nest.
    Nothing is broadcast: there are as many stretches as there are polylines, at least.
    """
    at = F.struct(F.col(order).cast("long").alias("p"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = vertices.select(*keys, at.alias("v"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    kept = [ends.select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))]
    open_ = stored(rows.join(ends.hint("merge"), list(keys)).where("v.p > a.p and v.p < b.p"), "stretches")
    while True:
        length = F.sqrt((F.col("b.x") - F.col("a.x")) * (F.col("b.x") - F.col("a.x")) + (F.col("b.y") - F.col("a.y")) * (F.col("b.y") - F.col("a.y")))
        dx, dy = F.col("v.x") - F.col("a.x"), F.col("v.y") - F.col("a.y")
        cross = F.abs((F.col("b.x") - F.col("a.x")) * dy - (F.col("b.y") - F.col("a.y")) * dx)
        far = F.when(length > 0, cross / F.nullif(length, F.lit(0.0))).otherwise(F.sqrt(dx * dx + dy * dy))
        split = open_.groupBy(*keys, F.col("a.p").alias("_from")).agg(F.max(F.struct(far.alias("d"), (-F.col("v.p")).alias("n"), F.col("v").alias("v"))).alias("far"))
        split = split.where(F.col("far.d") > epsilon).select(*keys, "_from", F.col("far.v").alias("s"))
        parted = stored(open_.withColumn("_from", F.col("a.p")).join(split.hint("merge"), [*keys, "_from"]).drop("_from"), "stretches")
        if parted.isEmpty():
            return functools.reduce(DataFrame.union, kept).select(*keys, F.col("v.p").alias(order), "v.x", "v.y")
        kept.append(parted.where("v.p = s.p").select(*keys, "v"))
        before = F.col("v.p") < F.col("s.p")
        open_ = parted.where("v.p <> s.p").select(*keys, "v", F.when(before, F.col("a")).otherwise(F.col("s")).alias("a"), F.when(before, F.col("s")).otherwise(F.col("b")).alias("b"))


def _kept(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, epsilon: float) -> np.ndarray:
    """Which vertices of polylines, one after the other, Douglas and Peucker's rule keeps; all open stretches go through a round at once."""
    keep = np.zeros(len(x), bool)
    a, b = offsets[:-1], offsets[1:] - 1
    keep[a] = keep[b] = True
    while len(a := a[longer := b - a > 1]):
        b = b[longer]
        size = b - a - 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(own)) - first[own] + a[own] + 1
        bx, by, dx, dy = (x[b] - x[a])[own], (y[b] - y[a])[own], x[at] - x[a][own], y[at] - y[a][own]
        length = np.sqrt(bx * bx + by * by)
        far = np.where(length > 0, np.abs(bx * dy - by * dx) / np.where(length > 0, length, 1.0), np.sqrt(dx * dx + dy * dy))
        top = np.maximum.reduceat(far, first)
        split = np.minimum.reduceat(np.where(far == top[own], at, len(x)), first)[top > epsilon]
        keep[split] = True
        a, b = a[top > epsilon], b[top > epsilon]
        a, b = np.concatenate([a, split]), np.concatenate([split, b])
    return keep


def left_of_pieces(pieces: DataFrame, epsilon: float, page: str = "document_id") -> DataFrame:
    """page, line and vertices, the number that simplification leaves of polylines (page, line, xs, ys: arrays) that each stand in one row."""
    kinds = [f"{c} {pieces.schema[c].dataType.simpleString()}" for c in (page, "line")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = (part.column(k).flatten().to_numpy().astype(float) for k in (2, 3))
            offsets = np.concatenate([[0], np.cumsum(part.column(2).value_lengths().to_numpy())]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(_kept(x, y, offsets, epsilon))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total[offsets[1:]] - total[offsets[:-1]])], [page, "line", "vertices"])

    return pieces.select(page, "line", "xs", "ys").mapInArrow(run, f"{', '.join(kinds)}, vertices bigint")
