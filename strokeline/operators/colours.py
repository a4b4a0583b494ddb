"""Colours of ink: conversion to and from LAB, and layers by k-means, for all pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: The chroma below which ink is black, and the pixels that a layer has at least.
BLACK_CHROMA, MIN_LAYER_PIXELS = 22.0, 40
#: Fixed values of the colour space: sRGB to XYZ under D65, row by row, and the white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
_WHITE = (0.950456, 1.0, 1.088754)


def to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct l, a, b of bytes r, g, b, each in whole numbers from 0 to 255: lightness stretched to 255, a and b from 128."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = (sum((F.lit(w) * c for w, c in zip(row[1:], linear[1:])), F.lit(row[0]) * linear[0]) / white for row, white in zip(_XYZ, _WHITE))
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    lightness = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    byte = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("long")
    return F.struct(byte(lightness * 255.0 / 100.0).alias("l"), byte(500.0 * (root(x) - root(y)) + 128.0).alias("a"), byte(200.0 * (root(y) - root(z)) + 128.0).alias("b"))


def to_rgb(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """struct r, g, b, in bytes, of a colour in the whole numbers of `to_lab`, or between them."""
    fy = (l * 100.0 / 255.0 + 16.0) / 116.0
    cube = lambda f: F.when(f > 6.0 / 29.0, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    parts = [white * cube(f) for white, f in zip(_WHITE, (fy + (a - 128.0) / 500.0, fy, fy - (b - 128.0) / 200.0))]
    made = []
    for row in _RGB:
        v = F.greatest(sum((F.lit(w) * p for w, p in zip(row[1:], parts[1:])), F.lit(row[0]) * parts[0]), F.lit(0.0))
        v = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)
        made.append(F.least(F.floor(255.0 * v + 0.5), F.lit(255)).cast("long"))
    return F.struct(*[v.alias(c) for v, c in zip(made, "rgb")])


def is_black(a: Column, b: Column) -> Column:
    return F.sqrt((a - 128.0) * (a - 128.0) + (b - 128.0) * (b - 128.0)) < BLACK_CHROMA


def first_centres(colours: DataFrame, page: str = "document_id") -> DataFrame:
    """page and centres (array of structs l, a, b): k of a page's distinct colours, evenly spread in the order of l, a and b.

    `colours` has page, l, a, b and n, the pixels of each distinct colour; k is a fortieth of the page's pixels, but 2 at least and 4 at
    most. Pages with fewer than 40 coloured pixels, or with a single colour, have no centres.
    """
    w = Window.partitionBy(page)
    ranked = colours.select(page, "l", "a", "b", F.row_number().over(w.orderBy("l", "a", "b")).alias("rank"), F.count("*").over(w).alias("m"), F.sum("n").over(w).alias("pixels"))
    k = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.col("pixels") / MIN_LAYER_PIXELS)), F.col("m")).cast("int")
    spread = ranked.where((F.col("pixels") >= MIN_LAYER_PIXELS) & (F.col("m") >= 2)).withColumn("k", k)
    chosen = spread.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where(F.expr("rank = (2 * j + 1) * m div (2 * k) + 1"))
    centre = F.struct(*[F.col(c).cast("double").alias(c) for c in "lab"]).alias("c")
    return chosen.groupBy(page).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", centre))), lambda s: s["c"]).alias("centres"))


def _nearest(centres: str = "centres") -> Column:
    """struct d2 and c (place from 0) of the centre nearest to l, a, b; the first of those as near."""
    far = lambda s, c: (F.col(c) - s[c]) * (F.col(c) - s[c])
    return F.array_min(F.transform(centres, lambda s, k: F.struct((far(s, "l") + far(s, "a") + far(s, "b")).alias("d2"), k.alias("c"))))


def k_means(colours: DataFrame, centres: DataFrame, rounds: int = 20, shift: float = 1.0, page: str = "document_id") -> DataFrame:
    """page, centres and pixels (of each centre) after at most `rounds` rounds; a page rests once none of its centres moves further than `shift`.

    A round gives every distinct colour of every page to its nearest centre and takes the means, weighted by pixels: a join on the
    page and a grouping that tasks combine. A centre without colours stays where it is.
    """
    now = stored(centres.select(page, "centres", F.lit(True).alias("open")), "centres")
    for _ in range(rounds):
        if now.where("open").isEmpty():
            break
        held = colours.join(now.where("open"), page).select(page, "l", "a", "b", "n", _nearest()["c"].alias("c"))
        sums = held.groupBy(page, "c").agg(F.sum("n").cast("double").alias("n"), *[F.sum(F.col(x) * F.col("n")).cast("double").alias(x) for x in "lab"])
        means = sums.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct(*[(F.col(x) / F.col("n")).alias(x) for x in "lab"])))).alias("means"))
        moved = now.join(means, page, "left").withColumn("next", F.transform("centres", lambda s, k: F.coalesce(F.try_element_at("means", k), s)))
        square = lambda p, q, x: (p[x] - q[x]) * (p[x] - q[x])
        far = F.array_max(F.zip_with("centres", "next", lambda p, q: square(p, q, "l") + square(p, q, "a") + square(p, q, "b")))
        moved = moved.select(page, F.when(F.col("open"), F.col("next")).otherwise(F.col("centres")).alias("centres"), (F.col("open") & (far > shift * shift)).alias("open"))
        now = stored(moved, "centres")
    held = colours.join(now, page).select(page, "n", _nearest()["c"].alias("c")).groupBy(page, "c").agg(F.sum("n").alias("n"))
    sizes = held.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("sizes"))
    return now.join(sizes, page).select(page, "centres", F.transform("centres", lambda s, k: F.coalesce(F.try_element_at("sizes", k), F.lit(0))).alias("pixels"))


def layers(pixels: DataFrame, page: str = "document_id") -> DataFrame:
    """Pixels (page, id, l, a, b) with their layer: black, color_1, color_2, ... by their centres' l, a and b, or unclassified.

    Clusters of fewer than 40 pixels, and coloured ink of pages with fewer, stay unclassified.
    """
    told = pixels.withColumn("black", is_black(F.col("a"), F.col("b")))
    colours = stored(told.where("not black").groupBy(page, "l", "a", "b").agg(F.count("*").alias("n")), "colours")
    found = k_means(colours, first_centres(colours, page), page=page)
    large = F.filter(F.arrays_zip("centres", "pixels"), lambda s: s["pixels"] >= MIN_LAYER_PIXELS)
    order = F.transform(F.array_sort(F.transform(large, lambda s: F.struct(s["centres"]["l"].alias("l"), s["centres"]["a"].alias("a"), s["centres"]["b"].alias("b")))), lambda s: s)
    named = found.select(page, "centres", "pixels", order.alias("order"))
    placed = told.join(named, page, "left").withColumn("c", F.when(~F.col("black"), _nearest()["c"]))
    own = F.get("centres", F.col("c"))
    rank = F.when(F.get("pixels", F.col("c")) >= MIN_LAYER_PIXELS, F.array_position("order", own))
    layer = F.when(F.col("black"), "black").when(rank > 0, F.concat(F.lit("color_"), rank.cast("string"))).otherwise("unclassified")
    return placed.select(*pixels.columns, layer.alias("layer"))
