"""Evidence of scene objects in the source image, ink as pixel rows, and readings as nested records."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

#: By EXIF orientation the image's x and y on display, as factors of x and y and of the stored width and height.
ORIENTATIONS = {
    1: ((1, 0, 0, 0), (0, 1, 0, 0)),
    2: ((-1, 0, 1, 0), (0, 1, 0, 0)),
    3: ((-1, 0, 1, 0), (0, -1, 0, 1)),
    4: ((1, 0, 0, 0), (0, -1, 0, 1)),
    5: ((0, 1, 0, 0), (1, 0, 0, 0)),
    6: ((0, -1, 0, 1), (1, 0, 0, 0)),
    7: ((0, -1, 0, 1), (-1, 0, 1, 0)),
    8: ((0, 1, 0, 0), (-1, 0, 1, 0)),
}
#: Groups of a reading table, in order, with their titles.
READING_GROUPS = (("dimensions", "Dimensions"), ("connections", "Connections"), ("components", "Components"), ("handwriting", "Other handwriting"))
READING_TABLE = T.StructType([T.StructField("groups", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("reading", T.StringType())])))])))])
#: The confidence of machine evidence without an observation, and half the side of a point's square.
CONFIDENCE, POINT_RADIUS = 0.75, 4.0


def oriented(orientation: Column, width: Column, height: Column) -> Column:
    """Row-major 3 x 3 matrix from a stored image to its display; identity for an unknown orientation."""
    row = lambda f: F.array(F.lit(float(f[0])), F.lit(float(f[1])), F.lit(float(f[2])) * width + F.lit(float(f[3])) * height)
    one = lambda o: F.concat(row(ORIENTATIONS[o][0]), row(ORIENTATIONS[o][1]), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return F.coalesce(*[F.when(orientation == o, one(o)) for o in ORIENTATIONS], one(1))


def display_size(orientation: Column, width: Column, height: Column) -> Column:
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def source_polygon(matrix: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The corners of a box in the source image, clockwise from the top left."""
    corners = ((x, y), (x + width, y), (x + width, y + height), (x, y + height))
    return F.array(*[G.apply_matrix(matrix, a, b) for a, b in corners])


def point_polygon(matrix: Column, x: Column, y: Column, radius: float = POINT_RADIUS) -> Column:
    return source_polygon(matrix, x - radius, y - radius, F.lit(2 * radius), F.lit(2 * radius))


def machine_evidence(stage: Column, artifact: Column, polygon: Column, confidence: Column) -> Column:
    return F.struct(stage.alias("stage"), artifact.alias("artifact_id"), polygon.alias("source_polygon"), F.coalesce(confidence, F.lit(CONFIDENCE)).alias("confidence"))


def centroid(points: Column) -> Column:
    """The mean of the vertices of an array of structs x, y."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda total, p: total + p[c]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def fitted(value: Column, upper: Column) -> Column:
    """A coordinate within 0 and `upper`, to six places, without minus zero."""
    return F.least(F.greatest(F.round(value, 6), F.lit(0.0)), upper.cast("double")) + F.lit(0.0)


def walked_pixels(segments: DataFrame, size: float, page: str = "document_id") -> DataFrame:
    """page, px, py: the pixels, `size` wide, that segments (page, x0 to y1) touch at steps of half a pixel, as often as they do."""
    steps = F.greatest(F.ceil(2 * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / size).cast("int"), F.lit(1))
    walked = segments.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda c: F.floor((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("_k") / F.col("_n")) / size).cast("long")
    return walked.select(page, at("x").alias("px"), at("y").alias("py"))


def ink_pixels(segments: DataFrame, size: float, page: str = "document_id") -> DataFrame:
    """page, px, py: the distinct pixels, `size` wide, that segments (page, x0 to y1) touch at steps of half a pixel."""
    return walked_pixels(segments, size, page).distinct()


def pixel_degrees(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """Ink with the number of its eight neighbours that are ink too."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    beside = ink.select(page, "px", "py", around.alias("s")).select(page, (F.col("px") + F.col("s.i")).alias("px"), (F.col("py") + F.col("s.j")).alias("py"))
    touched = beside.groupBy(page, "px", "py").agg(F.count("*").alias("degree"))
    return ink.join(touched, [page, "px", "py"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def pixel_number(px: Column, py: Column) -> Column:
    """One number for a pixel within a page."""
    return px * 1_000_000 + py


def pixel_links(ink: DataFrame, page: str = "document_id") -> DataFrame:
    """page, a, b: numbers of ink pixels that touch, each pair once."""
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    left = ink.select(page, pixel_number(F.col("px"), F.col("py")).alias("a"), "px", "py", ahead.alias("s"))
    left = left.select(page, "a", pixel_number(F.col("px") + F.col("s.i"), F.col("py") + F.col("s.j")).alias("b"))
    return left.join(ink.select(page, pixel_number(F.col("px"), F.col("py")).alias("b")), [page, "b"]).select(page, "a", "b")


def run_links(runs: DataFrame, page: str = "document_id") -> DataFrame:
    """page, a, b: numbers of runs of ink (page, py, x0, x1), each that of its first pixel, in neighbouring rows that touch. Far fewer than links of pixels."""
    below = runs.select(page, (F.col("py") - 1).alias("py"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    met = runs.join(below, [page, "py"]).where("_x0 <= x1 + 1 and _x1 >= x0 - 1")
    return met.select(page, pixel_number(F.col("x0"), F.col("py")).alias("a"), pixel_number(F.col("_x0"), F.col("py") + 1).alias("b"))


def run_boxes(runs: DataFrame, components: DataFrame, page: str = "document_id") -> DataFrame:
    """page, component, area and box of each connected component (page, node, component) of runs of ink."""
    numbered = runs.withColumn("node", pixel_number(F.col("x0"), F.col("py"))).join(components, [page, "node"])
    box = [F.min("x0").alias("x"), F.min("py").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("py") - F.min("py") + 1).alias("height")]
    return numbered.groupBy(page, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), *box)


def component_boxes(ink: DataFrame, components: DataFrame, page: str = "document_id") -> DataFrame:
    """page, component, area and the box of each connected component (page, node, component) of ink."""
    numbered = ink.withColumn("node", pixel_number(F.col("px"), F.col("py"))).join(components, [page, "node"])
    box = [F.min("px").alias("x"), F.min("py").alias("y"), (F.max("px") - F.min("px") + 1).alias("width"), (F.max("py") - F.min("py") + 1).alias("height")]
    return numbered.groupBy(page, "component").agg(F.count("*").alias("area"), *box)


def line_coverage(lines: DataFrame, ink: DataFrame, size: float, step: float, page: str = "document_id") -> DataFrame:
    """page, id and the part of the samples, `step` apart, of lines (page, id, x0 to y1) that lie on ink."""
    samples = F.greatest(F.floor(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / step).cast("int"), F.lit(1))
    walked = lines.withColumn("_n", samples).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda c: F.floor((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("_k") / F.col("_n")) / size).cast("long")
    met = walked.select(page, "id", at("x").alias("px"), at("y").alias("py")).join(ink.withColumn("_ink", F.lit(1.0)), [page, "px", "py"], "left")
    return met.groupBy(page, "id").agg(F.avg(F.coalesce("_ink", F.lit(0.0))).alias("coverage"))


def disk_coverage(centres: DataFrame, ink: DataFrame, size: float, radius: int, page: str = "document_id") -> DataFrame:
    """page, id and the part of the pixels within `radius` pixels of a centre (page, id, x, y) that are ink."""
    inside = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in inside]))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    each = centres.select(page, "id", cell("x").alias("cx"), cell("y").alias("cy"), around.alias("s"))
    each = each.select(page, "id", (F.col("cx") + F.col("s.i")).alias("px"), (F.col("cy") + F.col("s.j")).alias("py"))
    met = each.join(ink.withColumn("_ink", F.lit(1.0)), [page, "px", "py"], "left")
    return met.groupBy(page, "id").agg(F.avg(F.coalesce("_ink", F.lit(0.0))).alias("coverage"))


def reading_table(text: Column) -> Column:
    """A provider's JSON as READING_TABLE, null unless it has the groups in order with their titles, no other keys, and no blank cell."""
    parsed = F.from_json(text, READING_TABLE)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    ok = [F.json_object_keys(text) == F.array(F.lit("groups")), F.size(parsed["groups"]) == len(READING_GROUPS)]
    for n, (ident, title) in enumerate(READING_GROUPS):
        group = F.get(parsed["groups"], F.lit(n))
        raw = F.get_json_object(text, f"$.groups[{n}]")
        ok.append((group["id"] == ident) & (group["title"] == title) & group["rows"].isNotNull())
        ok.append(F.size(F.array_except(F.json_object_keys(raw), F.array(F.lit("id"), F.lit("title"), F.lit("rows")))) == 0)
        ok.append(~F.exists(group["rows"], lambda r: r.isNull() | blank(r["location"]) | blank(r["reading"])))
    return F.when(functools.reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in ok]), parsed)


def provider_text(payload: Column, paths: tuple[str, ...] = ("$.result.response", "$.result.output", "$.result.text", "$.response", "$.output")) -> Column:
    """The first text of a provider's answer by the order of its places; null if all are blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


def joined_parts(payload: Column) -> Column:
    """The texts of the parts of the first candidate of an answer, one after the other; null if nothing is left."""
    parts = F.from_json(F.get_json_object(payload, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.nullif(F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")), F.lit(""))


def retry_schedule(calls: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    """key, made (attempts that count), waited (seconds) and outcome of calls (key, attempt, status): transient errors are tried again after 1, 2, ... seconds, anything else ends the series."""
    folded = calls.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt", "status"))).alias("_c"))
    start = F.struct(F.lit(0).alias("made"), F.lit(0).alias("waited"), F.lit("none").alias("outcome"), F.lit(True).alias("open"))

    def step(s: Column, c: Column) -> Column:
        go = s["open"] & (s["made"] < attempts)
        again = (c["status"] == "transient") & (s["made"] + 1 < attempts)
        after = F.struct((s["made"] + 1).alias("made"), (s["waited"] + F.when(again, F.pow(F.lit(2), s["made"]).cast("int")).otherwise(0)).alias("waited"), c["status"].alias("outcome"), again.alias("open"))
        return F.when(go, after).otherwise(s)

    made = folded.withColumn("_s", F.aggregate("_c", start, step))
    return made.select(key, F.col("_s.made").alias("made"), F.col("_s.waited").alias("waited"), F.col("_s.outcome").alias("outcome"))
