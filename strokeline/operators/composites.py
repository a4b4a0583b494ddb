"""Stages of a drawing as one plan each: snapping, topology, and the association of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE, Profile
from ..functions import geometry as G
from . import association, graph, snapping, spatial


def ends_of(segments: DataFrame, page: str = "document_id") -> DataFrame:
    """Both ends of every segment (page, id, x0 to y1): page, id, k (0 or 1), ord (a number of the end's own), x, y."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("id") * 2 + k).alias("ord"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]))
    return segments.select(page, "id", each.alias("_e")).select(page, "id", "_e.*")


def axis_weights(primitives: DataFrame, models: DataFrame, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """page and the weight of the votes within 15 degrees of each of the model's three axes."""
    met = snapping.votes(primitives, profile, page).join(models.select(page, "rotation"), page)
    axes = G.triad(F.col("rotation"))
    near = lambda k: G.line_delta(F.col("angle"), axes[k])
    return met.groupBy(page).agg(*[F.sum(F.when(near(k) <= 15.0, F.col("weight") * (1 - near(k) / 15.0)).otherwise(0.0)).alias(f"weight_{k}") for k in range(3)])


def snap_stage(primitives: DataFrame, folder: str, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """Primitives (page, id, status, x0 to y1) snapped to the axes of their page, then with their ends moved to the centre of the ends they reach: id, reason, adjusted (number of ends moved) and the final ends."""
    models = snapping.axis_models(primitives, profile, page)
    decided = snapping.snapped(primitives, models, None, profile, page)
    ends = ends_of(decided, page)
    tolerance = profile.endpoint_align_tolerance
    pairs = spatial.radius_join(ends, ends, tolerance, page).where("l.ord < r.ord").select(F.col(f"l.{page}").alias(page), F.col("l.ord").alias("a"), F.col("r.ord").alias("b"))
    moved = association.aligned(ends, graph.connected_components(pairs, ends, folder, node="ord", page=page), page)
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(f"c{c}"))).alias(f"{c}{k}")
    final = moved.groupBy(page, "id").agg(F.count_if((F.col("members") > 1) & (F.col("moved") > 1e-9)).alias("adjusted"), at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"))
    return decided.select(page, "id", "reason").join(final, [page, "id"])


def topology_stage(segments: DataFrame, profile: Profile = PROFILE, page: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments (page, id, layer_id, x0 to y1): clusters of their ends are nodes, with centre, layers, degree and kind; a segment between two nodes is an edge, one within a node none."""
    ends = ends_of(segments, page).join(segments.select(page, "id", "layer_id"), [page, "id"])
    clustered = graph.leader_clusters(ends.select(page, "ord", "id", "k", "layer_id", "x", "y"), profile.endpoint_cluster_tolerance, page)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("cluster_id")))
    edges = clustered.groupBy(page, "id").agg(at(0).alias("start_node"), at(1).alias("end_node")).where("start_node <> end_node")
    lines = edges.join(segments.select(page, "id", "x0", "y0", "x1", "y1"), [page, "id"])
    angle = G.undirected(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    incident = graph.endpoints(lines.withColumn("angle", angle), [page, "id", "angle"])
    degree = incident.groupBy(page, "node").agg(F.count("*").alias("degree"), F.min_by("angle", "id").alias("_first"), F.max_by("angle", "id").alias("_last"))
    nodes = clustered.groupBy(page, F.col("cluster_id").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_sort(F.collect_set("layer_id")).alias("layers"), F.count("*").alias("ends"))
    made = nodes.join(degree, [page, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kind = graph.node_kind(F.col("degree"), G.line_delta(F.col("_first"), F.col("_last")))
    return made.withColumn("kind", kind).drop("_first", "_last"), edges


def measured_relationships(targets: DataFrame) -> DataFrame:
    """Relationships of dimensions to the edges they measure, from ranked targets (dimension_id, rank, edge_id); unresolved where a second one is as good."""
    second = F.max(F.col("rank")).over(Window.partitionBy("dimension_id")) > 1
    ranked = targets.select("document_id", "dimension_id", "rank", F.lit("topology_edge").alias("ref_kind"), F.col("edge_id").alias("ref_id"), second.alias("ambiguous"))
    return association.relationships(ranked, "measures", "dimension_id", "dim_")


def arrows_at_tips(tips: DataFrame, arrows: DataFrame, radius: float = 12.0, page: str = "document_id") -> DataFrame:
    """id and arrow_id of tips (page, id, x, y) with the centre of an arrow region within the radius; the first arrow by id."""
    return spatial.radius_join(tips, arrows, radius, page).groupBy(F.col("l.id").alias("id")).agg(F.min("r.id").alias("arrow_id"))


def aligned_arrowheads(witnesses: DataFrame, arrows: DataFrame, tolerance: float = 35.0, reach: float = 80.0, page: str = "document_id") -> DataFrame:
    """witness_id, arrow_id and end of arrow regions (page, id, x, y: centre, size) at an end of a witness line whose direction to that end is the line's, either way; of two ends the first.

    An arrow counts within its size and 8 pixels of the end, `reach` at most.
    """
    ends = ends_of(witnesses, page).join(witnesses.select(page, "id", "x0", "y0", "x1", "y1"), [page, "id"])
    met = spatial.radius_join(ends, arrows, reach, page).where("sqrt(d2) <= r.size + 8")
    line = G.direction(F.col("l.x1") - F.col("l.x0"), F.col("l.y1") - F.col("l.y0"))
    delta = G.line_delta(G.direction(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")), line)
    near = met.where(delta <= tolerance)
    return near.groupBy(F.col("l.id").alias("witness_id"), F.col("r.id").alias("arrow_id")).agg(F.min("l.k").alias("end"))


def toward(x: Column, y: Column, segment: str = "s") -> Column:
    """Whether a segment's second end is the one nearer to a point, so that it runs toward it."""
    return G.squared(F.col(f"{segment}.x1"), F.col(f"{segment}.y1"), x, y) <= G.squared(F.col(f"{segment}.x0"), F.col(f"{segment}.y0"), x, y)


def chord_deviation(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and deviation of samples (keys, k, x, y): the largest distance to the line from the first to the last; null where these coincide."""
    ends = samples.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "k").alias("_a"), F.max_by(F.struct("x", "y"), "k").alias("_b"), F.count("*").alias("n"))
    met = samples.join(ends, keys)
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    length = F.hypot(dx, dy)
    off = F.abs(dx * (F.col("_a.y") - F.col("y")) - dy * (F.col("_a.x") - F.col("x"))) / F.when(length < 1e-6, F.lit(None)).otherwise(length)
    return met.groupBy(*keys, "n").agg(F.max(off).alias("deviation"))


def ordered_corners(corners: DataFrame, key: str) -> DataFrame:
    """key and the corners (key, x, y) in order - top left, top right, bottom right, bottom left - by extremes of sum and difference; `ambiguous` where one corner has two places."""
    p = F.struct("x", "y")
    made = corners.groupBy(key).agg(F.min_by(p, F.col("x") + F.col("y")).alias("tl"), F.min_by(p, F.col("y") - F.col("x")).alias("tr"), F.max_by(p, F.col("x") + F.col("y")).alias("br"), F.max_by(p, F.col("y") - F.col("x")).alias("bl"))
    return made.withColumn("ambiguous", F.size(F.array_distinct(F.array("tl", "tr", "br", "bl"))) < 4)


def numbered(rows: DataFrame, by: str, order: list[str], prefix: str) -> DataFrame:
    """Rows with `name`: the prefix and a number of four digits in the order within `by`, from 0."""
    return rows.withColumn("name", F.format_string(f"{prefix}_%04d", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1))


def capped(rows: DataFrame, by: list[str], order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` rows of each group, the groups that have more): the cap is a stated property of the output, and what it cuts is reported."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_n") <= limit).drop("_n"), ranked.groupBy(*by).agg(F.max("_n").alias("rows")).where(F.col("rows") > limit)


def segments_of_edges(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """edge_id and segment_id of edges (id, primitive_ids): the segment (id, primitive_ids) of the same id, else the first by id that shares a primitive, else null."""
    own = edges.select(F.col("id").alias("edge_id"), "primitive_ids").join(segments.select(F.col("id").alias("edge_id"), F.col("id").alias("_own")), "edge_id", "left")
    named = segments.select("id", F.explode("primitive_ids").alias("_p")).groupBy("_p").agg(F.min("id").alias("_other"))  # one row for each primitive: no edge meets more than it names
    shared = own.where("_own is null").select("edge_id", F.explode("primitive_ids").alias("_p")).join(named, "_p").groupBy("edge_id").agg(F.min("_other").alias("_other"))
    return own.join(shared, "edge_id", "left").select("edge_id", F.coalesce("_own", "_other").alias("segment_id"))


def residuals(samples: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """key, n and rms: the root of the mean squared distance of samples (key, x, y) to their segment (key, x0 to y1)."""
    d = G.point_segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return samples.join(segments, key).withColumn("_d", d).groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"))


def strided(samples: DataFrame, key: str, order: str, at_most: int = 10) -> DataFrame:
    """Every so-manieth sample of each key, from the first, so that about `at_most` remain: a step of their number divided by it, 1 at least."""
    w = Window.partitionBy(key)
    made = samples.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return made.where(F.pmod("_k", F.greatest(F.floor(F.col("_n") / at_most), F.lit(1))) == 0).drop("_k", "_n")


def layer_names(colours: DataFrame, by: str = "document_id") -> DataFrame:
    """Colours (by, l, a, b) with the name of their layer: color_0 and so on, in the order of l, a, b."""
    return colours.withColumn("layer", F.format_string("color_%d", F.row_number().over(Window.partitionBy(by).orderBy("l", "a", "b")) - 1))
