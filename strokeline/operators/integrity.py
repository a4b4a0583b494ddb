"""Integrity of stage artifacts and drawn scenes: each rule gives rows (owner, code, detail), and a report is their union.

Every reference is checked by an anti-join against the ids that exist, polymorphic ones against one union of all kinds.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

#: Which candidates a relationship may start from, and what it may point to.
SOURCES = {"measures": "dimension", "annotates": "annotation", "callout_targets": "annotation"}
MEASURED = "topology_edge"
#: Parts that the problems of one kind are dealt into; each part's first ones are compared at the end.
BUCKETS = 1024


def finding(rows: DataFrame, code: str, owner: Column, detail: Column) -> DataFrame:
    return rows.select(owner.cast("string").alias("owner"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def report(*parts: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions. Adaptive execution doesn't merge a number that is asked for, so a task sorts no more than its part."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def missing(references: DataFrame, there: DataFrame, code: str, key: list[str], owner: str = "owner") -> DataFrame:
    """References (owner and the key columns) that aren't there; null ones refer to nothing and are no fault.

    The ids of a partition, distinct and so never hot, are hashed; references stream past them and aren't sorted, however many are to one id.
    """
    given = references.where(functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    ids = spread(there.select(*key), *key).distinct().hint("shuffle_hash")
    return finding(spread(given, *key).join(ids, key, "left_anti"), code, F.col(owner), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))


def topology_problems(nodes: DataFrame, edges: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Of nodes (id), edges (id, start_node, end_node) and alternatives of hypotheses (id, alternative_id, node_ids, edge_ids, recommended): repeated edges, ends and members that don't exist, edges without length, recommendations of no alternative."""
    repeated = edges.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    node_ids, edge_ids = nodes.select(F.col("id").alias("ref")), edges.select(F.col("id").alias("ref"))
    ends = [missing(edges.select(F.col("id").alias("owner"), F.col(c).alias("ref")), node_ids, f"missing_{c}", ["ref"]) for c in ("start_node", "end_node")]
    members = [missing(hypotheses.select(F.col("id").alias("owner"), F.explode(c).alias("ref")), ids, f"missing_{c[:4]}_of_alternative", ["ref"]) for c, ids in (("node_ids", node_ids), ("edge_ids", edge_ids))]
    known = spread(hypotheses.select("id", F.col("alternative_id").alias("ref")), "id", "ref")
    given = hypotheses.select("id", F.col("recommended").alias("ref")).where("ref is not null")
    advice = spread(given.distinct(), "id", "ref").join(known, ["id", "ref"], "left_anti")
    return report(
        finding(repeated, "duplicate_edge", F.col("id"), F.col("_n")), *ends, finding(edges.where("start_node = end_node"), "self_loop", F.col("id"), F.col("start_node")), *members,
        finding(advice, "unknown_recommendation", F.col("id"), F.col("ref")),
    )


def candidate_problems(candidates: DataFrame, regions: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Of text or symbol candidates (id, region_id, status, label): repeated ids, regions that don't exist, proposals without a label, labels that the library (label) lacks."""
    repeated = candidates.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    proposed = candidates.where("status = 'proposed'")
    parts = [
        finding(repeated, "duplicate_candidate", F.col("id"), F.col("_n")),
        missing(candidates.select(F.col("id").alias("owner"), F.col("region_id").alias("ref")), regions.select(F.col("id").alias("ref")), "missing_region", ["ref"]),
        finding(proposed.where("label is null or trim(label) = ''"), "blank_proposal", F.col("id"), F.col("status")),
    ]
    if library is not None:
        parts.append(missing(candidates.select(F.col("id").alias("owner"), "label"), library, "unknown_label", ["label"]))
    return report(*parts)


def target_problems(targets: DataFrame, known: DataFrame, code: str = "missing_target") -> DataFrame:
    """Targets (owner, ref_kind, ref_id) that no known thing (ref_kind, ref_id) is."""
    return missing(targets, known, code, ["ref_kind", "ref_id"])


def association_problems(dimensions: DataFrame, annotations: DataFrame, relationships: DataFrame, reviews: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Of dimensions and annotations (id, text_id, status, targets: array of ref_kind and ref_id), relationships (id, type, from_id, ref_kind, ref_id, evidence) and review items (id, kind, ref): texts, targets and sources that don't exist, proposals without a target, relationships of the wrong kind or without evidence."""
    text_ids = texts.select(F.col("id").alias("ref"))
    sources = dimensions.select(F.lit("dimension").alias("kind"), "id").union(annotations.select(F.lit("annotation").alias("kind"), "id"))
    parts = []
    for name, rows in (("dimension", dimensions), ("annotation", annotations)):
        parts.append(missing(rows.select(F.col("id").alias("owner"), F.col("text_id").alias("ref")), text_ids, f"{name}_without_text", ["ref"]))
        parts.append(finding(rows.where((F.col("status") == "proposed") & (F.size("targets") == 0)), f"{name}_without_target", F.col("id"), F.col("status")))
        parts.append(target_problems(rows.select(F.col("id").alias("owner"), F.explode("targets").alias("_t")).select("owner", "_t.*"), known, f"{name}_missing_target"))
    kind = F.coalesce(*[F.when(F.col("type") == t, F.lit(k)) for t, k in SOURCES.items()])
    parts.append(missing(relationships.select(F.col("id").alias("owner"), kind.alias("kind"), F.col("from_id").alias("id")), sources, "relationship_without_source", ["kind", "id"]))
    parts.append(finding(relationships.where((F.col("type") == "measures") & (F.col("ref_kind") != MEASURED)), "measures_no_edge", F.col("id"), F.col("ref_kind")))
    parts.append(target_problems(relationships.select(F.col("id").alias("owner"), "ref_kind", "ref_id"), known, "relationship_missing_target"))
    parts.append(finding(relationships.where((F.col("interpretation") == "proposed") & (F.col("evidence") == 0)), "relationship_without_evidence", F.col("id"), F.col("type")))
    every = sources.union(texts.select(F.lit("text").alias("kind"), "id"))
    parts.append(missing(reviews.select(F.col("id").alias("owner"), "kind", F.col("ref").alias("id")), every, "review_of_nothing", ["kind", "id"]))
    return report(*parts)


def first_problems(found: DataFrame, by: str, limit: int) -> DataFrame:
    """`by`, the number of problems (owner, code, detail) and the first `limit` of them in one line. A kind of problem is never one group of rows."""
    dealt = spread(found.withColumn("_b", F.pmod(F.xxhash64("owner", "code", "detail"), F.lit(BUCKETS))), by, "_b")
    w = Window.partitionBy(by, "_b").orderBy("owner", "code", "detail")
    one = F.struct("owner", "code", "detail")
    ranked = dealt.withColumn("_n", F.row_number().over(w)).groupBy(by, "_b").agg(F.count("*").alias("_c"), F.collect_list(F.when(F.col("_n") <= limit, one)).alias("_f"))
    both = ranked.groupBy(by).agg(F.sum("_c").alias("problems"), F.slice(F.array_sort(F.flatten(F.collect_list("_f"))), 1, limit).alias("_f"))
    return both.select(by, "problems", F.array_join(F.transform("_f", lambda x: F.concat_ws(" ", x["code"], x["owner"], x["detail"])), "; ").alias("message"))


def rejected_attachments(references: DataFrame, junctions: DataFrame) -> DataFrame:
    """References (owner, node_id) to junctions (id, state) that were rejected: what still hangs on them can't be drawn."""
    gone = junctions.where("state = 'rejected'").select(F.col("id").alias("node_id"))
    return finding(references.join(gone, "node_id", "left_semi"), "attached_to_rejected", F.col("owner"), F.col("node_id"))


def live_with_degrees(objects: DataFrame, incidences: DataFrame) -> DataFrame:
    """Objects (id, state) that weren't rejected, with the number of live pipes and ports (node_id, state) at each."""
    degree = incidences.where("state <> 'rejected'").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("degree"))
    return objects.where("state <> 'rejected'").join(degree, "id", "left").fillna(0, ["degree"])


def drawn_differences(expected: DataFrame, drawn: DataFrame) -> DataFrame:
    """Ids (page, id) of live objects that aren't drawn, of drawings of no object, and of objects drawn more than once."""
    both = expected.select("page", "id").distinct().withColumn("_e", F.lit(1)).join(drawn.groupBy("page", "id").agg(F.count("*").alias("_d")), ["page", "id"], "full")
    code = F.when(F.col("_d").isNull(), "not_drawn").when(F.col("_e").isNull(), "not_in_scene").when(F.col("_d") > 1, "drawn_twice")
    return both.select("page", "id", code.alias("code")).where("code is not null")


def id_problems(drawn: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Elements (page, place, id, object_id) whose id repeats on its page, has an unknown prefix, or isn't its prefix and its object."""
    w = Window.partitionBy("page", "id").orderBy("place")
    prefix = F.regexp_extract("id", r"^([a-z]+-)", 1)
    code = F.when(F.row_number().over(w) > 1, "repeated").when(~prefix.isin(*prefixes), "unknown_prefix").when(F.col("object_id").isNotNull() & (F.col("id") != F.concat(prefix, "object_id")), "other_object")
    return drawn.withColumn("code", code).where("code is not null").select("page", "place", "id", "code")


def outside_view(values: DataFrame, views: DataFrame, margin: float) -> DataFrame:
    """Coordinates (page, owner, axis, value) outside the page's view (page, width, height) and a margin."""
    size = F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height"))
    return values.join(views, "page").where((F.col("value") < -margin) | (F.col("value") > size + margin) | F.isnan("value")).select("page", "owner", "axis", "value")


def view_mismatches(views: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose view box (page, view_box) isn't 0 0 width height of the page (page, width, height)."""
    stated = F.concat_ws(" ", F.lit("0"), F.lit("0"), F.col("width").cast("string"), F.col("height").cast("string"))
    return views.join(pages, "page").where(F.col("view_box") != stated).select("page", "view_box", stated.alias("expected"))


def pipe_line_mismatches(lines: DataFrame, pipes: DataFrame, junctions: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Drawn lines (id, x0 to y1) whose ends aren't the junctions (id, x, y) of their pipe (id, start_node, end_node), in either direction."""
    met = lines.join(pipes.select("id", "start_node", "end_node"), "id")
    for side, node in (("s", "start_node"), ("e", "end_node")):
        met = met.join(junctions.select(F.col("id").alias(node), F.col("x").alias(f"_{side}x"), F.col("y").alias(f"_{side}y")), node)
    near = lambda a, b: (F.abs(F.col(f"x{a}") - F.col(f"_{b}x")) <= tolerance) & (F.abs(F.col(f"y{a}") - F.col(f"_{b}y")) <= tolerance)
    return met.where(~((near(0, "s") & near(1, "e")) | (near(0, "e") & near(1, "s")))).select("id", F.round(G.distance(F.col("x0"), F.col("y0"), F.col("_sx"), F.col("_sy")), 6).alias("off"))
