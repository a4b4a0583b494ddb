"""Scene assembly: candidates of the stages become scene objects of one schema, with ids that depend on the document and the candidate alone.

Every builder gives rows of OBJECT; a scene is their union in the order of the builders. References between objects go
through one map of (document_id, ref_kind, ref_id) to scene ids, so a polymorphic reference is an equi-join.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5

#: Columns of a scene object; what a kind doesn't have is null.
OBJECT = {"document_id": "long", "ord": "int", "type": "string", "ref": "string", "id": "string", "layer": "string", "x": "double", "y": "double", "x1": "double", "y1": "double", "start_id": "string", "end_id": "string", "target_id": "string", "label": "string", "score": "double", "stage": "string"}
BUILDERS = ("junction", "pipe_segment", "symbol", "dimension", "annotation", "unknown_mark", "relationship")
#: Scores of machine interpretations.
JUNCTION_SCORES, PIPE_SCORE, TARGET_SCORE, TEXT_SCORE, UNKNOWN_SCORE = (0.85, 0.7), 0.82, 0.72, 0.6, 0.35


def scene_id(document: Column, candidate: Column) -> Column:
    return uuid5(uuid.NAMESPACE_URL, F.concat_ws("|", document.cast("string"), candidate))


def objects(rows: DataFrame, kind: str, stage: str | Column, ref: Column, **columns: Column) -> DataFrame:
    """Rows of OBJECT from candidates (document_id and whatever the columns read)."""
    known = {"document_id": F.col("document_id"), "ord": F.lit(BUILDERS.index(kind)), "type": F.lit(kind), "ref": ref, "id": scene_id(F.col("document_id"), ref), "stage": F.lit(stage), "layer": F.lit("default"), **columns}
    return rows.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in OBJECT.items()])


def layers(candidates: DataFrame) -> DataFrame:
    """document_id, layer and place of a document's layers; one that names none has `default`."""
    named = candidates.where("layer is not null").select("document_id", "layer").distinct()
    plain = candidates.select("document_id").distinct().join(named, "document_id", "left_anti").select("document_id", F.lit("default").alias("layer"))
    return named.union(plain)


def with_known_layer(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (document_id, layer) whose unknown layer is replaced by the document's first."""
    first = known.groupBy("document_id").agg(F.min("layer").alias("_first"))
    there = known.select("document_id", "layer", F.lit(True).alias("_there"))
    met = rows.join(there, ["document_id", "layer"], "left").join(first, "document_id", "left")
    return met.withColumn("layer", F.when(F.col("_there"), F.col("layer")).otherwise(F.col("_first"))).drop("_there", "_first").select(*rows.columns)


def junctions(nodes: DataFrame) -> DataFrame:
    """Nodes (document_id, id, kind, confirmed, layer, x, y) as junctions."""
    score = F.when(F.col("confirmed"), JUNCTION_SCORES[0]).otherwise(JUNCTION_SCORES[1])
    return objects(nodes, "junction", "infer_topology", F.concat(F.lit("node_"), F.col("id").cast("string")), layer=F.col("layer"), x=F.col("x"), y=F.col("y"), label=F.col("kind"), score=score)


def resolved(references: DataFrame, made: DataFrame, ref: str, name: str) -> DataFrame:
    """References (document_id, `ref`: a candidate's name) with the scene id of their object as `name`, null for one that wasn't made."""
    ids = made.select("document_id", F.col("ref").alias(ref), F.col("id").alias(name))
    return references.join(ids, ["document_id", ref], "left")


def pipes(edges: DataFrame, made: DataFrame) -> DataFrame:
    """Edges (document_id, id, start_node, end_node, layer, x0 to y1) whose nodes both became junctions `made`, as pipes."""
    named = edges.withColumns({f"_{end}": F.concat(F.lit("node_"), F.col(f"{end}_node").cast("string")) for end in ("start", "end")})
    met = resolved(resolved(named, made, "_start", "start_id"), made, "_end", "end_id").where("start_id is not null and end_id is not null")
    ref = F.concat(F.lit("edge_"), F.col("id").cast("string"))
    return objects(met, "pipe_segment", "infer_topology", ref, layer=F.col("layer"), x=F.col("x0"), y=F.col("y0"), x1=F.col("x1"), y1=F.col("y1"), start_id=F.col("start_id"), end_id=F.col("end_id"), score=F.lit(PIPE_SCORE))


def symbols(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, unknown marks) of candidates (document_id, id, symbol_id, status, combined, x, y): only proposed ones are symbols."""
    ref = F.concat(F.lit("sym_"), F.col("id").cast("string"))
    known = F.col("status").eqNullSafe(F.lit("proposed")) & F.col("symbol_id").isNotNull() & (F.col("symbol_id") != "unknown")
    at = {"x": F.col("x"), "y": F.col("y"), "label": F.coalesce("symbol_id", F.lit("unknown"))}
    yes = objects(candidates.where(known), "symbol", "classify_symbols", ref, score=F.least(F.lit(1.0), F.col("combined")), **at)
    return yes, objects(candidates.where(~known), "unknown_mark", "classify_symbols", F.concat(F.lit("unknown_"), ref), score=F.lit(UNKNOWN_SCORE), **at)


def dimensions(candidates: DataFrame, made: DataFrame) -> DataFrame:
    """Dimensions (document_id, id, text, edge_ref, x, y), with the pipe they measure where it was made."""
    met = resolved(candidates, made, "edge_ref", "target_id")
    return objects(met, "dimension", "associate_markup", F.concat(F.lit("dim_"), F.col("id").cast("string")), x=F.col("x"), y=F.col("y"), target_id=F.col("target_id"), label=F.col("text"), score=F.lit(TARGET_SCORE))


def annotations(texts: DataFrame, targets: DataFrame, taken: DataFrame, made: DataFrame, margin: float) -> DataFrame:
    """Texts (document_id, id, text, confidence, x, y) as annotations: those with ranked targets (document_id, id, rank, score, target_ref), and those that neither these nor dimensions `taken` (document_id, id) use.

    A target counts if it is the only one, or leads the next by `margin`.
    """
    best = targets.groupBy("document_id", "id").agg(F.min_by("target_ref", "rank").alias("target_ref"), F.count("*").alias("_n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_b"))
    sure = F.when((F.col("_n") == 1) | (F.round(F.col("_a") - F.col("_b"), 9) >= margin), F.col("target_ref"))
    met = texts.join(best.withColumn("target_ref", sure), ["document_id", "id"], "left")
    free = met.join(taken.select("document_id", "id").distinct(), ["document_id", "id"], "left_anti").where("text is not null and text <> ''")
    score = F.when(F.col("_n").isNotNull(), F.lit(TARGET_SCORE)).otherwise(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(TEXT_SCORE))))
    stage = F.when(F.col("_n").isNotNull(), "associate_markup").otherwise("transcribe_regions")
    return objects(resolved(free, made, "target_ref", "target_id"), "annotation", stage, F.concat(F.lit("text_"), F.col("id").cast("string")), x=F.col("x"), y=F.col("y"), target_id=F.col("target_id"), label=F.col("text"), score=score)


def unknown_marks(regions: DataFrame, *covered: DataFrame) -> DataFrame:
    """Regions (document_id, id, kind, x, y) that no candidate set (document_id, id) covers, arrows aside."""
    every = functools.reduce(lambda a, b: a.union(b), [c.select("document_id", "id") for c in covered]).distinct()
    free = regions.where("kind <> 'arrow'").join(every, ["document_id", "id"], "left_anti")
    return objects(free, "unknown_mark", "detect_regions", F.concat(F.lit("region_"), F.col("id").cast("string")), x=F.col("x"), y=F.col("y"), label=F.col("kind"), score=F.lit(UNKNOWN_SCORE))


def relationships(made: DataFrame) -> DataFrame:
    """What dimensions and annotations point to, as objects of their own; targets that weren't made have none."""
    kind = F.when(F.col("type") == "dimension", "measures").otherwise("annotates")
    found = made.where("type in ('dimension', 'annotation') and target_id is not null").select("document_id", kind.alias("label"), F.col("id").alias("from_id"), F.col("target_id").alias("to_id"))
    ref = F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", "label", "from_id", "to_id"), 256), 1, 12))
    return objects(found, "relationship", "associate_markup", ref, start_id=F.col("from_id"), end_id=F.col("to_id"), label=F.col("label"))


def assembled(*parts: DataFrame) -> DataFrame:
    """The scene: all parts in one table, `ord` telling their order."""
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def counts(made: DataFrame) -> DataFrame:
    """Objects of each kind by document."""
    return made.groupBy("document_id").agg(*[F.count_if(F.col("type") == k).alias(f"{k}s") for k in BUILDERS], F.count("*").alias("objects"))


def code_severity(code: Column) -> Column:
    """Severity of a review code by its form."""
    return (
        F.when(code.startswith("dimension.") & code.contains("conflict"), "critical")
        .when(code.startswith("topology.") & code.contains("crossing"), "high")
        .when(code.contains("unresolved") | code.contains("ambiguous"), "high")
        .otherwise("medium")
    )


def planned_reviews(made: DataFrame, **stages: DataFrame) -> DataFrame:
    """Review items of all stages (document_id, issue_key, code, refs: candidate names by preference), open, each with the first of its objects that was made."""
    every = functools.reduce(lambda a, b: a.unionByName(b), [rows.select("document_id", "issue_key", "code", "refs", F.lit(stage).alias("stage")) for stage, rows in sorted(stages.items())])
    each = every.select("document_id", "issue_key", F.posexplode("refs").alias("_at", "_ref"))
    found = resolved(each, made, "_ref", "_id").groupBy("document_id", "issue_key").agg(F.min_by("_id", F.when(F.col("_id").isNotNull(), F.col("_at"))).alias("object_id"))
    return every.join(found, ["document_id", "issue_key"], "left").select("document_id", "issue_key", F.col("code").alias("issue_type"), code_severity(F.col("code")).alias("severity"), "object_id", F.lit("open").alias("state"), "stage")


def machine_reviews(made: DataFrame, below: float) -> DataFrame:
    """A review item for each machine object whose score is below a threshold."""
    return made.where(F.col("score") < below).select("document_id", F.concat(F.lit("machine:"), "id").alias("issue_key"), F.concat(F.lit("machine."), "type").alias("issue_type"), F.col("id").alias("object_id"), "score")


#: The points that objects of each kind have.
POINT_FIELDS = {"junction": ("position",), "pipe_segment": ("primitive.start", "primitive.end"), "symbol": ("position",), "annotation": ("anchor",), "dimension": ("witness.start", "witness.end")}


def point_paths(made: DataFrame) -> DataFrame:
    """document_id, id and path of every point of an object; kinds without points have none."""
    paths = F.coalesce(*[F.when(F.col("type") == kind, F.array(*[F.lit(p) for p in fields])) for kind, fields in POINT_FIELDS.items()])
    return made.select("document_id", "id", F.explode(paths).alias("path"))


def export_metadata(made: DataFrame, version: str) -> DataFrame:
    """document_id and metadata: JSON of what an export states - version, objects, and how many of them are unresolved."""
    open_ = (F.col("type") == "unknown_mark") | ((F.col("type") == "junction") & (F.col("label") == "unknown"))
    counted = made.groupBy("document_id").agg(F.count("*").alias("objects"), F.count_if(open_).alias("unresolved"))
    return counted.select("document_id", F.to_json(F.struct(F.lit(version).alias("version"), "objects", "unresolved")).alias("metadata"))


def attachment_problems(attached: DataFrame, limits: DataFrame) -> DataFrame:
    """Symbols (id, symbol_id, node_id, kind, edges: of the node, null where nothing is attached) whose node isn't of a kind (kinds) or degree (low, high) that the library's limits (symbol_id) allow."""
    met = attached.where("node_id is not null").join(limits, "symbol_id")
    code = F.when(F.col("kinds").isNotNull() & ~F.array_contains("kinds", F.col("kind")), "node_kind").when(F.col("edges") < F.col("low"), "too_few_edges").when(F.col("edges") > F.col("high"), "too_many_edges")
    return met.withColumn("code", code).where("code is not null").select("id", "symbol_id", "node_id", "code")
