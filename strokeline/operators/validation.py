"""Validation of whole scenes: every rule that ties layers, objects and relationships together, as one table of issues in the order of the rules.

    layers         page, n, id
    objects        page, n, id, type, state, evidence (their number), layer, symbol_id, start_id, end_id, targets (array of ids), x, y, x1, y1
    ports          page, n (of the symbol), port, node_id
    relationships  page, n, id, type, state, evidence, from_id, to_id
    library        symbol_id, ports (array of names), required (array of names)

n is a row's place in its list. Pipes lie from (x, y) to (x1, y1) by themselves; other objects are at (x, y). All ids of a
page share one index, where of equal ids the first counts: layers, then objects, then relationships.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

#: The rules in their order. Fixed values.
STEPS = ("ids", "references", "pipes", "symbols", "evidence", "relationships")
#: What pipes are joined by, which relationships may not say again. Fixed values.
CONNECTIVITY = ("pipe_segment", "junction", "symbol")
#: The type of object that a relationship comes from. Fixed values.
SOURCES = {"annotates": "annotation", "callout_targets": "annotation", "measures": "dimension"}


def _at(place: str, *more: Column | str) -> Column:
    return F.concat(F.lit(f"{place}["), F.col("n").cast("string"), F.lit("]"), *[m if isinstance(m, Column) else F.lit(m) for m in more])


def _issues(rows: DataFrame, page: str, step: str, code: Column | str, path: Column, owner: str = "id") -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    return rows.select(page, F.lit(STEPS.index(step)).alias("step"), code.alias("code"), path.alias("path"), F.col(owner).alias("owner"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.union(b), parts)


def indexed(layers: DataFrame, objects: DataFrame, relationships: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(index: page, id, kind, own (type), x, y, targets; duplicates: page, id, path) of all ids."""
    none, row = F.lit(None), lambda rows, ord_, kind, own, *more: rows.select(page, "id", F.lit(ord_).alias("ord"), "n", F.lit(kind).alias("kind"), own.alias("own"), *more)
    blank = (none.cast("double").alias("x"), none.cast("double").alias("y"), none.cast("array<string>").alias("targets"))
    every = _union([
        row(layers, 0, "layer", F.lit("layer"), *blank), row(objects, 1, "object", F.col("type"), "x", "y", "targets"), row(relationships, 2, "relationship", F.lit("relationship"), *blank),
    ])
    every = every.withColumn("_k", F.row_number().over(Window.partitionBy(page, "id").orderBy("ord", "n")))
    path = F.when(F.col("ord") == 0, _at("layers", ".id")).when(F.col("ord") == 1, _at("objects", ".id")).otherwise(_at("relationships", ".id"))
    return every.where("_k = 1").drop("_k", "ord", "n"), every.where("_k > 1").select(page, "id", path.alias("path"))


def references(objects: DataFrame, ports: DataFrame, page: str) -> DataFrame:
    """page, owner, path, ref and expected (layer, object or junction) of everything that objects refer to."""
    row = lambda rows, path, ref, expected: rows.select(page, F.col("id").alias("owner"), path.alias("path"), F.col(ref).alias("ref"), F.lit(expected).alias("expected"))
    of = lambda kind: objects.where(F.col("type") == kind)
    plugged = ports.where("node_id is not null").join(of("symbol").select(page, "n", "id"), [page, "n"])
    noted = of("annotation").select(page, "n", "id", F.explode("targets").alias("ref"))
    measured = of("dimension").select(page, "n", "id", F.posexplode("targets").alias("j", "ref"))
    return _union([
        row(objects, _at("objects", ".layerId"), "layer", "layer"), row(of("pipe_segment"), _at("objects", ".startNodeId"), "start_id", "junction"), row(of("pipe_segment"), _at("objects", ".endNodeId"), "end_id", "junction"),
        row(plugged, _at("objects", '.portNodeIds["', F.col("port"), '"]'), "node_id", "junction"), row(noted, _at("objects", ".targetObjectId"), "ref", "object"),
        row(measured, _at("objects", ".targetObjectIds[", F.col("j").cast("string"), "]"), "ref", "object"),
    ])


def _resolution(expected: Column) -> Column:
    """What is wrong with a reference that met an index entry (kind, own), or none; null where it is right."""
    right = F.when(expected == "junction", (F.col("kind") == "object") & (F.col("own") == "junction")).otherwise(F.col("kind") == expected)
    return F.when(F.col("kind").isNull(), "UNKNOWN_REFERENCE").when(~right, "WRONG_REFERENCE_TYPE")


def reference_issues(objects: DataFrame, ports: DataFrame, index: DataFrame, page: str) -> DataFrame:
    met = references(objects, ports, page).join(index.select(page, F.col("id").alias("ref"), "kind", "own"), [page, "ref"], "left")
    met = met.withColumn("_code", _resolution(F.col("expected"))).where("_code is not null")
    return _issues(met, page, "references", F.col("_code"), F.col("path"), "owner")


def pipe_issues(objects: DataFrame, index: DataFrame, page: str, tolerance: float) -> DataFrame:
    """Pipes from a node to itself or, else, without length, and ends that lie off their junctions."""
    pipes = objects.where("type = 'pipe_segment'")
    short = G.squared(F.col("x"), F.col("y"), F.col("x1"), F.col("y1")) <= tolerance * tolerance
    same = F.col("start_id") == F.col("end_id")
    parts = [_issues(pipes.where(same), page, "pipes", "PIPE_DEGENERATE", _at("objects", ".endNodeId")), _issues(pipes.where(~same & short), page, "pipes", "PIPE_DEGENERATE", _at("objects", ".primitive"))]
    for ref, end, x, y in (("start_id", "start", "x", "y"), ("end_id", "end", "x1", "y1")):
        nodes = index.where("own = 'junction'").select(page, F.col("id").alias(ref), F.col("x").alias("_x"), F.col("y").alias("_y"))
        gap = G.squared(F.col(x), F.col(y), F.col("_x"), F.col("_y"))
        far = pipes.join(nodes, [page, ref]).where((gap > tolerance * tolerance) & (gap < float("inf")))
        parts.append(_issues(far, page, "pipes", "PIPE_ENDPOINT_MISMATCH", _at("objects", f".primitive.{end}")))
    return _union(parts)


def symbol_issues(objects: DataFrame, ports: DataFrame, library: DataFrame, page: str) -> DataFrame:
    """Symbols that the library lacks; ports that a symbol's entry lacks, and required ones that the symbol lacks."""
    own = ports.groupBy(page, "n").agg(F.collect_set("port").alias("_own"))
    met = objects.where("type = 'symbol'").join(library.select("symbol_id", "ports", "required"), "symbol_id", "left").join(own, [page, "n"], "left")
    names, known = F.coalesce("_own", F.array().cast("array<string>")), F.col("ports").isNotNull()
    more = met.where(known).select(page, "n", "id", F.explode(F.array_except(names, "ports")).alias("port"))
    less = met.where(known).select(page, "n", "id", F.explode(F.array_except("required", names)).alias("port"))
    return _union([
        _issues(met.where(~known), page, "symbols", "UNKNOWN_REFERENCE", _at("objects", ".symbolId")), _issues(more, page, "symbols", "SYMBOL_PORT_UNKNOWN_NAME", _at("objects", '.portNodeIds["', F.col("port"), '"](key)')),
        _issues(less, page, "symbols", "SYMBOL_REQUIRED_PORT_MISSING", _at("objects", ".portNodeIds")),
    ])


def evidence_issues(objects: DataFrame, relationships: DataFrame, page: str) -> DataFrame:
    bare = "state = 'machine' and evidence = 0"
    parts = [_issues(rows.where(bare), page, "evidence", "MACHINE_EVIDENCE_MISSING", _at(place, ".interpretation.evidence")) for rows, place in ((objects, "objects"), (relationships, "relationships"))]
    return _union(parts)


def relationship_issues(objects: DataFrame, relationships: DataFrame, index: DataFrame, page: str) -> DataFrame:
    """Relationships whose ends aren't objects, that say what pipes say, or come from another type than theirs; dimensions and `measures` that don't match."""
    side = lambda c: index.select(page, F.col("id").alias(f"{c}_id"), F.struct("kind", "own", "targets").alias(f"_{c}"))
    met = relationships.join(side("from"), [page, "from_id"], "left").join(side("to"), [page, "to_id"], "left")
    thing = lambda c: F.when(F.col(f"_{c}.kind") == "object", F.col(f"_{c}.own"))
    met = met.withColumns({"_source": thing("from"), "_target": thing("to"), "_wanted": F.coalesce(*[F.when(F.col("type") == t, F.lit(s)) for t, s in SOURCES.items()])})
    said = F.coalesce(F.col("_source").isin(*CONNECTIVITY) & F.col("_target").isin(*CONNECTIVITY), F.lit(False))
    stray = ~said & F.col("_source").isNotNull() & ~F.col("_source").eqNullSafe(F.col("_wanted"))
    measures = met.where(~said & (F.col("type") == "measures") & (F.col("_source") == "dimension") & F.col("_target").isNotNull())
    parts = []
    for c, path in (("from", ".fromId"), ("to", ".toId")):
        ends = met.withColumns({"kind": F.col(f"_{c}.kind"), "own": F.col(f"_{c}.own")}).withColumn("_code", _resolution(F.lit("object"))).where("_code is not null")
        parts.append(_issues(ends, page, "relationships", F.col("_code"), _at("relationships", path)))
    parts.append(_issues(met.where(said), page, "relationships", "RELATIONSHIP_CONNECTIVITY_FORBIDDEN", _at("relationships")))
    parts.append(_issues(met.where(stray), page, "relationships", "RELATIONSHIP_INVALID_ENDPOINTS", _at("relationships", ".fromId")))
    unlisted = measures.where(~F.coalesce(F.array_contains("_from.targets", F.col("to_id")), F.lit(False)))
    parts.append(_issues(unlisted, page, "relationships", "DIMENSION_TARGET_MISMATCH", _at("relationships", ".toId")))
    listed = objects.where("type = 'dimension'").select(page, "n", "id", F.posexplode("targets").alias("j", "ref"))
    listed = listed.join(index.where("kind = 'object'").select(page, F.col("id").alias("ref")), [page, "ref"])
    lonely = listed.join(measures.select(page, F.col("from_id").alias("id"), F.col("to_id").alias("ref")).distinct(), [page, "id", "ref"], "left_anti")
    parts.append(_issues(lonely, page, "relationships", "DIMENSION_TARGET_MISMATCH", _at("objects", ".targetObjectIds[", F.col("j").cast("string"), "]")))
    return _union(parts)


def scene_issues(layers: DataFrame, objects: DataFrame, ports: DataFrame, relationships: DataFrame, library: DataFrame, page: str = "document_id", tolerance: float = 1e-6) -> DataFrame:
    """page, step (place in STEPS), code, path and owner of everything that is wrong with scenes; a scene without issues has no row.

    A null end, layer or target is a reference to nothing, but for ports, which may be open.
    """
    index, repeated = indexed(layers, objects, relationships, page)
    parts = [
        _issues(repeated, page, "ids", "DUPLICATE_ID", F.col("path")), reference_issues(objects, ports, index, page), pipe_issues(objects, index, page, tolerance),
        symbol_issues(objects, ports, library, page), evidence_issues(objects, relationships, page), relationship_issues(objects, relationships, index, page),
    ]
    return _union(parts)
