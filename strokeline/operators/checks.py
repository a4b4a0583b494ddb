"""Integrity checks of scenes as issue tables (code, owner, path): each check is a join or a filter, and all are one union."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.text import first_invalid_xml_character


def issues(rows: DataFrame, code: str, owner: Column, path: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), owner.cast("string").alias("owner"), F.lit(path).alias("path"))


def duplicate_ids(objects: DataFrame, ident: str = "id", order: str = "ord") -> DataFrame:
    """Every occurrence of an id after its first."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(order))
    return issues(objects.withColumn("_n", n).where("_n > 1"), "DUPLICATE_ID", F.col(ident), "id")


def reference_problems(references: DataFrame, index: DataFrame) -> DataFrame:
    """References (owner, path, ref, expected) to ids that aren't in the index (id, kind), or are of another kind."""
    met = references.join(index.select(F.col("id").alias("ref"), "kind"), "ref", "left")
    code = F.when(F.col("kind").isNull(), "UNKNOWN_REFERENCE").when(F.col("kind") != F.col("expected"), "WRONG_REFERENCE_TYPE")
    return met.select(code.alias("code"), F.col("owner").cast("string").alias("owner"), "path").where("code is not null")


def out_of_bounds(points: DataFrame, width: float, height: float, path: str) -> DataFrame:
    """Points (owner, x, y) that aren't finite numbers, or lie outside the page; its edges belong to it."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    finite = points.where(bad("x") | bad("y"))
    inside = points.where(~(bad("x") | bad("y")) & ~(F.col("x").between(0, width) & F.col("y").between(0, height)))
    return issues(finite, "NON_FINITE_NUMBER", F.col("owner"), path).union(issues(inside, "COORDINATE_OUT_OF_BOUNDS", F.col("owner"), path))


def pipe_problems(pipes: DataFrame, junctions: DataFrame, tolerance: float) -> DataFrame:
    """Pipes (id, start_node, end_node, x0 to y1) without length, or whose ends lie off their junctions (id, x, y)."""
    same = pipes.where((F.col("start_node") == F.col("end_node")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))))
    made = [issues(same, "PIPE_DEGENERATE", F.col("id"), "pipe")]
    for k, node in ((0, "start_node"), (1, "end_node")):
        at = junctions.select(F.col("id").alias(node), F.col("x").alias("_x"), F.col("y").alias("_y"))
        far = pipes.join(at, node).where(G.squared(F.col(f"x{k}"), F.col(f"y{k}"), F.col("_x"), F.col("_y")) > tolerance * tolerance)
        made.append(issues(far, "PIPE_ENDPOINT_MISMATCH", F.col("id"), node))
    return functools.reduce(lambda a, b: a.union(b), made)


def missing_evidence(objects: DataFrame) -> DataFrame:
    return issues(objects.where((F.col("state") == "machine") & (F.col("evidence") == 0)), "MACHINE_EVIDENCE_MISSING", F.col("id"), "interpretation.evidence")


def text_problems(texts: DataFrame, path: str = "text") -> DataFrame:
    """Texts (owner, text) with a character that XML doesn't allow."""
    return issues(texts.where(first_invalid_xml_character(F.col("text")).isNotNull()), "TEXT_INVALID_CHARACTER", F.col("owner"), path)


def relationship_problems(relationships: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Relationships (id, type, from_id, to_id) that state connectivity, and dimensions (id, target) without the `measures` that matches theirs, or the reverse."""
    forbidden = relationships.where(F.col("type").isin("connects", "connected_to"))
    measures = relationships.where("type = 'measures'").select(F.col("from_id").alias("id"), F.col("to_id").alias("target"))
    lonely = dimensions.join(measures, ["id", "target"], "left_anti").union(measures.join(dimensions, ["id", "target"], "left_anti").select(*dimensions.columns))
    return issues(forbidden, "RELATIONSHIP_CONNECTIVITY_FORBIDDEN", F.col("id"), "type").union(issues(lonely, "DIMENSION_TARGET_MISMATCH", F.col("id"), "target"))


def symbol_problems(symbols: DataFrame, ports: DataFrame) -> DataFrame:
    """Symbols (id, symbol_id, ports: map of names to nodes) with ports their library entry (symbol_id, name, required) lacks, or without required ones."""
    own = symbols.select("id", "symbol_id", F.explode(F.map_keys("ports")).alias("name"))
    unknown = own.join(ports.select("symbol_id", "name"), ["symbol_id", "name"], "left_anti")
    needed = symbols.select("id", "symbol_id").join(ports.where("required").select("symbol_id", "name"), "symbol_id")
    missing = needed.join(own, ["id", "symbol_id", "name"], "left_anti")
    return issues(unknown, "SYMBOL_PORT_UNKNOWN_NAME", F.col("id"), "ports").union(issues(missing, "SYMBOL_REQUIRED_PORT_MISSING", F.col("id"), "ports"))


def unequal_keys(keys: Column, allowed: list[str]) -> Column:
    """Keys of an object that its schema doesn't allow."""
    return F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
