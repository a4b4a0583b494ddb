"""Ranking of readings and symbols: alternatives with their evidence, margins, and the state a candidate gets from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE, Profile
from ..functions import geometry as G
from . import spatial

#: By symbol the base of its shape score and the weight of each feature.
SHAPES = {
    "ball_valve": (0.5, {"symmetry": 0.2, "near_three_halves": 0.1}),
    "block_bleed_assembly": (0.35, {"symmetry": 0.15, "fill": 0.1}),
    "tee_fitting": (0.2, {"symmetry": 0.1}),
    "elbow_fitting": (0.2, {"symmetry": 0.1}),
    "flange": (0.4, {"symmetry": 0.3, "wide": 0.2}),
    "threaded_connection": (0.3, {"symmetry": 0.2}),
    "drop": (0.35, {"few_vertices": 0.25}),
    "riser": (0.35, {"few_vertices": 0.25}),
    "endpoint": (0.35, {"fill": 0.2}),
    "flow_arrow": (0.3, {"few_vertices": 0.4, "long": 0.2}),
    "equipment_connection": (0.3, {"compact": 0.2}),
    "unknown": (0.25, {"fill": 0.15}),
}
#: The shape score of a flow arrow in an arrow region, of an alias in a nearby text, of a proposed reading, and what a graph nearby adds to the latter.
ARROW_SCORE, ALIAS_SCORE, VOCABULARY_SCORE, GRAPH_BONUS = 0.85, 0.7, 0.55, 0.02
FITTINGS = ("tee_fitting", "elbow_fitting")


@dataclass(frozen=True)
class Symbol:
    """A library entry: names that a text may call it by, and the nodes it may be attached to."""

    symbol_id: str
    aliases: tuple[str, ...] = ()
    node_kinds: tuple[str, ...] | None = None
    edges: tuple[int, int] | None = None


def vocabulary_alternative(raw: Column, proposed: Column) -> Column:
    """An array with the proposed reading as an alternative, empty where nothing is proposed."""
    one = F.array(F.struct(proposed.alias("text"), F.lit(VOCABULARY_SCORE).alias("score"), F.lit("vocabulary").alias("source")))
    return F.when(proposed.isNull() | (proposed == F.trim(raw)), F.slice(one, 1, 0)).otherwise(one)


def reranked(alternatives: DataFrame, nearby: DataFrame, limit: int = 5) -> DataFrame:
    """The first `limit` alternatives (text_id, ord, text, score, source) by score, with `rank`; near a graph (text_id, nodes) the vocabulary's gain a little, rounded to nine places. Ties keep their order."""
    met = alternatives.join(nearby.where("nodes > 0").select("text_id", F.lit(True).alias("_near")), "text_id", "left")
    gain = F.when(F.col("_near") & (F.col("source") == "vocabulary"), F.lit(GRAPH_BONUS)).otherwise(F.lit(0.0))
    made = met.withColumn("score", F.when(gain > 0, F.least(F.lit(1.0), F.round(F.col("score") + gain, 9))).otherwise(F.col("score"))).drop("_near")
    w = Window.partitionBy("text_id").orderBy(F.desc("score"), "ord")
    return made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def text_status(kind: Column, text: Column, confidence: Column, margin: Column, profile: Profile = PROFILE) -> Column:
    """State of a region's reading: skipped for other regions, then unreadable, low_confidence, conflicting or proposed; the first that holds."""
    return (
        F.when(~kind.isin("text", "dimension"), "skipped")
        .when(text.isNull() | (F.trim(text) == ""), "unreadable")
        .when(confidence < profile.min_text_confidence, "low_confidence")
        .when(margin < profile.conflict_margin, "conflicting")
        .otherwise("proposed")
    )


def shape_scores(kind: Column, aspect: Column, fill: Column, symmetry: Column, vertices: Column) -> Column:
    """Array of structs ord, symbol_id, shape for every symbol, from the features of a region's crop."""
    step = lambda c: F.when(c, 1.0).otherwise(0.0)
    features = {"symmetry": symmetry, "fill": fill, "few_vertices": step(vertices <= 4), "wide": step(aspect > 1.2), "long": step(aspect > 1.0), "compact": step(aspect < 1.2), "near_three_halves": 1.0 - F.abs(aspect - 1.5)}
    made = []
    for n, (symbol, (base, weights)) in enumerate(SHAPES.items()):
        score = F.lit(base)
        for name, weight in weights.items():
            score = score + F.lit(weight) * features[name]
        score = G.clamp(score, 0.0, 1.0)
        if symbol == "flow_arrow":
            score = F.when(kind == "arrow", F.lit(ARROW_SCORE)).otherwise(score)
        made.append(F.struct(F.lit(n).alias("ord"), F.lit(symbol).alias("symbol_id"), score.alias("shape")))
    return F.array(*made)


def alias_hits(regions: DataFrame, texts: DataFrame, library: list[Symbol], profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """id and symbol_id of regions (page, id, x, y: centres) that have a text (page, x, y, text) with one of the symbol's aliases nearby."""
    pairs = spatial.radius_join(regions, texts, profile.nearby_text_radius, page)
    lowered = F.lower("r.text")
    named = [F.when(F.exists(F.array(*[F.lit(a.lower()) for a in s.aliases]), lambda a: F.contains(lowered, a)), F.lit(s.symbol_id)) for s in library if s.aliases]
    return pairs.select(F.col("l.id").alias("id"), F.explode(F.array_compact(F.array(*named))).alias("symbol_id")).distinct()


def attachment_scores(nodes: DataFrame, library: list[Symbol]) -> DataFrame:
    """id, symbol_id and topology score of regions with their node (id, kind, edges)."""
    each = []
    for s in library:
        if s.node_kinds is None and s.edges is None:
            score = F.lit(0.2)
        else:
            score = F.lit(0.1)
            if s.node_kinds:
                score = score + F.when(F.col("kind").isin(*s.node_kinds), 0.4).otherwise(0.0)
            if s.edges:
                score = score + F.when(F.col("edges") >= s.edges[0], 0.2).otherwise(0.0) + F.when(F.col("edges") <= s.edges[1], 0.2).otherwise(0.0)
        each.append(F.struct(F.lit(s.symbol_id).alias("symbol_id"), G.clamp(score, 0.0, 1.0).alias("topology")))
    return nodes.select("id", F.explode(F.array(*each)).alias("_s")).select("id", "_s.symbol_id", "_s.topology")


def ranked_symbols(scores: DataFrame, structural: DataFrame, profile: Profile = PROFILE, min_shape: float = 0.35, limit: int = 5) -> DataFrame:
    """The `limit` best symbols of each region (id, ord, symbol_id, shape, text, topology) with rank, combined, margin to the next and status.

    `status` is unknown where the best shape is too weak, low_margin where the second is too near, else proposed. On a
    region of `structural` (id), a bend or branch that the graph explains, fittings are unknown symbols.
    """
    combined = F.col("shape") + F.col("text") + F.col("topology")
    w = Window.partitionBy("id")
    order = w.orderBy(F.desc("combined"), "ord")
    made = scores.withColumn("combined", F.round(combined, 9))
    made = made.withColumns({"rank": F.row_number().over(order), "margin": F.round(F.col("combined") - F.lead("combined").over(order), 9), "_top": F.first("shape").over(order)})
    made = made.withColumn("_near", F.first("margin").over(order)).where(F.col("rank") <= limit)
    status = F.when(F.col("_top") < min_shape, "unknown").when(F.col("_near") < profile.symbol_margin, "low_margin").otherwise("proposed")
    made = made.withColumn("status", status).join(structural.select("id", F.lit(True).alias("_structural")).distinct(), "id", "left")
    symbol = F.when(F.col("_structural") & F.col("symbol_id").isin(*FITTINGS), "unknown").otherwise(F.col("symbol_id"))
    return made.select("id", "rank", symbol.alias("symbol_id"), "combined", "margin", "status")


def structural_junctions(regions: DataFrame, nodes: DataFrame, profile: Profile = PROFILE, page: str = "document_id") -> DataFrame:
    """id and node_id of regions (page, id, x, y) on a confirmed tee or elbow (page, id, kind, confirmed, x, y) within the port tolerance; the first node by id."""
    bends = nodes.where(F.col("confirmed") & F.col("kind").isin("tee", "elbow"))
    pairs = spatial.radius_join(regions, bends, profile.port_tolerance, page)
    return pairs.groupBy(F.col("l.id").alias("id")).agg(F.min("r.id").alias("node_id"))


def port_positions(symbols: DataFrame, ports: Column) -> DataFrame:
    """One row for each port of a symbol (document_id, id, x, y, rotation), at its place on the page; `ports` is an array of structs name, x, y."""
    made = symbols.select("document_id", "id", "x", "y", "rotation", F.posexplode(ports).alias("ord", "port"))
    c, s = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    return made.select("document_id", "id", "ord", F.col("port.name").alias("port"), (F.col("x") + F.col("port.x") * c - F.col("port.y") * s).alias("x"), (F.col("y") + F.col("port.x") * s + F.col("port.y") * c).alias("y"))


def port_conflicts(attached: DataFrame) -> DataFrame:
    """Ports (id, ord, port, node_id) that take a node which an earlier port of their symbol has, with that port."""
    before = F.lag("port").over(Window.partitionBy("id", "node_id").orderBy("ord"))
    return attached.where("node_id is not null").withColumn("earlier", before).where("earlier is not null")
