"""Queries of association and scene assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE as P
from ..operators import association, graph, spatial
from ..sources.shared import new_folder
from ..sources.tables import BOXES_SQL, POINTS_SQL, SEGMENTS_SQL, boxes, points, segments, table
from . import spatial as pages
from . import stages
from .registry import ORACLES, query


@query(f"""SELECT concat('rel_', substr(sha256(concat('callout_targets|ann_', CAST(annotation_id AS VARCHAR), '|', ref_kind, '|', CAST(ref_id AS VARCHAR))),1,12)) AS id, 'callout_targets' AS type, annotation_id AS from_id, ref_kind, ref_id, CASE WHEN ambiguous THEN 'unresolved' ELSE 'proposed' END AS interpretation FROM ({ORACLES["annotation_targets"]}) WHERE rank=1""")
def callout_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return association.relationships(pages.annotation_targets(spark, folder), "callout_targets", "annotation_id", "ann_")


@query(f"""WITH t AS (SELECT id AS text_id FROM ({BOXES_SQL}) WHERE kind='dimension'), w AS (SELECT text_id, witness_id, witness_id % 3 AS arrows FROM ({ORACLES["witness_lines"]})), m AS (SELECT t.text_id, w.witness_id, w.arrows, hit IS NOT NULL AS hit FROM t LEFT JOIN w USING (text_id) LEFT JOIN (SELECT DISTINCT dimension_id AS hit FROM ({ORACLES["dimension_targets"]})) ON hit=witness_id)
SELECT text_id, 'dimension.no_witness_line' AS code FROM m WHERE witness_id IS NULL UNION ALL SELECT text_id, 'dimension.missing_arrow' FROM m WHERE arrows=0 UNION ALL SELECT text_id, 'association.unresolved' FROM m WHERE witness_id IS NOT NULL AND NOT hit""")
def dimension_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review codes of dimension texts, whose witness lines measure what `dimension_targets` finds; a third of the lines have no arrows."""
    texts = boxes(spark, folder).where("kind = 'dimension'").select(F.col("id").alias("text_id"))
    witnesses = pages.witness_lines(spark, folder).select("text_id", "witness_id", (F.col("witness_id") % 3).alias("arrows"))
    return association.dimension_reviews(texts, witnesses, stages.dimension_targets(spark, folder).select(F.col("dimension_id").alias("witness_id")).distinct())


@query()
def greedy_witnesses(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one choice of segments for the dimension regions of each page."""
    middles = segments(spark, folder).select("document_id", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"))
    regions = boxes(spark, folder).where("kind = 'dimension'").select("document_id", "id", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    near = spatial.radius_join(regions, middles, P.witness_text_distance)
    return association.greedy_witnesses(near.select("l.document_id", F.col("l.id").alias("region_id"), F.col("r.id").alias("segment_id"), "r.length", F.sqrt("d2").alias("distance")))


@query(f"""WITH b AS ({BOXES_SQL}), c AS (SELECT id FROM b WHERE kind='text' AND height>=24 UNION SELECT id FROM b WHERE kind='symbol' AND width>=24 UNION SELECT id FROM b WHERE kind='dimension' AND width>30) SELECT document_id, id AS region_id, kind FROM b WHERE kind<>'arrow' AND id NOT IN (SELECT id FROM c)""")
def unknown_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, arrows aside, that no text, symbol or dimension covers."""
    b = boxes(spark, folder).withColumnRenamed("id", "region_id")
    regions = b.where("kind <> 'arrow'").select("document_id", "region_id", "kind")
    made = association.uncovered(regions, b.where("kind = 'text' and height >= 24"), b.where("kind = 'symbol' and width >= 24"), b.where("kind = 'dimension' and width > 30"))
    return made.select("document_id", "region_id", "kind")


@query("""WITH e AS (SELECT o_orderkey AS edge_id, unnest([o_orderkey + 1000000000, o_orderkey, o_custkey]) AS id, unnest([0,1,2]) AS k FROM orders), m AS (SELECT edge_id, k, p_brand FROM e LEFT JOIN part ON p_partkey=id)
SELECT edge_id, arg_min(p_brand, k) FILTER (WHERE p_brand IS NOT NULL) AS brand FROM m GROUP BY edge_id""")
def original_primitives(spark: SparkSession, folder: str) -> DataFrame:
    """For each edge the first of its source ids that is a known primitive."""
    edges = table(spark, folder, "orders").select(F.col("o_orderkey").alias("edge_id"), F.array(F.col("o_orderkey") + 1000000000, F.col("o_orderkey"), F.col("o_custkey")).alias("ids"))
    known = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return association.first_match(edges, "edge_id", "ids", known, "id", "brand")


@query(f"""WITH c AS (SELECT document_id, CAST(floor(x/24) AS BIGINT) AS px, CAST(floor(y/24) AS BIGINT) AS py, layer_id*100000+id AS priority, layer_id FROM ({POINTS_SQL})), w AS (SELECT *, row_number() OVER (PARTITION BY document_id, px, py ORDER BY priority) AS n FROM c) SELECT document_id, layer_id, count(*) AS pixels FROM w WHERE n=1 GROUP BY document_id, layer_id""")
def layer_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of each layer, where a pixel belongs to the first layer that claims it."""
    claims = points(spark, folder).select("document_id", F.floor(F.col("x") / 24).alias("px"), F.floor(F.col("y") / 24).alias("py"), (F.col("layer_id") * 100000 + F.col("id")).alias("priority"), "layer_id")
    return association.by_priority(claims, ["document_id", "px", "py"], "priority").groupBy("document_id", "layer_id").agg(F.count("*").alias("pixels"))


@query(f"""WITH RECURSIVE s AS ({SEGMENTS_SQL}), e AS (SELECT document_id, id*2 AS ord, x0 AS x, y0 AS y FROM s UNION ALL SELECT document_id, id*2+1, x1, y1 FROM s), g AS (SELECT a.document_id, a.ord AS a, b.ord AS b FROM e a JOIN e b ON a.document_id=b.document_id AND a.ord<>b.ord WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=36.0),
r(document_id, node, reached) AS (SELECT document_id, ord, ord FROM e UNION SELECT r.document_id, r.node, g.b FROM r JOIN g ON r.document_id=g.document_id AND r.reached=g.a), k AS (SELECT document_id, node AS ord, min(reached) AS component FROM r GROUP BY document_id, node),
m AS (SELECT e.*, component, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS members FROM e JOIN k USING (document_id, ord) WINDOW w AS (PARTITION BY e.document_id, component))
SELECT document_id, ord, component, round(cx,4) AS x, round(cy,4) AS y, round(sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)),4) AS moved FROM m WHERE members>1""")
def aligned_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of segments moved to the centre of the ends they reach in steps of the alignment tolerance."""
    s = segments(spark, folder)
    ends = F.explode(F.array(*[F.struct((F.col("id") * 2 + k).alias("ord"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]))
    e = s.select("document_id", ends.alias("e")).select("document_id", "e.ord", "e.x", "e.y")
    pairs = spatial.radius_join(e, e, P.endpoint_align_tolerance).where("l.ord < r.ord").select(F.col("l.document_id").alias("document_id"), F.col("l.ord").alias("a"), F.col("r.ord").alias("b"))
    made = association.aligned(e, graph.connected_components(pairs, e, new_folder(spark, "ends"), node="ord")).where("members > 1")
    return made.select("document_id", "ord", "component", F.round("cx", 4).alias("x"), F.round("cy", 4).alias("y"), F.round("moved", 4).alias("moved"))


@query(f"""WITH p AS ({POINTS_SQL}), e AS (SELECT a.document_id, a.id AS s, b.id AS t FROM p a JOIN p b ON a.document_id=b.document_id AND a.id<b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=576.0), i AS (SELECT document_id, s AS node FROM e UNION ALL SELECT document_id, t FROM e UNION ALL SELECT document_id, id FROM ({BOXES_SQL}) WHERE kind='symbol'),
d AS (SELECT document_id, node, count(*) AS degree FROM i GROUP BY document_id, node HAVING count(*)>=3) SELECT document_id, count(*) AS dots, sha256(string_agg(concat('<circle id="dot-', CAST(node AS VARCHAR), '"/>'), chr(10) ORDER BY node)) AS digest FROM d GROUP BY document_id""")
def connection_dots(spark: SparkSession, folder: str) -> DataFrame:
    """Dots at junctions of three or more pipes and symbol ports, drawn in order of their ids."""
    p = points(spark, folder)
    pairs = spatial.radius_join(p, p, 24.0).where("l.id < r.id")
    edges = pairs.select(F.col("l.document_id").alias("document_id"), F.col("l.id").alias("start_node"), F.col("r.id").alias("end_node"))
    ports = boxes(spark, folder).where("kind = 'symbol'").select("document_id", F.col("id").alias("node"))
    degree = graph.endpoints(edges, ["document_id"]).select("document_id", "node").union(ports).groupBy("document_id", "node").agg(F.count("*").alias("degree")).where("degree >= 3")
    lines = degree.withColumn("line", F.concat(F.lit('<circle id="dot-'), F.col("node").cast("string"), F.lit('"/>')))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("document_id").agg(F.count("*").alias("dots"), F.sha2(body, 256).alias("digest"))


@query("""SELECT l_orderkey*10+l_linenumber AS id, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN concat('dimension:', s_name) END, CASE WHEN c_custkey IS NOT NULL THEN concat('annotation:', c_name) END, CASE WHEN p_partkey IS NOT NULL THEN concat('text:', p_name) END) AS source FROM lineitem LEFT JOIN supplier ON s_suppkey=l_partkey LEFT JOIN customer ON c_custkey=l_partkey LEFT JOIN part ON p_partkey=l_partkey WHERE s_suppkey IS NOT NULL OR c_custkey IS NOT NULL OR p_partkey IS NOT NULL""")
def relationship_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The object each relationship starts from: a dimension, else an annotation, else a text; unresolved ones are dropped."""
    l = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("key"))  # noqa: E741
    kinds = [("dimension", table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("v"))), ("annotation", table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("v"))), ("text", table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("v")))]
    for kind, names in kinds:
        l = l.join(names.select("key", F.concat(F.lit(f"{kind}:"), "v").alias(kind)), "key", "left")  # noqa: E741
    return l.select("id", F.coalesce(*[k for k, _ in kinds]).alias("source")).where("source is not null")
