"""Queries of scene assembly: points stand for nodes, segments for edges, boxes for regions with their texts and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE as P
from ..operators import review, scene
from ..sources.shared import stored
from ..sources.tables import BOXES_SQL, POINTS_SQL, SEGMENTS_SQL, boxes, points, segments
from .registry import query

_LAYER = "CASE id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'color_1' ELSE 'color_9' END"
_ID = "concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',substr('89ab', CAST(strpos('0123456789abcdef', substr(h,17,1))-1 AS INTEGER) % 4 + 1, 1),substr(h,18,3),'-',substr(h,21,12))"
_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat(document_id, '|', {})))"


def _uuid(ref: str) -> str:
    return _ID.replace("(h,", f"({_HASH.format(ref)},")


_SCENE_SQL = f"""WITH p AS (SELECT *, {_LAYER} AS own FROM ({POINTS_SQL})), s AS (SELECT *, {_LAYER} AS own FROM ({SEGMENTS_SQL})), b AS (SELECT document_id, id, kind, x+width/2 AS x, y+height/2 AS y FROM ({BOXES_SQL})),
n AS (SELECT document_id, 0 AS ord, 'junction' AS type, concat('node_', id) AS ref, CASE WHEN own='color_9' THEN 'color_1' ELSE own END AS layer, x, y, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, NULL AS start_ref, NULL AS end_ref, NULL AS target_ref, CASE WHEN id % 2=0 THEN 'elbow' ELSE 'unknown' END AS label, CASE WHEN id % 3<>0 THEN 0.85 ELSE 0.7 END AS score, 'infer_topology' AS stage FROM p),
e AS (SELECT document_id, 1, 'pipe_segment', concat('edge_', id), CASE WHEN own='color_9' THEN 'color_1' ELSE own END, x0, y0, x1, y1, concat('node_', id), concat('node_', id+1), NULL, NULL, 0.82, 'infer_topology' FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.document_id=s.document_id AND p.id=s.id+1)),
m AS (SELECT document_id, id, x, y, CASE id % 5 WHEN 0 THEN 'ball_valve' WHEN 1 THEN 'flange' WHEN 2 THEN 'unknown' WHEN 3 THEN 'riser' END AS symbol_id, CASE WHEN id % 7=0 THEN 'low_margin' ELSE 'proposed' END AS status, 0.5+(id % 9)/10.0 AS combined FROM b WHERE kind='symbol'),
y AS (SELECT document_id, 2, 'symbol', concat('sym_', id), 'default', x, y, NULL, NULL, NULL, NULL, NULL, symbol_id, least(1.0, combined), 'classify_symbols' FROM m WHERE status='proposed' AND symbol_id IS NOT NULL AND symbol_id<>'unknown'),
v AS (SELECT document_id, 5, 'unknown_mark', concat('unknown_sym_', id), 'default', x, y, NULL, NULL, NULL, NULL, NULL, coalesce(symbol_id,'unknown'), 0.35, 'classify_symbols' FROM m WHERE NOT (status='proposed' AND symbol_id IS NOT NULL AND symbol_id<>'unknown')),
d AS (SELECT document_id, 3, 'dimension', concat('dim_', id), 'default', x, y, NULL, NULL, NULL, NULL, concat('edge_', id+2), concat(CAST(id % 40 AS VARCHAR), ''''), 0.72, 'associate_markup' FROM b WHERE kind='dimension' AND id % 8<>3),
t AS (SELECT document_id, id, x, y, CASE WHEN id % 9=0 THEN '' ELSE concat('text ', CAST(id AS VARCHAR)) END AS text, id % 11/10.0 AS confidence, id % 6 AS k FROM b WHERE kind='text' AND id % 12<>0),
a AS (SELECT document_id, 4, 'annotation', concat('text_', id), 'default', x, y, NULL, NULL, NULL, NULL, CASE WHEN k IN (1,2) THEN concat('node_', id+1) WHEN k=3 THEN NULL END, text, CASE WHEN k IN (1,2,3) THEN 0.72 ELSE least(1.0, confidence) END, CASE WHEN k IN (1,2,3) THEN 'associate_markup' ELSE 'transcribe_regions' END FROM t WHERE text<>''),
u AS (SELECT document_id, 5, 'unknown_mark', concat('region_', id), 'default', x, y, NULL, NULL, NULL, NULL, NULL, kind, 0.35, 'detect_regions' FROM b WHERE kind<>'arrow' AND NOT (kind='symbol') AND NOT (kind='dimension' AND id % 8<>3) AND NOT (kind='text' AND id % 12<>0)),
w AS (SELECT * FROM n UNION ALL SELECT * FROM e UNION ALL SELECT * FROM y UNION ALL SELECT * FROM v UNION ALL SELECT * FROM d UNION ALL SELECT * FROM a UNION ALL SELECT * FROM u),
i AS (SELECT *, {_uuid("ref")} AS id FROM w), r AS (SELECT i.*, f.id AS start_id, g.id AS end_id, k.id AS target_id FROM i LEFT JOIN i f ON f.document_id=i.document_id AND f.ref=i.start_ref LEFT JOIN i g ON g.document_id=i.document_id AND g.ref=i.end_ref LEFT JOIN i k ON k.document_id=i.document_id AND k.ref=i.target_ref),
l AS (SELECT document_id, CASE WHEN type='dimension' THEN 'measures' ELSE 'annotates' END AS label, id AS start_id, target_id AS end_id FROM r WHERE type IN ('dimension','annotation') AND target_id IS NOT NULL), q AS (SELECT *, concat('rel_', substr(sha256(concat(label,'|',start_id,'|',end_id)),1,12)) AS ref FROM l),
o AS (SELECT document_id, type, ref, id, layer, round(x,4) AS x, round(y,4) AS y, round(x1,4) AS x1, round(y1,4) AS y1, start_id, end_id, target_id, label, round(CAST(score AS DOUBLE),6) AS score, stage FROM r
UNION ALL SELECT document_id, 'relationship', ref, {_uuid("ref")}, 'default', NULL, NULL, NULL, NULL, start_id, end_id, NULL, label, NULL, 'associate_markup' FROM q)"""


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    layer = F.expr(_LAYER)
    nodes = points(spark, folder).select("document_id", "id", "x", "y", layer.alias("layer"), F.when(F.col("id") % 2 == 0, "elbow").otherwise("unknown").alias("kind"), (F.col("id") % 3 != 0).alias("confirmed"))
    edges = segments(spark, folder).select("document_id", "id", layer.alias("layer"), "x0", "y0", "x1", "y1", F.col("id").alias("start_node"), (F.col("id") + 1).alias("end_node"))
    # color_9 is no layer of any document, so its objects go to the first one
    known = scene.layers(nodes.select("document_id", F.when(F.col("layer") != "color_9", F.col("layer")).alias("layer")))
    regions = boxes(spark, folder).select("document_id", "id", "kind", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    junctions = stored(scene.junctions(scene.with_known_layer(nodes, known)), "junctions")
    pipes = stored(scene.pipes(scene.with_known_layer(edges, known), junctions), "pipes")
    symbol = F.expr("CASE id % 5 WHEN 0 THEN 'ball_valve' WHEN 1 THEN 'flange' WHEN 2 THEN 'unknown' WHEN 3 THEN 'riser' END")
    candidates = regions.where("kind = 'symbol'").select("document_id", "id", "x", "y", symbol.alias("symbol_id"), F.when(F.col("id") % 7 == 0, "low_margin").otherwise("proposed").alias("status"), (0.5 + F.col("id") % 9 / 10.0).alias("combined"))
    symbols, marks = scene.symbols(candidates)
    measured = regions.where("kind = 'dimension' and id % 8 <> 3")
    dimensions = scene.dimensions(measured.select("document_id", "id", "x", "y", F.concat((F.col("id") % 40).cast("string"), F.lit("'")).alias("text"), F.concat(F.lit("edge_"), (F.col("id") + 2).cast("string")).alias("edge_ref")), pipes)
    read = regions.where("kind = 'text' and id % 12 <> 0")
    texts = read.select("document_id", "id", "x", "y", F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), (F.col("id") % 11 / 10.0).alias("confidence"))
    # one target, two far apart, and two too near each other
    ranked = F.expr("CASE id % 6 WHEN 1 THEN array(struct(1 AS rank, 0.9D AS score)) WHEN 2 THEN array(struct(1 AS rank, 0.9D AS score), struct(2 AS rank, 0.5D AS score)) WHEN 3 THEN array(struct(1 AS rank, 0.9D AS score), struct(2 AS rank, 0.85D AS score)) END")
    targets = texts.select("document_id", "id", F.explode(ranked).alias("t")).select("document_id", "id", "t.rank", "t.score", F.concat(F.lit("node_"), (F.col("id") + F.col("t.rank")).cast("string")).alias("target_ref"))
    annotations = scene.annotations(texts, targets, measured, junctions, P.target_margin)
    unknown = scene.unknown_marks(regions, measured, read, candidates)
    objects = stored(scene.assembled(junctions, pipes, symbols, marks, dimensions, annotations, unknown), "scene")
    return objects.unionByName(scene.relationships(objects))


@query(f"{_SCENE_SQL} SELECT * FROM o")
def assembled_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Every object of every scene."""
    made = assembled(spark, folder)
    return made.drop("ord").withColumns({c: F.round(c, 4) for c in ("x", "y", "x1", "y1")} | {"score": F.round("score", 6)})


@query(f"""{_SCENE_SQL} SELECT document_id, count(*) FILTER (WHERE type='junction') AS junctions, count(*) FILTER (WHERE type='pipe_segment') AS pipe_segments, count(*) FILTER (WHERE type='symbol') AS symbols, count(*) FILTER (WHERE type='dimension') AS dimensions, count(*) FILTER (WHERE type='annotation') AS annotations, count(*) FILTER (WHERE type='unknown_mark') AS unknown_marks, count(*) FILTER (WHERE type='relationship') AS relationships, count(*) AS objects FROM o GROUP BY document_id""")
def scene_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of each kind by document."""
    return scene.counts(assembled(spark, folder))


_REVIEWS = f"""x AS (SELECT document_id, concat('topo_', id) AS issue_key, CASE id % 3 WHEN 0 THEN 'topology.crossing_near_tee' WHEN 1 THEN 'topology.ambiguous_junction' ELSE 'topology.gap' END AS code, concat('node_', id+1) AS a, concat('edge_', id) AS b, 'topology' AS stage FROM ({POINTS_SQL}) UNION ALL
SELECT document_id, concat('text_', id), CASE WHEN id % 2=0 THEN 'ocr.unreadable' ELSE 'association.unresolved' END, concat('text_', id), NULL, 'text' FROM b WHERE kind='text' UNION ALL SELECT document_id, concat('dim_', id), CASE WHEN id % 3=0 THEN 'dimension.unit_conflict' ELSE 'dimension.missing_arrow' END, concat('dim_', id), concat('region_', id), 'associations' FROM b WHERE kind='dimension')"""


@query(f"""{_SCENE_SQL}, {_REVIEWS} SELECT x.document_id, issue_key, code AS issue_type, CASE WHEN starts_with(code,'dimension.') AND contains(code,'conflict') THEN 'critical' WHEN starts_with(code,'topology.') AND contains(code,'crossing') THEN 'high' WHEN contains(code,'unresolved') OR contains(code,'ambiguous') THEN 'high' ELSE 'medium' END AS severity, coalesce(f.id, g.id) AS object_id, 'open' AS state, x.stage
FROM x LEFT JOIN o f ON f.document_id=x.document_id AND f.ref=x.a LEFT JOIN o g ON g.document_id=x.document_id AND g.ref=x.b""")
def planned_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review items of three stages, with the scene objects they are about."""
    name = lambda prefix, step=0: F.concat(F.lit(prefix), (F.col("id") + step).cast("string"))
    b = boxes(spark, folder)
    topology = points(spark, folder).select("document_id", name("topo_").alias("issue_key"), F.expr("CASE id % 3 WHEN 0 THEN 'topology.crossing_near_tee' WHEN 1 THEN 'topology.ambiguous_junction' ELSE 'topology.gap' END").alias("code"), F.array(name("node_", 1), name("edge_")).alias("refs"))
    text = b.where("kind = 'text'").select("document_id", name("text_").alias("issue_key"), F.when(F.col("id") % 2 == 0, "ocr.unreadable").otherwise("association.unresolved").alias("code"), F.array(name("text_")).alias("refs"))
    associations = b.where("kind = 'dimension'").select("document_id", name("dim_").alias("issue_key"), F.when(F.col("id") % 3 == 0, "dimension.unit_conflict").otherwise("dimension.missing_arrow").alias("code"), F.array(name("dim_"), name("region_")).alias("refs"))
    return scene.planned_reviews(assembled(spark, folder), topology=topology, text=text, associations=associations)


@query(f"{_SCENE_SQL} SELECT document_id, concat('machine:', id) AS issue_key, concat('machine.', type) AS issue_type, CASE WHEN score<0.5 THEN 'high' ELSE 'medium' END AS severity FROM o WHERE score<0.75")
def machine_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that the machine isn't sure of."""
    made = scene.machine_reviews(assembled(spark, folder), 0.75)
    return made.select("document_id", "issue_key", "issue_type", review.severity(F.col("score")).alias("severity"))
