"""Queries of whole stages, and of the steps that only these need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import association, composites, snapping
from ..sources.shared import new_folder, stored
from ..sources.tables import BOXES_SQL, POINTS_SQL, SEGMENTS_SQL, boxes, points, segments, table
from . import spatial as pages
from . import stages
from .registry import ORACLES, query
from .spatial import _AXIS_SQL, _TRACE_SQL, _trace


def _primitives(spark: SparkSession, folder: str) -> DataFrame:
    return segments(spark, folder).withColumn("status", F.when(F.col("id") % 11 == 0, "uncertain").otherwise("accepted"))


_FOLDED = "((((axis-dir+90.0) % 180.0)+180.0) % 180.0)-90.0"
_SNAP = f"""{_AXIS_SQL}, l AS (SELECT s.document_id, s.id, s.x0, s.y0, s.x1, s.y1, rotation, confidence, CASE WHEN id % 11=0 THEN 'uncertain' ELSE 'accepted' END AS status, degrees(atan2(y1-y0, x1-x0)) AS dir, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM s LEFT JOIN (SELECT document_id, rotation, confidence FROM model) USING (document_id)),
z AS (SELECT *, ((dir % 180.0)+180.0) % 180.0 AS angle, (coalesce(rotation,0.0)+90.0) % 180.0 AS r1, (coalesce(rotation,0.0)+30.0) % 180.0 AS r2, (coalesce(rotation,0.0)+150.0) % 180.0 AS r3 FROM l), y AS (SELECT *, least(abs(angle-r1),180-abs(angle-r1)) AS d1, least(abs(angle-r2),180-abs(angle-r2)) AS d2, least(abs(angle-r3),180-abs(angle-r3)) AS d3 FROM z),
x AS (SELECT *, least(d1,d2,d3) AS delta, CASE WHEN d1<=d2 AND d1<=d3 THEN r1 WHEN d2<=d3 THEN r2 ELSE r3 END AS axis FROM y), u AS (SELECT *, radians({_FOLDED}) AS turn, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy FROM x),
g AS (SELECT *, CASE WHEN status='uncertain' THEN 'preserved_uncertain' WHEN coalesce(confidence,0.0)<0.35 THEN 'weak_axis_model' WHEN len<20.0 THEN 'low_evidence' WHEN delta>4.0 THEN 'off_axis' WHEN len*sin(radians(delta/2))>8.0 THEN 'endpoint_displacement' ELSE 'snapped_to_axis' END AS reason FROM u),
e AS (SELECT document_id, id, reason, id*2 AS ord, CASE WHEN reason='snapped_to_axis' THEN cx+(x0-cx)*cos(turn)-(y0-cy)*sin(turn) ELSE x0 END AS x, CASE WHEN reason='snapped_to_axis' THEN cy+(x0-cx)*sin(turn)+(y0-cy)*cos(turn) ELSE y0 END AS y FROM g UNION ALL SELECT document_id, id, reason, id*2+1, CASE WHEN reason='snapped_to_axis' THEN cx+(x1-cx)*cos(turn)-(y1-cy)*sin(turn) ELSE x1 END, CASE WHEN reason='snapped_to_axis' THEN cy+(x1-cx)*sin(turn)+(y1-cy)*cos(turn) ELSE y1 END FROM g),
pr AS (SELECT a.document_id, a.ord AS a, b.ord AS b FROM e a JOIN e b ON a.document_id=b.document_id AND a.ord<>b.ord WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=36.0), rc(document_id, node, reached) AS (SELECT document_id, ord, ord FROM e UNION SELECT rc.document_id, rc.node, pr.b FROM rc JOIN pr ON rc.document_id=pr.document_id AND rc.reached=pr.a), co AS (SELECT document_id, node AS ord, min(reached) AS component FROM rc GROUP BY document_id, node),
al AS (SELECT e.*, avg(x) OVER w AS ax, avg(y) OVER w AS ay, count(*) OVER w AS members FROM e JOIN co USING (document_id, ord) WINDOW w AS (PARTITION BY e.document_id, component))"""


@query(f"""{_SNAP.replace("WITH s AS", "WITH RECURSIVE s AS", 1)} SELECT document_id, id, any_value(reason) AS reason, count(*) FILTER (WHERE members>1 AND sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y))>1e-9) AS adjusted, round(max(ax) FILTER (WHERE ord % 2=0),3) AS x0, round(max(ay) FILTER (WHERE ord % 2=0),3) AS y0, round(max(ax) FILTER (WHERE ord % 2=1),3) AS x1, round(max(ay) FILTER (WHERE ord % 2=1),3) AS y1 FROM al GROUP BY document_id, id""")
def snap_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Segments after axis inference, snapping and alignment."""
    made = composites.snap_stage(_primitives(spark, folder), new_folder(spark, "snap"))
    return made.withColumns({c: F.round(c, 3) for c in ("x0", "y0", "x1", "y1")})


@query(f"""{_AXIS_SQL}, t AS (SELECT v.document_id, angle, weight, rotation FROM v JOIN model USING (document_id)), y AS (SELECT document_id, weight, abs(angle-(rotation+90.0) % 180.0) AS a1, abs(angle-(rotation+30.0) % 180.0) AS a2, abs(angle-(rotation+150.0) % 180.0) AS a3 FROM t)
SELECT document_id, {", ".join(f"round(sum(CASE WHEN least(a{k},180-a{k})<=15.0 THEN weight*(1-least(a{k},180-a{k})/15.0) ELSE 0.0 END),4) AS weight_{k - 1}" for k in (1, 2, 3))} FROM y GROUP BY document_id""")
def axis_weights(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each page's ink follows each of its axes."""
    p = segments(spark, folder).withColumn("status", F.lit("accepted"))
    made = composites.axis_weights(p, snapping.axis_models(p))
    return made.select("document_id", *[F.round(f"weight_{k}", 4).alias(f"weight_{k}") for k in range(3)])


@query()
def topology_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of every page's graph with their degree and kind; the tests hold them against brute force."""
    nodes, _ = composites.topology_stage(segments(spark, folder))
    return nodes.select("document_id", "node", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "layers", "ends", "degree", "kind")


@query(f"""WITH t AS ({ORACLES["dimension_targets"]}), m AS (SELECT *, max(rank) OVER (PARTITION BY dimension_id) AS n FROM t), r AS (SELECT concat('rel_', substr(sha256(concat('measures|dim_', CAST(dimension_id AS VARCHAR), '|topology_edge|', CAST(edge_id AS VARCHAR))),1,12)) AS id, 'measures' AS type, dimension_id AS from_id, 'topology_edge' AS ref_kind, edge_id AS ref_id, CASE WHEN n>1 THEN 'unresolved' ELSE 'proposed' END AS interpretation FROM m WHERE rank=1)
SELECT * FROM r UNION ALL SELECT * FROM ({ORACLES["callout_relationships"]})""")
def association_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships of dimensions to what they measure, and of annotations to what they point to."""
    measures = composites.measured_relationships(stages.dimension_targets(spark, folder))
    return measures.unionByName(association.relationships(pages.annotation_targets(spark, folder), "callout_targets", "annotation_id", "ann_"))


_ARROWS = f"SELECT document_id, id, x+width/2 AS x, y+height/2 AS y, greatest(width, height) AS size FROM ({BOXES_SQL}) WHERE kind='arrow'"


def _arrows(spark: SparkSession, folder: str) -> DataFrame:
    return boxes(spark, folder).where("kind = 'arrow'").select("document_id", "id", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"), F.greatest("width", "height").alias("size"))


@query(f"SELECT p.id, min(a.id) AS arrow_id FROM ({POINTS_SQL}) p JOIN ({_ARROWS}) a ON p.document_id=a.document_id AND (p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y)<=144.0 GROUP BY p.id")
def arrows_at_tips(spark: SparkSession, folder: str) -> DataFrame:
    """The arrow region at the tip of each leader."""
    return composites.arrows_at_tips(points(spark, folder), _arrows(spark, folder))


@query(f"""WITH s AS ({SEGMENTS_SQL}), e AS (SELECT document_id, id, 0 AS k, x0 AS x, y0 AS y, x0, y0, x1, y1 FROM s UNION ALL SELECT document_id, id, 1, x1, y1, x0, y0, x1, y1 FROM s), m AS (SELECT e.id AS witness_id, a.id AS arrow_id, e.k, abs(degrees(atan2(e.y-a.y, e.x-a.x))-degrees(atan2(y1-y0, x1-x0))) AS d FROM e JOIN ({_ARROWS}) a ON e.document_id=a.document_id AND (e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)<=(a.size+8)*(a.size+8))
SELECT witness_id, arrow_id, min(k) AS "end" FROM m WHERE least(d % 180.0, 180.0-d % 180.0)<=35.0 GROUP BY witness_id, arrow_id""")
def aligned_arrowheads(spark: SparkSession, folder: str) -> DataFrame:
    """Arrow regions at the ends of witness lines, that point along them."""
    return composites.aligned_arrowheads(segments(spark, folder), _arrows(spark, folder))


@query(f"""SELECT b.document_id, b.id AS text_id, s.id AS segment_id, (s.x1-cx)*(s.x1-cx)+(s.y1-cy)*(s.y1-cy)<=(s.x0-cx)*(s.x0-cx)+(s.y0-cy)*(s.y0-cy) AS toward FROM (SELECT document_id, id, x+width/2 AS cx, y+height/2 AS cy FROM ({BOXES_SQL}) WHERE kind='dimension') b JOIN ({SEGMENTS_SQL}) s ON s.id=b.id""")
def witness_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the witness line of each dimension runs toward its text."""
    b = boxes(spark, folder).where("kind = 'dimension'").select("document_id", F.col("id").alias("text_id"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    met = b.join(segments(spark, folder).select(F.col("id").alias("segment_id"), F.struct("x0", "y0", "x1", "y1").alias("s")), F.col("text_id") == F.col("segment_id"))
    return met.select("document_id", "text_id", "segment_id", composites.toward(F.col("cx"), F.col("cy")).alias("toward"))


@query(f"""WITH t AS ({_TRACE_SQL}), e AS (SELECT user_id, min(k) AS ka, max(k) AS kb, count(*) AS n FROM t GROUP BY user_id), f AS (SELECT e.user_id, n, ka, kb, a.value AS va, b.value AS vb FROM e JOIN t a ON a.user_id=e.user_id AND a.k=ka JOIN t b ON b.user_id=e.user_id AND b.k=kb)
SELECT t.user_id, any_value(n) AS n, round(max(CASE WHEN sqrt((kb-ka)*(kb-ka)+(vb-va)*(vb-va))<1e-6 THEN NULL ELSE abs((kb-ka)*(va-value)-(vb-va)*(ka-k))/sqrt((kb-ka)*(kb-ka)+(vb-va)*(vb-va)) END),5) AS deviation FROM t JOIN f ON f.user_id=t.user_id GROUP BY t.user_id""")
def chord_deviations(spark: SparkSession, folder: str) -> DataFrame:
    """How far each user's trace leaves the line from its first to its last sample."""
    samples = _trace(spark, folder).select("user_id", "k", F.col("k").cast("double").alias("x"), F.col("value").alias("y"))
    return composites.chord_deviation(samples, ["user_id"]).withColumn("deviation", F.round("deviation", 5))


@query("""WITH c AS (SELECT vec_id AS id, unnest([embedding[1], embedding[3], embedding[5], embedding[7]]) AS x, unnest([embedding[2], embedding[4], embedding[6], embedding[8]]) AS y FROM embeddings), q AS (SELECT id, arg_min(struct_pack(x:=x, y:=y), x::DOUBLE+y::DOUBLE) AS tl, arg_min(struct_pack(x:=x, y:=y), y::DOUBLE-x::DOUBLE) AS tr, arg_max(struct_pack(x:=x, y:=y), x::DOUBLE+y::DOUBLE) AS br, arg_max(struct_pack(x:=x, y:=y), y::DOUBLE-x::DOUBLE) AS bl FROM c GROUP BY id)
SELECT id, round(tl.x::DOUBLE,6) AS tl_x, round(tr.y::DOUBLE,6) AS tr_y, round(br.x::DOUBLE,6) AS br_x, round(bl.y::DOUBLE,6) AS bl_y, len(list_distinct([tl, tr, br, bl]))<4 AS ambiguous FROM q""")
def ordered_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of quadrilaterals in order, and those that can't be ordered."""
    e = table(spark, folder, "embeddings")
    each = F.explode(F.array(*[F.struct(F.col("embedding")[2 * k].cast("double").alias("x"), F.col("embedding")[2 * k + 1].cast("double").alias("y")) for k in range(4)]))
    made = composites.ordered_corners(e.select(F.col("vec_id").alias("id"), each.alias("c")).select("id", "c.x", "c.y"), "id")
    return made.select("id", F.round("tl.x", 6).alias("tl_x"), F.round("tr.y", 6).alias("tr_y"), F.round("br.x", 6).alias("br_x"), F.round("bl.y", 6).alias("bl_y"), "ambiguous")


@query(f"""WITH n AS (SELECT document_id, id, layer_id, printf('prim_%04d', row_number() OVER (PARTITION BY document_id ORDER BY id)-1) AS name, row_number() OVER (PARTITION BY document_id, layer_id ORDER BY id) AS k, count(*) OVER (PARTITION BY document_id, layer_id) AS rows FROM ({SEGMENTS_SQL}))
SELECT document_id, id, layer_id, name, rows>20 AS cut FROM n WHERE k<=20""")
def named_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty paths of each layer by name, and whether the layer has more."""
    named = stored(composites.numbered(segments(spark, folder), "document_id", ["id"], "prim").select("document_id", "id", "layer_id", "name"), "paths")
    kept, over = composites.capped(named, ["document_id", "layer_id"], ["id"], 20)
    met = kept.join(over.select("document_id", "layer_id", F.lit(True).alias("cut")), ["document_id", "layer_id"], "left")
    return met.select("document_id", "id", "layer_id", "name", F.coalesce("cut", F.lit(False)).alias("cut"))


@query(f"""WITH s AS ({SEGMENTS_SQL}), c AS (SELECT document_id, id, layer_id, id % 7=0 AS skipped, id % 5=0 AS rejected FROM s), p AS (SELECT * FROM s WHERE id % 4<>1) SELECT c.document_id, c.id, round(sqrt((p.x1-p.x0)*(p.x1-p.x0)+(p.y1-p.y0)*(p.y1-p.y0)),5) AS length FROM c JOIN p USING (document_id, id) WHERE NOT skipped AND NOT rejected""")
def working_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Snapped candidates as working segments: not skipped, and of a primitive that is there and wasn't rejected."""
    s = segments(spark, folder)
    candidates = s.select("document_id", "id", (F.col("id") % 7 == 0).alias("skipped"), (F.col("id") % 5 == 0).alias("rejected")).where("not skipped and not rejected")
    made = candidates.join(s.where("id % 4 <> 1").select("document_id", "id", "x0", "y0", "x1", "y1"), ["document_id", "id"])
    return made.select("document_id", "id", F.round(G.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 5).alias("length"))
