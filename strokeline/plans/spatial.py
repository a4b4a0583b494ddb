"""Queries on points, segments and regions of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE as P
from ..functions import geometry as G
from ..operators import graph, snapping, spatial
from ..sources.shared import new_folder
from ..sources.tables import BOXES_SQL, POINTS2_SQL, POINTS_SQL, SEGMENTS_SQL, boxes, points, segments, table
from .registry import query

r6 = lambda c: F.round(c, 6)


@query(f"""WITH p AS ({POINTS_SQL}), j AS (SELECT a.document_id, a.id, b.id AS o, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM p a JOIN p b ON a.document_id=b.document_id AND a.id<>b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=256.0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS k, count(*) OVER (PARTITION BY id) AS degree FROM j)
SELECT document_id, id, degree, o AS nearest_id, round(sqrt(d2),6) AS nearest_distance FROM n WHERE k=1""")
def point_neighbourhoods(spark: SparkSession, folder: str) -> DataFrame:
    """Degree and nearest neighbour of every point with another within 16 pixels."""
    p = points(spark, folder)
    pairs = spatial.radius_join(p, p, 16.0).where("l.id <> r.id").withColumn("_id", F.col("l.id"))
    pairs = pairs.withColumn("degree", F.count("*").over(Window.partitionBy("_id")))
    best = spatial.nearest(pairs, "_id", [F.col("d2"), F.col("r.id")])
    return best.select("l.document_id", "l.id", "degree", F.col("r.id").alias("nearest_id"), r6(F.sqrt("d2")).alias("nearest_distance"))


_ENDS_SQL = f"WITH s AS ({SEGMENTS_SQL}), e AS (SELECT document_id, id, 0 AS k, x0 AS x, y0 AS y FROM s UNION ALL SELECT document_id, id, 1, x1, y1 FROM s)"


def _ends(spark: SparkSession, folder: str) -> DataFrame:
    s = segments(spark, folder)
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]))
    return s.select("document_id", "id", "layer_id", ends.alias("e")).select("document_id", "id", "layer_id", "e.k", "e.x", "e.y")


@query(f"""{_ENDS_SQL} SELECT a.document_id, a.id AS a_id, a.k AS a_end, b.id AS b_id, b.k AS b_end, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),6) AS distance
FROM e a JOIN e b ON a.document_id=b.document_id AND a.id<b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)>64.0 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=256.0""")
def near_miss_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of different segments that are near but beyond the cluster tolerance."""
    e = _ends(spark, folder)
    tolerance = P.endpoint_cluster_tolerance
    pairs = spatial.radius_join(e, e, 2 * tolerance).where((F.col("l.id") < F.col("r.id")) & (F.col("d2") > tolerance * tolerance))
    return pairs.select("l.document_id", F.col("l.id").alias("a_id"), F.col("l.k").alias("a_end"), F.col("r.id").alias("b_id"), F.col("r.k").alias("b_end"), r6(F.sqrt("d2")).alias("distance"))


_CROSS_SQL = f"""WITH s AS ({SEGMENTS_SQL}), j AS (SELECT a.document_id, a.id AS a_id, b.id AS b_id, a.layer_id AS la, b.layer_id AS lb, a.x0 AS x1, a.y0 AS y1, a.x1 AS x2, a.y1 AS y2, b.x0 AS x3, b.y0 AS y3, b.x1 AS x4, b.y1 AS y4,
(a.x0-a.x1)*(b.y0-b.y1)-(a.y0-a.y1)*(b.x0-b.x1) AS det FROM s a JOIN s b ON a.document_id=b.document_id AND a.id<b.id),
c AS (SELECT *, ((x1*y2-y1*x2)*(x3-x4)-(x1-x2)*(x3*y4-y3*x4))/det AS x, ((x1*y2-y1*x2)*(y3-y4)-(y1-y2)*(x3*y4-y3*x4))/det AS y FROM j WHERE abs(det)>=1e-9),
t AS (SELECT *, CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)<1e-9 THEN 0.0 ELSE ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) END AS ta,
CASE WHEN (x4-x3)*(x4-x3)+(y4-y3)*(y4-y3)<1e-9 THEN 0.0 ELSE ((x-x3)*(x4-x3)+(y-y3)*(y4-y3))/((x4-x3)*(x4-x3)+(y4-y3)*(y4-y3)) END AS tb FROM c),
i AS (SELECT * FROM t WHERE ta BETWEEN -0.02 AND 1.02 AND tb BETWEEN -0.02 AND 1.02 AND (x-x1)*(x-x1)+(y-y1)*(y-y1)>36.0 AND (x-x2)*(x-x2)+(y-y2)*(y-y2)>36.0 AND (x-x3)*(x-x3)+(y-y3)*(y-y3)>36.0 AND (x-x4)*(x-x4)+(y-y4)*(y-y4)>36.0)"""


@query(f"{_CROSS_SQL} SELECT document_id, a_id, b_id, round(x,4) AS x, round(y,4) AS y FROM i")
def interior_intersections(spark: SparkSession, folder: str) -> DataFrame:
    """Crossings inside two segments of a page, away from their ends."""
    made = spatial.interior_intersections(segments(spark, folder), P.intersection_proximity)
    return made.select("a.document_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_AWAY = "CASE WHEN (x-x{0})*(x-x{0})+(y-y{0})*(y-y{0})<=(x-x{1})*(x-x{1})+(y-y{1})*(y-y{1}) THEN 1.0 ELSE -1.0 END"


@query(f"""{_CROSS_SQL}, v AS (SELECT *, {_AWAY.format(1, 2)} AS sa, {_AWAY.format(3, 4)} AS sb FROM i),
g AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (sa*(x2-x1)*sb*(x4-x3)+sa*(y2-y1)*sb*(y4-y3))/(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))*sqrt((x4-x3)*(x4-x3)+(y4-y3)*(y4-y3))))))) AS angle FROM v),
h AS (SELECT document_id, a_id, b_id, angle, CASE WHEN la=lb THEN 0.45 ELSE 0.75 END AS crossing, CASE WHEN la=lb THEN CASE WHEN angle>=35.0 THEN 0.2 ELSE 0.0 END ELSE 0.05 END AS tee FROM g)
SELECT document_id, count(*) AS hypotheses, count(*) FILTER (WHERE abs(tee-crossing)>=0.15 AND crossing>=tee) AS crossings, count(*) FILTER (WHERE abs(tee-crossing)<0.15) AS unresolved, round(avg(angle),4) AS mean_angle, round(CAST(sum(tee) AS DOUBLE),4) AS tee_score FROM h GROUP BY document_id""")
def intersection_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """Crossing and tee scores of all interior crossings, by page."""
    made = spatial.interior_intersections(segments(spark, folder), P.intersection_proximity)
    made = made.withColumn("angle", graph.angle_at("a", "b", F.col("x"), F.col("y")))
    made = made.withColumn("h", graph.hypothesis_scores(F.col("a.layer_id") == F.col("b.layer_id"), F.col("angle"), F.lit(0.0)))
    return made.groupBy("a.document_id").agg(
        F.count("*").alias("hypotheses"), F.count_if(F.col("h.recommended") == "crossing").alias("crossings"), F.count_if(F.col("h.recommended").isNull()).alias("unresolved"),
        F.round(F.avg("angle"), 4).alias("mean_angle"), F.round(F.sum("h.tee"), 4).alias("tee_score"),
    )


@query(f"""WITH p AS ({POINTS_SQL}), n AS ({POINTS2_SQL}), j AS (SELECT p.document_id, p.id AS port_id, n.id AS node_id, (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y) AS d2 FROM p JOIN n ON p.document_id=n.document_id)
SELECT document_id, port_id, node_id, round(sqrt(d2),6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY d2, node_id DESC) AS k FROM j WHERE d2<=144.0) WHERE k=1""")
def port_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest node within the port tolerance, the last of equally near ones."""
    pairs = spatial.radius_join(points(spark, folder), points(spark, folder, 2), P.port_tolerance).withColumn("port_id", F.col("l.id"))
    best = spatial.nearest(pairs, "port_id", [F.col("d2"), F.col("r.id").desc()])
    return best.select("l.document_id", "port_id", F.col("r.id").alias("node_id"), r6(F.sqrt("d2")).alias("distance"))


@query(f"""WITH p AS ({POINTS_SQL}), n AS ({POINTS2_SQL}), j AS (SELECT p.document_id, p.id, n.id AS node_id, row_number() OVER (PARTITION BY p.id ORDER BY n.id) AS k FROM p JOIN n ON p.document_id=n.document_id WHERE (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)<=2304.0)
SELECT document_id, id, count(*) AS nearby, min(node_id) AS first_node, max(node_id) AS last_node FROM j WHERE k<=8 GROUP BY ALL""")
def nearby_topology(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight nodes within the context radius of each text."""
    pairs = spatial.radius_join(points(spark, folder), points(spark, folder, 2), P.context_radius).withColumn("_id", F.col("l.id"))
    first = spatial.nearest(pairs, "_id", [F.col("r.id")], P.nearby_limit)
    return first.groupBy("l.document_id", F.col("l.id").alias("id")).agg(F.count("*").alias("nearby"), F.min("r.id").alias("first_node"), F.max("r.id").alias("last_node"))


_PSD = """sqrt((px-(x0+t*(x1-x0)))*(px-(x0+t*(x1-x0)))+(py-(y0+t*(y1-y0)))*(py-(y0+t*(y1-y0))))"""


@query(f"""WITH b AS ({BOXES_SQL}), s AS ({SEGMENTS_SQL}), j AS (SELECT b.document_id, b.id AS text_id, s.id AS witness_id, b.x+b.width/2 AS px, b.y+b.height/2 AS py, s.x0, s.y0, s.x1, s.y1 FROM b JOIN s ON b.document_id=s.document_id WHERE b.kind='dimension'),
d AS (SELECT *, greatest(0.0, least(1.0, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) AS t FROM j), e AS (SELECT document_id, text_id, witness_id, {_PSD} AS dist FROM d)
SELECT document_id, text_id, witness_id, round(dist,5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY dist, witness_id) AS k FROM e WHERE dist<=48.0) WHERE k=1""")
def witness_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest segment within reach of each dimension text, the first of equally near ones."""
    texts = boxes(spark, folder).where("kind = 'dimension'").select("document_id", "id", (F.col("x") + F.col("width") / 2).alias("px"), (F.col("y") + F.col("height") / 2).alias("py"))
    # a text is a segment without length; pairs whose boxes meet within the reach include all that are near enough
    both = segments(spark, folder).select("document_id", F.concat(F.lit("s"), F.col("id")).alias("id"), "x0", "y0", "x1", "y1")
    ends = texts.select("document_id", F.concat(F.lit("d"), F.col("id")).alias("id"), F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    pairs = spatial.segment_pairs(both.union(ends), 64.0, reach=P.witness_text_distance / 2).where("a.id like 'd%' and b.id like 's%'")
    dist = G.point_segment_distance(F.col("a.x0"), F.col("a.y0"), F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"))
    made = pairs.select("a.document_id", F.substring("a.id", 2, 20).cast("long").alias("text_id"), F.substring("b.id", 2, 20).cast("long").alias("witness_id"), dist.alias("d")).where(F.col("d") <= P.witness_text_distance)
    best = spatial.nearest(made, "text_id", [F.col("d"), F.col("witness_id")])
    return best.select("document_id", "text_id", "witness_id", F.round("d", 5).alias("distance"))


@query(f"""WITH p AS ({POINTS_SQL}), n AS ({POINTS2_SQL}), s AS (SELECT document_id, id, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM ({SEGMENTS_SQL})),
c AS (SELECT p.document_id, p.id AS annotation_id, 'topology_edge' AS ref_kind, 1 AS o, s.id AS ref_id, (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y) AS d2, 0.15 AS bonus FROM p JOIN s ON p.document_id=s.document_id
UNION ALL SELECT p.document_id, p.id, 'topology_node', 2, n.id, (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y), 0.0 FROM p JOIN n ON p.document_id=n.document_id),
k AS (SELECT *, round(least(1.0, greatest(0.0, 1-sqrt(d2)/96.0)+bonus),6) AS score FROM c WHERE d2<=9216.0)
SELECT document_id, annotation_id, rank, ref_kind, ref_id, score, coalesce(score-next_score<0.08, false) AS ambiguous FROM (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM k WINDOW w AS (PARTITION BY annotation_id ORDER BY score DESC, o, ref_id)) WHERE rank<=3""")
def annotation_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The three best targets of each annotation among edges (with the leader bonus) and nodes, and whether the next one is too near."""
    tips, nodes = points(spark, folder), points(spark, folder, 2)
    middles = segments(spark, folder).select("document_id", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    kinds = []
    for order, kind, things, bonus in ((1, "topology_edge", middles, P.leader_bonus), (2, "topology_node", nodes, 0.0)):
        near = spatial.radius_join(tips, things, P.annotation_target_distance)
        score = F.round(F.least(F.lit(1.0), G.distance_score(F.sqrt("d2"), P.annotation_target_distance) + bonus), 6)
        kinds.append(near.select("l.document_id", F.col("l.id").alias("annotation_id"), F.lit(kind).alias("ref_kind"), F.lit(order).alias("o"), F.col("r.id").alias("ref_id"), score.alias("score")))
    w = Window.partitionBy("annotation_id").orderBy(F.desc("score"), "o", "ref_id")
    made = kinds[0].unionByName(kinds[1]).withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank <= 3")
    return made.select("document_id", "annotation_id", "rank", "ref_kind", "ref_id", "score", F.coalesce(F.col("score") - F.col("next") < P.target_margin, F.lit(False)).alias("ambiguous"))


@query(f"""WITH p AS ({POINTS_SQL}), b AS ({BOXES_SQL}) SELECT p.document_id, p.id, count(*) AS symbols, CAST(CASE WHEN count(*)>0 THEN 0.2 ELSE 1.0 END AS DOUBLE) AS continuity FROM p JOIN b ON p.document_id=b.document_id AND b.kind='symbol' AND p.x BETWEEN b.x-4.0 AND b.x+b.width+4.0 AND p.y BETWEEN b.y-4.0 AND b.y+b.height+4.0 GROUP BY p.document_id, p.id""")
def points_in_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Points inside the buffered boxes of symbols."""
    met = spatial.points_in_boxes(points(spark, folder), boxes(spark, folder).where("kind = 'symbol'"), P.symbol_buffer)
    return met.groupBy("l.document_id", F.col("l.id").alias("id")).agg(F.count("*").alias("symbols")).withColumn("continuity", F.lit(0.2))


@query(f"""WITH b AS ({BOXES_SQL}), r AS (SELECT *, width/height AS aspect, width*height AS area FROM b WHERE width*height>=24)
SELECT id, CASE WHEN aspect>=2.2 AND width>=30 THEN 'text' WHEN aspect<=1.8 AND greatest(width,height)<=48 THEN 'symbol' WHEN aspect>=3.0 AND width>=40 AND height<=20 THEN 'dimension' WHEN aspect>=1.2 AND area<200 THEN 'arrow' WHEN aspect>=2.2 THEN 'text' ELSE 'symbol' END AS region_kind,
CAST(CASE WHEN aspect>=2.2 AND width>=30 THEN 0.72 WHEN aspect<=1.8 AND greatest(width,height)<=48 THEN 0.68 WHEN aspect>=3.0 AND width>=40 AND height<=20 THEN 0.65 WHEN aspect>=1.2 AND area<200 THEN 0.55 WHEN aspect>=2.2 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS score, greatest(0.0, round(x-4,6)) AS crop_x, greatest(0.0, round(y-4,6)) AS crop_y FROM r""")
def region_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and score of regions of enough area by their shape, and their padded crop."""
    aspect, w, h = F.col("width") / F.col("height"), F.col("width"), F.col("height")
    rules = [((aspect >= 2.2) & (w >= 30), "text", 0.72), ((aspect <= 1.8) & (F.greatest(w, h) <= 48), "symbol", 0.68), ((aspect >= 3.0) & (w >= 40) & (h <= 20), "dimension", 0.65), ((aspect >= 1.2) & (w * h < 200), "arrow", 0.55), (aspect >= 2.2, "text", 0.6)]
    kind = score = None
    for rule, name, value in rules:
        kind = F.when(rule, name) if kind is None else kind.when(rule, name)
        score = F.when(rule, value) if score is None else score.when(rule, value)
    made = boxes(spark, folder).where(w * h >= 24)
    return made.select("id", kind.otherwise("symbol").alias("region_kind"), score.otherwise(0.5).alias("score"), *[F.greatest(F.lit(0.0), F.round(F.col(c) - 4, 6)).alias(f"crop_{c}") for c in ("x", "y")])


@query(f"""WITH s AS (SELECT document_id, id, least(x0,x1) AS lx, greatest(x0,x1) AS hx, least(y0,y1) AS ly, greatest(y0,y1) AS hy, (x0+x1)/2 AS mx, (y0+y1)/2 AS my FROM ({SEGMENTS_SQL})), b AS (SELECT * FROM ({BOXES_SQL}) WHERE kind='dimension'),
j AS (SELECT s.*, b.x, b.y, b.width, b.height, least(hx,b.x+b.width)-greatest(lx,b.x) AS w, least(hy,b.y+b.height)-greatest(ly,b.y) AS h FROM s JOIN b ON s.document_id=b.document_id)
SELECT document_id, id, round(max(CASE WHEN w>0 AND h>0 THEN w*h/greatest(1.0,(hx-lx)*(hy-ly)) ELSE 0.0 END),6) AS overlap FROM j WHERE CASE WHEN w>0 AND h>0 THEN w*h/greatest(1.0,(hx-lx)*(hy-ly))>=0.25 ELSE mx BETWEEN x AND x+width AND my BETWEEN y AND y+height END GROUP BY document_id, id""")
def dimension_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that a dimension region covers to a quarter, or whose midpoint it holds."""
    made = dimension_hits(spark, folder)
    return made.groupBy("a.document_id", F.substring("a.id", 2, 20).cast("long").alias("id")).agg(r6(F.max("overlap")).alias("overlap"))


def dimension_hits(spark: SparkSession, folder: str) -> DataFrame:
    lines = segments(spark, folder).select("document_id", F.concat(F.lit("a"), F.col("id")).alias("id"), "x0", "y0", "x1", "y1")
    areas = boxes(spark, folder).where("kind = 'dimension'")
    areas = areas.select("document_id", F.concat(F.lit("b"), F.col("id")).alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    pairs = spatial.segment_pairs(lines.union(areas), 64.0).where("a.id like 'a%' and b.id like 'b%'")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    overlap = G.overlap_fraction(a("x0"), a("y0"), a("x1"), a("y1"), b("x0"), b("y0"), b("x1") - b("x0"), b("y1") - b("y0"))
    middle = [((a(f"{c}0") + a(f"{c}1")) / 2).between(b(f"{c}0"), b(f"{c}1")) for c in ("x", "y")]
    made = pairs.withColumns({"overlap": overlap, "middle": middle[0] & middle[1]})
    return made.where((F.col("overlap") >= P.dimension_overlap) | ((F.col("overlap") == 0) & F.col("middle")))


_DEGREE_SQL = f"""WITH p AS ({POINTS_SQL}), e AS (SELECT a.document_id, a.id AS s, b.id AS t, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.document_id=b.document_id AND a.id<b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=400.0),
i AS (SELECT document_id, s AS node, t AS other, degrees(atan2(by_-ay, bx-ax)) AS angle FROM e UNION ALL SELECT document_id, t, s, degrees(atan2(ay-by_, ax-bx)) FROM e),"""


@query(f"""{_DEGREE_SQL} g AS (SELECT document_id, node, count(*) AS degree, arg_min(angle, other) AS first_angle, arg_max(angle, other) AS last_angle FROM i GROUP BY document_id, node),
b AS (SELECT *, abs(first_angle-last_angle) % 180.0 AS d FROM g)
SELECT document_id, node, degree, CASE WHEN degree<=1 THEN 'endpoint' WHEN degree>=3 THEN 'tee' WHEN least(d,180.0-d) BETWEEN 55.0 AND 130.0 THEN 'elbow' ELSE 'unknown' END AS kind, round(first_angle,4) AS first_angle FROM b""")
def node_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Degree, kind and first incident direction of the nodes of a proximity graph."""
    p = points(spark, folder)
    pairs = spatial.radius_join(p, p, 20.0).where("l.id < r.id")
    edges = pairs.select(F.col("l.document_id").alias("document_id"), F.col("l.id").alias("start_node"), F.col("r.id").alias("end_node"), F.col("l.x").alias("ax"), F.col("l.y").alias("ay"), F.col("r.x").alias("bx"), F.col("r.y").alias("by"))
    ends = graph.endpoints(edges, ["document_id", "ax", "ay", "bx", "by"])
    sign = F.when(F.col("end") == 0, 1.0).otherwise(-1.0)
    ends = ends.withColumn("angle", G.direction(sign * (F.col("bx") - F.col("ax")), sign * (F.col("by") - F.col("ay"))))
    made = ends.groupBy("document_id", "node").agg(F.count("*").alias("degree"), F.min_by("angle", "other").alias("first"), F.max_by("angle", "other").alias("last"))
    return made.select("document_id", "node", "degree", graph.node_kind(F.col("degree"), G.line_delta(F.col("first"), F.col("last"))).alias("kind"), F.round("first", 4).alias("first_angle"))


@query(f"""WITH RECURSIVE p AS ({POINTS_SQL}), e AS (SELECT a.document_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.document_id=b.document_id AND a.id<>b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=400.0),
r(document_id, node, reached) AS (SELECT document_id, id, id FROM p UNION SELECT r.document_id, r.node, e.b FROM r JOIN e ON r.document_id=e.document_id AND r.reached=e.a)
SELECT document_id, node, min(reached) AS component FROM r GROUP BY document_id, node""")
def proximity_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of the points of a page that lie within 20 pixels of each other."""
    p = points(spark, folder)
    pairs = spatial.radius_join(p, p, 20.0).where("l.id < r.id").select(F.col("l.document_id").alias("document_id"), F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return graph.connected_components(pairs, p, new_folder(spark, "components")).select("document_id", "node", "component")


_AXIS_SQL = f"""WITH s AS ({SEGMENTS_SQL}), w AS (SELECT document_id, ((degrees(atan2(y1-y0, x1-x0)) % 180.0)+180.0) % 180.0 AS angle, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS weight FROM s),
v AS (SELECT * FROM w WHERE weight>=20.0), q AS (SELECT v.*, r.step*0.5 AS rotation FROM v, (SELECT unnest(range(360)) AS step) r),
d AS (SELECT *, abs(angle-(rotation+90.0) % 180.0) AS a1, abs(angle-(rotation+30.0) % 180.0) AS a2, abs(angle-(rotation+150.0) % 180.0) AS a3 FROM q),
m AS (SELECT document_id, rotation, weight, least(a1,180-a1,a2,180-a2,a3,180-a3) AS dist FROM d),
k AS (SELECT document_id, rotation, round(sum(CASE WHEN dist<=12.0 THEN weight*(1-dist/12.0) ELSE 0.0 END),6) AS score FROM m GROUP BY document_id, rotation),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, rotation) AS n FROM k),
model AS (SELECT o.document_id, t.total, o.rotation, least(1.0, o.score/greatest(t.total,1.0)) AS confidence FROM o JOIN (SELECT document_id, sum(weight) AS total FROM v GROUP BY document_id) t ON o.document_id=t.document_id WHERE n=1 AND total>=20.0)"""


@query(f"{_AXIS_SQL} SELECT document_id, round(total,4) AS total, CAST(rotation AS DOUBLE) AS rotation, round(confidence,5) AS confidence FROM model")
def axis_models(spark: SparkSession, folder: str) -> DataFrame:
    """The axis model of each page."""
    made = snapping.axis_models(segments(spark, folder).withColumn("status", F.lit("accepted")))
    return made.select("document_id", F.round("total", 4).alias("total"), "rotation", F.round("confidence", 5).alias("confidence"))


@query(f"""{_AXIS_SQL}, l AS (SELECT s.*, rotation, confidence, CASE WHEN id % 11=0 THEN 'uncertain' ELSE 'accepted' END AS status, ((degrees(atan2(y1-y0, x1-x0)) % 180.0)+180.0) % 180.0 AS angle, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM s LEFT JOIN (SELECT document_id, rotation, confidence FROM model) USING (document_id)),
z AS (SELECT *, abs(angle-(rotation+90.0) % 180.0) AS a1, abs(angle-(rotation+30.0) % 180.0) AS a2, abs(angle-(rotation+150.0) % 180.0) AS a3 FROM l),
y AS (SELECT *, least(a1,180-a1) AS d1, least(a2,180-a2) AS d2, least(a3,180-a3) AS d3 FROM z), x AS (SELECT *, least(d1,d2,d3) AS delta FROM y)
SELECT document_id, CASE WHEN status='uncertain' THEN 'preserved_uncertain' WHEN coalesce(confidence,0.0)<0.35 THEN 'weak_axis_model' WHEN len<20.0 THEN 'low_evidence' WHEN delta>4.0 THEN 'off_axis' WHEN len*sin(radians(delta/2))>8.0 THEN 'endpoint_displacement' ELSE 'snapped_to_axis' END AS reason,
count(*) AS n, round(sum(len),3) AS length FROM x GROUP BY ALL""")
def snap_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """How many segments of a page are snapped to its axes, and why the others aren't."""
    primitives = segments(spark, folder).withColumn("status", F.when(F.col("id") % 11 == 0, "uncertain").otherwise("accepted"))
    # the weights of the model don't depend on the status here: uncertain primitives vote too
    made = snapping.snapped(primitives, snapping.axis_models(primitives)).select("document_id", "id", "reason")
    length = primitives.select("id", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"))
    return made.join(length, "id").groupBy("document_id", "reason").agg(F.count("*").alias("n"), F.round(F.sum("length"), 3).alias("length"))


_TRACE_SQL = "SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL AND value IS NOT NULL"


def _trace(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("ts is not null and value is not null")
    return e.select("user_id", "event_id", "ts", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))


@query(f"""WITH t AS ({_TRACE_SQL}), a AS (SELECT user_id, count(*) AS n, avg(k) AS mx, avg(value) AS my, var_pop(k) AS vx, var_pop(value) AS vy, covar_pop(k, value) AS c FROM t GROUP BY user_id),
f AS (SELECT *, greatest(0.0, (vx+vy-sqrt((vx-vy)*(vx-vy)+4*c*c))/2) AS small FROM a)
SELECT user_id, n, round(degrees(0.5*atan2(2*c, vx-vy)),3) AS angle, round(sqrt(small),4) AS rms, round(CASE WHEN vx+vy<=0 THEN 1.0 ELSE 1-small/(vx+vy) END,4) AS r2, CASE WHEN sqrt(small)>2.5 THEN 'rejected' WHEN 1-small/(vx+vy)<0.92 THEN 'uncertain' ELSE 'accepted' END AS status FROM f WHERE n>1""")
def line_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Total least squares lines through the traces of users."""
    made = snapping.line_fit(_trace(spark, folder).select("user_id", F.col("k").cast("double").alias("x"), F.col("value").alias("y")), ["user_id"]).where("n > 1")
    return made.select("user_id", "n", F.round("angle", 3).alias("angle"), F.round("rms", 4).alias("rms"), F.round("r2", 4).alias("r2"), "status")


@query(f"""WITH t AS ({_TRACE_SQL}), s AS (SELECT user_id, k, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM t WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, round(sum(CASE WHEN before IS NULL THEN 0 ELSE sqrt(1+(value-before)*(value-before)) END),4) AS length, count(*) FILTER (WHERE before IS NOT NULL AND after IS NOT NULL AND abs(degrees(atan2(after-value,1.0))-degrees(atan2(value-before,1.0)))>18.0) AS turns FROM s GROUP BY user_id""")
def polyline_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each user's trace, and its turns of more than 18 degrees."""
    w = Window.partitionBy("user_id").orderBy("k")
    t = _trace(spark, folder).withColumns({"before": F.lag("value").over(w), "after": F.lead("value").over(w)})
    step = F.when(F.col("before").isNull(), 0.0).otherwise(F.sqrt(1 + (F.col("value") - F.col("before")) * (F.col("value") - F.col("before"))))
    turn = G.angle_delta(G.direction(F.lit(1.0), F.col("after") - F.col("value")), G.direction(F.lit(1.0), F.col("value") - F.col("before")))
    return t.groupBy("user_id").agg(F.round(F.sum(step), 4).alias("length"), F.count_if(F.col("before").isNotNull() & F.col("after").isNotNull() & (turn > 18.0)).alias("turns"))


@query("""WITH m AS (SELECT vec_id AS id, [1.0+embedding[1]::DOUBLE, embedding[2]::DOUBLE, 10.0*embedding[3]::DOUBLE, embedding[4]::DOUBLE, 1.0+embedding[5]::DOUBLE, 10.0*embedding[6]::DOUBLE, 0.001*embedding[7]::DOUBLE, 0.001*embedding[8]::DOUBLE, 1.0] AS m, 100.0*embedding[9]::DOUBLE AS x, 100.0*embedding[10]::DOUBLE AS y FROM embeddings),
d AS (SELECT *, m[1]*(m[5]*m[9]-m[6]*m[8])-m[2]*(m[4]*m[9]-m[6]*m[7])+m[3]*(m[4]*m[8]-m[5]*m[7]) AS det FROM m)
SELECT id, round((m[1]*x+m[2]*y+m[3])/(m[7]*x+m[8]*y+m[9]),5) AS x, round((m[4]*x+m[5]*y+m[6])/(m[7]*x+m[8]*y+m[9]),5) AS y, round(det,6) AS det, true AS round_trip FROM d WHERE abs(det)>=0.05""")
def homographies(spark: SparkSession, folder: str) -> DataFrame:
    """Points under homographies, and whether the inverse brings them back to within half a pixel."""
    e = table(spark, folder, "embeddings")
    v = lambda k, scale=1.0, base=0.0: F.lit(base) + F.lit(scale) * F.col("embedding")[k].cast("double")
    m = F.array(v(0, base=1.0), v(1), v(2, 10.0), v(3), v(4, base=1.0), v(5, 10.0), v(6, 0.001), v(7, 0.001), F.lit(1.0))
    made = e.select(F.col("vec_id").alias("id"), m.alias("m"), v(8, 100.0).alias("x"), v(9, 100.0).alias("y"))
    made = made.withColumns({"det": G.determinant(F.col("m")), "to": G.apply_matrix(F.col("m"), F.col("x"), F.col("y"))}).where(F.abs("det") >= 0.05)
    back = G.apply_matrix(G.invert_matrix(F.col("m")), F.col("to.x"), F.col("to.y"))
    made = made.withColumn("back", back)
    return made.select("id", F.round("to.x", 5).alias("x"), F.round("to.y", 5).alias("y"), r6(F.col("det")).alias("det"), (G.distance(F.col("back.x"), F.col("back.y"), F.col("x"), F.col("y")) <= 0.5).alias("round_trip"))


@query()
def endpoint_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Leader clusters of segment ends on each page, with centroid and number of ends."""
    ends = _ends(spark, folder).withColumn("ord", (F.col("id") * 2 + F.col("k")).cast("long"))
    made = graph.leader_clusters(ends.select("document_id", "ord", "x", "y"))
    return made.groupBy("document_id", "cluster_id").agg(F.count("*").alias("ends"), r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"))


@query()
def merged_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of each page after merging collinear neighbours whose gap is taken as inked."""
    s = segments(spark, folder).select("document_id", F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), "layer_id", "x0", "y0", "x1", "y1", F.array(F.col("id").cast("string")).alias("primitive_ids"))
    made = graph.merged_collinear(s, _inked)
    return made.select("document_id", "id", F.size("primitive_ids").alias("primitives"), *[r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _inked(page: object, x0: float, y0: float, x1: float, y1: float) -> float:
    return 1.0
