"""Queries that rank readings and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE as P
from ..functions import text as X
from ..operators import graph, ranking, spatial
from ..sources.tables import BOXES_SQL, POINTS_SQL, boxes, points, table
from .registry import ORACLES, query
from .text import readings

#: The library of the queries: what texts call a symbol, and where it may be attached.
LIBRARY = [
    ranking.Symbol("ball_valve", ("ball valve", "bv"), ("endpoint", "unknown"), (1, 2)),
    ranking.Symbol("flange", ("flange", "flg")),
    ranking.Symbol("tee_fitting", ("tee",), ("tee",), (3, 3)),
    ranking.Symbol("riser", ("riser",), None, (1, 1)),
]

_ALT_SQL = """SELECT p_partkey AS text_id, 0 AS ord, p_name AS text, 0.30+(p_size % 30)/100.0 AS score, 'ocr' AS source FROM part UNION ALL SELECT p_partkey, 1, p_brand, 0.54+(p_partkey % 3)/100.0, 'ocr' FROM part UNION ALL SELECT p_partkey, 2, concat('Valve ', p_name), 0.55, 'vocabulary' FROM part"""


@query(f"""WITH a AS (SELECT *, round(CASE WHEN text_id % 4>0 AND source='vocabulary' THEN least(1.0, score+0.02) ELSE score END, 6) AS s FROM ({_ALT_SQL}))
SELECT text_id, text, CAST(s AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY text_id ORDER BY s DESC, ord) AS INTEGER) AS rank FROM a""")
def reranked_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Alternatives of readings in the order of their scores; those of the vocabulary gain near a graph."""
    p = table(spark, folder, "part")
    own = lambda n, text, score, source: F.struct(F.lit(n).alias("ord"), text.alias("text"), score.alias("score"), F.lit(source).alias("source"))
    each = F.array(own(0, F.col("p_name"), F.round(0.30 + F.col("p_size") % 30 / 100.0, 6), "ocr"), own(1, F.col("p_brand"), F.round(0.54 + F.col("p_partkey") % 3 / 100.0, 6), "ocr"), own(2, F.concat(F.lit("Valve "), "p_name"), F.lit(ranking.VOCABULARY_SCORE), "vocabulary"))
    alternatives = p.select(F.col("p_partkey").alias("text_id"), F.explode(each).alias("a")).select("text_id", "a.*")
    made = ranking.reranked(alternatives, p.select(F.col("p_partkey").alias("text_id"), (F.col("p_partkey") % 4).alias("nodes")))
    return made.select("text_id", "text", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT p_partkey AS id, normalized AS text, CASE WHEN normalized IS NULL THEN NULL ELSE CAST(0.55 AS DOUBLE) END AS score FROM part LEFT JOIN ({ORACLES["normalized_readings"]}) n ON n.id=p_partkey""")
def vocabulary_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """The reading that the vocabulary proposes for each text, as an alternative of a fixed score."""
    made = readings(spark, folder).withColumn("a", ranking.vocabulary_alternative(F.col("raw"), X.normalized(F.col("raw"))))
    return made.select("id", F.get("a", F.lit(0)).alias("a")).select("id", "a.text", "a.score")


@query(f"""SELECT id, CASE WHEN kind NOT IN ('text','dimension') THEN 'skipped' WHEN trim(CASE id % 6 WHEN 0 THEN ' ' ELSE 'x' END)='' THEN 'unreadable' WHEN (id % 20)/20.0<0.45 THEN 'low_confidence' WHEN (id % 9)/50.0<0.08 THEN 'conflicting' ELSE 'proposed' END AS status FROM ({BOXES_SQL})""")
def reading_states(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the reading of every region."""
    text = F.when(F.col("id") % 6 == 0, F.lit(" ")).otherwise(F.lit("x"))
    return boxes(spark, folder).select("id", ranking.text_status(F.col("kind"), text, F.col("id") % 20 / 20.0, F.col("id") % 9 / 50.0).alias("status"))


_CENTRES = f"SELECT document_id, id, kind, width, height, x+width/2 AS x, y+height/2 AS y FROM ({BOXES_SQL})"
_TEXT = "CASE id % 5 WHEN 0 THEN 'Ball valve 2\"' WHEN 1 THEN 'FLG 4' WHEN 2 THEN 'riser up' WHEN 3 THEN 'NPT thrd' ELSE 'note' END"
_TEXTS = f"SELECT document_id, id, x, y, {_TEXT} AS text FROM ({_CENTRES}) WHERE kind='text'"
_GRAPH = f"""p AS ({POINTS_SQL}), e AS (SELECT a.document_id, a.id AS s, b.id AS t FROM p a JOIN p b ON a.document_id=b.document_id AND a.id<b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=576.0),
deg AS (SELECT p.document_id, p.id, any_value(x) AS x, any_value(y) AS y, count(n.node) AS edges FROM p LEFT JOIN (SELECT s AS node FROM e UNION ALL SELECT t FROM e) n ON n.node=p.id GROUP BY p.document_id, p.id),
g AS (SELECT *, CASE WHEN edges<=1 THEN 'endpoint' WHEN edges>=3 THEN 'tee' WHEN id % 2=0 THEN 'elbow' ELSE 'unknown' END AS kind, id % 3<>0 AS confirmed FROM deg)"""


def _centres(spark: SparkSession, folder: str) -> DataFrame:
    return boxes(spark, folder).select("document_id", "id", "kind", "width", "height", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _centres(spark, folder).where("kind = 'text'").select("document_id", "id", "x", "y", F.expr(_TEXT).alias("text"))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Points with their edges to others within 24 pixels, and a kind."""
    p = points(spark, folder)
    pairs = spatial.radius_join(p, p, 24.0).where("l.id < r.id")
    edges = pairs.select(F.col("l.document_id").alias("document_id"), F.col("l.id").alias("start_node"), F.col("r.id").alias("end_node"))
    degree = graph.endpoints(edges, ["document_id"]).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("edges"))
    made = p.join(degree, "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    kind = graph.node_kind(F.col("edges"), F.when(F.col("id") % 2 == 0, 90.0).otherwise(0.0))
    return made.select("document_id", "id", "x", "y", "edges", kind.alias("kind"), (F.col("id") % 3 != 0).alias("confirmed"))


@query(f"""SELECT s.document_id, s.id AS symbol_id, t.id AS text_id FROM ({_CENTRES}) s JOIN ({_TEXTS}) t ON s.document_id=t.document_id WHERE s.kind='symbol' AND (s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)<=4096.0""")
def texts_near_symbols(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spatial.radius_join(_centres(spark, folder).where("kind = 'symbol'"), _texts(spark, folder), P.nearby_text_radius)
    return pairs.select("l.document_id", F.col("l.id").alias("symbol_id"), F.col("r.id").alias("text_id"))


@query(f"""WITH {_GRAPH} SELECT s.id, min(g.id) AS node_id FROM ({_CENTRES}) s JOIN g ON s.document_id=g.document_id AND (s.x-g.x)*(s.x-g.x)+(s.y-g.y)*(s.y-g.y)<=144.0 WHERE confirmed AND g.kind IN ('tee','elbow') AND s.kind='symbol' GROUP BY s.id""")
def structural_junctions(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol regions that lie on a confirmed tee or elbow."""
    return ranking.structural_junctions(_centres(spark, folder).where("kind = 'symbol'"), graph_nodes(spark, folder))


def _shape_sql() -> str:
    """One SELECT for each symbol over features aspect, fill, symmetry, vertices."""
    names = {"symmetry": "symmetry", "fill": "fill", "few_vertices": "(CASE WHEN vertices<=4 THEN 1.0 ELSE 0.0 END)", "wide": "(CASE WHEN aspect>1.2 THEN 1.0 ELSE 0.0 END)", "long": "(CASE WHEN aspect>1.0 THEN 1.0 ELSE 0.0 END)", "compact": "(CASE WHEN aspect<1.2 THEN 1.0 ELSE 0.0 END)", "near_three_halves": "(1.0-abs(aspect-1.5))"}
    rows = []
    for n, (symbol, (base, weights)) in enumerate(ranking.SHAPES.items()):
        score = "+".join([str(base), *[f"{w}*{names[f]}" for f, w in weights.items()]])
        rows.append(f"SELECT *, {n} AS ord, '{symbol}' AS symbol_id, CAST(greatest(0.0, least(1.0, {score})) AS DOUBLE) AS shape FROM f")
    return " UNION ALL ".join(rows)


@query(f"""WITH {_GRAPH}, c AS ({_CENTRES}), f AS (SELECT document_id, id, x, y, width/height AS aspect, CAST((id % 10)/10.0 AS DOUBLE) AS fill, CAST((id % 7)/7.0 AS DOUBLE) AS symmetry, id % 8 AS vertices FROM c WHERE kind='symbol'), s AS ({_shape_sql()}), t AS ({_TEXTS}),
h AS (SELECT DISTINCT f.id, unnest(CASE t.id % 5 WHEN 0 THEN ['ball_valve'] WHEN 1 THEN ['flange'] WHEN 2 THEN ['riser'] ELSE [] END) AS symbol_id FROM f JOIN t ON f.document_id=t.document_id AND (f.x-t.x)*(f.x-t.x)+(f.y-t.y)*(f.y-t.y)<=4096.0),
n AS (SELECT f.id, min(g.id) AS node FROM f JOIN g ON f.document_id=g.document_id AND (f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)<=576.0 GROUP BY f.id), k AS (SELECT n.id, g.kind, g.edges FROM n JOIN g ON g.id=n.node),
a AS (SELECT id, 'ball_valve' AS symbol_id, 0.1+(CASE WHEN kind IN ('endpoint','unknown') THEN 0.4 ELSE 0.0 END)+(CASE WHEN edges>=1 THEN 0.2 ELSE 0.0 END)+(CASE WHEN edges<=2 THEN 0.2 ELSE 0.0 END) AS topology FROM k UNION ALL SELECT id, 'flange', 0.2 FROM k
UNION ALL SELECT id, 'tee_fitting', 0.1+(CASE WHEN kind='tee' THEN 0.4 ELSE 0.0 END)+(CASE WHEN edges>=3 THEN 0.2 ELSE 0.0 END)+(CASE WHEN edges<=3 THEN 0.2 ELSE 0.0 END) FROM k UNION ALL SELECT id, 'riser', 0.1+(CASE WHEN edges>=1 THEN 0.2 ELSE 0.0 END)+(CASE WHEN edges<=1 THEN 0.2 ELSE 0.0 END) FROM k),
z AS (SELECT s.id, s.ord, s.symbol_id, s.shape, round(s.shape+(CASE WHEN h.id IS NULL THEN 0.0 ELSE 0.7 END)+coalesce(CAST(a.topology AS DOUBLE),0.0),9) AS combined FROM s LEFT JOIN h ON h.id=s.id AND h.symbol_id=s.symbol_id LEFT JOIN a ON a.id=s.id AND a.symbol_id=s.symbol_id),
r AS (SELECT *, row_number() OVER w AS rank, round(combined-lead(combined) OVER w,9) AS margin, first_value(shape) OVER w AS top FROM z WINDOW w AS (PARTITION BY id ORDER BY combined DESC, ord)), q AS (SELECT *, first_value(margin) OVER (PARTITION BY id ORDER BY rank) AS near FROM r),
j AS (SELECT DISTINCT f.id FROM f JOIN g ON f.document_id=g.document_id AND (f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)<=144.0 WHERE g.confirmed AND g.kind IN ('tee','elbow'))
SELECT q.id, CAST(rank AS INTEGER) AS rank, CASE WHEN j.id IS NOT NULL AND symbol_id IN ('tee_fitting','elbow_fitting') THEN 'unknown' ELSE symbol_id END AS symbol_id, round(combined,6) AS combined, CASE WHEN top<0.35 THEN 'unknown' WHEN near<0.08 THEN 'low_margin' ELSE 'proposed' END AS status FROM q LEFT JOIN j ON j.id=q.id WHERE rank<=5""")
def ranked_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The five best symbols of every symbol region by shape, nearby texts and the graph."""
    c = _centres(spark, folder).where("kind = 'symbol'")
    features = (F.col("width") / F.col("height"), F.col("id") % 10 / 10.0, F.col("id") % 7 / 7.0, F.col("id") % 8)
    shapes = c.select("id", F.explode(ranking.shape_scores(F.col("kind"), *features)).alias("s")).select("id", "s.*")
    nodes = graph_nodes(spark, folder)
    hits = ranking.alias_hits(c, _texts(spark, folder), LIBRARY).withColumn("text", F.lit(ranking.ALIAS_SCORE))
    first = spatial.radius_join(c, nodes, 2 * P.port_tolerance).groupBy(F.col("l.id").alias("id")).agg(F.min_by(F.struct("r.kind", "r.edges"), "r.id").alias("n"))
    attached = ranking.attachment_scores(first.select("id", "n.kind", "n.edges"), LIBRARY)
    scores = shapes.join(hits, ["id", "symbol_id"], "left").join(attached, ["id", "symbol_id"], "left").fillna(0.0, ["text", "topology"])
    made = ranking.ranked_symbols(scores, ranking.structural_junctions(c, nodes))
    return made.select("id", "rank", "symbol_id", F.round("combined", 6).alias("combined"), "status")


_PORTS = "SELECT document_id, id, unnest([0,1,2]) AS ord, unnest(['run_a','run_b','branch']) AS port, unnest([-20.0,20.0,0.0]) AS px, unnest([0.0,0.0,-20.0]) AS py, x, y, radians(CAST(id % 12 AS DOUBLE)*30.0) AS r FROM ({})"
_WORLD = f"SELECT document_id, id, ord, port, x+px*cos(r)-py*sin(r) AS x, y+px*sin(r)+py*cos(r) AS y FROM ({_PORTS.format(_CENTRES + ' WHERE kind=' + chr(39) + 'symbol' + chr(39))})"


def _ports(spark: SparkSession, folder: str) -> DataFrame:
    ports = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in (("run_a", -20.0, 0.0), ("run_b", 20.0, 0.0), ("branch", 0.0, -20.0))])
    symbols = _centres(spark, folder).where("kind = 'symbol'").withColumn("rotation", (F.col("id") % 12 * 30).cast("double"))
    return ranking.port_positions(symbols, ports)


@query(f"SELECT document_id, id, port, round(x,5) AS x, round(y,5) AS y FROM ({_WORLD})")
def port_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where the ports of every symbol lie on its page."""
    return _ports(spark, folder).select("document_id", "id", "port", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH w AS ({_WORLD}), p AS ({POINTS_SQL}), j AS (SELECT w.id, w.ord, w.port, p.id AS node_id, row_number() OVER (PARTITION BY w.id, w.ord ORDER BY (w.x-p.x)*(w.x-p.x)+(w.y-p.y)*(w.y-p.y), p.id) AS k FROM w JOIN p ON w.document_id=p.document_id AND (w.x-p.x)*(w.x-p.x)+(w.y-p.y)*(w.y-p.y)<=900.0),
c AS (SELECT *, lag(port) OVER (PARTITION BY id, node_id ORDER BY ord) AS earlier FROM j WHERE k=1) SELECT id, port, earlier, node_id FROM c WHERE earlier IS NOT NULL""")
def port_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Ports whose nearest node within 30 pixels an earlier port of their symbol has."""
    pairs = spatial.radius_join(_ports(spark, folder), points(spark, folder), 30.0).withColumn("_key", F.struct("l.id", "l.ord"))
    best = spatial.nearest(pairs, "_key", [F.col("d2"), F.col("r.id")])
    attached = best.select(F.col("l.id").alias("id"), F.col("l.ord").alias("ord"), F.col("l.port").alias("port"), F.col("r.id").alias("node_id"))
    return ranking.port_conflicts(attached).select("id", "port", "earlier", "node_id")
