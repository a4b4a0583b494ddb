"""Queries of integrity checks: orders stand for edges, parts for nodes and texts, line items for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..sources.tables import POINTS_SQL, SEGMENTS_SQL, points, segments, table
from .registry import ORACLES, query

_EDGES = "SELECT o_orderkey // 2 * (CASE WHEN o_orderkey % 50=1 THEN 2 ELSE 1 END) + (CASE WHEN o_orderkey % 50=1 THEN 0 ELSE o_orderkey % 2 * 1000000000 END) AS id, o_custkey AS start_node, o_orderkey % 1600 AS end_node FROM orders"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.expr("o_orderkey div 2 * (CASE WHEN o_orderkey % 50 = 1 THEN 2 ELSE 1 END) + (CASE WHEN o_orderkey % 50 = 1 THEN 0 ELSE o_orderkey % 2 * 1000000000 END)").alias("id"), F.col("o_custkey").alias("start_node"), (F.col("o_orderkey") % 1600).alias("end_node")
    )


@query(f"""WITH n AS (SELECT c_custkey AS id FROM customer), e AS ({_EDGES}), h AS (SELECT l_orderkey AS id, l_linenumber AS alternative_id, l_partkey AS node, l_orderkey AS edge, CASE WHEN l_orderkey % 4=0 THEN 3 END AS recommended FROM lineitem)
SELECT CAST(id AS VARCHAR) AS owner, 'duplicate_edge' AS code, CAST(count(*) AS VARCHAR) AS detail FROM e GROUP BY id HAVING count(*)>1 UNION ALL SELECT CAST(id AS VARCHAR), 'missing_start_node', CAST(start_node AS VARCHAR) FROM e WHERE start_node NOT IN (SELECT id FROM n) UNION ALL SELECT CAST(id AS VARCHAR), 'missing_end_node', CAST(end_node AS VARCHAR) FROM e WHERE end_node NOT IN (SELECT id FROM n)
UNION ALL SELECT CAST(id AS VARCHAR), 'self_loop', CAST(start_node AS VARCHAR) FROM e WHERE start_node=end_node UNION ALL SELECT CAST(id AS VARCHAR), 'missing_node_of_alternative', CAST(node AS VARCHAR) FROM h WHERE node NOT IN (SELECT id FROM n) UNION ALL SELECT CAST(id AS VARCHAR), 'missing_edge_of_alternative', CAST(edge AS VARCHAR) FROM h WHERE edge NOT IN (SELECT id FROM e)
UNION ALL SELECT DISTINCT CAST(id AS VARCHAR), 'unknown_recommendation', '3' FROM h WHERE recommended IS NOT NULL AND id NOT IN (SELECT id FROM h WHERE alternative_id=3)""")
def topology_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a graph and the hypotheses on it."""
    nodes = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    hypotheses = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("alternative_id"), F.array("l_partkey").alias("node_ids"), F.array("l_orderkey").alias("edge_ids"), F.when(F.col("l_orderkey") % 4 == 0, F.lit(3)).alias("recommended"))
    return integrity.topology_problems(nodes, _edges(spark, folder), hypotheses)


@query(f"""WITH f AS ({ORACLES["topology_problems"]}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY owner, detail) AS n FROM f) SELECT code, count(*) AS problems, string_agg(CASE WHEN n<=5 THEN concat_ws(' ', code, owner, detail) END, '; ' ORDER BY n) AS message FROM r GROUP BY code""")
def problem_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The first five problems of each kind in one line."""
    found = topology_problems(spark, folder)
    return integrity.first_problems(found, "code", 5)


@query("""WITH c AS (SELECT p_partkey // 2 AS id, p_partkey AS region_id, CASE WHEN p_size % 3=0 THEN 'unknown' ELSE 'proposed' END AS status, CASE WHEN p_size % 10=1 THEN ' ' ELSE p_type END AS label FROM part), g AS (SELECT c_custkey AS id FROM customer), l AS (SELECT DISTINCT p_type AS label FROM part WHERE p_size>48)
SELECT CAST(id AS VARCHAR) AS owner, 'duplicate_candidate' AS code, CAST(count(*) AS VARCHAR) AS detail FROM c GROUP BY id HAVING count(*)>1 UNION ALL SELECT CAST(id AS VARCHAR), 'missing_region', CAST(region_id AS VARCHAR) FROM c WHERE region_id NOT IN (SELECT id FROM g)
UNION ALL SELECT CAST(id AS VARCHAR), 'blank_proposal', status FROM c WHERE status='proposed' AND trim(label)='' UNION ALL SELECT CAST(id AS VARCHAR), 'unknown_label', label FROM c WHERE label NOT IN (SELECT label FROM l)""")
def candidate_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with candidates of texts and symbols."""
    p = table(spark, folder, "part")
    candidates = p.select(F.expr("p_partkey div 2").alias("id"), F.col("p_partkey").alias("region_id"), F.when(F.col("p_size") % 3 == 0, "unknown").otherwise("proposed").alias("status"), F.when(F.col("p_size") % 10 == 1, F.lit(" ")).otherwise(F.col("p_type")).alias("label"))
    library = p.where("p_size > 48").select(F.col("p_type").alias("label")).distinct()
    return integrity.candidate_problems(candidates, table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), library)


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey+600 AS text_id, CASE WHEN o_orderstatus='P' THEN 'proposed' ELSE 'unresolved' END AS status FROM orders WHERE o_orderkey % 2=0), a AS (SELECT o_orderkey AS id, o_custkey+600 AS text_id, CASE WHEN o_orderstatus='P' THEN 'proposed' ELSE 'unresolved' END AS status FROM orders WHERE o_orderkey % 2=1),
t AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag='R' THEN 'topology_edge' ELSE 'topology_node' END AS ref_kind, l_suppkey*2 AS ref_id FROM lineitem WHERE l_linenumber<=2), x AS (SELECT c_custkey AS id FROM customer), k AS (SELECT 'topology_edge' AS ref_kind, s_suppkey AS ref_id FROM supplier UNION ALL SELECT 'topology_node', c_custkey FROM customer WHERE c_custkey % 3<>0),
r AS (SELECT l_orderkey*10+l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'measures' WHEN 1 THEN 'annotates' ELSE 'callout_targets' END AS type, l_partkey AS from_id, CASE WHEN l_returnflag='R' THEN 'topology_edge' ELSE 'topology_node' END AS ref_kind, l_suppkey AS ref_id, CASE WHEN l_linestatus='O' THEN 'proposed' ELSE 'unresolved' END AS interpretation, CAST(l_tax*100 AS INTEGER) AS evidence FROM lineitem),
v AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'dimension' WHEN 1 THEN 'annotation' ELSE 'text' END AS kind, p_partkey*3 AS ref FROM part),
f AS (SELECT id AS owner, 'dimension_without_text' AS code FROM d WHERE text_id NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'annotation_without_text' FROM a WHERE text_id NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'dimension_without_target' FROM d WHERE status='proposed' AND id NOT IN (SELECT id FROM t) UNION ALL SELECT id, 'annotation_without_target' FROM a WHERE status='proposed' AND id NOT IN (SELECT id FROM t)
UNION ALL SELECT t.id, CASE WHEN t.id % 2=0 THEN 'dimension_missing_target' ELSE 'annotation_missing_target' END FROM t JOIN orders ON o_orderkey=t.id LEFT JOIN k USING (ref_kind, ref_id) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ref_kind=t.ref_kind AND k.ref_id=t.ref_id)
UNION ALL SELECT id, 'relationship_without_source' FROM r WHERE (type='measures' AND from_id NOT IN (SELECT id FROM d)) OR (type<>'measures' AND from_id NOT IN (SELECT id FROM a)) UNION ALL SELECT id, 'measures_no_edge' FROM r WHERE type='measures' AND ref_kind<>'topology_edge' UNION ALL SELECT id, 'relationship_missing_target' FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ref_kind=r.ref_kind AND k.ref_id=r.ref_id)
UNION ALL SELECT id, 'relationship_without_evidence' FROM r WHERE interpretation='proposed' AND evidence=0 UNION ALL SELECT id, 'review_of_nothing' FROM v WHERE (kind='dimension' AND ref NOT IN (SELECT id FROM d)) OR (kind='annotation' AND ref NOT IN (SELECT id FROM a)) OR (kind='text' AND ref NOT IN (SELECT id FROM x)))
SELECT code, count(*) AS n, min(owner) AS first, max(owner) AS last FROM f GROUP BY code""")
def association_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with dimensions, annotations, relationships and review items, by kind of problem."""
    o, l = table(spark, folder, "orders"), table(spark, folder, "lineitem")  # noqa: E741
    kind = F.when(F.col("l_returnflag") == "R", "topology_edge").otherwise("topology_node")
    targets = l.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(kind.alias("ref_kind"), (F.col("l_suppkey") * 2).alias("ref_id"))).alias("targets"))
    both = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 600).alias("text_id"), F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("unresolved").alias("status")).join(targets, "id", "left")
    both = both.withColumn("targets", F.coalesce("targets", F.array().cast("array<struct<ref_kind:string,ref_id:bigint>>")))
    texts = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    known = table(spark, folder, "supplier").select(F.lit("topology_edge").alias("ref_kind"), F.col("s_suppkey").alias("ref_id")).union(texts.where("id % 3 <> 0").select(F.lit("topology_node"), "id"))
    type_ = F.when(F.col("l_linenumber") % 3 == 0, "measures").when(F.col("l_linenumber") % 3 == 1, "annotates").otherwise("callout_targets")
    relationships = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), type_.alias("type"), F.col("l_partkey").alias("from_id"), kind.alias("ref_kind"), F.col("l_suppkey").alias("ref_id"), F.when(F.col("l_linestatus") == "O", "proposed").otherwise("unresolved").alias("interpretation"), F.round(F.col("l_tax") * 100).cast("int").alias("evidence"))
    reviews = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE p_size % 3 WHEN 0 THEN 'dimension' WHEN 1 THEN 'annotation' ELSE 'text' END").alias("kind"), (F.col("p_partkey") * 3).alias("ref"))
    found = integrity.association_problems(both.where("id % 2 = 0"), both.where("id % 2 = 1"), relationships, reviews, texts, known)
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min(F.col("owner").cast("long")).alias("first"), F.max(F.col("owner").cast("long")).alias("last"))


_STATE = "CASE WHEN id % 6=0 THEN 'rejected' WHEN id % 6=1 THEN 'confirmed' ELSE 'machine' END"


@query(f"""WITH j AS (SELECT id, {_STATE} AS state FROM ({POINTS_SQL})), s AS (SELECT id, {_STATE} AS state FROM ({SEGMENTS_SQL})), i AS (SELECT id AS owner, id AS node_id, state FROM s UNION ALL SELECT id, id+1, state FROM s), g AS (SELECT node_id, count(*) AS degree FROM i WHERE state<>'rejected' GROUP BY node_id)
SELECT j.id, j.state, coalesce(degree,0) AS degree, (SELECT count(*) FROM i JOIN j q ON q.id=i.node_id AND q.state='rejected' WHERE i.owner=j.id) AS rejected_ends FROM j LEFT JOIN g ON g.node_id=j.id WHERE j.state<>'rejected'""")
def live_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Live junctions with the pipes at each, and how many ends of the pipe of the same number hang on a rejected one."""
    junctions = points(spark, folder).select("id", F.expr(_STATE).alias("state"))
    s = segments(spark, folder).select("id", F.expr(_STATE).alias("state"))
    incidences = s.select(F.col("id").alias("owner"), F.explode(F.array("id", F.col("id") + 1)).alias("node_id"), "state")
    attached = integrity.rejected_attachments(incidences, junctions).groupBy(F.col("owner").cast("long").alias("id")).agg(F.count("*").alias("rejected_ends"))
    return integrity.live_with_degrees(junctions, incidences).join(attached, "id", "left").fillna(0, ["rejected_ends"])


_DRAWN = f"SELECT document_id AS page, id AS place, concat(CASE id % 4 WHEN 0 THEN 'pipe-' WHEN 1 THEN 'dot-' WHEN 2 THEN 'x-' ELSE 'text-' END, CAST(id // 3 AS VARCHAR)) AS id, CAST(CASE WHEN id % 5=0 THEN id ELSE id // 3 END AS VARCHAR) AS object_id FROM ({POINTS_SQL})"


def _drawn(spark: SparkSession, folder: str) -> DataFrame:
    prefix = F.expr("CASE id % 4 WHEN 0 THEN 'pipe-' WHEN 1 THEN 'dot-' WHEN 2 THEN 'x-' ELSE 'text-' END")
    third = F.expr("id div 3")
    return points(spark, folder).select(F.col("document_id").alias("page"), F.col("id").alias("place"), F.concat(prefix, third.cast("string")).alias("id"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(third).cast("string").alias("object_id"))


@query(f"""WITH d AS ({_DRAWN}), n AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY place) AS k, regexp_extract(id, '^([a-z]+-)', 1) AS prefix FROM d)
SELECT page, place, id, CASE WHEN k>1 THEN 'repeated' WHEN prefix NOT IN ('pipe-','dot-','text-') THEN 'unknown_prefix' ELSE 'other_object' END AS code FROM n WHERE k>1 OR prefix NOT IN ('pipe-','dot-','text-') OR id<>concat(prefix, object_id)""")
def drawn_id_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of drawn elements that repeat, have an unknown prefix, or name another object."""
    return integrity.id_problems(_drawn(spark, folder), ("pipe-", "dot-", "text-"))


@query(f"""WITH d AS (SELECT page, id, count(*) AS n FROM ({_DRAWN}) GROUP BY page, id), e AS (SELECT DISTINCT document_id AS page, concat('pipe-', CAST(id // 2 AS VARCHAR)) AS id FROM ({SEGMENTS_SQL}))
SELECT coalesce(e.page, d.page) AS page, coalesce(e.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'not_drawn' WHEN e.id IS NULL THEN 'not_in_scene' ELSE 'drawn_twice' END AS code FROM e FULL JOIN d ON e.page=d.page AND e.id=d.id WHERE d.id IS NULL OR e.id IS NULL OR n>1""")
def drawn_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between what a scene holds and what is drawn."""
    expected = segments(spark, folder).select(F.col("document_id").alias("page"), F.concat(F.lit("pipe-"), F.expr("id div 2").cast("string")).alias("id"))
    return integrity.drawn_differences(expected, _drawn(spark, folder).select("page", "id"))


@query(f"""SELECT document_id AS page, id AS owner, axis, round(value,6) AS value FROM (SELECT document_id, id, unnest(['x','y']) AS axis, unnest([x,y]) AS value FROM ({POINTS_SQL})) WHERE value<-4.0 OR value>CASE axis WHEN 'x' THEN 40.0+document_id ELSE 30.0 END+4.0""")
def coordinates_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates outside the views of their pages."""
    p = points(spark, folder)
    values = p.select(F.col("document_id").alias("page"), F.col("id").alias("owner"), F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in ("x", "y")])).alias("v")).select("page", "owner", "v.*")
    views = p.select(F.col("document_id").alias("page")).distinct().select("page", (F.lit(40.0) + F.col("page")).alias("width"), F.lit(30.0).alias("height"))
    return integrity.outside_view(values, views, 4.0).withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey AS page, concat('0 0 ', CAST(p_size AS VARCHAR), ' ', CAST(p_size % 7 + 1 AS VARCHAR)) AS view_box, concat('0 0 ', CAST(p_size AS VARCHAR), ' ', CAST(p_size % 5 + 1 AS VARCHAR)) AS expected FROM part WHERE p_size % 7<>p_size % 5""")
def view_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose view box isn't their size."""
    p = table(spark, folder, "part")
    box = F.concat_ws(" ", F.lit("0"), F.lit("0"), F.col("p_size").cast("string"), (F.col("p_size") % 7 + 1).cast("string"))
    return integrity.view_mismatches(p.select(F.col("p_partkey").alias("page"), box.alias("view_box")), p.select(F.col("p_partkey").alias("page"), F.col("p_size").alias("width"), (F.col("p_size") % 5 + 1).alias("height")))


@query(f"""WITH p AS ({POINTS_SQL}), l AS (SELECT a.id, CASE WHEN a.id % 2=0 THEN a.x ELSE b.x END AS x0, CASE WHEN a.id % 2=0 THEN a.y ELSE b.y END AS y0, CASE WHEN a.id % 2=0 THEN b.x ELSE a.x END + CASE WHEN a.id % 9=0 THEN 0.5 ELSE 0.0 END AS x1, CASE WHEN a.id % 2=0 THEN b.y ELSE a.y END AS y1, a.x AS sx, a.y AS sy FROM p a JOIN p b ON b.id=a.id+1)
SELECT id, round(sqrt((x0-sx)*(x0-sx)+(y0-sy)*(y0-sy)),6) AS off FROM l WHERE id % 9=0""")
def pipe_line_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn lines that don't end at the junctions of their pipes, whichever way they run."""
    p = points(spark, folder).select("id", "x", "y")
    met = p.alias("a").join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    even = F.col("id") % 2 == 0
    lines = met.select("id", F.when(even, F.col("x")).otherwise(F.col("bx")).alias("x0"), F.when(even, F.col("y")).otherwise(F.col("by")).alias("y0"), (F.when(even, F.col("bx")).otherwise(F.col("x")) + F.when(F.col("id") % 9 == 0, 0.5).otherwise(0.0)).alias("x1"), F.when(even, F.col("by")).otherwise(F.col("y")).alias("y1"))
    return integrity.pipe_line_mismatches(lines, p.select("id", F.col("id").alias("start_node"), (F.col("id") + 1).alias("end_node")), p)
