"""Queries of publication, retries and worker rounds, and of what else scenes and traces are checked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composites, markup, records, scene
from ..sources.tables import BOXES_SQL, SEGMENTS_SQL, segments, table
from .records import _J, _jobs, _now
from .registry import query
from .scene import _SCENE_SQL, assembled
from .spatial import _TRACE_SQL, _trace

_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


@query("""WITH e AS (SELECT o_orderkey*2 AS id, [o_custkey, o_orderkey % 97] AS p FROM orders), s AS (SELECT p_partkey AS id, [p_partkey % 53+500, p_partkey % 61] AS p FROM part), x AS (SELECT e.id, min(s.id) AS other FROM (SELECT id, unnest(p) AS k FROM e) e JOIN (SELECT id, unnest(p) AS k FROM s) s USING (k) GROUP BY e.id)
SELECT e.id AS edge_id, coalesce(s.id, x.other) AS segment_id FROM e LEFT JOIN s ON s.id=e.id LEFT JOIN x ON x.id=e.id""")
def segments_of_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The segment of every edge, by its id or a shared primitive."""
    edges = table(spark, folder, "orders").select((F.col("o_orderkey") * 2).alias("id"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 97).alias("primitive_ids"))
    return composites.segments_of_edges(edges, table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") % 53 + 500, F.col("p_partkey") % 61).alias("primitive_ids")))


@query(f"""WITH t AS ({_TRACE_SQL}), n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY k)-1) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM t), f AS (SELECT user_id, k, value FROM n WHERE i % greatest(c//10, 1)=0), d AS (SELECT user_id, k, value, greatest(0.0, least(1.0, (k*60.0+value*20.0)/4000.0)) AS u FROM f)
SELECT user_id, count(*) AS n, round(sqrt(avg((k-60*u)*(k-60*u)+(value-20*u)*(value-20*u))),5) AS rms FROM d GROUP BY user_id""")
def trace_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of about ten samples of each user's trace to one segment."""
    samples = composites.strided(_trace(spark, folder).select("user_id", "k", F.col("k").cast("double").alias("x"), F.col("value").alias("y")), "user_id", "k")
    lines = samples.select("user_id").distinct().select("user_id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 60.0), ("y1", 20.0))])
    return composites.residuals(samples, lines, "user_id").withColumn("rms", F.round("rms", 5))


@query("SELECT vec_id // 64 AS document_id, vec_id AS id, printf('color_%d', row_number() OVER (PARTITION BY vec_id // 64 ORDER BY embedding[1], embedding[2], embedding[3])-1) AS layer FROM embeddings")
def layer_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of colour layers by the order of their centres."""
    e = table(spark, folder, "embeddings")
    colours = e.select(F.expr("vec_id div 64").alias("document_id"), F.col("vec_id").alias("id"), *[F.col("embedding")[k].alias(c) for k, c in enumerate("lab")])
    return composites.layer_names(colours).select("document_id", "id", "layer")


@query(f"""{_SCENE_SQL} SELECT document_id, id, unnest(CASE type WHEN 'junction' THEN ['position'] WHEN 'pipe_segment' THEN ['primitive.start','primitive.end'] WHEN 'symbol' THEN ['position'] WHEN 'annotation' THEN ['anchor'] WHEN 'dimension' THEN ['witness.start','witness.end'] ELSE [] END) AS path FROM o""")
def point_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Where the points of every object stand in it."""
    return scene.point_paths(assembled(spark, folder))


@query(f"""{_SCENE_SQL} SELECT document_id, concat('{{"version":"1.0","objects":', count(*), ',"unresolved":', count(*) FILTER (WHERE type='unknown_mark' OR (type='junction' AND label='unknown')), '}}') AS metadata FROM o GROUP BY document_id""")
def export_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What the exports of every document state."""
    return scene.export_metadata(assembled(spark, folder), "1.0")


@query("""WITH a AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'ball_valve' WHEN 1 THEN 'tee_fitting' ELSE 'flange' END AS symbol_id, CASE WHEN p_size % 10=0 THEN NULL ELSE p_partkey*2 END AS node_id, CASE WHEN p_partkey % 2=0 THEN 'tee' ELSE 'endpoint' END AS kind, p_partkey % 5 AS edges FROM part)
SELECT id, symbol_id, node_id, CASE WHEN symbol_id='tee_fitting' AND kind<>'tee' THEN 'node_kind' WHEN edges<CASE symbol_id WHEN 'tee_fitting' THEN 3 ELSE 1 END THEN 'too_few_edges' ELSE 'too_many_edges' END AS code FROM a WHERE node_id IS NOT NULL AND symbol_id<>'flange' AND ((symbol_id='tee_fitting' AND kind<>'tee') OR edges<CASE symbol_id WHEN 'tee_fitting' THEN 3 ELSE 1 END OR edges>CASE symbol_id WHEN 'tee_fitting' THEN 3 ELSE 2 END)""")
def attachment_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Attached symbols that their library entry doesn't allow there."""
    symbol = F.expr("CASE p_size % 3 WHEN 0 THEN 'ball_valve' WHEN 1 THEN 'tee_fitting' ELSE 'flange' END")
    attached = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), symbol.alias("symbol_id"), F.when(F.col("p_size") % 10 != 0, F.col("p_partkey") * 2).alias("node_id"), F.when(F.col("p_partkey") % 2 == 0, "tee").otherwise("endpoint").alias("kind"), (F.col("p_partkey") % 5).alias("edges"))
    limits = spark.createDataFrame([("ball_valve", None, 1, 2), ("tee_fitting", ["tee"], 3, 3)], "symbol_id string, kinds array<string>, low int, high int")
    return scene.attachment_problems(attached, limits)


@query(f"""WITH r AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag='N') SELECT j.job_id, CASE WHEN r.job_id IS NOT NULL AND s IN ('failed','canceled') THEN 'queued' ELSE s END AS state, CASE WHEN r.job_id IS NOT NULL AND s IN ('failed','canceled') THEN 0 ELSE attempt END AS attempt, CASE WHEN r.job_id IS NOT NULL AND s IN ('failed','canceled') THEN {_NOW} ELSE created_at END AS updated_at FROM (SELECT *, CASE WHEN job_id % 4=0 THEN 'failed' WHEN job_id % 4=1 THEN 'canceled' ELSE state END AS s FROM {_J}) j LEFT JOIN r USING (job_id)""")
def retried_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Ended jobs that were asked to begin anew."""
    ended = F.when(F.col("job_id") % 4 == 0, "failed").when(F.col("job_id") % 4 == 1, "canceled").otherwise(F.col("state"))
    jobs = _jobs(spark, folder).withColumns({"state": ended, "updated_at": F.col("created_at")})
    requests = table(spark, folder, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("job_id"))
    return records.retried(jobs, requests, _now()).select("job_id", "state", "attempt", "updated_at")


@query("""WITH r AS (SELECT o_orderkey AS job_id, lower(o_orderstatus) AS stage, o_orderdate AS a, CASE WHEN o_orderkey % 3>0 THEN o_orderdate + INTERVAL 90 SECOND END AS b, CASE WHEN o_orderkey % 5=0 THEN [o_orderpriority, 'slow'] ELSE [] END AS w FROM orders), l AS (SELECT job_id, a AS t, 'info' AS level, concat(stage, ' started') AS message FROM r UNION ALL SELECT job_id, b, 'info', concat(stage, ' finished') FROM r WHERE b IS NOT NULL UNION ALL SELECT job_id, coalesce(b, a), 'warning', concat(stage, ': ', unnest(w)) FROM r)
SELECT job_id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS at, level, message FROM l""")
def stage_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of the stages of all jobs."""
    start = F.col("o_orderdate").cast("timestamp_ntz")
    warnings = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.col("o_orderpriority"), F.lit("slow"))).otherwise(F.array().cast("array<string>"))
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.lower("o_orderstatus").alias("stage"), start.alias("started_at"), F.when(F.col("o_orderkey") % 3 > 0, start + F.expr("interval 90 seconds")).alias("finished_at"), warnings.alias("warnings"))
    return records.stage_logs(runs)


@query("""WITH i AS (SELECT l_orderkey AS revision_id, l_partkey AS key, CASE WHEN l_partkey % 50=0 THEN 'x' ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS sha256 FROM lineitem), w AS (SELECT p_partkey AS key, sha256(CAST(p_partkey AS VARCHAR)) AS s FROM part WHERE p_size<45) SELECT revision_id, CASE WHEN bool_or(s IS NOT NULL AND s<>sha256) THEN 'damaged' WHEN bool_or(s IS NULL) THEN 'incomplete' ELSE 'published' END AS outcome, count(*) AS artifacts, count(s) AS written FROM i LEFT JOIN w USING (key) GROUP BY revision_id""")
def published_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which publications are complete, by the digests of their artifacts."""
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    intents = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("revision_id"), F.col("l_partkey").alias("key"), F.when(F.col("l_partkey") % 50 == 0, F.lit("x")).otherwise(digest("l_partkey")).alias("sha256"))
    return records.published_revisions(intents, table(spark, folder, "part").where("p_size < 45").select(F.col("p_partkey").alias("key"), digest("p_partkey").alias("sha256")))


@query(f"""WITH j AS (SELECT *, state='running' AND lease_expires_at<{_NOW} AS x FROM {_J}), r AS (SELECT *, CASE WHEN x AND cancel_requested THEN 'canceled' WHEN x AND attempt>=3 THEN 'failed' WHEN x THEN 'queued' ELSE state END AS s FROM j), o AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderpriority<>'5-LOW' ORDER BY o_orderdate, o_orderkey LIMIT 100)
SELECT job_id, CASE WHEN o.job_id IS NOT NULL AND s='queued' THEN 'running' ELSE s END AS state, CASE WHEN o.job_id IS NOT NULL AND s='queued' THEN attempt+1 ELSE attempt END AS attempt, o.job_id IS NOT NULL AS dispatched FROM r LEFT JOIN o USING (job_id)""")
def worker_round(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after one round of a worker: recovered, dispatched and claimed."""
    outbox = table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").cast("timestamp_ntz")).alias("published_at"))
    jobs, after = records.run_once(_jobs(spark, folder), outbox, _now())
    pending = outbox.where("published_at is null").select("event_id")
    sent = after.where("published_at is not null").join(pending, "event_id", "left_semi").select(F.col("event_id").alias("job_id"), F.lit(True).alias("dispatched"))
    return jobs.join(sent, "job_id", "left").select("job_id", "state", "attempt", F.coalesce("dispatched", F.lit(False)).alias("dispatched"))


_SVG = """concat(CASE WHEN id % 9=0 THEN '<!DOCTYPE svg>' ELSE '' END, '<svg width="40" height="30"><g id="a"', CASE WHEN id % 5=0 THEN ' onload="x"' ELSE '' END, '><path d="M', CAST(id % 100 AS {0}), ' ', CAST(id % 37 AS {0}), '"/>', CASE WHEN id % 7=0 THEN '<script>' ELSE '' END, '</g></svg>')"""


@query(f"""WITH d AS (SELECT id FROM ({BOXES_SQL})) SELECT id, 'declaration' AS code, CAST(NULL AS VARCHAR) AS detail FROM d WHERE id % 9=0 UNION ALL SELECT id, 'forbidden_element', 'script' FROM d WHERE id % 7=0 UNION ALL SELECT id, 'forbidden_attribute', 'onload' FROM d WHERE id % 5=0 UNION ALL SELECT id, 'outside_page', CAST(id % 100 AS VARCHAR) FROM d WHERE id % 100>46 UNION ALL SELECT id, 'outside_page', CAST(id % 37 AS VARCHAR) FROM d WHERE id % 37>35.5""")
def trace_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with traces as SVG."""
    traces = segments(spark, folder).select("id", F.expr(_SVG.format("STRING").replace("''", '""')).alias("svg"), F.lit(40.0).alias("width"), F.lit(30.0).alias("height"))
    return markup.trace_problems(traces, "id", "svg")
