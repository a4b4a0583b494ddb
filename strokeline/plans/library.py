"""Queries of libraries, manifests, artifact stores, and pages through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scene
from ..sources import library
from ..sources.tables import table
from . import composites, scene as scenes
from .registry import ORACLES, query


def _libraries(spark: SparkSession, folder: str) -> DataFrame:
    """A library for each supplier: its symbols are the parts of its number and of the two after it."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("library"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    port = F.concat(F.lit('{"name":"a","x":'), F.col("p_size").cast("string"), F.lit(',"y":0,"required":true}'), F.when(F.col("p_size") % 5 == 0, F.lit(',{"name":"a","x":1,"y":1}')).otherwise(F.lit("")), F.when(F.col("p_size") % 5 == 1, F.lit(',{"name":"b","x":1,"y":1,"z":2}')).otherwise(F.lit("")))
    entry = F.concat(F.lit('{"id":"s'), F.expr("id div 2").cast("string"), F.lit('","label":"'), "p_name", F.lit('","ports":['), port, F.lit("]"), F.when(F.col("p_size") % 7 == 0, F.lit(',"colour":1')).otherwise(F.lit("")), F.lit("}"))
    met = s.withColumn("id", F.explode(F.sequence(F.col("k"), F.col("k") + 2))).join(parts, "id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), ",")
    made = met.groupBy("library", "k").agg(body.alias("body"))
    text = F.concat(F.lit('{"version":"'), F.when(F.col("k") % 4 == 0, F.lit("0.9.0")).otherwise(F.lit("1.1.0")), F.lit('","units":"px","symbols":['), "body", F.lit("]"), F.when(F.col("k") % 6 == 0, F.lit(',"author":"x"')).otherwise(F.lit("")), F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(F.lit("}")))
    return made.select("library", text.alias("content"))


_ENTRIES = "m AS (SELECT s_name AS library, s_suppkey AS k, p_partkey AS id, p_name, p_size, concat('s', p_partkey // 2) AS symbol_id FROM supplier JOIN part ON p_partkey BETWEEN s_suppkey AND s_suppkey+2)"


@query(f"""WITH {_ENTRIES}, f AS (SELECT *, row_number() OVER (PARTITION BY library, symbol_id ORDER BY id) AS n FROM m WHERE k % 9<>0) SELECT library, CASE WHEN k % 4=0 THEN '0.9.0' ELSE '1.1.0' END AS version, symbol_id, p_name AS label, CASE WHEN p_size % 5 IN (0,1) THEN 2 ELSE 1 END AS ports FROM f WHERE n=1""")
def library_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols of all libraries that can be read."""
    made = library.symbols(_libraries(spark, folder))
    return made.where("symbol_id is not null and version is not null").select("library", "version", "symbol_id", "label", F.size("ports").alias("ports")).join(_broken(spark, folder), "library", "left_anti")


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    return _libraries(spark, folder).where(F.json_object_keys("content").isNull()).select("library")


@query(f"""WITH {_ENTRIES}, g AS (SELECT * FROM m WHERE k % 9<>0) SELECT DISTINCT library, 'not_json' AS code, CAST(NULL AS VARCHAR) AS detail FROM m WHERE k % 9=0 UNION ALL SELECT DISTINCT library, 'other_version', '0.9.0' FROM g WHERE k % 4=0 UNION ALL SELECT DISTINCT library, 'unknown_key', 'author' FROM g WHERE k % 6=0
UNION ALL SELECT library, 'unknown_symbol_key', 'colour' FROM g WHERE p_size % 7=0 UNION ALL SELECT library, 'unknown_port_key', 'z' FROM g WHERE p_size % 5=1 UNION ALL SELECT library, 'repeated_symbol', symbol_id FROM g GROUP BY library, symbol_id HAVING count(*)>1
UNION ALL SELECT library, 'repeated_port', concat(symbol_id, '.', port) FROM (SELECT library, symbol_id, unnest(CASE WHEN p_size % 5=0 THEN ['a','a'] WHEN p_size % 5=1 THEN ['a','b'] ELSE ['a'] END) AS port FROM g) GROUP BY library, symbol_id, port HAVING count(*)>1""")
def library_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the libraries."""
    return library.library_problems(_libraries(spark, folder), "1.1.0")


@query("""WITH a AS (SELECT l_orderkey AS job_id, concat('stage_', l_linenumber) AS stage, min(concat('jobs/', l_orderkey, '/', l_partkey)) AS key FROM lineitem GROUP BY 1, 2), m AS (SELECT job_id, string_agg(concat('"', stage, '":{"key":"', key, '","sha256":"', sha256(key), '"}'), ',' ORDER BY stage) AS body FROM a GROUP BY job_id)
SELECT job_id, sha256(concat('{"stages":{', body, '},"version":"1.0"}')) AS digest FROM m""")
def stage_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the manifest of every job."""
    key = F.min(F.concat_ws("/", F.lit("jobs"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")))
    a = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage")).agg(key.alias("key"))
    made = library.manifests(a.withColumn("sha256", F.sha2("key", 256)))
    return made.select("job_id", F.sha2("manifest", 256).alias("digest"))


@query("""WITH w AS (SELECT o_orderkey AS job_id, o_orderstatus AS kind, o_custkey AS key FROM orders), s AS (SELECT p_partkey AS key, p_name AS content FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)) SELECT job_id, kind, w.key, content, content IS NULL AND kind<>'O' AS missing FROM w LEFT JOIN s USING (key)""")
def loaded_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts that jobs ask for, from a store from which some were deleted; those of one kind may be missing."""
    store = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    wanted = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("key"))
    deleted = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"))
    return library.loaded(wanted, library.kept(store, deleted), ("O",)).select("job_id", "kind", "key", "content", "missing")


@query("SELECT p_partkey AS key, coalesce(s_name, CASE WHEN c_custkey IS NOT NULL THEN c_name END) AS content, CASE WHEN s_name IS NOT NULL THEN 'cache' WHEN c_name IS NOT NULL THEN 'built' END AS source FROM part LEFT JOIN supplier ON s_suppkey=p_partkey LEFT JOIN customer ON c_custkey=p_partkey")
def cached_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts from a cache, or built where it lacks them."""
    cache = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("content"))
    built = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("content"))
    return library.read_or_build(table(spark, folder, "part").select(F.col("p_partkey").alias("key")), cache, built)


@query(f"""WITH s AS (SELECT document_id, count(*) AS segments, count(*) FILTER (WHERE reason='snapped_to_axis') AS snapped, sum(adjusted) AS adjusted FROM ({ORACLES["snap_stage"]}) GROUP BY document_id), o AS ({ORACLES["scene_counts"]}), r AS (SELECT document_id, count(*) AS reviews, count(*) FILTER (WHERE severity IN ('critical','high')) AS blocking FROM ({ORACLES["planned_reviews"]}) GROUP BY document_id)
SELECT document_id, segments, snapped, CAST(adjusted AS BIGINT) AS adjusted, objects, relationships, reviews, blocking, CASE WHEN blocking>0 THEN 'partial' ELSE 'succeeded' END AS status FROM s JOIN o USING (document_id) JOIN r USING (document_id)""")
def processed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through snapping, assembly and review planning, with the counts of each stage and its state."""
    snapped = composites.snap_stage(spark, folder).groupBy("document_id").agg(F.count("*").alias("segments"), F.count_if(F.col("reason") == "snapped_to_axis").alias("snapped"), F.sum("adjusted").alias("adjusted"))
    counted = scene.counts(scenes.assembled(spark, folder)).select("document_id", "objects", "relationships")
    reviews = scenes.planned_reviews(spark, folder).groupBy("document_id").agg(F.count("*").alias("reviews"), F.count_if(F.col("severity").isin("critical", "high")).alias("blocking"))
    made = snapped.join(counted, "document_id").join(reviews, "document_id")
    return made.withColumn("status", F.when(F.col("blocking") > 0, "partial").otherwise("succeeded"))
