"""Queries of scene validation: the assembled scenes with faults that digits of their ids put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import validation
from ..sources.shared import stored
from .drawings import _DIGIT, LIBRARY, _digit
from .edits import _FULL
from .registry import query
from .scene import assembled

TOLERANCE = 0.5


def damaged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What `validation.scene_issues` takes: unknown layers, wrong and missing nodes, moved ends, other ports and symbols, no evidence, other targets and sources, and repeated ids."""
    found = stored(assembled(spark, folder), "damaged-scene")
    own = Window.partitionBy("document_id").orderBy("id")
    lost, is_ = F.lit("nowhere"), lambda kind: F.col("type") == kind
    things = found.where("type <> 'relationship'").withColumn("n", F.row_number().over(own) - 1)
    listed = F.when(F.col("target_id").isNotNull(), F.array("target_id")).otherwise(F.array().cast("array<string>"))
    objects = things.select(
        "document_id", "n", "id", "type", F.lit("machine").alias("state"), F.when(_digit(10) == 0, 0).otherwise(1).alias("evidence"), F.when(_digit(4) == 0, lost).otherwise(F.col("layer")).alias("layer"),
        F.when(_digit(8) == 0, "valve_x").otherwise(F.col("label")).alias("symbol_id"), F.when(_digit(5) == 1, F.col("id")).when(_digit(5) == 2, lost).otherwise(F.col("start_id")).alias("start_id"),
        F.when(_digit(5) == 0, F.col("start_id")).otherwise(F.col("end_id")).alias("end_id"), F.when(is_("dimension") & (_digit(11) == 0), F.concat(listed, F.array(lost))).otherwise(listed).alias("targets"),
        (F.col("x") + F.when(is_("pipe_segment") & (_digit(6) < 2), 1.0).otherwise(0.0)).alias("x"), "y", "x1", "y1",
    )
    again = objects.where(_digit(13) == 0).withColumn("n", F.col("n") + 1_000_000)
    objects = stored(objects.union(again), "damaged-objects")
    symbols = objects.where(is_("symbol"))
    name = F.when(_digit(6) == 0, "inlet").otherwise("in")
    ports = symbols.select("document_id", "n", F.explode(F.map_from_arrays(F.array(name, F.lit("out")), F.array(F.when(_digit(7) == 0, F.col("id")), F.lit(None).cast("string")))).alias("port", "node_id"))
    links = found.where("type = 'relationship'").withColumn("n", F.row_number().over(own) - 1)
    kind = F.when(_digit(12) == 0, F.when(F.col("label") == "measures", "annotates").otherwise("measures")).when(F.col("label") == "annotates", "callout_targets").otherwise(F.col("label"))
    relationships = links.select(
        "document_id", "n", "id", kind.alias("type"), F.lit("machine").alias("state"), F.when(_digit(10) == 0, 0).otherwise(1).alias("evidence"),
        F.when(_digit(12) == 1, F.col("end_id")).otherwise(F.col("start_id")).alias("from_id"), F.when(_digit(12) == 2, lost).otherwise(F.col("end_id")).alias("to_id"),
    )
    layers = found.select("document_id", F.col("layer").alias("id")).distinct().withColumn("n", F.row_number().over(own) - 1).select("document_id", "n", "id")
    library = spark.createDataFrame([(s, sorted(ports), ["in"]) for s, (ports, _) in LIBRARY.items()], "symbol_id string, ports array<string>, required array<string>")
    return {"layers": layers, "objects": objects, "ports": ports, "relationships": relationships, "library": library}


_D = {k: _DIGIT.format(k) for k in range(1, 14)}
_DAMAGED = f"""{_FULL}, th AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id)-1 AS n FROM o WHERE type<>'relationship'),
ob1 AS (SELECT document_id, n, id, type, CASE WHEN {_D[10]}=0 THEN 0 ELSE 1 END AS evidence, CASE WHEN {_D[4]}=0 THEN 'nowhere' ELSE layer END AS layer, CASE WHEN {_D[8]}=0 THEN 'valve_x' ELSE label END AS symbol_id,
  CASE {_D[5]} WHEN 1 THEN id WHEN 2 THEN 'nowhere' ELSE start_id END AS start_id, CASE {_D[5]} WHEN 0 THEN start_id ELSE end_id END AS end_id, target_id, type='dimension' AND {_D[11]}=0 AS more, x+CASE WHEN type='pipe_segment' AND {_D[6]}<2 THEN 1 ELSE 0 END AS x, y, x1, y1 FROM th),
ob AS (SELECT * FROM ob1 UNION ALL SELECT * REPLACE (n+1000000 AS n) FROM ob1 WHERE {_D[13]}=0),
po AS (SELECT document_id, n, id, symbol_id, CASE WHEN {_D[6]}=0 THEN 'inlet' ELSE 'in' END AS port, CASE WHEN {_D[7]}=0 THEN id END AS node_id FROM ob WHERE type='symbol' UNION ALL SELECT document_id, n, id, symbol_id, 'out', NULL FROM ob WHERE type='symbol'),
re AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY id)-1 AS n, id, CASE WHEN {_D[12]}=0 THEN CASE label WHEN 'measures' THEN 'annotates' ELSE 'measures' END WHEN label='annotates' THEN 'callout_targets' ELSE label END AS type, CASE WHEN {_D[10]}=0 THEN 0 ELSE 1 END AS evidence,
  CASE WHEN {_D[12]}=1 THEN end_id ELSE start_id END AS from_id, CASE WHEN {_D[12]}=2 THEN 'nowhere' ELSE end_id END AS to_id FROM o WHERE type='relationship'),
la AS (SELECT DISTINCT document_id, layer AS id FROM o), ta AS (SELECT document_id, n, id, type, 0 AS j, target_id AS ref FROM ob WHERE target_id IS NOT NULL UNION ALL SELECT document_id, n, id, type, CASE WHEN target_id IS NULL THEN 0 ELSE 1 END, 'nowhere' FROM ob WHERE more),
ix AS (SELECT document_id, id, 'layer' AS kind, 'layer' AS own, NULL AS x, NULL AS y FROM la UNION ALL SELECT document_id, id, 'object', type, x, y FROM ob WHERE n<1000000 UNION ALL SELECT document_id, id, 'relationship', 'relationship', NULL, NULL FROM re),
rf AS (SELECT document_id, id AS owner, concat('objects[', n, '].layerId') AS path, layer AS ref, 'layer' AS expected FROM ob UNION ALL SELECT document_id, id, concat('objects[', n, '].startNodeId'), start_id, 'junction' FROM ob WHERE type='pipe_segment' UNION ALL SELECT document_id, id, concat('objects[', n, '].endNodeId'), end_id, 'junction' FROM ob WHERE type='pipe_segment'
  UNION ALL SELECT document_id, id, concat('objects[', n, '].portNodeIds["', port, '"]'), node_id, 'junction' FROM po WHERE node_id IS NOT NULL UNION ALL SELECT document_id, id, concat('objects[', n, CASE type WHEN 'annotation' THEN '].targetObjectId' ELSE concat('].targetObjectIds[', j, ']') END), ref, 'object' FROM ta WHERE type IN ('annotation','dimension')),
pp AS (SELECT a.*, sqrt((a.x-a.x1)*(a.x-a.x1)+(a.y-a.y1)*(a.y-a.y1)) AS len, sqrt((a.x-s.x)*(a.x-s.x)+(a.y-s.y)*(a.y-s.y)) AS gap0, sqrt((a.x1-e.x)*(a.x1-e.x)+(a.y1-e.y)*(a.y1-e.y)) AS gap1 FROM ob a LEFT JOIN ix s ON s.document_id=a.document_id AND s.id=a.start_id AND s.own='junction' LEFT JOIN ix e ON e.document_id=a.document_id AND e.id=a.end_id AND e.own='junction' WHERE a.type='pipe_segment'),
rr AS (SELECT re.*, s.kind AS sk, s.own AS st, t.kind AS tk, t.own AS tt, coalesce(s.own IN ('pipe_segment','junction','symbol') AND t.own IN ('pipe_segment','junction','symbol'), false) AS said FROM re LEFT JOIN ix s ON s.document_id=re.document_id AND s.id=from_id LEFT JOIN ix t ON t.document_id=re.document_id AND t.id=to_id),
me AS (SELECT * FROM rr WHERE type='measures' AND NOT said AND st='dimension' AND tk='object'),
iss AS (SELECT document_id, 0 AS step, 'DUPLICATE_ID' AS code, concat('objects[', n, '].id') AS path, id AS owner FROM ob WHERE n>=1000000
UNION ALL SELECT rf.document_id, 1, CASE WHEN kind IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'WRONG_REFERENCE_TYPE' END, path, owner FROM rf LEFT JOIN ix ON ix.document_id=rf.document_id AND ix.id=ref WHERE kind IS NULL OR NOT CASE expected WHEN 'junction' THEN own='junction' ELSE kind=expected END
UNION ALL SELECT document_id, 2, 'PIPE_DEGENERATE', concat('objects[', n, '].', CASE WHEN start_id=end_id THEN 'endNodeId' ELSE 'primitive' END), id FROM pp WHERE start_id=end_id OR len<=0.5
UNION ALL SELECT document_id, 2, 'PIPE_ENDPOINT_MISMATCH', concat('objects[', n, '].primitive.start'), id FROM pp WHERE gap0>0.5 UNION ALL SELECT document_id, 2, 'PIPE_ENDPOINT_MISMATCH', concat('objects[', n, '].primitive.end'), id FROM pp WHERE gap1>0.5
UNION ALL SELECT document_id, 3, 'UNKNOWN_REFERENCE', concat('objects[', n, '].symbolId'), id FROM ob WHERE type='symbol' AND symbol_id NOT IN ('ball_valve','flange','riser')
UNION ALL SELECT document_id, 3, 'SYMBOL_PORT_UNKNOWN_NAME', concat('objects[', n, '].portNodeIds["inlet"](key)'), id FROM po WHERE port='inlet' AND symbol_id IN ('ball_valve','flange','riser')
UNION ALL SELECT document_id, 3, 'SYMBOL_REQUIRED_PORT_MISSING', concat('objects[', n, '].portNodeIds'), id FROM po WHERE port='inlet' AND symbol_id IN ('ball_valve','flange','riser')
UNION ALL SELECT document_id, 4, 'MACHINE_EVIDENCE_MISSING', concat('objects[', n, '].interpretation.evidence'), id FROM ob WHERE evidence=0 UNION ALL SELECT document_id, 4, 'MACHINE_EVIDENCE_MISSING', concat('relationships[', n, '].interpretation.evidence'), id FROM re WHERE evidence=0
UNION ALL SELECT document_id, 5, CASE WHEN sk IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'WRONG_REFERENCE_TYPE' END, concat('relationships[', n, '].fromId'), id FROM rr WHERE sk IS DISTINCT FROM 'object' UNION ALL SELECT document_id, 5, CASE WHEN tk IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'WRONG_REFERENCE_TYPE' END, concat('relationships[', n, '].toId'), id FROM rr WHERE tk IS DISTINCT FROM 'object'
UNION ALL SELECT document_id, 5, 'RELATIONSHIP_CONNECTIVITY_FORBIDDEN', concat('relationships[', n, ']'), id FROM rr WHERE said UNION ALL SELECT document_id, 5, 'RELATIONSHIP_INVALID_ENDPOINTS', concat('relationships[', n, '].fromId'), id FROM rr WHERE NOT said AND sk='object' AND st<>CASE type WHEN 'measures' THEN 'dimension' ELSE 'annotation' END
UNION ALL SELECT document_id, 5, 'DIMENSION_TARGET_MISMATCH', concat('relationships[', n, '].toId'), id FROM me WHERE NOT EXISTS (SELECT 1 FROM ta WHERE ta.document_id=me.document_id AND ta.id=me.from_id AND ta.ref=me.to_id AND ta.n<1000000)
UNION ALL SELECT document_id, 5, 'DIMENSION_TARGET_MISMATCH', concat('objects[', n, '].targetObjectIds[', j, ']'), id FROM ta WHERE type='dimension' AND EXISTS (SELECT 1 FROM ix WHERE ix.document_id=ta.document_id AND ix.id=ta.ref AND ix.kind='object') AND NOT EXISTS (SELECT 1 FROM me WHERE me.document_id=ta.document_id AND me.from_id=ta.id AND me.to_id=ta.ref))"""


@query(f"{_DAMAGED} SELECT document_id, CAST(step AS INTEGER) AS step, code, path, owner FROM iss")
def scene_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that is wrong with damaged scenes, by all rules."""
    return validation.scene_issues(**damaged(spark, folder), tolerance=TOLERANCE)


@query(f"{_DAMAGED} SELECT code, CAST(step AS INTEGER) AS step, count(*) AS n, count(DISTINCT document_id) AS documents FROM iss GROUP BY ALL")
def validation_codes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each rule is broken."""
    made = validation.scene_issues(**damaged(spark, folder), tolerance=TOLERANCE)
    return made.groupBy("code", "step").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))
