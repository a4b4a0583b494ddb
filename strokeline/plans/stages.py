"""Queries of edits, streams, artifacts, rasters and dimension targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE as P
from ..functions import geometry as G
from ..functions import raster
from ..operators import edits, graph, pixels, spatial
from ..sources import artifacts
from ..sources.shared import new_folder, stored
from ..sources.tables import POINTS_SQL, SEGMENTS_SQL, points, segments, table
from ..streaming import jobs as streams
from .control import job_commands
from .rasters import left_of_lines
from .registry import query


@query("""WITH c AS (SELECT l_partkey AS object_id, l_orderkey*10+l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'rotation' ELSE 'none' END AS field, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value FROM lineitem),
l AS (SELECT object_id, arg_max(value, seq) FILTER (WHERE field='text') AS t, arg_max(value, seq) FILTER (WHERE field='rotation') AS r FROM c GROUP BY object_id)
SELECT p_partkey AS id, coalesce(t, p_name) AS text, coalesce(CAST(r AS DOUBLE), CAST(p_size AS DOUBLE)) AS rotation, CASE WHEN object_id IS NOT NULL THEN 'confirmed' ELSE 'machine' END AS state FROM part LEFT JOIN l ON p_partkey=object_id""")
def edited_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts after all edit commands of lineitem."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    kind = F.when(F.col("l_linenumber") % 3 == 0, "update_annotation_text").when(F.col("l_linenumber") % 3 == 1, "set_symbol_rotation").otherwise("touch")
    commands = l.select(F.col("l_partkey").alias("object_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), kind.alias("type"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    objects = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("rotation"), F.lit("machine").alias("state"))
    return edits.applied(objects, commands)


@query(f"""WITH j AS ({POINTS_SQL}), m AS (SELECT id AS junction_id, x+10.0 AS x, y-5.0 AS y FROM j WHERE id % 4=0), p AS (SELECT s.id, s.id AS start_node, s.id+1 AS end_node, x0, y0, x1, y1 FROM ({SEGMENTS_SQL}) s)
SELECT p.id, round(coalesce(a.x,x0),6) AS x0, round(coalesce(a.y,y0),6) AS y0, round(coalesce(b.x,x1),6) AS x1, round(coalesce(b.y,y1),6) AS y1 FROM p LEFT JOIN m a ON p.start_node=a.junction_id LEFT JOIN m b ON p.end_node=b.junction_id""")
def pipes_after_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Pipes after their junctions were moved."""
    j = points(spark, folder)
    pipes = segments(spark, folder).select("id", F.col("id").alias("start_node"), (F.col("id") + 1).alias("end_node"), "x0", "y0", "x1", "y1")
    moves = j.where("id % 4 = 0").select(F.col("id").alias("junction_id"), F.lit(1).alias("seq"), (F.col("x") + 10.0).alias("x"), (F.col("y") - 5.0).alias("y"))
    _, out = edits.moved_junctions(j, pipes, moves)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""WITH s AS ({SEGMENTS_SQL}), w AS (SELECT * FROM s WHERE id % 7=0), e AS (SELECT document_id, id, (x0+x1)/2 AS px, (y0+y1)/2 AS py FROM s WHERE id % 7<>0),
j AS (SELECT w.document_id, w.id AS dimension_id, e.id AS edge_id, px, py, x0, y0, x1, y1, greatest(0.0, least(1.0, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) AS t FROM w JOIN e ON w.document_id=e.document_id),
d AS (SELECT *, sqrt((px-(x0+t*(x1-x0)))*(px-(x0+t*(x1-x0)))+(py-(y0+t*(y1-y0)))*(py-(y0+t*(y1-y0)))) AS dist FROM j),
k AS (SELECT document_id, dimension_id, edge_id, round(greatest(0.0, 1-dist/72.0),6) AS score FROM d WHERE dist<=72.0), r AS (SELECT *, row_number() OVER v AS rank, max(score) OVER (PARTITION BY dimension_id) AS top FROM k WINDOW v AS (PARTITION BY dimension_id ORDER BY score DESC, edge_id))
SELECT document_id, dimension_id, rank, edge_id, score FROM r WHERE rank=1 OR (rank=2 AND round(top-score,6)<0.08)""")
def dimension_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The edge that each dimension's witness line measures, and the second where the margin is too small."""
    s = segments(spark, folder)
    witnesses = s.where("id % 7 = 0").select("document_id", F.concat(F.lit("a"), F.col("id")).alias("id"), "x0", "y0", "x1", "y1")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    middles = s.where("id % 7 <> 0").select("document_id", F.concat(F.lit("b"), F.col("id")).alias("id"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    pairs = spatial.segment_pairs(witnesses.union(middles), 96.0, reach=P.dimension_target_distance / 2).where("a.id like 'a%' and b.id like 'b%'")
    d = G.point_segment_distance(F.col("b.x0"), F.col("b.y0"), F.col("a.x0"), F.col("a.y0"), F.col("a.x1"), F.col("a.y1"))
    near = pairs.withColumn("d", d).where(F.col("d") <= P.dimension_target_distance)
    number = lambda c: F.substring(c, 2, 20).cast("long")
    scored = near.select("a.document_id", number("a.id").alias("dimension_id"), number("b.id").alias("edge_id"), F.round(G.distance_score(F.col("d"), P.dimension_target_distance), 6).alias("score"))
    w = Window.partitionBy("dimension_id").orderBy(F.desc("score"), "edge_id")
    made = scored.withColumns({"rank": F.row_number().over(w), "top": F.first("score").over(w)})
    return made.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.round(F.col("top") - F.col("score"), 6) < P.target_margin))).drop("top")


@query("""WITH n AS (SELECT concat('pages/', CAST(page_id // 2 * 2 AS VARCHAR)) AS key, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL), o AS (SELECT concat('pages/', CAST(page_id AS VARCHAR)) AS key, sha256(html) AS old FROM pages WHERE html IS NOT NULL), d AS (SELECT DISTINCT * FROM n), f AS (SELECT key, min(sha256) AS first FROM n GROUP BY key)
SELECT d.key, d.sha256, CASE WHEN old IS NULL THEN CASE WHEN d.sha256=first THEN 'written' ELSE 'conflict' END WHEN old=d.sha256 THEN 'unchanged' ELSE 'conflict' END AS outcome FROM d JOIN f USING (key) LEFT JOIN o USING (key)""")
def artifact_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of immutable writes of all pages against a store of all pages, where two neighbours are written to one key."""
    p = table(spark, folder, "pages").where("html is not null")
    key = lambda c: F.concat(F.lit("pages/"), c.cast("string"))
    stored = p.select(key(F.col("page_id")).alias("key"), F.sha2("html", 256).alias("sha256"))
    return artifacts.immutable_outcomes(p.select(key(F.expr("page_id div 2 * 2")).alias("key"), F.sha2("html", 256).alias("sha256")), stored)


@query("SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours, max(c) AS busiest FROM (SELECT *, count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS c FROM events) GROUP BY event_type")
def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of a stream of events, by type."""
    path = f"{folder}/[e]vents.parquet"  # a pattern: a table may be one file or a folder of them
    events = streams.read_stream(spark, path, spark.read.parquet(f"{folder}/events.parquet").schema)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = streams.drained(streams.windowed_counts(events), "complete", "windows")
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return last.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("hours"), F.max("n").alias("busiest"))


@query()
def streamed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Final job states of a stream of commands."""
    path = f"{folder}/[e]vents.parquet"  # a pattern: a table may be one file or a folder of them
    commands = job_commands(streams.read_stream(spark, path, spark.read.parquet(f"{folder}/events.parquet").schema))
    rows = streams.drained(streams.job_states(commands), "update", "jobs")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "attempt", "events"), "batch").alias("s")).select("job_id", "s.state", "s.attempt", "s.events")


FRAME = 256


def framed_walk(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, px, py: every page's segments at half their size, in a frame of 256 pixels with the origin in its middle; a pixel as often as it is touched."""
    at = {c: (F.col(c) + FRAME) / 2 for c in ("x0", "y0", "x1", "y1")}
    s = segments(spark, folder).select("document_id", *[v.alias(c) for c, v in at.items()])
    n = F.floor(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))).cast("int") + 1
    walked = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    along = lambda c: F.rint(F.when(F.col("k") == F.col("n"), F.col(f"{c}1")).otherwise(F.col(f"{c}0") + F.col("k") * ((F.col(f"{c}1") - F.col(f"{c}0")) / F.col("n")))).cast("long")
    made = walked.select("document_id", along("x").alias("px"), along("y").alias("py"))
    return made.where(f"px >= 0 and px < {FRAME} and py >= 0 and py < {FRAME}")


@query()
def page_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of each page's ink: its segments drawn, closed, thinned, traced and labelled, all as tables of tiles."""
    page = "document_id"
    ink = stored(pixels.tiles_of(framed_walk(spark, folder)), "ink")
    skeleton = pixels.thinned_tiles(ink, close=FRAME)
    labelled = stored(pixels.tile_components(skeleton), "labelled")
    links = labelled.select(page, F.col("node").alias("a"), F.explode("links").alias("b"))
    components = graph.connected_components(links, labelled, new_folder(spark, "skeletons"), "node")
    areas = labelled.select(page, "node", "area").join(components.hint("merge"), [page, "node"]).groupBy(page, "component").agg(F.sum("area").alias("area"))
    traced = stored(pixels.traced_pieces(skeleton), "lines")
    parts = [
        ink.groupBy(page).agg(F.sum(F.bit_count("bits")).alias("ink")),
        labelled.groupBy(page).agg(F.sum("area").alias("skeleton")),
        areas.groupBy(page).agg(F.count("*").alias("components"), F.max("area").alias("largest")),
        labelled.groupBy(page).agg(F.sum("junctions").alias("junctions")),
        traced.groupBy(page).agg(F.count_if("final").alias("polylines")), left_of_lines(traced, 1.5).groupBy(page).agg(F.sum("vertices").alias("vertices")),
    ]
    made = segments(spark, folder).select(page).distinct()
    for part in parts:
        made = made.join(part, page, "left")
    return made.fillna(0)


@query()
def checked_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads made of vectors - images of their bytes, and others that aren't images - with type, size and error."""

    def run(parts):
        import numpy as np

        for rows in parts:
            made = []
            for k, v in zip(rows["id"], rows["v"]):
                image = (np.abs(np.asarray(v, dtype=float)) * 255).clip(0, 255).astype(np.uint8).reshape(8, -1)
                made.append(raster.encode_png(image) if k % 3 else image.tobytes())
            yield pd.DataFrame({"id": rows["id"], "content": made})

    uploads = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInPandas(run, "id long, content binary")
    return artifacts.checked_uploads(uploads).drop("content")
