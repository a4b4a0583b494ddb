"""Queries of evidence, ink and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE as P
from ..functions import geometry as G
from ..operators import evidence, graph, pixels
from ..sources.shared import new_folder, stored
from ..sources.tables import BOXES_SQL, POINTS_SQL, SEGMENTS_SQL, boxes, points, segments, table
from .registry import query

SIZE = 8.0


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 9 AS o, CAST(100+p_size AS DOUBLE) AS w, CAST(60+p_partkey % 40 AS DOUBLE) AS h, CAST(10+p_size AS DOUBLE) AS x, CAST(5+p_partkey % 7 AS DOUBLE) AS y FROM part)
SELECT id, o AS orientation, CASE WHEN o IN (2,3) THEN w-x WHEN o IN (5,8) THEN y WHEN o IN (6,7) THEN h-y ELSE x END AS x, CASE WHEN o IN (3,4) THEN h-y WHEN o IN (5,6) THEN x WHEN o IN (7,8) THEN w-x ELSE y END AS y, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN o BETWEEN 5 AND 8 THEN w ELSE h END AS height FROM p""")
def oriented_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of stored images on display, for every orientation."""
    w, h = F.lit(100.0) + F.col("p_size"), F.lit(60.0) + F.col("p_partkey") % 40
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 9).alias("orientation"), w.alias("w"), h.alias("h"), (F.lit(10.0) + F.col("p_size")).alias("x0"), (F.lit(5.0) + F.col("p_partkey") % 7).alias("y0"))
    o = F.col("orientation")
    made = p.withColumns({"at": G.apply_matrix(evidence.oriented(o, F.col("w"), F.col("h")), F.col("x0"), F.col("y0")), "size": evidence.display_size(o, F.col("w"), F.col("h"))})
    return made.select("id", "orientation", "at.x", "at.y", "size.width", "size.height")


@query(f"""WITH b AS ({BOXES_SQL}), c AS (SELECT id, unnest([x, x+width, x+width, x]) AS px, unnest([y, y, y+height, y+height]) AS py FROM b), s AS (SELECT id, (2*px+10)/(1+0.0001*px) AS x, (3*py-5)/(1+0.0001*px) AS y FROM c) SELECT id, round(avg(x),4) AS x, round(avg(y),4) AS y, count(*) AS corners, CAST(CASE WHEN id % 4=0 THEN 0.75 ELSE id % 10/10.0 END AS DOUBLE) AS confidence FROM s GROUP BY id""")
def evidence_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of the regions' polygons in the source image, with the confidence of their evidence."""
    m = F.array(*[F.lit(v) for v in (2.0, 0.0, 10.0, 0.0, 3.0, -5.0, 0.0001, 0.0, 1.0)])
    polygon = evidence.source_polygon(m, F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    e = evidence.machine_evidence(F.lit("detect_regions"), F.col("id"), polygon, F.when(F.col("id") % 4 != 0, F.col("id") % 10 / 10.0))
    made = boxes(spark, folder).select("id", e.alias("e")).withColumn("c", evidence.centroid(F.col("e.source_polygon")))
    return made.select("id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), F.size("e.source_polygon").cast("long").alias("corners"), "e.confidence")


@query(f"SELECT id, least(greatest(round(x,6), 0.0), 40.0) AS x, least(greatest(round(y,6), 0.0), 30.0) AS y FROM ({POINTS_SQL})")
def fitted_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points moved into their frame."""
    return points(spark, folder).select("id", evidence.fitted(F.col("x"), F.lit(40.0)).alias("x"), evidence.fitted(F.col("y"), F.lit(30.0)).alias("y"))


_WALK = "SELECT document_id, id, x0, y0, x1, y1, n, unnest(range(0, n+1)) AS k FROM (SELECT *, greatest(CAST({} AS INTEGER), 1) AS n FROM ({}))"
_AT = "CAST(floor((x0+(x1-x0)*k/n)/8.0) AS BIGINT) AS px, CAST(floor((y0+(y1-y0)*k/n)/8.0) AS BIGINT) AS py"
_LENGTH = "sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))"
INK_SQL = f"SELECT DISTINCT document_id, {_AT} FROM ({_WALK.format(f'ceil(2*{_LENGTH}/8.0)', SEGMENTS_SQL)})"


@query(f"""WITH i AS ({INK_SQL}), d AS (SELECT a.document_id, a.px, a.py, count(b.px) AS degree FROM i a LEFT JOIN i b ON a.document_id=b.document_id AND abs(a.px-b.px)<=1 AND abs(a.py-b.py)<=1 AND NOT (a.px=b.px AND a.py=b.py) GROUP BY ALL)
SELECT document_id, count(*) AS ink, count(*) FILTER (WHERE degree>=3) AS junctions, count(*) FILTER (WHERE degree<=1) AS ends, max(degree) AS most FROM d GROUP BY document_id""")
def ink_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Ink pixels of every page, with those of three neighbours or more, and of one at most."""
    made = evidence.pixel_degrees(stored(evidence.ink_pixels(segments(spark, folder), SIZE), "ink"))
    return made.groupBy("document_id").agg(F.count("*").alias("ink"), F.count_if(F.col("degree") >= 3).alias("junctions"), F.count_if(F.col("degree") <= 1).alias("ends"), F.max("degree").alias("most"))


@query(f"""WITH RECURSIVE i AS ({INK_SQL}), n AS (SELECT *, px*1000000+py AS node FROM i), e AS (SELECT a.document_id, a.node AS a, b.node AS b FROM n a, (SELECT unnest([-1,0,1]) AS dx) x, (SELECT unnest([-1,0,1]) AS dy) y, n b WHERE a.document_id=b.document_id AND b.px=a.px+dx AND b.py=a.py+dy AND a.node<>b.node),
c(document_id, node, component) USING KEY (document_id, node) AS (SELECT document_id, node, node FROM n UNION (SELECT u.document_id, u.node, min(v.component) FROM c v JOIN e ON e.document_id=v.document_id AND e.b=v.node JOIN recurring.c u ON u.document_id=e.document_id AND u.node=e.a WHERE v.component<u.component GROUP BY u.document_id, u.node))
SELECT document_id, component, count(*) AS area, min(px) AS x, min(py) AS y, max(px)-min(px)+1 AS width, max(py)-min(py)+1 AS height FROM c JOIN n USING (document_id, node) GROUP BY document_id, component""")
def ink_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of every page's ink, with area and box, by way of its runs."""
    runs = stored(pixels.runs_of(evidence.ink_pixels(segments(spark, folder), SIZE)), "runs")
    numbered = runs.select("document_id", evidence.pixel_number(F.col("x0"), F.col("py")).alias("id"))
    return evidence.run_boxes(runs, graph.connected_components(evidence.run_links(runs), numbered, new_folder(spark, "ink-components")))


@query(f"""WITH i AS ({INK_SQL}), g AS (SELECT document_id, id, x1 AS x0, y1 AS y0, x0+30.0 AS x1, y0-20.0 AS y1 FROM ({SEGMENTS_SQL})), w AS (SELECT document_id, id, {_AT} FROM ({_WALK.format(f'floor({_LENGTH}/3.0)', 'SELECT * FROM g')}))
SELECT w.document_id, w.id, round(avg(CASE WHEN i.px IS NULL THEN 0.0 ELSE 1.0 END),6) AS coverage FROM w LEFT JOIN i ON i.document_id=w.document_id AND i.px=w.px AND i.py=w.py GROUP BY w.document_id, w.id""")
def line_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each bridge line, from a segment's end to beside its start, lies on ink."""
    s = segments(spark, folder)
    bridges = s.select("document_id", "id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), (F.col("x0") + 30.0).alias("x1"), (F.col("y0") - 20.0).alias("y1"))
    return evidence.line_coverage(bridges, evidence.ink_pixels(s, SIZE), SIZE, P.ink_step).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH i AS ({INK_SQL}), o AS (SELECT a.v AS dx, b.v AS dy FROM (SELECT unnest(range(-3,4)) AS v) a, (SELECT unnest(range(-3,4)) AS v) b WHERE a.v*a.v+b.v*b.v<=9), w AS (SELECT document_id, id, CAST(floor(x/8.0) AS BIGINT)+dx AS px, CAST(floor(y/8.0) AS BIGINT)+dy AS py FROM ({POINTS_SQL}), o)
SELECT w.document_id, w.id, round(avg(CASE WHEN i.px IS NULL THEN 0.0 ELSE 1.0 END),6) AS coverage FROM w LEFT JOIN i ON i.document_id=w.document_id AND i.px=w.px AND i.py=w.py GROUP BY w.document_id, w.id""")
def disk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the disk around each point is ink."""
    ink = evidence.ink_pixels(segments(spark, folder), SIZE)
    return evidence.disk_coverage(points(spark, folder), ink, SIZE, 3).withColumn("coverage", F.round("coverage", 6))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 8 AS k, p_name FROM part) SELECT id, CASE WHEN k IN (0,1,6,7) THEN p_name END AS first_reading, CASE WHEN k IN (0,1,6,7) THEN 5 END AS cells FROM p""")
def reading_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Reading tables from JSON: well-formed ones, and ones with a missing group, a wrong title, another key, a blank cell, or no JSON at all."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 8).alias("k"), "p_name")
    cell = lambda name: F.concat(F.lit('{"location":"A1","reading":"'), name, F.lit('"}'))
    group = lambda n, title, rows, more="": F.concat(F.lit(f'{{"id":"{evidence.READING_GROUPS[n][0]}","title":"'), title, F.lit('","rows":['), rows, F.lit(f"]{more}}}"))
    titles = [F.lit(t) for _, t in evidence.READING_GROUPS]
    two = F.concat(cell(F.col("p_name")), F.lit(","), cell(F.lit("b")))
    full = [group(n, titles[n], two if n == 0 else cell(F.lit("x"))) for n in range(4)]
    made = lambda groups, more="": F.concat(F.lit('{"groups":['), F.concat_ws(",", *groups), F.lit(f"]{more}}}"))
    text = (
        F.when(F.col("k") == 2, made(full[:3])).when(F.col("k") == 3, made([*full[:3], group(3, F.lit("Notes"), cell(F.lit("x")))])).when(F.col("k") == 4, made(full, ',"more":1'))
        .when(F.col("k") == 5, F.when(F.col("id") % 3 == 0, F.lit("no table")).when(F.col("id") % 3 == 1, made([*full[:3], group(3, titles[3], cell(F.lit(" ")))])).otherwise(made([*full[:3], group(3, titles[3], cell(F.lit("x")), ',"z":1')]))).otherwise(made(full))
    )
    read = p.select("id", evidence.reading_table(text).alias("t"))
    cells = F.aggregate(F.col("t.groups"), F.lit(0), lambda n, g: n + F.size(g["rows"]))
    return read.select("id", F.col("t").getField("groups").getItem(0)["rows"].getItem(0)["reading"].alias("first_reading"), F.when(F.col("t").isNotNull(), cells).alias("cells"))


@query("""SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN NULL ELSE p_name END AS text, CASE WHEN p_size % 5=4 THEN concat(p_name, '-', p_brand) END AS parts FROM part""")
def answered_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of providers' answers, wherever these keep them."""
    name, brand, kind = (F.concat(F.lit('"'), c, F.lit('"')) for c in ("p_name", "p_brand", "p_type"))
    one = F.col("p_size") % 5
    payload = (
        F.when(one == 0, F.concat(F.lit('{"result":{"response":'), name, F.lit(',"output":"other"}}'))).when(one == 1, F.concat(F.lit('{"result":{"response":" ","text":'), brand, F.lit("}}")))
        .when(one == 2, F.concat(F.lit('{"output":'), kind, F.lit("}"))).when(one == 3, F.lit('{"result":{"response":""},"output":null}'))
        .otherwise(F.concat(F.lit('{"response":'), name, F.lit(',"candidates":[{"content":{"parts":[{"text":'), name, F.lit('},{"n":1},{"text":"-"},{"text":'), brand, F.lit("}]}}]}")))
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), evidence.provider_text(payload).alias("text"), evidence.joined_parts(payload).alias("parts"))


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS k, CASE WHEN l_returnflag='R' THEN 'transient' WHEN l_returnflag='A' THEN 'ok' ELSE 'fatal' END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_returnflag='R' THEN 'transient' WHEN l_returnflag='A' THEN 'ok' ELSE 'fatal' END) AS n FROM lineitem),
f AS (SELECT id, min(n) FILTER (WHERE s<>'transient') AS stop, max(n) AS every FROM c GROUP BY id), m AS (SELECT id, least(coalesce(stop, every), every, 3) AS made, every FROM f)
SELECT m.id, CAST(made AS INTEGER) AS made, CAST(CASE WHEN c.s='transient' AND made<3 THEN pow(2, made)-1 ELSE pow(2, made-1)-1 END AS INTEGER) AS waited, c.s AS outcome FROM m JOIN c ON c.id=m.id AND c.n=made""")
def retried_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of providers with their retries: how many count, how long was waited, and how it ended."""
    status = F.when(F.col("l_returnflag") == "R", "transient").when(F.col("l_returnflag") == "A", "ok").otherwise("fatal")
    calls = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("attempt"), status.alias("status"))
    return evidence.retry_schedule(calls, "id")
