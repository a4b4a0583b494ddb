"""Queries of whole drawings: the assembled scenes with states, rotations, ports, outlines and layers, as SVG documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drawing
from ..sources.shared import stored
from .edits import _FULL, _N
from .registry import query
from .scene import assembled

#: Symbols of the drawings: ports and shapes, in pixels of their own.
LIBRARY = {
    "ball_valve": ({"in": (-20.0, 0.0), "out": (20.0, 0.0)}, (("polygon", False, None, ((-20.0, -10.0), (-20.0, 10.0), (20.0, -10.0), (20.0, 10.0))), ("circle", True, 4.0, ((0.0, 0.0),)))),
    "flange": ({"in": (-20.0, 0.0), "out": (20.0, 0.0)}, (("line", False, None, ((0.0, -12.0), (0.0, 12.0))),)),
    "riser": ({"in": (-20.0, 0.0), "out": (20.0, 0.0)}, (("circle", False, 7.5, ((0.0, 0.0),)),)),
}


def library(spark: SparkSession) -> DataFrame:
    points = lambda found: [{"x": x, "y": y} for x, y in found]
    rows = [(name, {p: {"x": x, "y": y} for p, (x, y) in ports.items()}, [{"kind": k, "fill": f, "radius": r, "points": points(at)} for k, f, r, at in shapes]) for name, (ports, shapes) in LIBRARY.items()]
    return spark.createDataFrame(rows, "symbol_id string, ports map<string, struct<x: double, y: double>>, primitives array<struct<kind: string, fill: boolean, radius: double, points: array<struct<x: double, y: double>>>>")


def _digit(k: int) -> Column:
    """Digit k, from 1 on, of a scene id."""
    return F.conv(F.substring("id", k, 1), 16, 10).cast("int")


def scenes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What `drawing.documents` takes. Digits of an object's id tell what the scenes don't: the first its state, the second a symbol's rotation, the third whether its port is loose."""
    found = stored(assembled(spark, folder), "drawn-scene")
    is_, half = lambda *kinds: F.col("type").isin(*kinds), F.lit(20.0)
    state = F.when(_digit(1) == 0, "rejected").when(_digit(1) < 3, "confirmed").otherwise("machine")
    things = found.where("type <> 'relationship'")
    objects = things.select(
        "document_id", "id", "type", F.when(is_("junction"), F.when(_digit(1) == 3, "confirmed").otherwise("machine")).otherwise(state).alias("state"), "layer", F.col("label").alias("kind"),
        F.col("label").alias("symbol_id"), (_digit(2) * 22.5).alias("rotation"), F.trim("label").alias("text"), F.col("label").alias("recognized"),
        (F.col("x") - F.when(is_("dimension"), half).otherwise(0.0)).alias("x"), "y", F.when(is_("dimension"), F.col("x") + half).otherwise(F.col("x1")).alias("x1"),
        F.when(is_("dimension"), F.col("y") + F.lit(5.0)).otherwise(F.col("y1")).alias("y1"), "start_id", "end_id",
    )
    objects = stored(objects, "drawn-objects")
    hub = objects.where("type = 'junction'").groupBy("document_id").agg(F.min("id").alias("hub"))
    symbols = objects.where("type = 'symbol'").join(hub, "document_id", "left")
    ports = symbols.select("document_id", "id", F.explode(F.map_from_arrays(F.array(F.lit("in"), F.lit("out")), F.array(F.when(_digit(3) >= 8, F.col("hub")), F.col("hub")))).alias("port", "node_id"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = F.array(*[corner(dx, dy) for dx, dy in ((-4, -4), (4, -4), (4, 4), (-4, 4))])
    outlines = objects.where("type = 'unknown_mark'").select("document_id", "id", F.lit(0).alias("n"), square.alias("points"))
    links = found.where("type = 'relationship'")
    kind = F.when(F.col("label") == "annotates", "callout_targets").otherwise(F.col("label"))
    relationships = links.select("document_id", "id", kind.alias("type"), state.alias("state"), F.col("start_id").alias("from_id"), F.col("end_id").alias("to_id"))
    matrix = F.array(*[F.lit(float(v)) for v in (1, 0, 6, 0, 1, 3, 0, 0, 2)])
    pages = objects.select("document_id").distinct().select("document_id", F.lit(256).alias("width"), F.lit(200).alias("height"), F.lit("1.0").alias("schema_version"), F.col("document_id").alias("revision_id"), matrix.alias("matrix"))
    layers = objects.select("document_id", "layer").distinct().withColumn("color", F.when(F.col("layer") == "default", "#111111").otherwise("#0a5fb4"))
    return {"pages": pages, "layers": layers, "objects": objects, "ports": ports, "outlines": outlines, "relationships": relationships, "library": library(spark)}


_DIGIT = "(strpos('0123456789abcdef', substr(id,{0},1))-1)"
_STATE = f"CASE WHEN {_DIGIT.format(1)}=0 THEN 'rejected' WHEN {_DIGIT.format(1)}<3 THEN 'confirmed' ELSE 'machine' END"
_OBJECTS = f"""{_FULL},
gg AS (SELECT document_id, id, type, CASE WHEN type='junction' THEN CASE WHEN {_DIGIT.format(1)}=3 THEN 'confirmed' ELSE 'machine' END ELSE {_STATE} END AS state, layer, label, trim(label) AS text, {_DIGIT.format(2)}*22.5 AS rotation, {_DIGIT.format(3)} AS third,
  CASE WHEN type='dimension' THEN x-20 ELSE x END AS x, y, CASE WHEN type='dimension' THEN x+20 ELSE x1 END AS x1, CASE WHEN type='dimension' THEN y+5 ELSE y1 END AS y1, start_id, end_id FROM o WHERE type<>'relationship'),
vis AS (SELECT * FROM gg WHERE state<>'rejected'), rel AS (SELECT document_id, id, label AS type, {_STATE} AS state, start_id, end_id FROM o WHERE type='relationship'),
hub AS (SELECT document_id, min(id) AS hub FROM gg WHERE type='junction' GROUP BY document_id),
port AS (SELECT s.document_id, s.id, p AS port, s.x, s.y, s.rotation, CASE WHEN p='out' OR third>=8 THEN hub END AS node_id FROM vis s CROSS JOIN (VALUES ('in'), ('out')) t(p) LEFT JOIN hub USING (document_id) WHERE type='symbol'),
un AS (SELECT document_id, 'unknown_junction' AS kind, id, NULL AS port FROM vis v WHERE type='junction' AND label='unknown' UNION ALL SELECT document_id, 'unresolved_port', id, port FROM port WHERE node_id IS NULL UNION ALL SELECT document_id, 'unknown_mark', id, NULL FROM vis v WHERE type='unknown_mark')"""


@query(f"{_OBJECTS} SELECT * FROM un")
def unresolved_items(spark: SparkSession, folder: str) -> DataFrame:
    """What the drawings leave open."""
    s = scenes(spark, folder)
    return drawing.unresolved(s["objects"], s["ports"], "document_id")


@query(f"""{_OBJECTS}, rj AS (SELECT id FROM gg WHERE type='junction' AND {_DIGIT.format(1)}=0), hung AS (SELECT document_id, id, type, 'startNodeId' AS path, start_id AS node_id FROM vis v WHERE type='pipe_segment' UNION ALL SELECT document_id, id, type, 'endNodeId', end_id FROM vis v WHERE type='pipe_segment'
UNION ALL SELECT document_id, id, 'symbol', concat('portNodeIds[', port, ']'), node_id FROM port) SELECT hung.* FROM hung WHERE node_id IN (SELECT id FROM rj)""")
def rejected_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Live pipes and symbols on junctions that are rejected, where those whose id begins with 0 are."""
    s = scenes(spark, folder)
    objects = s["objects"].withColumn("state", F.when((F.col("type") == "junction") & (_digit(1) == 0), "rejected").otherwise(F.col("state")))
    return drawing.attached_to_rejected(objects, s["ports"], "document_id")


def _num(x: str) -> str:
    return _N.format(f"({x})")


_OWN = "concat('id=\"obj-', v.id, '\" data-object-id=\"', v.id, '\" data-state=\"', v.state, '\"')"
_COLOR = "CASE v.layer WHEN 'default' THEN '#111111' ELSE '#0a5fb4' END"
_FONT = """fill="#1a1a1a" font-family="Arial, Helvetica, ''Liberation Sans'', sans-serif" font-size="12\""""
_RING = """r="5" stroke="#d93025" stroke-width="1" fill="none\""""
_ROUND = 'stroke-linecap="round" stroke-linejoin="round"'
_CLEAN = "replace(replace(replace({},'&','&amp;'),'<','&lt;'),'>','&gt;')"
_MARK_X = "least(greatest((v.x{0}+6)/2, 0.0), 256.0)"
_MARK_Y = "least(greatest((v.y{0}+3)/2, 0.0), 200.0)"
_CORNERS = [(a, b) for a, b in (("-4", "-4"), ("+4", "-4"), ("+4", "+4"), ("-4", "+4"))]
_POLYGON = ", ' ', ".join(f"{_num(_MARK_X.format(a))}, ',', {_num(_MARK_Y.format(b))}" for a, b in _CORNERS)
_MEAN_X, _MEAN_Y = ("(" + "+".join(m.format(c[k]) for c in _CORNERS) + ")/4" for k, m in ((0, _MARK_X), (1, _MARK_Y)))
_SYMBOLS = """CASE label WHEN 'ball_valve' THEN '<symbol id="sym-ball_valve" overflow="visible">
<polygon points="-20,-10 -20,10 20,-10 20,10" fill="none"/>
<circle cx="0" cy="0" r="4"/>
</symbol>
' WHEN 'flange' THEN '<symbol id="sym-flange" overflow="visible">
<line x1="0" y1="-12" x2="0" y2="12"/>
</symbol>
' WHEN 'riser' THEN '<symbol id="sym-riser" overflow="visible">
<circle cx="0" cy="0" r="7.5" fill="none"/>
</symbol>
' END"""
_ARROWS = """'<marker id="marker-arrow-start" viewBox="0 0 6 6" refX="0" refY="3" markerWidth="6" markerHeight="6" markerUnits="userSpaceOnUse" orient="auto" overflow="visible">
<path d="M6 0L0 3L6 6Z" fill="#1a1a1a"/>
</marker>
<marker id="marker-arrow-end" viewBox="0 0 6 6" refX="6" refY="3" markerWidth="6" markerHeight="6" markerUnits="userSpaceOnUse" orient="auto" overflow="visible">
<path d="M0 0L6 3L0 6Z" fill="#1a1a1a"/>
</marker>
'"""
_REST = ("connections", "symbols", "dimensions", "callouts", "annotations", "unresolved")


@query(f"""{_OBJECTS},
deg AS (SELECT id, count(*) AS n FROM (SELECT start_id AS id FROM vis v WHERE type='pipe_segment' UNION ALL SELECT end_id FROM vis v WHERE type='pipe_segment' UNION ALL SELECT node_id FROM port WHERE node_id IS NOT NULL) GROUP BY id),
spot AS (SELECT v.id, CASE WHEN type='pipe_segment' THEN (a.x+b.x)/2 WHEN type='dimension' THEN (v.x+v.x1)/2 WHEN type='unknown_mark' THEN {_MEAN_X} ELSE v.x END AS px, CASE WHEN type='pipe_segment' THEN (a.y+b.y)/2 WHEN type='dimension' THEN (v.y+v.y1)/2 WHEN type='unknown_mark' THEN {_MEAN_Y} ELSE v.y END AS py
  FROM vis v LEFT JOIN (SELECT id, x, y FROM gg WHERE type='junction') a ON a.id=v.start_id LEFT JOIN (SELECT id, x, y FROM gg WHERE type='junction') b ON b.id=v.end_id),
z AS (SELECT v.document_id, 'pipes' AS grp, v.layer, v.id AS k, '' AS part, concat('<line ', {_OWN}, ' x1="', {_num("a.x")}, '" y1="', {_num("a.y")}, '" x2="', {_num("b.x")}, '" y2="', {_num("b.y")}, '"/>', chr(10)) AS line FROM vis v JOIN gg a ON a.type='junction' AND a.id=v.start_id JOIN gg b ON b.type='junction' AND b.id=v.end_id WHERE v.type='pipe_segment'
UNION ALL SELECT v.document_id, 'connections', '', v.id, '', CASE WHEN coalesce(n,0)>=3 THEN concat('<circle', CASE WHEN label='unknown' THEN '' ELSE concat(' ', {_OWN}) END, ' cx="', {_num("v.x")}, '" cy="', {_num("v.y")}, '" r="3" fill="', {_COLOR}, '"/>', chr(10)) WHEN label<>'unknown' THEN concat('<g ', {_OWN}, '/>', chr(10)) END FROM vis v LEFT JOIN deg USING (id) WHERE type='junction'
UNION ALL SELECT v.document_id, 'symbols', '', v.id, '', concat('<use ', {_OWN}, ' href="#sym-', label, '" transform="translate(', {_num("v.x")}, ' ', {_num("v.y")}, ') rotate(', {_num("v.rotation")}, ') scale(1)" stroke="', {_COLOR}, '" stroke-width="1.5" {_ROUND} fill="', {_COLOR}, '"/>', chr(10)) FROM vis v WHERE type='symbol'
UNION ALL SELECT v.document_id, 'dimensions', '', v.id, '', concat('<g ', {_OWN}, '>', chr(10), '<line x1="', {_num("v.x")}, '" y1="', {_num("v.y")}, '" x2="', {_num("v.x1")}, '" y2="', {_num("v.y1")}, '" stroke="#1a1a1a" stroke-width="0.75" marker-start="url(#marker-arrow-start)" marker-end="url(#marker-arrow-end)"/>', chr(10),
  '<text x="', {_num("(v.x+v.x1)/2")}, '" y="', {_num("(v.y+v.y1)/2")}, '" {_FONT} text-anchor="middle">', {_CLEAN.format("text")}, '</text>', chr(10), '</g>', chr(10)) FROM vis v WHERE type='dimension'
UNION ALL SELECT rel.document_id, 'callouts', '', rel.id, '', concat('<line x1="', {_num("v.x")}, '" y1="', {_num("v.y")}, '" x2="', {_num("px")}, '" y2="', {_num("py")}, '" stroke="#1a1a1a" stroke-width="0.75"/>', chr(10)) FROM rel JOIN vis v ON v.id=rel.start_id AND v.type='annotation' JOIN spot ON spot.id=rel.end_id WHERE rel.type='annotates' AND rel.state<>'rejected'
UNION ALL SELECT v.document_id, 'annotations', '', v.id, '', concat('<text ', {_OWN}, ' data-recognized-text="', {_CLEAN.format("label")}, '" x="', {_num("v.x")}, '" y="', {_num("v.y")}, '" {_FONT}>', {_CLEAN.format("text")}, '</text>', chr(10)) FROM vis v WHERE type='annotation'
UNION ALL SELECT v.document_id, 'unresolved', '', v.id, '', concat('<circle ', {_OWN}, ' cx="', {_num("v.x")}, '" cy="', {_num("v.y")}, '" {_RING}/>', chr(10)) FROM vis v WHERE type='junction' AND label='unknown'
UNION ALL SELECT v.document_id, 'unresolved', '', v.id, port, concat('<circle cx="', {_num("v.x+CASE port WHEN 'in' THEN -20 ELSE 20 END*cos(radians(v.rotation))")}, '" cy="', {_num("v.y+CASE port WHEN 'in' THEN -20 ELSE 20 END*sin(radians(v.rotation))")}, '" {_RING}/>', chr(10)) FROM port v WHERE node_id IS NULL
UNION ALL SELECT v.document_id, 'unresolved', '', v.id, '', concat('<g ', {_OWN}, ' stroke="#d93025" stroke-width="1" stroke-dasharray="4 2" fill="none">', chr(10), '<polygon points="', {_POLYGON}, '"/>', chr(10), '</g>', chr(10)) FROM vis v WHERE type='unknown_mark'),
body AS (SELECT document_id, grp, layer, string_agg(line, '' ORDER BY k, part) AS body FROM z WHERE line IS NOT NULL GROUP BY ALL),
lay AS (SELECT document_id, string_agg(concat('<g id="layer-', v.layer, '" stroke="', {_COLOR}, '" stroke-width="2" {_ROUND}', CASE WHEN body IS NULL THEN '/>' ELSE concat('>', chr(10), body, '</g>') END, chr(10)), '' ORDER BY v.layer) AS pipes FROM (SELECT DISTINCT document_id, layer FROM gg) v LEFT JOIN (SELECT document_id AS d, layer AS l, body FROM body WHERE grp='pipes') ON d=document_id AND l=v.layer GROUP BY document_id),
oth AS (SELECT document_id, {", ".join(f"max(body) FILTER (WHERE grp='{n}') AS {n}" for n in _REST)} FROM body GROUP BY document_id),
defs AS (SELECT document_id, concat(CASE WHEN bool_or(type='dimension') THEN {_ARROWS} ELSE '' END, string_agg(DISTINCT CASE WHEN type='symbol' THEN {_SYMBOLS} END, '' ORDER BY CASE WHEN type='symbol' THEN {_SYMBOLS} END)) AS defs FROM vis v GROUP BY document_id),
wd AS (SELECT l.document_id, concat('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 200" width="256" height="200">', chr(10), '<metadata>{{"schemaVersion":"1.0","documentId":"', l.document_id, '","revisionId":"', l.document_id, '","rendererVersion":"1.0.0","symbolLibraryVersion":"piping-symbols@1.0.0","styleProfileVersion":"piping-default@1.0.0","unresolvedCount":', coalesce((SELECT count(*) FROM un WHERE un.document_id=l.document_id), 0), '}}</metadata>', chr(10),
  CASE WHEN coalesce(defs,'')='' THEN '<defs/>' ELSE concat('<defs>', chr(10), defs, '</defs>') END, chr(10), '<g id="pipes">', chr(10), pipes, '</g>', chr(10), {", ".join(f"CASE WHEN {n} IS NULL THEN '<g id=" + chr(34) + n + chr(34) + f"/>' ELSE concat('<g id=" + chr(34) + n + chr(34) + f">', chr(10), {n}, '</g>') END, chr(10)" for n in _REST)}, '</svg>', chr(10)) AS svg FROM lay l LEFT JOIN oth USING (document_id) LEFT JOIN defs USING (document_id))
SELECT document_id, length(svg) AS characters, sha256(svg) AS digest FROM wd""")
def scene_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every scene as an SVG document: pipes by layer, dots, turned symbols, dimensions with arrows, callouts, texts, and what is unresolved."""
    made = drawing.documents(**scenes(spark, folder))
    return made.select("document_id", F.length("svg").cast("long").alias("characters"), F.sha2("svg", 256).alias("digest"))
