"""Drawings against documents written out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strokeline.functions.text import number
from strokeline.operators import drawing

SCHEMAS = {
    "pages": "document_id long, width int, height int, schema_version string, revision_id string, matrix array<double>",
    "layers": "document_id long, layer string, color string",
    "objects": "document_id long, id string, type string, state string, layer string, kind string, symbol_id string, rotation double, text string, recognized string, x double, y double, x1 double, y1 double, start_id string, end_id string",
    "ports": "document_id long, id string, port string, node_id string",
    "outlines": "document_id long, id string, n int, points array<struct<x: double, y: double>>",
    "relationships": "document_id long, id string, type string, state string, from_id string, to_id string",
    "library": "symbol_id string, ports map<string, struct<x: double, y: double>>, primitives array<struct<kind: string, fill: boolean, radius: double, points: array<struct<x: double, y: double>>>>",
}
SAME = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def thing(ident, what, x=None, y=None, state="machine", layer="a", page=1, **more):
    names = [c.split(" ")[0] for c in SCHEMAS["objects"].split(", ")]
    known = {"document_id": page, "id": ident, "type": what, "state": state, "layer": layer, "x": x, "y": y, **more}
    return tuple(known.get(n) for n in names)


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


LIBRARY = [("valve", {"in": (-20.0, 0.0), "out": (20.0, 0.0)}, [("line", False, None, [(0.0, -5.0), (0.0, 5.0)]), ("circle", True, 2.5, [(0.0, 0.0)]), ("polygon", False, None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])])]
SCENE = {
    "pages": [(1, 100, 80, "1.0", "r1", SAME), (2, 50, 40, "1.0", "r2", SAME)],
    "layers": [(1, "b", "#00ff00"), (1, "a", "#ff0000"), (1, "c", "#0000ff")],
    "objects": [
        thing("n1", "junction", 10.0, 20.0, kind="tee"), thing("n2", "junction", 30.12345, 20.0, kind="unknown", layer="b"), thing("n3", "junction", 10.0, 60.0, kind="elbow"), thing("n4", "junction", 50.0, 50.0, kind="elbow"),
        thing("p1", "pipe_segment", start_id="n1", end_id="n2"), thing("p2", "pipe_segment", start_id="n3", end_id="n1", layer="b"), thing("p3", "pipe_segment", start_id="n1", end_id="n4", state="rejected"),
        thing("s1", "symbol", 40.0, 40.0, symbol_id="valve", rotation=90.0, state="confirmed"), thing("d1", "dimension", 0.0, 5.0, x1=20.0, y1=5.0, text='5" <x>'),
        thing("t1", "annotation", 60.0, 10.0, text="a & b", recognized='a "&" b'), thing("t2", "annotation", 61.0, 11.0, text="gone", recognized="", state="rejected"),
        thing("u1", "unknown_mark"), thing("u2", "unknown_mark", layer="b"),
    ],
    "ports": [(1, "s1", "in", "n1"), (1, "s1", "out", None)],
    "outlines": [(1, "u1", 1, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]), (1, "u1", 0, [(-5.0, 70.0), (9.0, 70.0), (9.0, 95.0), (-5.0, 95.0)]), (1, "u2", 0, [(1.0, 1.0), (2.0, 2.0)])],
    "relationships": [
        (1, "r2", "callout_targets", "machine", "t1", "p1"), (1, "r1", "callout_targets", "confirmed", "t1", "u1"), (1, "r3", "callout_targets", "rejected", "t1", "n1"),
        (1, "r4", "callout_targets", "machine", "t2", "n1"), (1, "r5", "callout_targets", "machine", "t1", "p3"), (1, "r6", "measures", "machine", "t1", "n1"), (1, "r7", "callout_targets", "machine", "d1", "n1"), (1, "r8", "callout_targets", "machine", "t1", "u2"),
    ],
    "library": LIBRARY,
}
DRAWN = """<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 80" width="100" height="80">
<metadata>{"schemaVersion":"1.0","documentId":"1","revisionId":"r1","rendererVersion":"1.0.0","symbolLibraryVersion":"piping-symbols@1.0.0","styleProfileVersion":"piping-default@1.0.0","unresolvedCount":4}</metadata>
<defs>
<marker id="marker-arrow-start" viewBox="0 0 6 6" refX="0" refY="3" markerWidth="6" markerHeight="6" markerUnits="userSpaceOnUse" orient="auto" overflow="visible">
<path d="M6 0L0 3L6 6Z" fill="#1a1a1a"/>
</marker>
<marker id="marker-arrow-end" viewBox="0 0 6 6" refX="6" refY="3" markerWidth="6" markerHeight="6" markerUnits="userSpaceOnUse" orient="auto" overflow="visible">
<path d="M0 0L6 3L0 6Z" fill="#1a1a1a"/>
</marker>
<symbol id="sym-valve" overflow="visible">
<line x1="0" y1="-5" x2="0" y2="5"/>
<circle cx="0" cy="0" r="2.5"/>
<polygon points="0,0 1,0 1,1" fill="none"/>
</symbol>
</defs>
<g id="pipes">
<g id="layer-a" stroke="#ff0000" stroke-width="2" stroke-linecap="round" stroke-linejoin="round">
<line id="obj-p1" data-object-id="p1" data-state="machine" x1="10" y1="20" x2="30.123" y2="20"/>
</g>
<g id="layer-b" stroke="#00ff00" stroke-width="2" stroke-linecap="round" stroke-linejoin="round">
<line id="obj-p2" data-object-id="p2" data-state="machine" x1="10" y1="60" x2="10" y2="20"/>
</g>
<g id="layer-c" stroke="#0000ff" stroke-width="2" stroke-linecap="round" stroke-linejoin="round"/>
</g>
<g id="connections">
<circle id="obj-n1" data-object-id="n1" data-state="machine" cx="10" cy="20" r="3" fill="#ff0000"/>
<g id="obj-n3" data-object-id="n3" data-state="machine"/>
<g id="obj-n4" data-object-id="n4" data-state="machine"/>
</g>
<g id="symbols">
<use id="obj-s1" data-object-id="s1" data-state="confirmed" href="#sym-valve" transform="translate(40 40) rotate(90) scale(1)" stroke="#ff0000" stroke-width="1.5" stroke-linecap="round" stroke-linejoin="round" fill="#ff0000"/>
</g>
<g id="dimensions">
<g id="obj-d1" data-object-id="d1" data-state="machine">
<line x1="0" y1="5" x2="20" y2="5" stroke="#1a1a1a" stroke-width="0.75" marker-start="url(#marker-arrow-start)" marker-end="url(#marker-arrow-end)"/>
<text x="10" y="5" fill="#1a1a1a" font-family="Arial, Helvetica, 'Liberation Sans', sans-serif" font-size="12" text-anchor="middle">5" &lt;x&gt;</text>
</g>
</g>
<g id="callouts">
<line x1="60" y1="10" x2="4.5" y2="75" stroke="#1a1a1a" stroke-width="0.75"/>
<line x1="60" y1="10" x2="20.062" y2="20" stroke="#1a1a1a" stroke-width="0.75"/>
</g>
<g id="annotations">
<text id="obj-t1" data-object-id="t1" data-state="machine" data-recognized-text="a &quot;&amp;&quot; b" x="60" y="10" fill="#1a1a1a" font-family="Arial, Helvetica, 'Liberation Sans', sans-serif" font-size="12">a &amp; b</text>
</g>
<g id="unresolved">
<circle id="obj-n2" data-object-id="n2" data-state="machine" cx="30.123" cy="20" r="5" stroke="#d93025" stroke-width="1" fill="none"/>
<circle cx="40" cy="60" r="5" stroke="#d93025" stroke-width="1" fill="none"/>
<g id="obj-u1" data-object-id="u1" data-state="machine" stroke="#d93025" stroke-width="1" stroke-dasharray="4 2" fill="none">
<polygon points="0,70 9,70 9,80 0,80"/>
<polygon points="1,1 2,1 2,2"/>
</g>
<g id="obj-u2" data-object-id="u2" data-state="machine" stroke="#d93025" stroke-width="1" stroke-dasharray="4 2" fill="none"/>
</g>
</svg>
"""
EMPTY = """<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 50 40" width="50" height="40">
<metadata>{"schemaVersion":"1.0","documentId":"2","revisionId":"r2","rendererVersion":"1.0.0","symbolLibraryVersion":"piping-symbols@1.0.0","styleProfileVersion":"piping-default@1.0.0","unresolvedCount":0}</metadata>
<defs/>
<g id="pipes"/>
<g id="connections"/>
<g id="symbols"/>
<g id="dimensions"/>
<g id="callouts"/>
<g id="annotations"/>
<g id="unresolved"/>
</svg>
"""


def test_a_scene_is_drawn_whole(spark):
    made = {r.document_id: r.svg for r in drawing.documents(**tables(spark, **SCENE)).collect()}
    assert made[1].split("\n") == DRAWN.split("\n") and made[2] == EMPTY


def test_no_pages(spark):
    assert drawing.documents(**tables(spark)).collect() == []


def test_what_is_unresolved_and_what_hangs_on_rejected_junctions(spark):
    t = tables(spark, **SCENE)
    found = {(r.kind, r.id, r.port) for r in drawing.unresolved(t["objects"], t["ports"], "document_id").collect()}
    assert found == {("unknown_junction", "n2", None), ("unresolved_port", "s1", "out"), ("unknown_mark", "u1", None), ("unknown_mark", "u2", None)}
    assert drawing.attached_to_rejected(t["objects"], t["ports"], "document_id").collect() == []
    gone = t["objects"].selectExpr(*[f"if(id in ('n1', 'n4'), 'rejected', {c}) AS {c}" if c == "state" else c for c in t["objects"].columns])
    hung = {(r.id, r.path, r.node_id) for r in drawing.attached_to_rejected(gone, t["ports"], "document_id").collect()}
    assert hung == {("p1", "startNodeId", "n1"), ("p2", "endNodeId", "n1"), ("s1", "portNodeIds[in]", "n1")}


@pytest.mark.parametrize("matrix, points", [(SAME[:8] + [0.0], []), ([2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0], [(3.0, 4.0), (7.0, 4.0), (7.0, 80.0)])])
def test_outlines_are_mapped_onto_the_page(spark, matrix, points):
    t = tables(spark, pages=[(1, 100, 80, "1.0", "r1", matrix)], outlines=[(1, "u", 0, [(1.0, 2.0), (3.0, 2.0), (3.0, 500.0)])])
    made = [[(p.x, p.y) for p in r.points] for r in drawing.page_outlines(t["outlines"], t["pages"], "document_id").collect()]
    assert made == ([points] if points else [])


def test_numbers_have_three_decimals(spark):
    values = [0.0, -0.0, 1.0, 1000.0, -0.0001, 0.0625, 0.1875, 0.3125, -0.0625, -7.4375, 2.5, 12.125, 1e13 + 0.0625, 123456.78949, -3.00051, 1e15]

    def plain(v):
        text = f"{v:.3f}".rstrip("0").rstrip(".")
        return "0" if text == "-0" else text

    made = {r.v: r.s for r in spark.createDataFrame([(v,) for v in values if math.isfinite(v)], "v double").select("v", number(F.col("v")).alias("s")).collect()}
    assert made == {v: plain(v) for v in values}
