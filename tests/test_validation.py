"""Validation of small scenes, each issue named by hand."""

from strokeline.operators import validation

SCHEMAS = {
    "layers": "document_id long, n int, id string",
    "objects": "document_id long, n int, id string, type string, state string, evidence int, layer string, symbol_id string, start_id string, end_id string, targets array<string>, x double, y double, x1 double, y1 double",
    "ports": "document_id long, n int, port string, node_id string",
    "relationships": "document_id long, n int, id string, type string, state string, evidence int, from_id string, to_id string",
    "library": "symbol_id string, ports array<string>, required array<string>",
}
NAMES = [c.split(" ")[0] for c in SCHEMAS["objects"].split(", ")]
GOOD = [
    {"id": "a", "type": "junction", "x": 0.0, "y": 0.0}, {"id": "b", "type": "junction", "x": 9.0, "y": 0.0}, {"id": "p", "type": "pipe_segment", "start_id": "a", "end_id": "b", "x": 0.0, "y": 0.0, "x1": 9.0, "y1": 0.0},
    {"id": "s", "type": "symbol", "symbol_id": "valve"}, {"id": "t", "type": "annotation", "targets": ["p"]}, {"id": "d", "type": "dimension", "targets": ["p"]}, {"id": "u", "type": "unknown_mark"},
]
LINKS = [(1, 0, "r", "measures", "machine", 1, "d", "p"), (1, 1, "q", "callout_targets", "machine", 1, "t", "p")]
PORTS = [(1, 3, "in", "a"), (1, 3, "out", None)]


def found(spark, changed=None, layers=((1, 0, "l"),), ports=PORTS, links=LINKS, more=(), tolerance=1e-6):
    rows = [o | (changed or {}).get(o["id"], {}) for o in GOOD] + list(more)
    objects = [tuple(({"document_id": 1, "n": n, "state": "machine", "evidence": 1, "layer": "l", "targets": []} | o).get(c) for c in NAMES) for n, o in enumerate(rows)]
    given = {"layers": list(layers), "objects": objects, "ports": ports, "relationships": links, "library": [("valve", ["in", "out"], ["in"])]}
    made = validation.scene_issues(**{name: spark.createDataFrame(given[name], schema) for name, schema in SCHEMAS.items()}, tolerance=tolerance)
    return sorted((r.step, r.code, r.path, r.owner) for r in made.collect())


def test_a_good_scene_has_no_issue(spark):
    assert found(spark) == []
    assert found(spark, {"p": {"x1": 9.4}}, tolerance=0.5) == []


def test_ids_and_references(spark):
    made = found(spark, {"u": {"layer": "a"}, "t": {"targets": ["l"]}, "s": {"layer": None}}, ports=[(1, 3, "in", "d"), (1, 3, "out", "gone")], more=[{"id": "l", "type": "junction"}, {"id": "r", "type": "junction"}])
    assert made == [
        (0, "DUPLICATE_ID", "objects[7].id", "l"), (0, "DUPLICATE_ID", "relationships[0].id", "r"),
        (1, "UNKNOWN_REFERENCE", "objects[3].layerId", "s"), (1, "UNKNOWN_REFERENCE", 'objects[3].portNodeIds["out"]', "s"),
        (1, "WRONG_REFERENCE_TYPE", 'objects[3].portNodeIds["in"]', "s"), (1, "WRONG_REFERENCE_TYPE", "objects[4].targetObjectId", "t"), (1, "WRONG_REFERENCE_TYPE", "objects[6].layerId", "u"),
    ]


def test_pipes(spark):
    assert found(spark, {"p": {"end_id": "a"}}) == [(2, "PIPE_DEGENERATE", "objects[2].endNodeId", "p"), (2, "PIPE_ENDPOINT_MISMATCH", "objects[2].primitive.end", "p")]
    assert found(spark, {"p": {"x1": 0.0}}) == [(2, "PIPE_DEGENERATE", "objects[2].primitive", "p"), (2, "PIPE_ENDPOINT_MISMATCH", "objects[2].primitive.end", "p")]
    assert found(spark, {"p": {"x": float("nan"), "x1": float("inf")}}) == []  # values are another check's
    assert found(spark, {"p": {"start_id": "s"}}) == [(1, "WRONG_REFERENCE_TYPE", "objects[2].startNodeId", "p")]


def test_symbols_and_evidence(spark):
    assert found(spark, {"s": {"symbol_id": "what"}}) == [(3, "UNKNOWN_REFERENCE", "objects[3].symbolId", "s")]
    assert found(spark, ports=[(1, 3, "side", None)]) == [(3, "SYMBOL_PORT_UNKNOWN_NAME", 'objects[3].portNodeIds["side"](key)', "s"), (3, "SYMBOL_REQUIRED_PORT_MISSING", "objects[3].portNodeIds", "s")]
    assert found(spark, ports=[]) == [(3, "SYMBOL_REQUIRED_PORT_MISSING", "objects[3].portNodeIds", "s")]
    assert found(spark, {"u": {"evidence": 0}, "t": {"evidence": 0, "state": "confirmed"}}, links=[LINKS[0][:5] + (0, "d", "p"), LINKS[1]]) == [
        (4, "MACHINE_EVIDENCE_MISSING", "objects[6].interpretation.evidence", "u"), (4, "MACHINE_EVIDENCE_MISSING", "relationships[0].interpretation.evidence", "r"),
    ]


def test_relationships(spark):
    link = lambda kind, a, b, n=2: (1, n, "x", kind, "machine", 1, a, b)
    assert found(spark, links=[*LINKS, link("annotates", "p", "s")]) == [(5, "RELATIONSHIP_CONNECTIVITY_FORBIDDEN", "relationships[2]", "x")]
    assert found(spark, links=[*LINKS, link("annotates", "d", "p")]) == [(5, "RELATIONSHIP_INVALID_ENDPOINTS", "relationships[2].fromId", "x")]
    assert found(spark, links=[*LINKS, link("measures", "d", "u")]) == [(5, "DIMENSION_TARGET_MISMATCH", "relationships[2].toId", "x")]
    assert found(spark, links=[*LINKS, link("callout_targets", "l", "gone")]) == [(5, "UNKNOWN_REFERENCE", "relationships[2].toId", "x"), (5, "WRONG_REFERENCE_TYPE", "relationships[2].fromId", "x")]
    assert found(spark, links=LINKS[1:]) == [(5, "DIMENSION_TARGET_MISMATCH", "objects[5].targetObjectIds[0]", "d")]
    assert found(spark, {"d": {"targets": ["p", "gone"]}}) == [(1, "UNKNOWN_REFERENCE", "objects[5].targetObjectIds[1]", "d")]


def test_empty_tables(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    assert validation.scene_issues(**empty).collect() == []
