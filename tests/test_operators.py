import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeline.config import PROFILE
from strokeline.functions import geometry as G
from strokeline.functions import raster
from strokeline.functions import text as X
from strokeline.operators import checks, control, graph, review, snapping, spatial
from strokeline.sources import artifacts
from strokeline.sources.shared import new_folder
from strokeline.streaming.jobs import step


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def page(spark, segments, **columns):
    rows = [(0, n, n, "geometry", *map(float, s), [f"p{n}"]) for n, s in enumerate(segments)]
    return spark.createDataFrame(rows, "document_id int, ord long, id long, layer_id string, x0 double, y0 double, x1 double, y1 double, primitive_ids array<string>")


def test_crossing_stays_disconnected(spark):
    s = page(spark, [(24, 128, 232, 128), (128, 24, 128, 232)])
    met = spatial.interior_intersections(s, PROFILE.intersection_proximity).collect()
    assert [(r.x, r.y) for r in met] == [(128.0, 128.0)]
    scores = one(spark, graph.hypothesis_scores(F.lit(True), F.lit(90.0), F.lit(0.0)))
    assert scores.crossing == pytest.approx(0.45) and scores.tee == pytest.approx(0.2) and scores.recommended == "crossing"
    assert one(spark, graph.hypothesis_scores(F.lit(True), F.lit(20.0), F.lit(0.5))).recommended is None
    assert one(spark, graph.hypothesis_scores(F.lit(True), F.lit(90.0), F.lit(0.5))).recommended == "tee"
    assert one(spark, graph.hypothesis_scores(F.lit(False), F.lit(90.0), F.lit(0.5))).recommended == "crossing"


def test_clusters_follow_their_leader(spark):
    ends = spark.createDataFrame([(0, n, float(x), 0.0) for n, x in enumerate((0, 7, 14, 100))], "document_id int, ord long, x double, y double")
    made = {r.ord: r.cluster_id for r in graph.leader_clusters(ends).collect()}
    assert made == {0: 0, 1: 0, 2: 1, 3: 2}  # 14 is near 7 but not near the leader 0


def test_components_are_transitive(spark):
    nodes = spark.createDataFrame([(0, n) for n in range(6)], "document_id int, id long")
    edges = spark.createDataFrame([(0, 4, 3), (0, 3, 2), (0, 0, 1)], "document_id int, a long, b long")
    made = {r.node: r.component for r in graph.connected_components(edges, nodes, new_folder(spark, "c")).collect()}
    assert made == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}


def test_collinear_gaps_merge_only_over_ink(spark):
    s = page(spark, [(40, 128, 110, 128), (120, 128, 216, 128), (40, 0, 40, 60)])
    merged = graph.merged_collinear(s.withColumn("id", F.col("id").cast("string")), lambda p, *a: 1.0).collect()
    assert sorted(tuple(r.primitive_ids) for r in merged) == [("p0", "p1"), ("p2",)] and max(r.x1 - r.x0 for r in merged) == 176
    assert graph.merged_collinear(s.withColumn("id", F.col("id").cast("string")), lambda p, *a: 0.0).count() == 3


@pytest.mark.parametrize("radius", [3.0, 20.0, 64.0])
def test_radius_join_equals_all_pairs(spark, radius):
    rng = random.Random(1)
    rows = [(rng.randrange(2), n, rng.uniform(-100, 100), rng.uniform(-100, 100)) for n in range(150)]
    p = spark.createDataFrame(rows, "document_id int, id long, x double, y double")
    got = {(r.a, r.b) for r in spatial.radius_join(p, p, radius).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius}


def test_pairs_do_not_depend_on_order_or_cells(spark):
    rng = random.Random(2)
    s = page(spark, [[rng.uniform(0, 300) for _ in range(4)] for _ in range(60)])
    sets = [{(r.a.id, r.b.id) for r in spatial.interior_intersections(t, 6.0, cell=c).collect()} for t, c in ((s, 64.0), (s.repartition(3).orderBy(F.rand(1)), 17.0), (s, 1000.0))]
    assert sets[0] == sets[1] == sets[2] and sets[0]


def test_axis_model_and_snapping(spark):
    turn = lambda x, y, a: (200 + (x - 200) * math.cos(a) - (y - 200) * math.sin(a), 200 + (x - 200) * math.sin(a) + (y - 200) * math.cos(a))
    triad = [(70, 60, 70, 340), (110, 310, 310, 170 + 24.53), (110, 90, 310, 205.47)]
    s = page(spark, [*triad, (50, 350, 350, 50), (180, 200, 190, 199)]).withColumn("status", F.lit("accepted"))
    models = snapping.axis_models(s)
    reasons = {r.id: r.reason for r in snapping.snapped(s, models).collect()}
    assert [reasons[n] for n in range(5)] == ["snapped_to_axis"] * 3 + ["off_axis", "low_evidence"]
    assert models.first().confidence > 0.6 and turn(200, 200, 1) == (200, 200)
    none = snapping.snapped(s, models.limit(0))
    assert {r.reason for r in none.collect()} == {"weak_axis_model"}


def test_line_fit_rejects_and_accepts(spark):
    line = [(0, float(x), 2.0 * x) for x in range(20)]
    cloud = [(1, float(x), float((x * 7919) % 40)) for x in range(20)]
    made = {r.k: r for r in snapping.line_fit(spark.createDataFrame(line + cloud, "k int, x double, y double"), ["k"]).collect()}
    assert made[0].status == "accepted" and made[0].rms == pytest.approx(0, abs=1e-6) and made[0].angle == pytest.approx(math.degrees(math.atan(2)))
    assert made[1].status == "rejected"


def test_geometry(spark):
    v = lambda *x: [F.lit(float(a)) for a in x]
    assert one(spark, G.point_segment_distance(*v(0, 5, -3, 0, 3, 0))) == 5 and one(spark, G.point_segment_distance(*v(3, 4, 0, 0, 0, 0))) == 5
    assert one(spark, G.line_delta(*v(179, 1))) == 2 and one(spark, G.angle_delta(*v(350, 10))) == 20 and one(spark, G.shortest_turn(*v(10, 175))) == pytest.approx(-15)
    m = F.array(*v(2, 0, 5, 0, 3, -1, 0, 0, 1))
    back = one(spark, G.apply_matrix(G.multiply_matrices(G.invert_matrix(m), m), *v(7, 9)))
    assert (back.x, back.y) == pytest.approx((7, 9)) and one(spark, G.invert_matrix(F.array(*v(1, 2, 3, 2, 4, 6, 0, 0, 1)))) is None
    assert one(spark, G.polyline_length(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (3.0, 4.0), (3.0, 10.0))]))) == 11


@pytest.mark.parametrize(
    ("text", "value", "unit", "status", "confidence"),
    [("20 ft", 20.0, "ft", "parsed", 0.92), ("1'", 1.0, "ft", "parsed", 0.85), ("1' 6\"", 1.5, "ft", "parsed", 0.85), ('1"', 1.0, "in", "parsed", 0.88), ("'", None, None, "illegible", 0.2), ("", None, None, "none", 0.0), ("a'b\"", None, None, "ambiguous", 0.35)],
)
def test_dimensions(spark, text, value, unit, status, confidence):
    got = one(spark, X.parsed_dimension(F.lit(text)))
    assert (got.value, got.unit, got.status, got.confidence) == (value, unit, status, confidence)


def test_texts(spark):
    assert one(spark, X.parsed_dimension(F.lit("NPT"))) is None
    assert one(spark, X.normalized(F.lit("conn. to main"))) == "Conn. to MAIN"
    assert one(spark, X.normalized(F.lit("  "))) is None and one(spark, X.normalized(F.lit("Plain"))) is None
    assert one(spark, X.uuid5(uuid.NAMESPACE_URL, F.lit("été"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "été"))
    assert one(spark, X.number(F.lit(-0.0001))) == "0" and one(spark, X.number(F.lit(12.5))) == "12.5" and one(spark, X.number(F.lit(100.0))) == "100"
    assert one(spark, X.sanitized_filename(F.lit("../a\\b\x01c.png"))) == "bc.png" and one(spark, X.sanitized_filename(F.lit("a/"))) is None
    assert one(spark, X.xml_attribute(F.lit('<a&"\n'))) == "&lt;a&amp;&quot;&#10;" and one(spark, X.first_invalid_xml_character(F.lit("a\x02b"))) == "\x02"


def test_job_states(spark):
    def fold(*commands):
        rows = [("j", n, n, c) for n, c in enumerate(commands)]
        r = control.folded_jobs(spark.createDataFrame(rows, "job_id string, ts long, event_id long, command string")).first()
        state, attempt = "new", 0
        for c in commands:
            state, attempt = step(state, attempt, c)
        assert (r.state, r.attempt) == (state, attempt)
        return state

    assert fold("enqueue", "claim", "complete", "cancel") == "succeeded"
    assert fold("enqueue", "claim", "retry", "claim", "retry", "claim", "retry") == "failed"
    assert fold("enqueue", "cancel", "claim") == "canceled" and fold("claim") == "new" and fold("enqueue", "claim", "claim") == "running"


def test_checks_report_their_code(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "id string, ord int")
    assert [r.code for r in checks.duplicate_ids(ids).collect()] == ["DUPLICATE_ID"]
    refs = spark.createDataFrame([("p", "x", "a", "junction"), ("q", "x", "z", "junction"), ("r", "x", "a", "layer")], "owner string, path string, ref string, expected string")
    index = spark.createDataFrame([("a", "junction")], "id string, kind string")
    assert {(r.owner, r.code) for r in checks.reference_problems(refs, index).collect()} == {("q", "UNKNOWN_REFERENCE"), ("r", "WRONG_REFERENCE_TYPE")}
    points = spark.createDataFrame([(1, 0.0, 200.0), (2, -1.0, 5.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0)], "owner int, x double, y double")
    assert {(r.owner, r.code) for r in checks.out_of_bounds(points, 200, 200, "p").collect()} == {("2", "COORDINATE_OUT_OF_BOUNDS"), ("3", "NON_FINITE_NUMBER"), ("4", "NON_FINITE_NUMBER")}
    symbols = spark.createDataFrame([("s", "valve", {"in": "n1", "odd": None})], "id string, symbol_id string, ports map<string,string>")
    ports = spark.createDataFrame([("valve", "in", True), ("valve", "out", True)], "symbol_id string, name string, required boolean")
    assert sorted(r.code for r in checks.symbol_problems(symbols, ports).collect()) == ["SYMBOL_PORT_UNKNOWN_NAME", "SYMBOL_REQUIRED_PORT_MISSING"]
    relations = spark.createDataFrame([("r1", "measures", "d1", "e1"), ("r2", "connects", "a", "b")], "id string, type string, from_id string, to_id string")
    dims = spark.createDataFrame([("d1", "e1"), ("d2", "e2")], "id string, target string")
    assert sorted(r.code for r in checks.relationship_problems(relations, dims).collect()) == ["DIMENSION_TARGET_MISMATCH", "RELATIONSHIP_CONNECTIVITY_FORBIDDEN"]


def test_review_states(spark):
    items = spark.createDataFrame([("a", "open", "high"), ("b", "open", "low"), ("c", "confirmed", "critical"), ("d", "acknowledged_unknown", "critical")], "k string, state string, severity string")
    assert {r.k: r.review_state for r in review.review_state(items, "k").collect()} == {"a": "review_required", "b": "ready", "c": "ready", "d": "review_required"}


def test_immutable_store(spark):
    path = new_folder(spark, "store")
    outcome = lambda rows: {(r.key, r.outcome) for r in artifacts.write_immutable(spark.createDataFrame(rows, "key string, content binary"), path).collect()}
    assert outcome([("a", b"1"), ("b", b"2"), ("../c", b"3")]) == {("a", "written"), ("b", "written"), ("../c", "bad_key")}
    assert outcome([("a", b"1"), ("b", b"9"), ("d", b"4")]) == {("a", "unchanged"), ("b", "conflict"), ("d", "written")}
    assert {(r.key, bytes(r.content)) for r in spark.read.parquet(path).collect()} == {("a", b"1"), ("b", b"2"), ("d", b"4")}


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (7, 13), (5, 6, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(raster.decode_png(raster.encode_png(image)), image)
    assert raster.largest_difference(np.zeros((2, 2), np.uint8), np.full((2, 2), 2, np.uint8)) == 2


def test_rasters():
    mask = raster.drawn([(10, 50, 90, 50), (50, 10, 50, 90)], 101)
    thick = raster.dilated(raster.dilated(mask))
    skeleton = raster.thinned(thick)
    assert 120 <= skeleton.sum() <= 180 and raster.labelled(skeleton)[1] == 1
    assert np.array_equal(raster.thinned(skeleton * 255), skeleton)
    label, n = raster.labelled(raster.drawn([(0, 0, 5, 0), (20, 20, 20, 30)], 40))
    assert n == 2 and raster.component_boxes(label, n) == [(0, 0, 6, 1, 6), (20, 20, 1, 11, 11)]
    lines = raster.traced(raster.thinned(raster.drawn([(5, 5, 30, 5)], 40)))
    assert len(lines) == 1 and raster.simplified(lines[0], 1.5) in ([(5, 5), (30, 5)], [(30, 5), (5, 5)])
    assert raster.ink_coverage(mask, 10, 50, 90, 50) == 1.0 and raster.ink_coverage(mask, 10, 20, 40, 20) == 0.0
    assert raster.simplified([(0, 0), (1, 0.1), (2, 0), (2, 5)], 1.5) == [(0, 0), (2, 0), (2, 5)]


def test_lineage_of_any_depth(spark):
    rows = [(n, n - 1 if n % 150 else None) for n in range(300)] + [(900, 901), (901, 900), (902, 900), (903, 999)]
    made = control.lineage(spark.createDataFrame(rows, "revision_id long, parent_id long"), new_folder(spark, "lineage"))
    assert {tuple(r) for r in made.collect()} == {(n, n // 150 * 150, n % 150) for n in range(300)}


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(0, n) for n in range(300)], "document_id long, id long")
    edges = spark.createDataFrame([(0, (n * 7) % 300, ((n + 1) * 7) % 300) for n in range(299)], "document_id long, a long, b long")
    made = graph.connected_components(edges, nodes, new_folder(spark, "components"))
    assert {r.component for r in made.collect()} == {0} and made.count() == 300


def test_a_crossing_is_computed_once(spark):
    rows = [(0, n, float(n * 3), 0.0, float(90 - n * 3), 90.0) for n in range(31)]
    s = spark.createDataFrame(rows, "document_id long, id long, x0 double, y0 double, x1 double, y1 double")
    made = spatial.interior_intersections(s, 6.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, plan.split("\n"))) < 4000 and plan.count("explode(array(") + plan.count("Generate") >= 1
    lines = {r[1]: r[2:] for r in rows}

    def meets(a, b):
        (x1, y1, x2, y2), (x3, y3, x4, y4) = lines[a], lines[b]
        det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
        if abs(det) < 1e-9:
            return False
        x = ((x1 * y2 - y1 * x2) * (x3 - x4) - (x1 - x2) * (x3 * y4 - y3 * x4)) / det
        y = ((x1 * y2 - y1 * x2) * (y3 - y4) - (y1 - y2) * (x3 * y4 - y3 * x4)) / det
        inside = all(-0.02 <= ((x - u) * (w - u) + (y - v) * (z - v)) / ((w - u) ** 2 + (z - v) ** 2) <= 1.02 for u, v, w, z in (lines[a], lines[b]))
        return inside and all(math.hypot(x - u, y - v) > 6 for u, v in ((x1, y1), (x2, y2), (x3, y3), (x4, y4)))

    assert {(r["a"]["id"], r["b"]["id"]) for r in made.collect()} == {(a, b) for a in lines for b in lines if a < b and meets(a, b)}
