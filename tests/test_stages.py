"""Runs of stages that end and go on, and shapes of ink components against brute force."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from strokeline.operators import shapes, stages


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-stages-")


def chain(calls, fails=(), cancels=None, versions=("1", "1", "1"), rows=10):
    """Three stages, each on the one before, that note when they are made."""

    def maker(name, make):
        def run(spark, tables):
            calls.append(name)
            if name in fails:
                raise RuntimeError(name)
            if name == cancels:
                stages.Store(spark, chain.folder).cancel()
            return make(spark, tables)

        return run

    return [
        stages.Stage("numbers", maker("numbers", lambda spark, t: spark.range(rows).withColumn("v", F.col("id") * 2)), version=versions[0]),
        stages.Stage("evens", maker("evens", lambda spark, t: t["numbers"].where("v % 4 = 0")), ("numbers",), versions[1]),
        stages.Stage("total", maker("total", lambda spark, t: t["evens"].agg(F.sum("v").alias("v"))), ("evens", "numbers"), versions[2]),
    ]


def test_a_run_goes_on_where_it_ended(spark, folder):
    calls = []
    broken = stages.run(spark, folder, chain(calls, fails=("total",)))
    assert (broken.state, broken.failed_stage, str(broken.error), calls) == ("failed", "total", "total", ["numbers", "evens", "total"])
    assert [r.stage for r in stages.manifests(spark, folder, chain([])).orderBy("ord").collect()] == ["numbers", "evens"]
    calls.clear()
    whole = stages.run(spark, folder, chain(calls))
    assert (whole.state, whole.ran, whole.skipped, calls) == ("succeeded", ["total"], ["numbers", "evens"], ["total"])
    assert whole.tables["total"].first().v == 40
    again = stages.run(spark, folder, chain(calls))
    assert again.ran == [] and calls == ["total"] and again.tables["total"].first().v == 40


def test_another_version_makes_what_follows_anew(spark, folder):
    stages.run(spark, folder, chain([]))
    same = stages.run(spark, folder, chain([], versions=("2", "1", "1")))
    assert same.ran == ["numbers"]  # its table is as before, so the others stay
    more = stages.run(spark, folder, chain([], versions=("3", "1", "1"), rows=20))
    assert more.ran == ["numbers", "evens", "total"] and more.tables["total"].first().v == 180
    assert {r.stage: (r.version, r.attempt) for r in stages.manifests(spark, folder, chain([])).collect()} == {"numbers": ("3", 3), "evens": ("1", 2), "total": ("1", 2)}


def test_a_request_to_cancel_is_read_behind_each_stage(spark, folder):
    chain.folder = folder
    out = stages.run(spark, folder, chain([], cancels="numbers"))
    assert (out.state, out.ran) == ("canceled", ["numbers"])


def test_stages_are_checked(spark, folder):
    one = stages.Stage("a", lambda spark, t: spark.range(1))
    with pytest.raises(ValueError):
        stages.run(spark, folder, [one, one])
    with pytest.raises(ValueError):
        stages.run(spark, folder, [stages.Stage("b", one.make, ("a",)), one])


def blobs(seed, n):
    rng = random.Random(seed)
    out = {0: {(3, 4)}, 1: {(x, 7) for x in range(5)}, 2: {(2, y) for y in range(4)}, 3: {(k, 2 * k) for k in range(6)}, 4: {(x, y) for x in range(4) for y in range(3)}}
    for k in range(5, n):
        w, h = rng.randint(2, 12), rng.randint(2, 9)
        out[k] = {(rng.randint(-w, w), rng.randint(-h, h)) for _ in range(rng.randint(1, 40))}
    return out


def hull_of(points):
    """Corners, by taking away every point that lies inside a triangle or on a segment of others."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    corners = set()
    for p in points:
        others = sorted(points - {p}, key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0]))
        angles = [math.atan2(q[1] - p[1], q[0] - p[0]) for q in others]
        gaps = [(b - a) % (2 * math.pi) for a, b in zip(angles, angles[1:] + angles[:1])]
        if len(set(angles)) <= 1 or max(gaps) > math.pi + 1e-9:
            corners.add(p)
    assert all(turn(a, b, c) for a in corners for b in corners for c in corners if len({a, b, c}) == 3)
    return corners


def test_features_and_hulls_equal_brute_force(spark):
    pages = blobs(3, 40)
    ink = spark.createDataFrame([(k, x, y) for k, ps in pages.items() for x, y in ps], "c long, px long, py long")
    made = {r.c: r for r in shapes.component_features(ink, ["c"]).collect()}
    hulls = {r.c: r for r in shapes.hulls(ink, ["c"]).withColumn("r", shapes.least_rectangle()).collect()}
    for k, ps in pages.items():
        x0, x1, y0, y1 = min(p[0] for p in ps), max(p[0] for p in ps), min(p[1] for p in ps), max(p[1] for p in ps)
        w, h, r = x1 - x0 + 1, y1 - y0 + 1, made[k]
        half = w // 2
        unlike = sum(((x0 + c, y) in ps) != ((x1 - c, y) in ps) for c in range(half) for y in range(y0, y1 + 1))
        assert (r.x, r.y, r.width, r.height, r.area) == (x0, y0, w, h, len(ps))
        assert (r.aspect, r.fill, r.symmetry) == pytest.approx((w / h, len(ps) / (w * h), 1 - unlike / (half * h) if half else 0.0))
        hull = [(p.x, p.y) for p in hulls[k].hull]
        assert set(hull) == hull_of(ps) and len(hull) == len(set(hull)) and hull[0] == min(ps)
        assert all((b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2]) if len(hull) > 2)
        best = min((spread(hull, math.atan2(b[1] - a[1], b[0] - a[0])) for a, b in zip(hull, hull[1:] + hull[:1]) if a != b), default=0.0)
        assert hulls[k].r.area == pytest.approx(best, abs=1e-5)
        finer = min(spread(hull, t * math.pi / 720) for t in range(720))
        assert hulls[k].r.area <= finer + 1e-5 and 0 <= hulls[k].r.angle < 90


def spread(points, angle):
    u = [x * math.cos(angle) + y * math.sin(angle) for x, y in points]
    v = [y * math.cos(angle) - x * math.sin(angle) for x, y in points]
    return (max(u) - min(u)) * (max(v) - min(v))


def test_best_shapes_equal_written_out_scores(spark):
    from strokeline import plans

    score = {
        "ball_valve": lambda a, f, s, v: 0.5 + 0.2 * s + 0.1 * (1 - abs(a - 1.5)), "block_bleed_assembly": lambda a, f, s, v: 0.35 + 0.15 * s + 0.1 * f, "tee_fitting": lambda a, f, s, v: 0.2 + 0.1 * s,
        "elbow_fitting": lambda a, f, s, v: 0.2 + 0.1 * s, "flange": lambda a, f, s, v: 0.4 + 0.3 * s + 0.2 * (a > 1.2), "threaded_connection": lambda a, f, s, v: 0.3 + 0.2 * s, "drop": lambda a, f, s, v: 0.35 + 0.25 * (v <= 4),
        "riser": lambda a, f, s, v: 0.35 + 0.25 * (v <= 4), "endpoint": lambda a, f, s, v: 0.35 + 0.2 * f, "flow_arrow": lambda a, f, s, v: 0.3 + 0.4 * (v <= 4) + 0.2 * (a > 1.0), "equipment_connection": lambda a, f, s, v: 0.3 + 0.2 * (a < 1.2), "unknown": lambda a, f, s, v: 0.25 + 0.15 * f,
    }
    folder = "/root/testdata/sf0.001"
    features = {(r.document_id, r.id): r for r in plans.QUERIES["region_features"](spark, folder).collect()}
    rows = plans.QUERIES["shaped_symbols"](spark, folder).collect()
    assert {(r.document_id, r.id) for r in rows} == set(features) and {r.kind for r in rows} == {"symbol", "arrow"}
    for r in rows:
        f = features[r.document_id, r.id]
        best = {n: min(1.0, max(0.0, g(f.aspect, f.fill, f.symmetry, r.corners))) for n, g in score.items()}
        if r.kind == "arrow":
            best["flow_arrow"] = 0.85
        assert r.shape == pytest.approx(max(best.values()), abs=2e-6) and best[r.symbol_id] == pytest.approx(r.shape, abs=2e-6)
