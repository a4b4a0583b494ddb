"""Every registered query against its SQL, and the operators without SQL against brute force."""

import math
import os

import duckdb
import pytest

from strokeline import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in plans.ORACLES:
        assert rows
        return
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    arranged = lambda rs, cs: sorted((tuple(plain(r[cs.index(c)]) for c in sorted(columns)) for r in rs), key=repr)
    assert arranged(rows, df.columns) == arranged(found.fetchall(), columns)


def test_spatial_joins_are_not_nested_loops(spark):
    for name in ("point_neighbourhoods", "interior_intersections", "points_in_symbols", "annotation_targets", "dimension_targets"):
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_streamed_and_folded_jobs_agree(spark):
    folded = {r.job_id: (r.state, r.attempt, r.events) for r in plans.QUERIES["folded_jobs"](spark, DATA).collect()}
    streamed = {r.job_id: (r.state, r.attempt, r.events) for r in plans.QUERIES["streamed_jobs"](spark, DATA).collect()}
    assert folded == streamed


def near(a, b, tolerance):
    return math.hypot(a[0] - b[0], a[1] - b[1]) <= tolerance


def leaders(ends, tolerance):
    """Cluster of each end by comparing it with every leader before it."""
    found, out = [], {}
    for key in sorted(ends):
        first = next((n for n, leader in enumerate(found) if near(ends[leader], ends[key], tolerance)), None)
        if first is None:
            found.append(key)
            first = len(found) - 1
        out[key] = first
    return out


@pytest.fixture(scope="module")
def drawn(spark):
    """Segments by page: {page: {id: (layer, x0, y0, x1, y1)}}."""
    from strokeline.sources.tables import segments

    out = {}
    for r in segments(spark, DATA).collect():
        out.setdefault(r.document_id, {})[r.id] = (r.layer_id, r.x0, r.y0, r.x1, r.y1)
    return out


def test_endpoint_clusters_and_topology_equal_brute_force(spark, drawn):
    clusters = {(r.document_id, r.cluster_id): (r.ends, r.x, r.y) for r in plans.QUERIES["endpoint_clusters"](spark, DATA).collect()}
    nodes = {(r.document_id, r.node): r for r in plans.QUERIES["topology_stage"](spark, DATA).collect()}
    for page, lines in drawn.items():
        ends = {2 * i + k: (s[1 + 2 * k], s[2 + 2 * k]) for i, s in lines.items() for k in (0, 1)}
        of = leaders(ends, 8.0)
        for c in set(of.values()):
            mine = [ends[e] for e in of if of[e] == c]
            n, x, y = clusters.pop((page, c))
            assert n == len(mine) and x == pytest.approx(sum(p[0] for p in mine) / n, abs=1e-5) and y == pytest.approx(sum(p[1] for p in mine) / n, abs=1e-5)
            edges = sorted(i for i in lines if of[2 * i] != of[2 * i + 1] and c in (of[2 * i], of[2 * i + 1]))
            r = nodes.pop((page, c))
            assert (r.ends, r.degree) == (n, len(edges)) and r.layers == sorted({lines[e // 2][0] for e in of if of[e] == c})
            if len(edges) == 2:
                a, b = (math.degrees(math.atan2(lines[i][4] - lines[i][2], lines[i][3] - lines[i][1])) % 180 for i in edges)
                bend = min(abs(a - b), 180 - abs(a - b))
                assert r.kind == ("elbow" if 55 <= bend <= 130 else "unknown")
            else:
                assert r.kind == ("endpoint" if len(edges) <= 1 else "tee")
    assert not clusters and not nodes


def test_merged_segments_equal_brute_force(spark, drawn):
    made = [(r.document_id, r.primitives, r.x0, r.y0, r.x1, r.y1) for r in plans.QUERIES["merged_segments"](spark, DATA).collect()]
    expected = []
    for page, lines in drawn.items():
        now = [(layer, (x0, y0), (x1, y1), {i}) for i, (layer, x0, y0, x1, y1) in sorted(lines.items())]

        def merge(a, b):
            turn = lambda s: math.degrees(math.atan2(s[2][1] - s[1][1], s[2][0] - s[1][0])) % 180
            d = abs(turn(a) - turn(b))
            if a[0] != b[0] or min(d, 180 - d) > 8.0 or min(math.dist(p, q) for p in a[1:3] for q in b[1:3]) > 14.0:
                return None
            points = [*a[1:3], *b[1:3]]
            far = max(math.dist(p, q) for p in points for q in points)
            p, q = next((points[i], points[j]) for i in range(4) for j in range(i + 1, 4) if math.dist(points[i], points[j]) == far)
            return a[0], p, q, a[3] | b[3]

        while (hit := next(((i, j) for i in range(len(now)) for j in range(i + 1, len(now)) if merge(now[i], now[j])), None)) is not None:
            i, j = hit
            now = [s for k, s in enumerate(now) if k not in hit] + [merge(now[i], now[j])]
        expected += [(page, len(s[3]), *s[1], *s[2]) for s in now]
    ends = lambda rows: sorted((r[0], r[1], *sorted([r[2:4], r[4:6]])) for r in rows)
    for mine, right in zip(ends(made), ends(expected), strict=True):
        assert mine[:2] == right[:2] and [*mine[2], *mine[3]] == pytest.approx([*right[2], *right[3]], abs=1e-5)


def test_greedy_witnesses_equal_brute_force(spark, drawn):
    from strokeline.sources.tables import boxes

    made = {(r.document_id, r.region_id): (r.segment_id, round(r.score, 9)) for r in plans.QUERIES["greedy_witnesses"](spark, DATA).collect()}
    expected, used = {}, set()
    for b in sorted((b for b in boxes(spark, DATA).collect() if b.kind == "dimension"), key=lambda b: (b.document_id, b.id)):
        best = None
        for i, (_, x0, y0, x1, y1) in sorted(drawn[b.document_id].items()):
            d = math.hypot((x0 + x1) / 2 - b.x - b.width / 2, (y0 + y1) / 2 - b.y - b.height / 2)
            score = math.hypot(x1 - x0, y1 - y0) / max(1.0, d)
            if d <= 48.0 and (b.document_id, i) not in used and (best is None or score > best[1]):
                best = (i, score)
        if best is not None:
            used.add((b.document_id, best[0]))
            expected[b.document_id, b.id] = (best[0], round(best[1], 9))
    assert made == expected


def test_jobs_equal_brute_force(spark):
    from strokeline.plans.control import job_commands
    from strokeline.sources.tables import table

    events = job_commands(table(spark, DATA, "events")).collect()
    jobs = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        state, attempt, n = jobs.get(e.job_id, ("new", 0, 0))
        if e.command == "enqueue" and state == "new":
            state = "queued"
        elif e.command == "claim" and state == "queued":
            state, attempt = "running", attempt + 1
        elif e.command == "retry" and state == "running":
            state = "failed" if attempt >= 3 else "queued"
        elif e.command == "cancel" and state in ("queued", "running"):
            state = "canceled"
        elif e.command in ("complete", "fail") and state == "running":
            state = "succeeded" if e.command == "complete" else "failed"
        jobs[e.job_id] = (state, attempt, n + 1)
    for name in ("folded_jobs", "streamed_jobs"):
        assert {r.job_id: (r.state, r.attempt, r.events) for r in plans.QUERIES[name](spark, DATA).collect()} == jobs


def test_uploads_equal_brute_force(spark):
    made = plans.QUERIES["checked_uploads"](spark, DATA).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert {r.id for r in made} == ids
    assert all((r.error is None) == (r.id % 3 != 0) for r in made)
