"""What grows faster than its input: hot keys, groups in one task, rows beyond what is asked for."""

import os
import random

from strokeline.llm import components, heavylight, store
from strokeline.operators import composites, control, integrity, lines, pixels
from strokeline.plans import stages
from strokeline.sources import shared
from strokeline.streaming import jobs as streams


def joined_rows(df):
    """The rows that come out of the largest join of a query, which is run."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found, left = [0], [plan]
    while left:
        node = left.pop()
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        left += [node.children().apply(n) for n in range(node.children().size())]
    return max(found)


def test_a_late_command_takes_its_place(spark, tmp_path):
    """states are kept as commands, in order whatever batch they came with."""
    rows = [("j", 1, 1, "enqueue"), ("j", 4, 4, "complete"), ("k", 1, 5, "enqueue")], [("j", 2, 2, "claim"), ("k", 2, 6, "cancel")]
    schema = "job_id string, ts long, event_id long, command string"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        for f in (tmp_path / "c").glob("*.parquet"):
            if f.stat().st_mtime > 2_000_000 * 2:
                os.utime(f, (1_000_000 * (n + 1),) * 2)
    made = streams.drained(streams.job_states(streams.read_stream(spark, str(tmp_path / "c"), schema, 1)), "update", "jobs")
    last = {(r.job_id, r.state, r.attempt, r.events) for r in made.where("batch = 1").collect()}
    whole = control.folded_jobs(spark.createDataFrame(rows[0] + rows[1], schema))
    assert last == {tuple(r) for r in whole.collect()} == {("j", "succeeded", 1, 3), ("k", "canceled", 0, 2)}


def test_edges_meet_a_shared_primitive_once(spark):
    """a primitive that all edges and segments share."""
    edges = spark.range(300).selectExpr("id + 1000 AS id", "array(7L, id) AS primitive_ids")
    segments = spark.range(300).selectExpr("id + 5 AS id", "array(7L) AS primitive_ids")
    made = composites.segments_of_edges(edges, segments)
    assert {(r.edge_id, r.segment_id) for r in made.collect()} == {(n + 1000, 5) for n in range(300)}
    assert joined_rows(made) <= 700


def test_one_kind_of_problem_is_many_groups(spark):
    """the rows of a kind aren't one group of a window."""
    rows = [(str(n * 37 % 200), "bad", str(n % 7)) for n in range(500)] + [("1", "rare", "x")] * 2
    found = spark.createDataFrame(rows, "owner string, code string, detail string")
    made = integrity.first_problems(found, "code", 5)
    assert "hashpartitioning(code" in (plan := made._jdf.queryExecution().executedPlan().toString())
    assert all("_b" in line for line in plan.splitlines() if " Window " in line)
    lines = {c: "; ".join(f"{c} {o} {d}" for o, k, d in sorted(rows) if k == c) for c in ("bad", "rare")}
    first = {"bad": "; ".join(lines["bad"].split("; ")[:5]), "rare": lines["rare"]}
    assert {(r.code, r.problems, r.message) for r in made.collect()} == {("bad", 500, first["bad"]), ("rare", 2, first["rare"])}


def test_references_are_not_sorted(spark):
    """references stream past the ids that exist, however many are to one id; null ones are no fault."""
    given = spark.createDataFrame([(n, 3 if n % 2 else 4) for n in range(100)] + [(100, None)], "owner long, ref long")
    made = integrity.missing(given, spark.createDataFrame([(3,), (3,), (5,), (None,)], "ref long"), "gone", ["ref"])
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.owner, r.code, r.detail) for r in made.collect()} == {(str(n), "gone", "4") for n in range(0, 100, 2)}
    assert made.count() == 50


def test_stretches_are_not_broadcast(spark, monkeypatch):
    """ends and splits of stretches, as many as polylines, stay off the driver."""
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, name)

    monkeypatch.setattr(lines, "stored", kept)
    vertices = spark.createDataFrame([(k, n, float(n), float(n * 7 % 5)) for k in range(3) for n in range(12)], "line long, pos long, x double, y double")
    assert lines.simplified(vertices, 0.5, ("line",)).count() > 6
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_thinning_goes_over_tiles(spark, monkeypatch):
    """F8, F9: a round writes a row for each tile of 8 x 8 pixels, not for each pixel, and thin ink takes one job."""
    rows = []
    monkeypatch.setattr(pixels, "stored", lambda df, name: (made := shared.stored(df, name), rows.append(made.count()))[0])
    ink = spark.createDataFrame([(0, x, y) for x in range(-16, 16) for y in range(-1, 2)], "document_id long, px long, py long")
    left = {(r.px, r.py) for r in pixels.thinned(ink).collect()}
    assert rows == [8] and left and all(y == 0 for _, y in left)


def test_tracing_ranks_pieces_of_tiles(spark, monkeypatch):
    """tables of a traced line have rows for its tiles, not for its pixels; a ring over several tiles is cut once."""
    rows = []
    monkeypatch.setattr(pixels, "stored", lambda df, name: (made := shared.stored(df, name), rows.append(made.count()))[0])
    line = [(0, n - 100, n // 2) for n in range(200)]
    ring = [(1, 9 + i, 9 + j) for i in range(-9, 10) for j in (abs(i) - 9, 9 - abs(i))] + [(1, 40, 40), (1, 41, 40)]
    made = pixels.traced(spark.createDataFrame(line + ring, "document_id long, px long, py long")).collect()
    assert max(rows) < 150
    lines = {}
    for r in sorted(made, key=lambda r: r.pos):
        lines.setdefault((r.document_id, r.line), []).append((r.px, r.py))
    walked = sorted(lines.items())
    assert len(walked) == 3 and sorted(walked[0][1]) == sorted(p[1:] for p in line)
    assert sorted(len(points) for key, points in walked[1:]) == [2, 37]
    closed = next(points for _, points in walked[1:] if len(points) == 37)
    assert closed[0] == closed[-1] == (0, 9) and set(closed) == {p[1:] for p in ring[:-2]}
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(closed, closed[1:]))


def test_lines_within_a_tile_keep_the_same_vertices(spark):
    """simplification of lines in arrays equals that in rounds, ties and closed lines included."""
    dice = random.Random(5)
    drawn = [[(dice.randrange(-1, 9), dice.randrange(-1, 9)) for _ in range(dice.randrange(2, 20))] for _ in range(200)]
    drawn += [[(0, 0), (3, 4), (0, 0)], [(0, 0), (0, 0)], [(0, 0), (2, 2), (4, 0), (6, 2), (8, 0)]]
    pieces = spark.createDataFrame([(0, k, [x for x, _ in p], [y for _, y in p]) for k, p in enumerate(drawn)], "document_id long, line long, xs array<tinyint>, ys array<tinyint>")
    rows = spark.createDataFrame([(0, k, n, float(x), float(y)) for k, p in enumerate(drawn) for n, (x, y) in enumerate(p)], "document_id long, line long, pos long, x double, y double")
    there = {r.line: r["count"] for r in lines.simplified(rows, 1.5).groupBy("line").count().collect()}
    assert {r.line: r.vertices for r in lines.left_of_pieces(pieces, 1.5).collect()} == there


def test_components_are_found_over_tiles(spark, monkeypatch):
    """ink is written by tiles; components are those of its pixels."""
    rows = {}
    monkeypatch.setattr(stages, "stored", lambda df, name: (made := shared.stored(df, name), rows.update({name: made.count()}))[0])
    found = stages.page_skeletons(spark, "/root/testdata/sf0.001").collect()
    assert 8 * rows["ink"] < sum(r.ink for r in found)
    dice = random.Random(3)
    ink = {(dice.randrange(-20, 20), dice.randrange(-20, 20)) for _ in range(500)}
    tiles = pixels.tiles_of(spark.createDataFrame([(7, *p) for p in ink], "document_id long, px long, py long"))
    made = pixels.tile_components(tiles).collect()
    nodes = {r.node: r.node for r in made}

    def root(n):
        while nodes[n] != n:
            n = nodes[n]
        return n

    for r in made:
        for other in r.links:
            nodes[root(r.node)] = root(other)
    areas = {}
    for r in made:
        areas[root(r.node)] = areas.get(root(r.node), 0) + r.area
    free, whole = set(ink), []
    around = lambda x, y: [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    while free:
        front, n = [free.pop()], 1
        while front:
            near = [p for p in around(*front.pop()) if p in free]
            free -= set(near)
            front += near
            n += len(near)
        whole.append(n)
    assert sorted(areas.values()) == sorted(whole)
    assert sum(r.junctions for r in made) == sum(len([q for q in around(*p) if q in ink]) >= 3 for p in ink)


def test_near_copies_meet_in_few_rows(spark, monkeypatch):
    """op12: a group of near copies, which min-hashes link, sends no subsets of its heads."""
    rows = {}
    monkeypatch.setattr(heavylight, "written", lambda df, name: (made := store.written(df, name), rows.update({name: made.count()}))[0])
    texts = [(n, " ".join(f"w{k}" if k != n + 20 else f"own{n}" for k in range(150))) for n in range(40)]
    made = heavylight.similar_texts(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4, percent=85).collect()
    assert {r.component_id for r in made} == {0} and len(made) == 40
    assert rows["prefixes"] == 40 and rows["members"] <= 40


def test_components_end_without_another_round(spark, monkeypatch):
    """op12: pairs need no round of stars and a star one, chains some, and components are those of the graph."""
    made = []
    monkeypatch.setattr(components, "written", lambda df, name: (made.append(name), store.written(df, name))[1])
    dice = random.Random(8)
    graphs = {
        1: [(n, n + 1) for n in range(0, 80, 2)],
        2: [(50, n) for n in range(90) if n != 50],
        9: [(n, n + 1) for n in range(60)] + [(100 + dice.randrange(80), 100 + dice.randrange(80)) for _ in range(50)] + [(None, 1), (7, 7), (300, 300)],
    }
    for most, edges in graphs.items():
        made.clear()
        found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert len(made) <= most
        root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
        for _ in range(len(root)):
            for a, b in edges:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        assert found == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_take_few_tables(spark, monkeypatch):
    """op12: each table is a shuffle over all partitions, whose tasks cost more than their rows in large groups of near copies."""
    made = []
    for module in (heavylight, components):
        monkeypatch.setattr(module, "written", lambda df, name: (made.append(name), store.written(df, name))[1])
    # near copies of two texts, and a chain of texts that only neighbours are similar to
    texts = [(1000 * g + n, " ".join(f"g{g}w{k}" if k != n + 20 else f"own{g}x{n}" for k in range(150))) for g in (1, 2) for n in range(40)]
    texts += [(n, " ".join(f"c{k}" for k in range(4 * n, 4 * n + 100))) for n in range(30)]
    found = heavylight.similar_texts(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(n, n // 1000 * 1000) for n, _ in texts}
    assert len(made) <= 24, made
