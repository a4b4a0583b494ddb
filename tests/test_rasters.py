"""Ink as tables of pixels against images in NumPy and plain walks; simplification, colours and leaders against brute force."""

import math
import random
from xml.parsers import expat

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeline import plans
from strokeline.functions import raster
from strokeline.operators import colours, edits, leaders, lines, nesting, payloads, pixels, profiles

RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
INK = "document_id long, px long, py long"


def images(seed, n=4, size=40):
    """Pages with thick and thin strokes, rings, dots and blobs, away from the edge."""
    rng, out = random.Random(seed), {}
    for page in range(n):
        mask = np.zeros((size, size), np.uint8)
        for _ in range(rng.randint(2, 5)):
            mask |= raster.drawn([tuple(rng.randint(4, size - 5) for _ in range(4))], size)
        if page % 2:
            mask = raster.dilated(mask)
        mask[6:16, 6:16] |= np.where((np.add.outer(np.arange(-5, 5) ** 2, np.arange(-5, 5) ** 2) // 4) == 5, 255, 0).astype(np.uint8)
        mask[30:34, 3:9] = 255
        mask[37, 37] = mask[2, 30] = mask[2, 31] = 255
        out[page] = mask
    return out


def ink_of(spark, pages):
    return spark.createDataFrame([(p, int(x), int(y)) for p, m in pages.items() for y, x in np.argwhere(m > 0)], INK)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.document_id, set()).add((r.px, r.py))
    return out


def points(mask):
    return {(int(x), int(y)) for y, x in np.argwhere(mask > 0)}


def near(p, ink):
    return [(p[0] + a, p[1] + b) for a, b in RING if (p[0] + a, p[1] + b) in ink]


def less_ends(ink):
    """One round of pruning, end after end in the order of an image."""
    ink = set(ink)
    for p in sorted((p for p in ink if len(near(p, ink)) == 1), key=lambda p: (p[1], p[0])):
        if len(near(p, ink)) == 1:
            ink.discard(p)
    return ink


def test_thinning_and_pruning_equal_images(spark):
    pages = images(1)
    df = ink_of(spark, pages)
    skeleton = pixels.thinned(df)
    expected = {p: points(raster.thinned(m)) for p, m in pages.items()}
    assert found(skeleton) == expected
    for rounds in (1, 3):
        left = expected
        for _ in range(rounds):
            left = {p: less_ends(ink) for p, ink in left.items()}
        assert found(pixels.pruned(skeleton, rounds)) == left
    assert pixels.thinned(spark.createDataFrame([], INK)).count() == 0


def test_morphology_equals_images(spark):
    pages = images(2)
    df = ink_of(spark, pages)
    assert found(pixels.dilated(df, 1)) == {p: points(raster.dilated(m)) for p, m in pages.items()}
    assert found(pixels.eroded(df, 1)) == {p: s for p, m in pages.items() if (s := points(raster.eroded(m)))}


def walked(ink):
    """Polylines between pixels that haven't two neighbours, and rings, as sets of their steps, and their points in order."""
    stops = {p for p in ink if len(near(p, ink)) != 2}
    done, out = set(), []
    for start in sorted(stops) + sorted(ink - stops):
        for second in near(start, ink):
            if frozenset((start, second)) in done or (start not in stops and any(start in e for e in done)):
                continue
            path = [start, second]
            while path[-1] not in stops and path[-1] != start:
                path.append(next(q for q in near(path[-1], ink) if q != path[-2]))
            done |= {frozenset(e) for e in zip(path, path[1:])}
            out.append(path)
    return out


def forms(paths):
    """Paths without direction; a ring begins at its least pixel."""
    return sorted(min(tuple(p), tuple(reversed(p))) for p in paths)


def test_tracing_equals_walks(spark):
    pages = {p: raster.thinned(m) for p, m in images(3, 5).items()}
    pages[9] = np.zeros((9, 9), np.uint8)
    for x, y in [(3, 1), (4, 2), (5, 3), (4, 4), (3, 5), (2, 4), (1, 3), (2, 2)]:  # a ring without a stop
        pages[9][y, x] = 1
    pages[10] = raster.drawn([(1, 1, 300, 1)], 310)  # a long line
    got = {}
    for r in pixels.traced(ink_of(spark, pages)).collect():
        got.setdefault((r.document_id, r.line), {})[r.pos] = (r.px, r.py)
    for p, m in pages.items():
        mine = [[v[k] for k in range(len(v))] for (page, _), v in got.items() if page == p]
        expected = walked(points(m))
        assert forms(mine) == forms(expected)
        edges = [frozenset(e) for path in mine for e in zip(path, path[1:])]
        assert len(edges) == len(set(edges)) == sum(len(near(q, points(m))) for q in points(m)) // 2


def test_distances_equal_brute_force(spark):
    pages = images(4, 3, 38)
    got = {(r.document_id, r.px, r.py): r.d2 for r in pixels.squared_distances(ink_of(spark, pages)).collect()}
    expected = {}
    for p, m in pages.items():
        free = np.argwhere(np.pad(m, 1) == 0) - 1
        for x, y in points(m):
            expected[p, x, y] = int(((free - [y, x]) ** 2).sum(axis=1).min())
    assert got == expected


def test_runs_and_masks_equal_sets(spark):
    rng = random.Random(5)
    a, b = ({(rng.randint(0, 2), rng.randint(0, 14), rng.randint(0, 5)) for _ in range(120)} for _ in "ab")
    runs = [pixels.runs_of(spark.createDataFrame(sorted(s), INK)) for s in (a, b)]
    overlapping = runs[0].union(runs[0].selectExpr("document_id", "py", "x0", "x0 as x1"))
    for op, expected in ((pixels.union, a | b), (pixels.intersection, a & b), (pixels.difference, a - b)):
        rows = op(overlapping, runs[1]).collect()
        assert {(r.document_id, x, r.py) for r in rows for x in range(r.x0, r.x1 + 1)} == expected
        assert sum(r.x1 - r.x0 + 1 for r in rows) == len(expected)
        assert len(rows) == sum((p, x - 1, y) not in expected for p, x, y in expected)  # as few runs as there can be


def test_simplification_equals_recursion(spark):
    rng = random.Random(6)
    shapes = {0: [(0, 0)], 1: [(0, 0), (3, 4)], 2: [(k, 0) for k in range(9)], 3: [(0, 0), (1, 0.1), (2, 0), (2, 5)], 4: [(5, 5), (9, 9), (1, 1), (5, 5)]}
    shapes |= {n: [(k + rng.random(), 6 * rng.random()) for k in range(rng.randint(3, 90))] for n in range(5, 12)}
    df = spark.createDataFrame([(1, n, k, float(x), float(y)) for n, v in shapes.items() for k, (x, y) in enumerate(v)], "document_id long, line long, pos long, x double, y double")
    got = {}
    for r in lines.simplified(df, 1.5).collect():
        got.setdefault(r.line, {})[r.pos] = (r.x, r.y)
    assert {n: [v[k] for k in sorted(v)] for n, v in got.items()} == {n: [tuple(map(float, p)) for p in raster.simplified(v, 1.5)] for n, v in shapes.items()}


def test_k_means_equals_plain_rounds(spark):
    rng = random.Random(7)
    rows = [(p, k, *(min(255, max(0, int(rng.gauss(c, 18)))) for c in rng.choice(((60, 60, 200), (200, 90, 90), (120, 220, 120))))) for p in range(4) for k in range((30, 90, 200, 400)[p])]
    rows += [(4, k, 50, 128, 130) for k in range(60)] + [(5, k, 50, 220, 30) for k in range(60)]  # black, and one colour
    df = spark.createDataFrame(rows, "document_id long, id long, l long, a long, b long")
    got = {(r.document_id, r.id): r.layer for r in colours.layers(df).collect()}
    black = lambda r: math.hypot(r[3] - 128, r[4] - 128) < 22
    expected = {}
    for p in range(6):
        mine = [r for r in rows if r[0] == p]
        coloured = [r for r in mine if not black(r)]
        distinct = sorted({r[2:] for r in coloured})
        expected |= {r[:2]: "black" if black(r) else "unclassified" for r in mine}
        if len(coloured) < 40 or len(distinct) < 2:
            continue
        k = min(4, max(2, len(coloured) // 40), len(distinct))
        centres = [tuple(map(float, distinct[(2 * j + 1) * len(distinct) // (2 * k)])) for j in range(k)]
        nearest = lambda c: min(range(k), key=lambda n: (sum((u - v) ** 2 for u, v in zip(c, centres[n])), n))  # noqa: B023, E731
        for _ in range(20):
            groups = [[r[2:] for r in coloured if nearest(r[2:]) == n] for n in range(k)]
            after = [tuple(sum(c) / len(g) for c in zip(*g)) if g else centres[n] for n, g in enumerate(groups)]
            moved = max(math.dist(u, v) for u, v in zip(centres, after))
            centres = after
            if moved <= 1.0:
                break
        groups = [[r for r in coloured if nearest(r[2:]) == n] for n in range(k)]
        large = sorted((n for n in range(k) if len(groups[n]) >= 40), key=lambda n: centres[n])
        for rank, n in enumerate(large, 1):
            expected |= {r[:2]: f"color_{rank}" for r in groups[n]}
    assert got == expected and len({v for v in got.values()}) >= 4


def test_colours_there_and_back(spark):
    rgb = spark.createDataFrame([(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)], "r long, g long, b long")
    lab = rgb.select("r", "g", "b", colours.to_lab(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    back = lab.select("r", "g", "b", "c", colours.to_rgb(F.col("c.l"), F.col("c.a"), F.col("c.b")).alias("t"))
    back = back.select("*", colours.to_lab(F.col("t.r"), F.col("t.g"), F.col("t.b")).alias("again")).collect()
    assert max(abs(r.c[k] - r.again[k]) for r in back for k in range(3)) <= 1  # a colour in whole numbers names others nearby
    named = {(r.r, r.g, r.b): tuple(r.c) for r in back}
    assert named[255, 255, 255] == (255, 128, 128) and named[0, 0, 0] == (0, 128, 128) and named[255, 0, 0] == (136, 208, 195)


def test_leaders_equal_walks(spark):
    pages = images(8, 3)
    rng = random.Random(9)
    starts = [(p, n, rng.randint(-30, 60), rng.randint(-30, 60)) for p in pages for n in range(25)] + [(1, 100, *min(points(pages[1])))]
    got = {}
    for r in leaders.traced_leaders(spark.createDataFrame(starts, "document_id long, id long, px long, py long"), ink_of(spark, pages)).collect():
        got.setdefault((r.document_id, r.id), {})[r.pos] = (r.px, r.py)
    expected = {}
    for p, n, x, y in starts:
        ink = points(pages[p])
        closest = lambda at, reach, seen: min(((q[0] - at[0]) ** 2 + (q[1] - at[1]) ** 2, q[1] - at[1], q[0] - at[0], q) for q in [*near_by(ink, at, reach, seen), (10**6, 10**6)])[3]
        path, seen = [(x, y)], set()
        if (x, y) not in ink:
            seed = closest((x, y), 24, seen)
            if seed not in ink:
                continue
            path.append(seed)
            seen.add(seed)
        for _ in range(32):
            step = closest(path[-1], 4, seen)
            if step not in ink:
                break
            path.append(step)
            seen.add(step)
        if len(path) >= 2:
            expected[p, n] = path
    assert {k: [v[n] for n in range(len(v))] for k, v in got.items()} == expected and any(len(v) > 20 for v in expected.values())


def near_by(ink, at, reach, seen):
    return [q for q in ink if abs(q[0] - at[0]) <= reach and abs(q[1] - at[1]) <= reach and q not in seen]


def test_skeleton_queries(spark):
    """The registered queries agree with each other and with images of the same ink."""
    folder = "/root/testdata/sf0.001"
    ink = found(plans.rasters.ink(spark, folder))
    thin = found(plans.QUERIES["thinned_strokes"](spark, folder))
    pruned = found(plans.QUERIES["pruned_skeletons"](spark, folder))
    traced = {}
    for r in plans.QUERIES["skeleton_lines"](spark, folder).collect():
        traced.setdefault(r.document_id, []).append((r.points, r.closed))
        assert 2 <= r.vertices <= r.points
    for page, own in ink.items():
        low = min(x for x, _ in own) - 1, min(y for _, y in own) - 1
        mask = np.zeros((max(y for _, y in own) - low[1] + 2, max(x for x, _ in own) - low[0] + 2), np.uint8)
        for x, y in own:
            mask[y - low[1], x - low[0]] = 1
        expected = {(x + low[0], y + low[1]) for x, y in points(raster.thinned(mask))}
        assert thin[page] == expected and pruned[page] == less_ends(less_ends(expected))
        assert sorted(traced[page]) == sorted((len(w), w[0] == w[-1]) for w in walked(pruned[page]))


def test_page_figures_equal_images(spark):
    from strokeline.sources.tables import segments

    folder, drawn = "/root/testdata/sf0.001", {}
    for r in segments(spark, folder).collect():
        drawn.setdefault(r.document_id, []).append(tuple((v + 256) / 2 for v in (r.x0, r.y0, r.x1, r.y1)))
    rows = {r.document_id: r for r in plans.QUERIES["page_skeletons"](spark, folder).collect()}
    assert set(rows) == set(drawn)
    for page, shapes in drawn.items():
        mask = raster.drawn(shapes, 256)
        skeleton = raster.thinned(raster.closed(mask))
        label, n = raster.labelled(skeleton)
        traced = walked(points(skeleton))
        r = rows[page]
        assert (r.ink, r.skeleton, r.components) == (int((mask > 0).sum()), int(skeleton.sum()), n)
        assert r.largest == max(b[4] for b in raster.component_boxes(label, n)) and r.junctions == int((raster.degrees(skeleton) >= 3).sum())
        assert r.polylines == len(traced) and 2 * len(traced) <= r.vertices <= sum(map(len, traced))


# --- markup, profiles, payloads, edits


def test_parsing_equals_expat(spark):
    texts = ["<svg/>", "<svg><g a='1>2'><line/></g></svg>", "<svg></g>", "<svg><g></svg></g>", "", "  ", "<a/><b/>", "</a>", "<a><!-- </a> --></a>", "<a><![CDATA[</a><b>]]></a>", "<a><b/><b><c/></b></a>", "<a>x < y</a><"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, svg string")
    deep = nesting.nested(nesting.tags(df, "id", "svg"), "id")
    broken = {r.id for r in nesting.parse_problems(deep, df, "id").collect()}
    paths = {}
    for r in nesting.paths(deep.where(~F.col("id").isin(*broken)), "id").collect():
        paths.setdefault(r.id, []).append((r.place, r.path))
    for n, text in enumerate(texts[:-1]):  # stray brackets in text are no tags here
        stack, counts, made = [], [{}], []

        def start(name, _):
            number = counts[-1][name] = counts[-1].get(name, 0) + 1
            stack.append(f"{stack[-1]}/{name}[{number}]" if stack else f"/{name}")
            counts.append({})
            made.append(stack[-1])

        def end(_):
            stack.pop()
            counts.pop()

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse(text, True)
        except expat.ExpatError:
            assert n in broken
            continue
        assert n not in broken and [p for _, p in sorted(paths[n])] == made


def test_thresholds_that_are_missing(spark):
    rows = profiles.threshold_rows(spark, {"a": plans.documents.PROFILE, "b@2.0.0": plans.documents.STRICT})
    assert profiles.missing_thresholds(rows).count() == 0 and profiles.structs(rows).count() == 2
    fewer = rows.where("not (profile = 'b' and name = 'max_snap_angle')").union(spark.createDataFrame([("a", "1.0.0", "max_residual", 1.0), ("c", "1.0.0", "max_residual", float("nan"))], rows.schema))
    missing = {(r.profile, r.name) for r in profiles.missing_thresholds(fewer).where("profile <> 'c'").collect()}
    assert missing == {("b", "max_snap_angle"), ("a", "max_residual")} and profiles.structs(fewer).count() == 0
    named = spark.createDataFrame([("a",), ("b@2.0.0",)], "p string").select(profiles.resolved(F.col("p")).alias("r")).collect()
    assert [tuple(r.r) for r in named] == [("a", "1.0.0"), ("b", "2.0.0")]


def test_payloads_of_any_shape(spark):
    rows = [(1, '{"a":{"b":[1,[2,{"c":null}]]},"d":"x"}'), (2, "not json"), (3, None), (4, "[]"), (5, '"s"')]
    made = {(r.id, r.path): (r.kind, r.value) for r in payloads.walked(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert made[1, "$.a.b[1][1].c"] == ("null", None) and made[1, "$.a.b[0]"] == ("number", "1") and made[1, "$.d"] == ("string", "x")
    assert made[2, "$"][0] == made[3, "$"][0] == "malformed" and made[4, "$"] == ("array", None) and made[5, "$"] == ("string", "s")
    bare = spark.range(1).select(payloads.without_nulls({"a": F.lit(1), "b": F.lit(None).cast("string")}).alias("j")).first().j
    assert bare == '{"a":1}'


def test_edits_are_all_or_none(spark):
    objects = spark.createDataFrame(
        [(1, 1, "dimension", None, None, "old", 0.0, 1.0, 1.0, 9.0, 9.0, "machine"), (1, 2, "annotation", "t", None, None, 0.0, 1.0, 1.0, 9.0, 9.0, "machine"), (2, 1, "dimension", None, None, "old", 0.0, 1.0, 1.0, 9.0, 9.0, "machine")],
        "document_id long, id long, type string, text string, symbol_id string, display_text string, rotation double, x double, y double, page_width double, page_height double, state string",
    )
    commands = spark.createDataFrame(
        [(1, 1, 1, "set_dimension_text", "a", None, None, None), (1, 1, 3, "set_dimension_text", "c", None, None, None), (1, 1, 2, "set_dimension_text", "b", None, None, None), (1, 2, 4, "move_annotation", None, None, 20.0, 2.0), (2, 1, 1, "set_dimension_text", "a", None, None, None), (2, 1, 2, "move_annotation", None, None, 1.0, 1.0), (2, 9, 3, "move_junction", None, None, 1.0, float("nan"))],
        "document_id long, object_id long, seq long, type string, value string, number double, x double, y double",
    )
    made, problems = edits.edited_scenes(objects, commands)
    assert {(r.document_id, r.id): (r.display_text, r.x, r.state, r.edited) for r in made.collect()} == {(1, 1): ("c", 1.0, "confirmed", True), (1, 2): (None, 20.0, "confirmed", True), (2, 1): ("old", 1.0, "machine", False)}
    assert {(r.seq, r.problem) for r in problems.collect()} == {(2, "wrong_type"), (3, "unknown_object")}
    assert [(r.id, r.problem) for r in edits.scene_problems(made).collect()] == [(2, "outside")]


@pytest.mark.parametrize("name", ["thinned_strokes", "skeleton_lines", "ink_distances", "markup_masks"])
def test_pages_are_never_one_group(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
