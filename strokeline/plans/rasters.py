"""Queries of ink as tables of pixels: skeletons, lines, distances, masks, colours and leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import colours, evidence, leaders, lines, pixels, ranking, shapes, stages
from ..sources.shared import new_folder, stored
from ..sources.tables import BOXES_SQL, SEGMENTS_SQL, boxes, segments, table
from .registry import query
from .spatial import _TRACE_SQL, _trace

#: Pixels of these queries are two units wide.
SIZE = 2.0
_STEPS = "greatest(CAST(ceil(2*sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/2.0) AS INTEGER), 1)"
_AT = "CAST(floor((x0+(x1-x0)*k/n)/2.0) AS BIGINT) AS px, CAST(floor((y0+(y1-y0)*k/n)/2.0) AS BIGINT) AS py"
_WALK_SQL = f"SELECT document_id, id, k, {_AT} FROM (SELECT document_id, id, x0, y0, x1, y1, n, unnest(range(0, n+1)) AS k FROM (SELECT *, {_STEPS} AS n FROM ({SEGMENTS_SQL})))"
THIN_SQL = f"SELECT DISTINCT document_id, px, py FROM ({_WALK_SQL})"
INK_SQL = f"SELECT DISTINCT document_id, px+i AS px, py+j AS py FROM ({THIN_SQL}), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)"


def ink(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of every page, drawn three pixels wide."""
    return stored(pixels.dilated(evidence.ink_pixels(segments(spark, folder), SIZE), 1), "ink")


def _thin(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of the skeleton of every page's ink."""
    return pixels.thinned_tiles(pixels.tiles_of(evidence.walked_pixels(segments(spark, folder), SIZE)), widen=True)


@query()
def thinned_strokes(spark: SparkSession, folder: str) -> DataFrame:
    """The skeleton of every page's ink, and what each of its pixels touches."""
    return pixels.tile_degrees(_thin(spark, folder)).select("document_id", "px", "py", "degree")


@query()
def pruned_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    """The skeleton of every page's ink without its shortest branches."""
    return pixels.pixels_of(pixels.pruned_tiles(_thin(spark, folder), 2))


def left_of_lines(pieces: DataFrame, epsilon: float) -> DataFrame:
    """document_id, line and vertices: how many simplification leaves. Lines within a tile are rows of their own; the others go through rounds."""
    whole = lines.left_of_pieces(pieces.where("whole"), epsilon)
    longer = pixels.vertices_of(pieces.where("not whole")).withColumnsRenamed({"px": "x", "py": "y"})
    return whole.union(lines.simplified(longer, epsilon).groupBy("document_id", "line").agg(F.count("*").alias("vertices")))


@query()
def skeleton_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The polylines of every page's skeleton: points, whether it is closed, and the vertices that simplification leaves."""
    made = stored(pixels.traced_pieces(pixels.pruned_tiles(_thin(spark, folder), 2)), "lines")
    at = lambda k: F.struct((F.col("tx") * pixels.TILE + F.element_at("xs", k)).alias("px"), (F.col("ty") * pixels.TILE + F.element_at("ys", k)).alias("py"))
    ends = made.groupBy("document_id", "line").agg((F.sum("n") + 1).alias("points"), (F.min_by(at(1), "pos") == F.max_by(at(-1), "pos")).alias("closed"))
    return ends.join(left_of_lines(made, 1.5).hint("merge"), ["document_id", "line"])


@query(f"""WITH RECURSIVE t AS (SELECT user_id, k, CAST(k AS DOUBLE) AS x, value AS y FROM ({_TRACE_SQL})), e AS (SELECT user_id, min(k) AS a, max(k) AS b FROM t GROUP BY user_id),
s(user_id, a, b) AS (SELECT user_id, a, b FROM e UNION ALL SELECT user_id, unnest([a, p]), unnest([p, b]) FROM (
  SELECT s.user_id, s.a, s.b, arg_max(v.k, struct_pack(d := CASE WHEN sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y))>0 THEN abs((q.x-p.x)*(v.y-p.y)-(q.y-p.y)*(v.x-p.x))/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) ELSE sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)) END, n := -v.k)) AS p,
    max(CASE WHEN sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y))>0 THEN abs((q.x-p.x)*(v.y-p.y)-(q.y-p.y)*(v.x-p.x))/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) ELSE sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)) END) AS far
  FROM s JOIN t p ON p.user_id=s.user_id AND p.k=s.a JOIN t q ON q.user_id=s.user_id AND q.k=s.b JOIN t v ON v.user_id=s.user_id AND v.k>s.a AND v.k<s.b GROUP BY s.user_id, s.a, s.b) WHERE far>20.0),
k AS (SELECT user_id, a AS k FROM s UNION SELECT user_id, b FROM s) SELECT k.user_id, k.k, t.y AS value FROM k JOIN t USING (user_id, k)""")
def simplified_traces(spark: SparkSession, folder: str) -> DataFrame:
    """The traces of users, simplified to within 20 units."""
    t = _trace(spark, folder).select("user_id", F.col("k").cast("long").alias("k"), F.col("k").cast("double").alias("x"), F.col("value").alias("y"))
    made = lines.simplified(t, 20.0, ("user_id",), "k")
    return made.select("user_id", "k", F.col("y").alias("value"))


_DISTANCES_SQL = f"""i AS ({INK_SQL}), c AS (SELECT *, py-row_number() OVER (PARTITION BY document_id, px ORDER BY py) AS run FROM i),
g AS (SELECT document_id, px, py, least(py-min(py) OVER w, max(py) OVER w-py)+1 AS g FROM c WINDOW w AS (PARTITION BY document_id, px, run)),
z AS (SELECT * FROM g UNION ALL SELECT document_id, unnest(list_filter(range(lo-1, hi+2), lambda x: NOT list_contains(xs, x))), py, 0 FROM (SELECT document_id, py, min(px) AS lo, max(px) AS hi, list(px) AS xs FROM g GROUP BY document_id, py)),
d AS (SELECT g.document_id, g.px, g.py, min((g.px-z.px)*(g.px-z.px)+z.g*z.g) AS d2 FROM g JOIN z ON z.document_id=g.document_id AND z.py=g.py GROUP BY ALL)"""


@query(f"WITH {_DISTANCES_SQL} SELECT document_id, px, py, CAST(d2 AS BIGINT) AS d2 FROM d")
def ink_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The squared distance of every ink pixel to the nearest pixel without ink."""
    return pixels.squared_distances(ink(spark, folder)).select("document_id", "px", "py", F.col("d2").cast("long").alias("d2"))


@query(f"""WITH {_DISTANCES_SQL}, w AS ({_WALK_SQL}), n AS (SELECT document_id, id, count(*) AS n FROM w GROUP BY ALL)
SELECT w.document_id, w.id AS line, round(quantile_cont(2*sqrt(d2), 0.5), 6) AS width FROM w JOIN n USING (document_id, id) JOIN d USING (document_id, px, py) WHERE k % greatest(1, n // 10)=0 GROUP BY ALL""")
def stroke_widths(spark: SparkSession, folder: str) -> DataFrame:
    """The width of the ink along every segment: the median at every tenth of its points."""
    steps = F.greatest(F.ceil(2 * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / SIZE).cast("int"), F.lit(1))
    walked = segments(spark, folder).withColumn("n", steps).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c: F.floor((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("pos") / F.col("n")) / SIZE).cast("long")
    walked = walked.select("document_id", F.col("id").alias("line"), "pos", at("x").alias("px"), at("y").alias("py"))
    made = pixels.stroke_widths(walked, pixels.squared_distances(ink(spark, folder)), 50.0)
    return made.withColumn("width", F.round("width", 6))


_REGION = "CAST(floor({}/2.0) AS BIGINT)"
_BOX_SQL = f"SELECT document_id, kind, {_REGION.format('x')} AS x0, {_REGION.format('(x+width)')}-1 AS x1, {_REGION.format('y')} AS y0, {_REGION.format('(y+height)')}-1 AS y1 FROM ({BOXES_SQL})"
_RUNS = "SELECT document_id, py, min(px) AS x0, max(px) AS x1 FROM (SELECT *, px-row_number() OVER (PARTITION BY document_id, py ORDER BY px) AS run FROM {}) GROUP BY document_id, py, run"


def _covered(kinds: str, pad: int) -> str:
    return f"EXISTS (SELECT 1 FROM b WHERE b.document_id=i.document_id AND kind IN ({kinds}) AND px BETWEEN x0-{pad} AND x1+{pad} AND py BETWEEN y0-{pad} AND y1+{pad})"


def _regions(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    b = boxes(spark, folder).where(F.col("kind").isin(kinds))
    return b.select("document_id", *[(F.col(c) / SIZE).alias(c) for c in ("x", "y", "width", "height")])


@query(f"""WITH i AS ({INK_SQL}), b AS ({_BOX_SQL}), m AS (SELECT *, {_covered("'text','symbol','dimension'", 0)} AS p FROM i), kept AS (SELECT document_id, px, py FROM m WHERE NOT p), held AS (SELECT document_id, px, py FROM m WHERE p)
SELECT 'geometry' AS mask, document_id, py, x0, x1 FROM ({_RUNS.format('kept')}) UNION ALL SELECT 'protected', document_id, py, x0, x1 FROM ({_RUNS.format('held')})""")
def protection_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ink inside the regions of text, symbols and dimensions, and of the ink that is left as geometry."""
    runs, held = stored(pixels.runs_of(ink(spark, folder)), "runs"), pixels.box_runs(_regions(spark, folder, ["text", "symbol", "dimension"]))
    geometry, inside = pixels.difference(runs, held), pixels.intersection(runs, held)
    return geometry.select(F.lit("geometry").alias("mask"), "*").union(inside.select(F.lit("protected"), "*"))


@query(f"""WITH i AS ({INK_SQL}), b AS ({_BOX_SQL}), t AS ({THIN_SQL}), p AS (SELECT DISTINCT document_id, px+i AS px, py+j AS py FROM (SELECT document_id, px, py FROM ({_WALK_SQL}) WHERE id % 3=0), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)),
m AS (SELECT i.*, p.px IS NOT NULL AS pipe, {_covered("'dimension'", 24).replace('px BETWEEN', 'i.px BETWEEN').replace('py BETWEEN', 'i.py BETWEEN')} AS near, {_covered("'text','symbol','dimension'", 0).replace('px BETWEEN', 'i.px BETWEEN').replace('py BETWEEN', 'i.py BETWEEN')} AS inside FROM i LEFT JOIN p USING (document_id, px, py)),
kept AS (SELECT document_id, px, py FROM m WHERE (NOT pipe OR near) AND NOT inside) {_RUNS.format('kept')}""")
def markup_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the ink that may be markup: no pipes (every third segment) save near dimensions, and nothing inside regions."""
    pipes = pixels.dilated(evidence.ink_pixels(segments(spark, folder).where("id % 3 = 0"), SIZE), 1)
    dimensions = pixels.box_runs(_regions(spark, folder, ["dimension"]), 24)
    regions = pixels.box_runs(_regions(spark, folder, ["text", "symbol", "dimension"]))
    return pixels.markup_runs(pixels.runs_of(ink(spark, folder)), pixels.runs_of(pipes), dimensions, regions)


_RGB_SQL = "SELECT vec_id // 64 AS document_id, vec_id*21+j AS id, " + ", ".join(f"CAST(least(greatest(floor(128+512*CAST(embedding[3*j+{k}] AS DOUBLE)), 0), 255) AS BIGINT) AS {c}" for k, c in enumerate("rgb", 1)) + " FROM embeddings, (SELECT unnest(range(0, 21)) AS j)"
_LINEAR = "CASE WHEN {0}/255.0<=0.04045 THEN {0}/255.0/12.92 ELSE pow(({0}/255.0+0.055)/1.055, 2.4) END"
_ROOT = "CASE WHEN {0}>0.008856 THEN cbrt({0}) ELSE 7.787*{0}+16.0/116.0 END"
_LAB_SQL = f"""WITH p AS ({_RGB_SQL}), n AS (SELECT document_id, id, {_LINEAR.format('CAST(r AS DOUBLE)')} AS r, {_LINEAR.format('CAST(g AS DOUBLE)')} AS g, {_LINEAR.format('CAST(b AS DOUBLE)')} AS b FROM p),
x AS (SELECT document_id, id, (0.412453*r+0.357580*g+0.180423*b)/0.950456 AS x, 0.212671*r+0.715160*g+0.072169*b AS y, (0.019334*r+0.119193*g+0.950227*b)/1.088754 AS z FROM n),
f AS (SELECT document_id, id, CASE WHEN y>0.008856 THEN 116.0*cbrt(y)-16.0 ELSE 903.3*y END AS l, {_ROOT.format('x')} AS x, {_ROOT.format('y')} AS y, {_ROOT.format('z')} AS z FROM x)
SELECT document_id, id, CAST(least(greatest(floor(l*255.0/100.0+0.5), 0), 255) AS BIGINT) AS l, CAST(least(greatest(floor(500.0*(x-y)+128.5), 0), 255) AS BIGINT) AS a, CAST(least(greatest(floor(200.0*(y-z)+128.5), 0), 255) AS BIGINT) AS b FROM f"""


def lab_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, id, l, a, b: 21 coloured pixels for each vector."""
    byte = lambda k: F.least(F.greatest(F.floor(128 + 512 * F.get("embedding", 3 * F.col("j") + k).cast("double")), F.lit(0)), F.lit(255))
    e = table(spark, folder, "embeddings").select(F.expr("vec_id div 64").alias("document_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    made = e.select("document_id", (F.col("vec_id") * 21 + F.col("j")).alias("id"), colours.to_lab(byte(0), byte(1), byte(2)).alias("c"))
    return made.select("document_id", "id", "c.l", "c.a", "c.b")


@query(_LAB_SQL)
def lab_colours(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels in LAB."""
    return lab_pixels(spark, folder)


_NEAR = "list_transform({0}, lambda s: (l-s.l)*(l-s.l)+(a-s.a)*(a-s.a)+(b-s.b)*(b-s.b))"
_CUBE = "CASE WHEN {0}>6.0/29.0 THEN {0}*{0}*{0} ELSE ({0}-16.0/116.0)/7.787 END"
_BYTE = "CAST(least(floor(255.0*CASE WHEN {0}<=0.0031308 THEN 12.92*{0} ELSE 1.055*pow({0}, 1.0/2.4)-0.055 END+0.5), 255) AS BIGINT)"
_LAYERS_SQL = f"""WITH RECURSIVE t AS (SELECT *, sqrt((a-128.0)*(a-128.0)+(b-128.0)*(b-128.0))<22.0 AS black FROM ({_LAB_SQL})), c AS (SELECT document_id, l, a, b, count(*) AS n FROM t WHERE NOT black GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY l, a, b) AS rank, count(*) OVER (PARTITION BY document_id) AS m, sum(n) OVER (PARTITION BY document_id) AS px FROM c),
e AS (SELECT *, unnest(range(0, k)) AS j FROM (SELECT *, CAST(least(4, greatest(2, px // 40), m) AS BIGINT) AS k FROM k WHERE px>=40 AND m>=2)),
r(document_id, it, z, go) AS (SELECT document_id, 0, list(struct_pack(l := CAST(l AS DOUBLE), a := CAST(a AS DOUBLE), b := CAST(b AS DOUBLE)) ORDER BY j), true FROM e WHERE rank=(2*j+1)*m // (2*k)+1 GROUP BY document_id
  UNION ALL SELECT document_id, it+1, y, list_max(list_transform(range(1, len(z)+1), lambda i: (z[i].l-y[i].l)*(z[i].l-y[i].l)+(z[i].a-y[i].a)*(z[i].a-y[i].a)+(z[i].b-y[i].b)*(z[i].b-y[i].b)))>1.0 FROM (
    SELECT document_id, it, z, list_transform(range(1, len(z)+1), lambda i: coalesce(list_filter(g, lambda x: x.p=i)[1].v, z[i])) AS y FROM (
      SELECT document_id, it, any_value(z) AS z, list(struct_pack(p := p, v := v)) AS g FROM (
        SELECT document_id, it, p, any_value(z) AS z, struct_pack(l := CAST(sum(l*n) AS DOUBLE)/CAST(sum(n) AS DOUBLE), a := CAST(sum(a*n) AS DOUBLE)/CAST(sum(n) AS DOUBLE), b := CAST(sum(b*n) AS DOUBLE)/CAST(sum(n) AS DOUBLE)) AS v FROM (
          SELECT r.document_id, it, z, l, a, b, n, list_position({_NEAR.format('z')}, list_min({_NEAR.format('z')})) AS p FROM r JOIN c ON c.document_id=r.document_id WHERE go AND it<20) GROUP BY document_id, it, p) GROUP BY document_id, it))),
f AS (SELECT document_id, arg_max(z, it) AS z FROM r GROUP BY document_id), h AS (SELECT t.*, z, CASE WHEN NOT black AND z IS NOT NULL THEN list_position({_NEAR.format('z')}, list_min({_NEAR.format('z')})) END AS p FROM t LEFT JOIN f USING (document_id)),
u AS (SELECT document_id, p, count(*) AS px, any_value(z)[p] AS v FROM h WHERE p IS NOT NULL GROUP BY document_id, p), o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY v.l, v.a, v.b) AS rank FROM u WHERE px>=40),
y AS (SELECT h.document_id, CASE WHEN black THEN 'black' WHEN rank IS NULL THEN 'unclassified' ELSE concat('color_', rank) END AS layer, count(*) AS pixels, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM h LEFT JOIN o ON o.document_id=h.document_id AND o.p=h.p GROUP BY ALL),
q AS (SELECT *, (l*100.0/255.0+16.0)/116.0 AS fy FROM y), x AS (SELECT *, 0.950456*{_CUBE.format('(fy+(a-128.0)/500.0)')} AS x, {_CUBE.format('fy')} AS y, 1.088754*{_CUBE.format('(fy-(b-128.0)/200.0)')} AS z FROM q),
g AS (SELECT document_id, layer, pixels, greatest(3.240479*x-1.537150*y-0.498535*z, 0) AS r, greatest(-0.969256*x+1.875991*y+0.041556*z, 0) AS g, greatest(0.055648*x-0.204043*y+1.057311*z, 0) AS b FROM x)
SELECT document_id, layer, pixels, {_BYTE.format('r')} AS r, {_BYTE.format('g')} AS g, {_BYTE.format('b')} AS b FROM g"""


@query(_LAYERS_SQL)
def colour_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers of every page's coloured pixels by k-means, with pixels and mean colour."""
    made = colours.layers(stored(lab_pixels(spark, folder), "lab"))
    sums = made.groupBy("document_id", "layer").agg(F.count("*").alias("pixels"), *[F.avg(c).alias(c) for c in "lab"])
    return sums.select("document_id", "layer", "pixels", colours.to_rgb(F.col("l"), F.col("a"), F.col("b")).alias("c")).select("document_id", "layer", "pixels", "c.*")


@query(f"""WITH RECURSIVE i AS ({THIN_SQL}), s AS (SELECT document_id, id, CAST(floor((x+width/2)/2.0) AS BIGINT) AS px, CAST(floor((y+height)/2.0) AS BIGINT) AS py FROM ({BOXES_SQL}) WHERE kind='text'),
o AS (SELECT s.*, i.px IS NOT NULL AS hit FROM s LEFT JOIN i USING (document_id, px, py)),
n AS (SELECT o.document_id, o.id, arg_min(struct_pack(px := i.px, py := i.py), struct_pack(d := (i.px-o.px)*(i.px-o.px)+(i.py-o.py)*(i.py-o.py), dy := i.py-o.py, dx := i.px-o.px)) AS spot FROM o JOIN i ON i.document_id=o.document_id AND abs(i.px-o.px)<=24 AND abs(i.py-o.py)<=24 WHERE NOT hit GROUP BY ALL),
w(document_id, id, k, px, py, points) AS (SELECT document_id, id, 0, px, py, [struct_pack(px := px, py := py, v := false)] FROM o WHERE hit UNION ALL SELECT o.document_id, o.id, 0, spot.px, spot.py, [struct_pack(px := o.px, py := o.py, v := false), struct_pack(px := spot.px, py := spot.py, v := true)] FROM o JOIN n USING (document_id, id) UNION ALL
  SELECT document_id, id, k+1, spot.px, spot.py, list_append(points, struct_pack(px := spot.px, py := spot.py, v := true)) FROM (
    SELECT w.document_id, w.id, w.k, any_value(w.points) AS points, arg_min(struct_pack(px := i.px, py := i.py), struct_pack(d := (i.px-w.px)*(i.px-w.px)+(i.py-w.py)*(i.py-w.py), dy := i.py-w.py, dx := i.px-w.px)) AS spot
    FROM w JOIN i ON i.document_id=w.document_id AND abs(i.px-w.px)<=4 AND abs(i.py-w.py)<=4 WHERE w.k<32 AND NOT list_contains(w.points, struct_pack(px := i.px, py := i.py, v := true)) GROUP BY w.document_id, w.id, w.k)),
l AS (SELECT document_id, id, arg_max(points, k) AS points FROM w GROUP BY document_id, id)
SELECT document_id, id, CAST(pos-1 AS INTEGER) AS pos, points[pos].px AS px, points[pos].py AS py FROM (SELECT document_id, id, points, unnest(range(1, len(points)+1)) AS pos FROM l WHERE len(points)>=2)""")
def traced_leaders(spark: SparkSession, folder: str) -> DataFrame:
    """The walks over ink from below each text."""
    b = boxes(spark, folder).where("kind = 'text'")
    at = lambda v: F.floor(v / SIZE).cast("long")
    starts = b.select("document_id", "id", at(F.col("x") + F.col("width") / 2).alias("px"), at(F.col("y") + F.col("height")).alias("py"))
    return leaders.traced_leaders(starts, stored(evidence.ink_pixels(segments(spark, folder), SIZE), "ink"))


def cropped(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    """document_id, id, kind, px, py: the ink inside each region."""
    b = boxes(spark, folder).where(F.col("kind").isin(kinds))
    whole = b.select(F.struct("document_id", "id", "kind").alias("r"), *[(F.col(c) / SIZE).alias(c) for c in ("x", "y", "width", "height")])
    rows = pixels.box_runs(whole, page="r").select("r.*", "py", "x0", "x1")
    return ink(spark, folder).join(rows, ["document_id", "py"]).where("px between x0 and x1").select("document_id", "id", "kind", "px", "py")


_CROP_SQL = f"""i AS ({INK_SQL}), b AS (SELECT id, {_BOX_SQL.removeprefix('SELECT ')}), c AS (SELECT b.document_id, id, kind, px, py FROM b JOIN i ON i.document_id=b.document_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 WHERE kind IN ('symbol','arrow')),
e AS (SELECT document_id, id, min(px) AS x, max(px) AS r, min(py) AS y, max(px)-min(px)+1 AS width, max(py)-min(py)+1 AS height, count(*) AS area FROM c GROUP BY ALL),
m AS (SELECT e.document_id, e.id, count(*) AS unlike FROM e JOIN c ON c.document_id=e.document_id AND c.id=e.id LEFT JOIN c d ON d.document_id=c.document_id AND d.id=c.id AND d.py=c.py AND d.px=e.x+e.r-c.px WHERE (c.px-e.x<e.width // 2 OR e.r-c.px<e.width // 2) AND d.px IS NULL GROUP BY ALL)"""


@query(f"""WITH {_CROP_SQL} SELECT e.document_id, e.id, x, y, width, height, area, round(width/height, 6) AS aspect, round(area/(width*height), 6) AS fill, round(CASE WHEN width>1 THEN 1-coalesce(unlike, 0)/(height*(width // 2)) ELSE 0 END, 6) AS symmetry FROM e LEFT JOIN m ON m.document_id=e.document_id AND m.id=e.id""")
def region_features(spark: SparkSession, folder: str) -> DataFrame:
    """Shape features of the ink in every region of a symbol or an arrow."""
    made = shapes.component_features(cropped(spark, folder, ["symbol", "arrow"]), ["document_id", "id"])
    return made.select("document_id", "id", "x", "y", "width", "height", "area", *[F.round(c, 6).alias(c) for c in ("aspect", "fill", "symmetry")])


@query()
def shaped_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol whose shape fits the ink of each region best, with the corners of the ink's hull and the least rectangle around it."""
    crops = stored(cropped(spark, folder, ["symbol", "arrow"]), "crops")
    keys = ["document_id", "id"]
    hulls = shapes.hulls(crops, keys).select(*keys, F.size("hull").alias("corners"), shapes.least_rectangle().alias("r"))
    found = shapes.component_features(crops, keys).join(hulls, keys).join(crops.select(*keys, "kind").distinct(), keys)
    scores = ranking.shape_scores(F.col("kind"), F.col("aspect"), F.col("fill"), F.col("symmetry"), F.col("corners"))
    best = F.array_max(F.transform(scores, lambda s: F.struct(F.round(s["shape"], 9).alias("shape"), (-s["ord"]).alias("turn"), s["symbol_id"].alias("symbol_id"))))
    made = found.withColumn("best", best)
    return made.select(*keys, "kind", "corners", F.round("r.area", 4).alias("rectangle"), "best.symbol_id", F.round("best.shape", 6).alias("shape"))


@query(f"""WITH i AS ({INK_SQL}), b AS ({_BOX_SQL}), m AS (SELECT *, {_covered("'text','symbol','dimension'", 0)} AS p FROM i), kept AS (SELECT document_id, px, py FROM m WHERE NOT p), r AS ({_RUNS.format('kept')})
SELECT 'ink' AS stage, 0 AS ord, count(*) AS rows, true AS kept FROM i UNION ALL SELECT 'regions', 1, count(*), true FROM b WHERE kind IN ('text','symbol','dimension') UNION ALL SELECT 'geometry', 2, count(*), false FROM r UNION ALL SELECT 'lengths', 3, count(DISTINCT document_id), false FROM r""")
def staged_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stages of all pages in a run that ended behind the second and went on: rows of each, and whether the second run took it as it was."""

    def geometry(_: SparkSession, made: dict[str, DataFrame]) -> DataFrame:
        return pixels.difference(pixels.runs_of(made["ink"]), pixels.box_runs(made["regions"]))

    def lengths(_: SparkSession, made: dict[str, DataFrame]) -> DataFrame:
        return made["geometry"].groupBy("document_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))

    chain = [
        stages.Stage("ink", lambda s, _: ink(s, folder)),
        stages.Stage("regions", lambda s, _: _regions(s, folder, ["text", "symbol", "dimension"])),
        stages.Stage("geometry", geometry, ("ink", "regions")),
        stages.Stage("lengths", lengths, ("geometry",)),
    ]
    job = new_folder(spark, "job")
    stages.run(spark, job, chain[:2])
    second = stages.run(spark, job, chain)
    return stages.manifests(spark, job, chain).select("stage", "ord", "rows", F.col("stage").isin(second.skipped).alias("kept"))
