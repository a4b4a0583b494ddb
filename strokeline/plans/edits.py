"""Queries of edits, review answers, drawings of scenes and canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits, markup, review
from ..sources.tables import POINTS_SQL, SEGMENTS_SQL, points, segments, table
from .registry import query
from .scene import _SCENE_SQL
from .scene import assembled as assembled_scene

_COMMANDS = "SELECT o_custkey AS pipe_id, CASE WHEN o_orderkey % 2=0 THEN 'start' ELSE 'end' END AS \"end\", o_orderkey AS seq, CASE WHEN o_orderkey % 5=0 THEN NULL ELSE o_orderkey % 800 END AS node_id FROM orders"
_PIPES = f"""p AS (SELECT id, CAST(id AS VARCHAR) AS start_node, CAST(id+1 AS VARCHAR) AS end_node, x0, y0, x1, y1 FROM ({SEGMENTS_SQL})), j AS (SELECT id, x, y FROM ({POINTS_SQL})), c AS ({_COMMANDS}), m AS (SELECT c.*, p.id IS NOT NULL AND (node_id IS NULL OR j.id IS NOT NULL) AS good, j.x, j.y FROM c LEFT JOIN p ON p.id=pipe_id LEFT JOIN j ON j.id=node_id),
l AS (SELECT pipe_id, "end", arg_max(coalesce(CAST(node_id AS VARCHAR), concat('cut-', pipe_id, '-', "end", '-', seq)), seq) AS node, arg_max(node_id IS NULL, seq) AS cut, arg_max(x, seq) FILTER (WHERE node_id IS NOT NULL) AS x, arg_max(y, seq) FILTER (WHERE node_id IS NOT NULL) AS y FROM m WHERE good GROUP BY pipe_id, "end"),
o AS (SELECT p.id, coalesce(s.node, start_node) AS start_node, coalesce(e.node, end_node) AS end_node, round(coalesce(s.x, x0),5) AS x0, round(coalesce(s.y, y0),5) AS y0, round(coalesce(e.x, x1),5) AS x1, round(coalesce(e.y, y1),5) AS y1, CASE WHEN s.node IS NOT NULL OR e.node IS NOT NULL THEN 'confirmed' ELSE 'machine' END AS state, coalesce(s.cut,false) AS s_cut, coalesce(e.cut,false) AS e_cut FROM p LEFT JOIN l s ON s.pipe_id=p.id AND s."end"='start' LEFT JOIN l e ON e.pipe_id=p.id AND e."end"='end')"""


def _connected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = lambda c: c.cast("string")
    pipes = segments(spark, folder).select("id", name(F.col("id")).alias("start_node"), name(F.col("id") + 1).alias("end_node"), "x0", "y0", "x1", "y1", F.lit("machine").alias("state"))
    o = table(spark, folder, "orders")
    commands = o.select(F.col("o_custkey").alias("pipe_id"), F.when(F.col("o_orderkey") % 2 == 0, "start").otherwise("end").alias("end"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 800).alias("node_id"))
    return edits.connected_pipes(pipes, points(spark, folder), commands)


@query(f"WITH {_PIPES} SELECT id, start_node, end_node, x0, y0, x1, y1, state FROM o")
def connected_pipes(spark: SparkSession, folder: str) -> DataFrame:
    """Pipes after their ends were connected and disconnected."""
    made = _connected(spark, folder)[0]
    return made.withColumns({c: F.round(c, 5) for c in ("x0", "y0", "x1", "y1")})


@query(f"""WITH {_PIPES} SELECT 'created' AS what, start_node AS name, x0 AS x, y0 AS y FROM o WHERE s_cut UNION ALL SELECT 'created', end_node, x1, y1 FROM o WHERE e_cut UNION ALL SELECT 'rejected', concat(pipe_id, '-', seq), NULL, NULL FROM m WHERE NOT good""")
def cut_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Junctions that disconnected ends lie on now, and commands that name no pipe or junction."""
    _, created, rejected = _connected(spark, folder)
    cut = created.select(F.lit("created").alias("what"), F.col("id").alias("name"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
    return cut.union(rejected.select(F.lit("rejected"), F.concat_ws("-", F.col("pipe_id").cast("string"), F.col("seq").cast("string")), F.lit(None).cast("double"), F.lit(None).cast("double")))


@query(f"""WITH r AS (SELECT id, p.port, CASE WHEN id % 3=0 THEN NULL ELSE id END AS node_id FROM ({POINTS_SQL}), (SELECT unnest(['a','b']) AS port) p), c AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2=0 THEN 'a' ELSE 'b' END AS port, arg_max(o_orderkey % 9, o_orderkey) AS v, true AS hit FROM orders GROUP BY 1, 2)
SELECT r.id, r.port, CASE WHEN hit THEN CASE WHEN v=0 THEN NULL ELSE v END ELSE node_id END AS node_id, hit IS NOT NULL AS edited FROM r LEFT JOIN c USING (id, port)""")
def connected_ports(spark: SparkSession, folder: str) -> DataFrame:
    """Ports of symbols after they were connected and disconnected."""
    ports = points(spark, folder).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("port"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("node_id"))
    value = F.col("o_orderkey") % 9
    commands = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("port"), F.col("o_orderkey").alias("seq"), F.when(value != 0, value).alias("node_id"))
    return edits.last_values(ports, commands, ["id", "port"], ["node_id"])


@query(f"""WITH c AS (SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) SELECT p.id, round(CASE WHEN k IS NULL THEN x ELSE k/4.0 END,5) AS x, round(CASE WHEN k IS NULL THEN y ELSE k/8.0 END,5) AS y, k IS NOT NULL AS edited FROM ({POINTS_SQL}) p LEFT JOIN c ON c.id=p.id""")
def moved_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations after they were moved."""
    key = F.col("o_orderkey")
    commands = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), key.alias("seq"), (key / 4.0).alias("x"), (key / 8.0).alias("y"))
    made = edits.last_values(points(spark, folder).select("id", "x", "y"), commands, ["id"], ["x", "y"])
    return made.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


@query("""WITH c AS (SELECT s_nationkey AS layer, arg_max(concat('#', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')), s_suppkey) AS color FROM supplier GROUP BY s_nationkey) SELECT n_nationkey AS layer, coalesce(color, '#000000') AS color, color IS NOT NULL AS edited FROM nation LEFT JOIN c ON layer=n_nationkey""")
def layer_colors(spark: SparkSession, folder: str) -> DataFrame:
    """Layers after their colours were set."""
    layers = table(spark, folder, "nation").select(F.col("n_nationkey").alias("layer"), F.lit("#000000").alias("color"))
    commands = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("layer"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("#"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("color"))
    return edits.last_values(layers, commands, ["layer"], ["color"])


_ITEMS = "SELECT p_partkey AS key, p_partkey // 2 AS object_id, CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged_unknown' WHEN 2 THEN 'confirmed' ELSE 'corrected' END AS state FROM part"
_ANSWERS = "SELECT l_partkey AS key, arg_max(CASE l_linenumber % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'acknowledge_unknown' END, seq) AS action, arg_max(concat('text ', CAST(l_linenumber AS VARCHAR)), seq) AS text FROM (SELECT *, l_orderkey*10+l_linenumber AS seq FROM lineitem WHERE l_linenumber % 4<>3) GROUP BY l_partkey"


def _items(spark: SparkSession, folder: str) -> DataFrame:
    state = F.expr("CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged_unknown' WHEN 2 THEN 'confirmed' ELSE 'corrected' END")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.expr("p_partkey div 2").alias("object_id"), state.alias("state"))


@query(f"""WITH a AS (SELECT i.key, object_id, action, text, CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'correct' THEN 'corrected' WHEN 'acknowledge_unknown' THEN 'acknowledged_unknown' ELSE state END AS state FROM ({_ITEMS}) i LEFT JOIN ({_ANSWERS}) n USING (key)),
h AS (SELECT object_id, max(CASE WHEN action='correct' THEN text END) AS text FROM a WHERE action IN ('confirm','correct') GROUP BY object_id)
SELECT key, a.state, c_custkey AS object, CASE WHEN h.object_id IS NOT NULL THEN 'confirmed' ELSE 'machine' END AS object_state, CASE WHEN h.object_id IS NULL THEN c_acctbal END AS score, coalesce(h.text, c_name) AS text FROM a LEFT JOIN customer ON c_custkey=a.object_id LEFT JOIN h ON h.object_id=a.object_id WHERE c_custkey IS NOT NULL""")
def answered_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review items after all answers, beside the objects they are about."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    action = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'acknowledge_unknown' ELSE 'note' END")
    answers = l.select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), action.alias("action"), F.concat(F.lit("text "), F.col("l_linenumber").cast("string")).alias("text"))
    objects = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("machine").alias("state"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("text"))
    items, after = review.answered(_items(spark, folder), objects, answers)
    return items.join(after.select(F.col("id").alias("object_id"), F.col("state").alias("object_state"), "score", "text"), "object_id").select("key", "state", F.col("object_id").alias("object"), "object_state", "score", "text")


@query(f"""WITH i AS ({_ITEMS}), k AS (SELECT DISTINCT s_suppkey AS key FROM supplier), c AS (SELECT i.* FROM i LEFT JOIN k USING (key) WHERE state IN ('open','acknowledged_unknown') OR k.key IS NOT NULL)
SELECT c.key, object_id, CASE WHEN object_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P') AND c.key NOT IN (SELECT key FROM k) THEN 'open' ELSE state END AS state FROM c""")
def carried_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the next revision: blocking and requested ones, open again where their object was edited."""
    keys = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"))
    affected = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("object_id"))
    return review.reopened(review.carried(_items(spark, folder), keys), affected, keys).select("key", "object_id", "state")


@query("""WITH d AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4=0 THEN NULL ELSE c_nationkey END AS current FROM customer), c AS (SELECT o_custkey AS document_id, o_orderkey AS revision_id, CASE WHEN o_orderkey % 3=0 THEN NULL ELSE o_orderkey % 25 END AS parent_id FROM orders WHERE o_orderstatus='O'),
b AS (SELECT d.document_id, min(revision_id) AS new FROM d JOIN c ON c.document_id=d.document_id AND c.parent_id IS NOT DISTINCT FROM d.current GROUP BY d.document_id) SELECT d.document_id, coalesce(new, current) AS current, new IS NOT NULL AS promoted FROM d LEFT JOIN b USING (document_id)""")
def promoted_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """The current revision of every document after ready candidates were promoted."""
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).cast("long").alias("current"))
    o = table(spark, folder, "orders")
    candidates = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 25).alias("parent_id"), F.lit("machine").alias("author"), (F.col("o_orderstatus") == "O").alias("ready"))
    return review.promoted(docs, candidates)


_N = "CASE WHEN rtrim(rtrim(printf('%.3f', {0}),'0'),'.')='-0' THEN '0' ELSE rtrim(rtrim(printf('%.3f', {0}),'0'),'.') END"
_X, _Y = _N.format("r.x"), _N.format("r.y")
_TEXT_SQL = "replace(replace(replace(replace({},'&','&amp;'),'<','&lt;'),'>','&gt;'),chr(13),'&#13;')"
#: The scene with all digits of its coordinates.
_FULL = _SCENE_SQL.replace("round(x,4) AS x", "x").replace("round(y,4) AS y", "y").replace("round(x1,4) AS x1", "x1").replace("round(y1,4) AS y1", "y1")


@query(f"""{_FULL}, deg AS (SELECT id, count(*) AS n FROM (SELECT start_id AS id FROM o WHERE type='pipe_segment' UNION ALL SELECT end_id FROM o WHERE type='pipe_segment') GROUP BY id),
z AS (SELECT r.document_id, 'pipes' AS g, r.id AS k, concat('<line id="pipe-', r.id, '" x1="', {_X}, '" y1="', {_Y}, '" x2="', {_N.format("r.x1")}, '" y2="', {_N.format("r.y1")}, '"/>') AS line FROM o r WHERE type='pipe_segment'
UNION ALL SELECT r.document_id, 'connections', r.id, concat('<circle cx="', {_X}, '" cy="', {_Y}, '" r="3"/>') FROM o r JOIN deg USING (id) WHERE type='junction' AND n>=2
UNION ALL SELECT r.document_id, 'symbols', r.id, concat('<use id="symbol-', r.id, '" href="#sym-', label, '" transform="translate(', {_X}, ' ', {_Y}, ')"/>') FROM o r WHERE type='symbol'
UNION ALL SELECT r.document_id, 'dimensions', r.id, concat('<text id="dimension-', r.id, '" x="', {_X}, '" y="', {_Y}, '">', {_TEXT_SQL.format("label")}, '</text>') FROM o r WHERE type='dimension'
UNION ALL SELECT r.document_id, 'callouts', r.id, concat('<line x1="', {_X}, '" y1="', {_Y}, '" x2="', {_N.format("coalesce((t.x+t.x1)/2, t.x)")}, '" y2="', {_N.format("coalesce((t.y+t.y1)/2, t.y)")}, '"/>') FROM o r JOIN o t ON t.document_id=r.document_id AND t.id=r.target_id WHERE r.type='annotation'
UNION ALL SELECT r.document_id, 'annotations', r.id, concat('<text id="text-', r.id, '" x="', {_X}, '" y="', {_Y}, '">', {_TEXT_SQL.format("label")}, '</text>') FROM o r WHERE type='annotation'
UNION ALL SELECT r.document_id, 'unresolved', r.id, concat('<circle id="unknown-', r.id, '" cx="', {_X}, '" cy="', {_Y}, '" r="6" fill="none"/>') FROM o r WHERE type='unknown_mark' OR (type='junction' AND label='unknown')),
sy AS (SELECT document_id, string_agg(DISTINCT concat('<symbol id="sym-', label, '"/>', chr(10)), '' ORDER BY concat('<symbol id="sym-', label, '"/>', chr(10))) AS d FROM o WHERE type='symbol' GROUP BY document_id),
bb AS (SELECT document_id, g, string_agg(concat(line, chr(10)), '' ORDER BY k) AS body FROM z GROUP BY document_id, g), qq AS (SELECT document_id, {", ".join(f"coalesce(max(body) FILTER (WHERE g='{g}'),'') AS g{n}" for n, g in enumerate(markup.GROUPS))} FROM bb GROUP BY document_id),
vv AS (SELECT document_id, concat('<svg xmlns="http://www.w3.org/2000/svg">', chr(10), '<defs>', chr(10), coalesce(d,''), '</defs>', chr(10), {", ".join(f"'<g id=" + chr(34) + g + chr(34) + f">', chr(10), g{n}, '</g>', chr(10)" for n, g in enumerate(markup.GROUPS))}, '</svg>', chr(10)) AS svg FROM qq LEFT JOIN sy USING (document_id))
SELECT document_id, length(svg) AS characters, sha256(svg) AS digest FROM vv""")
def drawn_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Every scene as one SVG document, by its digest; junctions of two pipes have dots here."""
    objects = assembled_scene(spark, folder)
    made = markup.drawn_scene(markup.scene_lines(objects, dots=2), markup.symbol_definitions(objects))
    return made.select("document_id", F.length("svg").cast("long").alias("characters"), F.sha2("svg", 256).alias("digest"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE concat('{"a":{"c":', CAST(p_size AS VARCHAR), ',"d":0},"b":"', p_name, '","z":[1,null,true]}') END AS canonical FROM part) SELECT id, canonical, sha256(canonical) AS options_hash FROM r""")
def canonical_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records as canonical JSON with its hash; broken ones, and ones with a repeated key, have none."""
    body = F.concat(F.lit('{ "z": [1, null, true], "b": "'), "p_name", F.lit('",\n "a": {"d": -0.0, "c": '), F.col("p_size").cast("string"), F.lit("}"))
    text = F.when(F.col("p_size") % 6 == 0, body).when(F.col("p_size") % 6 == 1, F.concat(body, F.lit(', "b": 1}'))).otherwise(F.concat(body, F.lit("}")))
    made = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), X.canonical_json(text).alias("canonical"))
    return made.withColumn("options_hash", F.sha2("canonical", 256))


@query("""SELECT l_orderkey*10+l_linenumber AS id, concat('objects[', l_linenumber, '].', CASE WHEN l_linenumber % 2=0 THEN 'anchor.x' ELSE 'text' END) AS path, l_linenumber=1 AS supported, concat('rev_', substr(sha256(concat('dimension.missing_arrow|', l_orderkey, '|', l_linenumber)),1,12)) AS review_id FROM lineitem""")
def issue_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, versions and review ids of issues."""
    n = F.col("l_linenumber")
    path = F.when(n % 2 == 0, X.issue_path(F.lit("objects"), n, F.lit("anchor"), F.lit("x"))).otherwise(X.issue_path(F.lit("objects"), n, F.lit("text")))
    version = F.concat(n.cast("string"), F.lit(".0"))
    return table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), path.alias("path"), X.supported_version(version).alias("supported"), X.review_id(F.lit("dimension.missing_arrow"), F.col("l_orderkey").cast("string"), n.cast("string")).alias("review_id"))


@query(f"{_SCENE_SQL} SELECT document_id, string_agg(DISTINCT label, ',' ORDER BY label) AS symbols FROM o WHERE type='symbol' GROUP BY document_id")
def used_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that each scene needs definitions of."""
    return markup.symbol_definitions(assembled_scene(spark, folder)).withColumn("symbols", F.array_join("symbols", ","))
