"""Queries of nested markup, profiles as rows, and JSON of any shape."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE
from ..operators import edits, nesting, payloads, profiles, snapping
from ..sources.shared import stored
from ..sources.tables import segments, table
from .registry import query
from .spatial import _AXIS_SQL

_PROLOG = "regexp_replace(coalesce(html, ''), '^<!DOCTYPE html>', '')"
_TAGS_SQL = f"""t AS (SELECT page_id, generate_subscripts(x, 1)-1 AS place, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all({_PROLOG}, '(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<[?!/]?[A-Za-z_:](?:[^<>"'']|"[^"]*"|''[^'']*'')*>') AS x FROM pages)),
k AS (SELECT *, CASE WHEN starts_with(tag, '<?') THEN 'instruction' WHEN starts_with(tag, '<!') THEN 'declaration' WHEN starts_with(tag, '</') THEN 'end' WHEN ends_with(tag, '/>') THEN 'empty' ELSE 'start' END AS kind, regexp_extract(tag, '^<[?!/]?([A-Za-z_:][A-Za-z0-9_:.-]*)', 1) AS name FROM t WHERE NOT starts_with(tag, '<!--') AND NOT starts_with(tag, '<![CDATA[')),
l AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place) AS level FROM k), d AS (SELECT *, CASE WHEN kind='start' THEN level WHEN kind IN ('end','empty') THEN level+1 END AS depth FROM l)"""


@query(f"""WITH {_TAGS_SQL}, e AS (SELECT *, last_value(CASE WHEN kind IN ('start','end') THEN struct_pack(kind := kind, name := name) END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM d),
w AS (SELECT *, CASE WHEN kind='end' AND (opened IS NULL OR opened.kind='end' OR opened.name<>name) THEN 1 ELSE 0 END AS wrong FROM e)
SELECT page_id, count(*) AS tags, CAST(max(depth) AS INTEGER) AS deepest, CAST(sum(wrong) AS BIGINT) AS mismatched, CAST(arg_min(name, place) FILTER (WHERE wrong=1) AS VARCHAR) AS first_mismatch, CAST(sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) AS BIGINT) AS left_open FROM w GROUP BY page_id""")
def page_nesting(spark: SparkSession, folder: str) -> DataFrame:
    """How the tags of every page nest: their number, the greatest depth, end tags that end nothing or another element, and what is left open."""
    pages = table(spark, folder, "pages").select("page_id", F.expr(_PROLOG).alias("html"))
    deep = nesting.nested(nesting.tags(pages, "page_id", "html"), "page_id")
    wrong = (F.col("kind") == "end") & (F.col("opener").isNull() | (F.col("opener") != F.col("name")))
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    return deep.groupBy("page_id").agg(F.count("*").alias("tags"), F.max("depth").alias("deepest"), F.count_if(wrong).alias("mismatched"), F.min_by(F.when(wrong, F.col("name")), F.when(wrong, F.col("place"))).alias("first_mismatch"), F.sum(step).alias("left_open"))


@query(f"""WITH {_TAGS_SQL}, s AS (SELECT * FROM d WHERE kind='start') SELECT d.page_id, d.place, d.name, CAST(d.depth AS INTEGER) AS depth, (SELECT max(s.place) FROM s WHERE s.page_id=d.page_id AND s.depth=d.depth-1 AND s.place<d.place) AS parent FROM d WHERE kind IN ('start','empty')""")
def element_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every page with its depth and the place of the tag around it."""
    pages = table(spark, folder, "pages").select("page_id", F.expr(_PROLOG).alias("html"))
    deep = nesting.nested(nesting.tags(pages, "page_id", "html"), "page_id")
    return deep.where("kind in ('start', 'empty')").select("page_id", F.col("place").cast("long").alias("place"), "name", "depth", F.col("parent").cast("long").alias("parent"))


#: Drawings by the number of a part modulo 10; %s is its name.
_DRAWINGS = (
    '<svg><title>%s</title><g><line x1="1"/><path d="M0 0"/></g></svg>', '<svg><defs><marker id="m"><g><path d="M0 0"/></g></marker></defs><use href="#m"/></svg>', "<svg><g><svg><g/></svg><line/><line/><svg/></g></svg>",
    '<g note="a > b"><line/></g>', "<svg><script><path/><svg/></script><text>%s</text><foreignObject/></svg>", "<svg><g></svg>", "<!DOCTYPE svg><svg/>", '<?xml version="1.0" encoding="latin-1"?><svg></svg>', "<svg/><svg/>", "<!-- <script> --><svg><g><g/><g><path/></g></g></svg>",
)


def _drawings(spark: SparkSession, folder: str) -> DataFrame:
    template = F.element_at(F.array(*[F.lit(d) for d in _DRAWINGS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.replace(template, F.lit("%s"), F.col("p_name")).alias("svg"))


@query("""WITH r AS (SELECT * FROM (VALUES (0, 'svg_element_forbidden', '/svg/g[1]/path[1]', '<path> is only allowed inside a <marker>'), (2, 'svg_element_forbidden', '/svg/g[1]/svg[1]', 'nested <svg> is not allowed'), (2, 'svg_element_forbidden', '/svg/g[1]/svg[2]', 'nested <svg> is not allowed'),
(3, 'svg_element_forbidden', '/g', 'root element must be <svg>, not <g>'), (4, 'svg_element_forbidden', '/svg/script[1]', 'element <script> is not allowed'), (4, 'svg_element_forbidden', '/svg/foreignObject[1]', 'element <foreignObject> is not allowed'), (5, 'svg_xml_invalid', '/', 'mismatched tag'),
(6, 'svg_xml_invalid', '/', 'DOCTYPE declaration is not allowed'), (7, 'svg_xml_invalid', '/', 'encoding is not allowed; use UTF-8'), (8, 'svg_xml_invalid', '/', 'junk after document element'), (9, 'svg_element_forbidden', '/svg/g[1]/g[2]/path[1]', '<path> is only allowed inside a <marker>')) AS v(k, code, path, problem))
SELECT p_partkey AS id, code, path, problem FROM part JOIN r ON p_partkey % 10 = k""")
def nested_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with drawings made of parts: what can't be read, and elements that may not stand where they do."""
    return nesting.checked(_drawings(spark, folder), "id", "svg")


@query("SELECT p_partkey AS id, 'm' AS target, 'marker' AS found FROM part WHERE p_partkey % 10 = 1")
def markup_references(spark: SparkSession, folder: str) -> DataFrame:
    """References inside drawings made of parts, and what they point to."""
    deep = nesting.nested(nesting.tags(_drawings(spark, folder), "id", "svg"), "id")
    return nesting.local_references(deep, "id").select("id", "target", "found")


#: Profiles of pages with even and with odd numbers; strokes without an order give weak axes, so both take weak ones.
LOOSE = dataclasses.replace(PROFILE, min_axis_confidence=0.05)
STRICT = dataclasses.replace(PROFILE, max_snap_angle=2.0, min_primitive_length=45.0, max_endpoint_displacement=1.5, min_axis_confidence=0.1)


@query(f"""{_AXIS_SQL}, l AS (SELECT s.*, rotation, confidence, document_id % 2=1 AS strict, ((degrees(atan2(y1-y0, x1-x0)) % 180.0)+180.0) % 180.0 AS angle, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM s LEFT JOIN (SELECT document_id, rotation, confidence FROM model) USING (document_id)),
z AS (SELECT *, abs(angle-(rotation+90.0) % 180.0) AS a1, abs(angle-(rotation+30.0) % 180.0) AS a2, abs(angle-(rotation+150.0) % 180.0) AS a3 FROM l),
y AS (SELECT *, least(a1,180-a1) AS d1, least(a2,180-a2) AS d2, least(a3,180-a3) AS d3 FROM z), x AS (SELECT *, least(d1,d2,d3) AS delta FROM y)
SELECT document_id, CASE WHEN strict THEN 'strict@2.1.0' ELSE 'piping@1.0.0' END AS profile, CASE WHEN coalesce(confidence,0.0)<CASE WHEN strict THEN 0.1 ELSE 0.05 END THEN 'weak_axis_model' WHEN len<CASE WHEN strict THEN 45.0 ELSE 20.0 END THEN 'low_evidence' WHEN delta>CASE WHEN strict THEN 2.0 ELSE 4.0 END THEN 'off_axis'
  WHEN len*sin(radians(delta/2))>CASE WHEN strict THEN 1.5 ELSE 8.0 END THEN 'endpoint_displacement' ELSE 'snapped_to_axis' END AS reason, count(*) AS n FROM x GROUP BY ALL""")
def profiled_snaps(spark: SparkSession, folder: str) -> DataFrame:
    """Snap decisions of pages with two profiles, in one plan: an id without a version, and one with."""
    primitives = segments(spark, folder).withColumn("status", F.lit("accepted"))
    assigned = primitives.select("document_id").distinct().withColumn("profile_id", F.when(F.col("document_id") % 2 == 1, "strict@2.1.0").otherwise("piping"))
    thresholds = profiles.threshold_rows(spark, {"piping": LOOSE, "strict@2.1.0": STRICT})
    rows = profiles.with_thresholds(primitives, assigned, thresholds)
    made = snapping.snapped(rows, snapping.axis_models(primitives), profile=profiles.Thresholds())
    named = assigned.select("document_id", profiles.resolved(F.col("profile_id")).alias("p")).select("document_id", F.concat_ws("@", "p.profile", "p.version").alias("profile"))
    return made.join(named, "document_id").groupBy("document_id", "profile", "reason").agg(F.count("*").alias("n"))


#: JSON by the number of a part modulo 8; %s is its name, %n its size.
_PAYLOADS = (
    '{"id":"%s","score":%n,"label":null}', '{"id":"%s","score":null}', '{"id":"%s","label":"nan","at":[1,{"x":null,"y":[]},"Infinity"]}', "[%n]", '{"id":"%s"', '{"id":"%s","id":"b"}', '{"score":%n.5,"label":true,"more":{"score":null}}', "null",
)


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    template = F.element_at(F.array(*[F.lit(d) for d in _PAYLOADS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.replace(F.replace(template, F.lit("%s"), F.col("p_name")), F.lit("%n"), F.col("p_size").cast("string"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.alias("payload"))


@query("""WITH r AS (SELECT * FROM (VALUES (0, 'present', 'null', 'label'), (1, 'null', 'missing', 'score'), (2, 'missing', 'present', ''), (3, 'not_an_object', 'not_an_object', ''), (4, 'malformed', 'malformed', ''), (5, 'malformed', 'malformed', ''), (6, 'present', 'present', ''), (7, 'not_an_object', 'not_an_object', '')) AS v(k, score, label, nulls))
SELECT p_partkey AS id, score, label, nulls FROM part JOIN r ON p_partkey % 8 = k""")
def explicit_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of JSON payloads that are there, null or missing; repeated keys make a payload malformed."""
    made = _payloads(spark, folder)
    nulls = F.array_join(payloads.explicit_nulls(F.col("payload"), ["score", "label"]), ",")
    return made.select("id", payloads.key_state(F.col("payload"), "score").alias("score"), payloads.key_state(F.col("payload"), "label").alias("label"), nulls.alias("nulls"))


@query("""WITH r AS (SELECT * FROM (VALUES (0, '$', 0, 'object', NULL), (0, '$.id', 1, 'string', '%s'), (0, '$.score', 1, 'number', '%n'), (0, '$.label', 1, 'null', NULL), (1, '$', 0, 'object', NULL), (1, '$.id', 1, 'string', '%s'), (1, '$.score', 1, 'null', NULL),
(2, '$', 0, 'object', NULL), (2, '$.id', 1, 'string', '%s'), (2, '$.label', 1, 'string', 'nan'), (2, '$.at', 1, 'array', NULL), (2, '$.at[0]', 2, 'number', '1'), (2, '$.at[1]', 2, 'object', NULL), (2, '$.at[2]', 2, 'string', 'Infinity'), (2, '$.at[1].x', 3, 'null', NULL), (2, '$.at[1].y', 3, 'array', NULL),
(3, '$', 0, 'array', NULL), (3, '$[0]', 1, 'number', '%n'), (4, '$', 0, 'malformed', NULL), (5, '$', 0, 'malformed', NULL), (6, '$', 0, 'object', NULL), (6, '$.score', 1, 'number', '%n.5'), (6, '$.label', 1, 'boolean', 'true'), (6, '$.more', 1, 'object', NULL), (6, '$.more.score', 2, 'null', NULL), (7, '$', 0, 'null', NULL)) AS v(k, path, depth, kind, value))
SELECT p_partkey AS id, path, depth, kind, replace(replace(value, '%s', p_name), '%n', CAST(p_size AS VARCHAR)) AS value FROM part JOIN r ON p_partkey % 8 = k""")
def walked_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of JSON payloads of any shape, with its path."""
    return payloads.walked(_payloads(spark, folder), "id", "payload")


@query("SELECT p_partkey AS id, path FROM part, (SELECT unnest(['$.label', '$.at[2]']) AS path) WHERE p_partkey % 8 = 2")
def non_finite_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of JSON payloads that say they aren't finite."""
    return payloads.non_finite(stored(payloads.walked(_payloads(spark, folder), "id", "payload"), "walk")).select("id", "path")


_SCENES_SQL = """o AS (SELECT p_partkey // 20 AS document_id, p_partkey AS id, ['annotation','symbol','junction','dimension','pipe_segment'][p_partkey % 5 + 1] AS type, p_name AS text, p_brand AS symbol_id, p_type AS display_text, CAST(p_size AS DOUBLE) AS rotation, p_size*7.0 AS x, p_size*5.0 AS y FROM part),
c AS (SELECT l_partkey // 20 AS document_id, CASE WHEN l_partkey % 5=4 THEN l_partkey-4 ELSE l_partkey END AS object_id, l_orderkey*10+l_linenumber AS seq, concat(l_returnflag, '-', l_linenumber) AS value, CAST(l_discount AS DOUBLE)*100 AS number, CAST(l_quantity AS DOUBLE)*10 AS x, CAST(l_tax AS DOUBLE)*1000 AS y,
  CASE WHEN l_partkey // 20 % 5=4 AND l_linenumber=7 THEN 'explode' WHEN l_partkey // 20 % 5=3 AND l_linenumber=6 THEN 'set_dimension_text' WHEN l_partkey % 5=1 THEN CASE WHEN l_linenumber % 2=1 THEN 'set_symbol_type' ELSE 'set_symbol_rotation' END WHEN l_partkey % 5=2 THEN 'move_junction' WHEN l_partkey % 5=3 THEN 'set_dimension_text' WHEN l_linenumber % 2=1 THEN 'update_annotation_text' ELSE 'move_annotation' END AS type FROM lineitem),
b AS (SELECT c.*, CASE WHEN c.type='explode' THEN 'unknown_command' WHEN o.id IS NULL THEN 'unknown_object' WHEN c.type='set_dimension_text' AND o.type<>'dimension' THEN 'wrong_type' END AS problem FROM c LEFT JOIN o ON o.document_id=c.document_id AND o.id=c.object_id)"""


def _scenes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(objects, commands): scenes of twenty parts, and a command for each line of an order."""
    page, kind = F.expr("p_partkey div 20").alias("document_id"), F.element_at(F.array(*[F.lit(t) for t in ("annotation", "symbol", "junction", "dimension", "pipe_segment")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = F.col("p_size").cast("double")
    objects = table(spark, folder, "part").select(
        page, F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("text"), F.col("p_brand").alias("symbol_id"), F.col("p_type").alias("display_text"),
        size.alias("rotation"), (size * 7).alias("x"), (size * 5).alias("y"), F.lit(400.0).alias("page_width"), F.lit(300.0).alias("page_height"), F.lit("machine").alias("state"),
    )
    l = table(spark, folder, "lineitem")  # noqa: E741
    part, place, odd = F.col("l_partkey"), F.expr("l_partkey div 20 % 5"), F.col("l_linenumber") % 2 == 1
    kind = (
        F.when((place == 4) & (F.col("l_linenumber") == 7), "explode").when((place == 3) & (F.col("l_linenumber") == 6), "set_dimension_text").when((part % 5 == 1) & odd, "set_symbol_type").when(part % 5 == 1, "set_symbol_rotation")
        .when(part % 5 == 2, "move_junction").when(part % 5 == 3, "set_dimension_text").when(odd, "update_annotation_text").otherwise("move_annotation")
    )
    number = lambda c, factor, name: (F.col(c).cast("double") * factor).alias(name)
    commands = l.select(
        F.expr("l_partkey div 20").alias("document_id"), F.when(part % 5 == 4, part - 4).otherwise(part).alias("object_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), kind.alias("type"),
        F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("value"), number("l_discount", 100, "number"), number("l_quantity", 10, "x"), number("l_tax", 1000, "y"),
    )
    return objects, commands


@query(f"WITH {_SCENES_SQL} SELECT document_id, object_id, seq, type, problem FROM b WHERE problem IS NOT NULL")
def command_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Commands that can't be applied."""
    return edits.command_problems(*_scenes(spark, folder))


@query(f"""WITH {_SCENES_SQL}, g AS (SELECT * FROM c WHERE document_id NOT IN (SELECT document_id FROM b WHERE problem IS NOT NULL)),
l AS (SELECT document_id, object_id AS id, arg_max(value, seq) FILTER (WHERE type='update_annotation_text') AS t, arg_max(value, seq) FILTER (WHERE type='set_symbol_type') AS s, arg_max(value, seq) FILTER (WHERE type='set_dimension_text') AS d, arg_max(number, seq) FILTER (WHERE type='set_symbol_rotation') AS r, arg_max(x, seq) FILTER (WHERE type IN ('move_annotation','move_junction')) AS x, arg_max(y, seq) FILTER (WHERE type IN ('move_annotation','move_junction')) AS y FROM g GROUP BY ALL)
SELECT o.document_id, o.id, type, coalesce(t, text) AS text, coalesce(s, symbol_id) AS symbol_id, coalesce(d, display_text) AS display_text, round(coalesce(r, rotation), 6) AS rotation, round(coalesce(l.x, o.x), 6) AS x, round(coalesce(l.y, o.y), 6) AS y, CASE WHEN l.id IS NULL THEN 'machine' ELSE 'confirmed' END AS state, l.id IS NOT NULL AS edited FROM o LEFT JOIN l ON l.document_id=o.document_id AND l.id=o.id""")
def edited_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes after all their commands; those with a command that can't be applied stay as they are."""
    made, _ = edits.edited_scenes(*_scenes(spark, folder))
    return made.select("document_id", "id", "type", "text", "symbol_id", "display_text", *[F.round(c, 6).alias(c) for c in ("rotation", "x", "y")], "state", "edited")


@query(f"""WITH {_SCENES_SQL}, g AS (SELECT * FROM c WHERE document_id NOT IN (SELECT document_id FROM b WHERE problem IS NOT NULL)),
l AS (SELECT document_id, object_id AS id, arg_max(x, seq) AS x, arg_max(y, seq) AS y FROM g WHERE type IN ('move_annotation','move_junction') GROUP BY ALL)
SELECT o.document_id, o.id, 'outside' AS problem FROM o LEFT JOIN l ON l.document_id=o.document_id AND l.id=o.id WHERE coalesce(l.x, o.x)>400 OR coalesce(l.y, o.y)>300""")
def problems_after_edits(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with scenes after all their commands."""
    made, _ = edits.edited_scenes(*_scenes(spark, folder))
    return edits.scene_problems(made)
