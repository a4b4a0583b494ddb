"""Queries on names, readings, identifiers, markup, payloads and scene integrity."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, markup, metrics
from ..sources.tables import POINTS_SQL, SEGMENTS_SQL, points, segments, table
from .registry import query

_TERM = "list_contains(['npt','valve','main','drop','clamp','strut','flange','elbow','tee','connection','threaded'], lower(b))"
_READING = "concat('  conn.x thrd. to ', CASE p_size % 5 WHEN 0 THEN 'npt,' WHEN 1 THEN 'Tee.' WHEN 2 THEN 'valve;' WHEN 3 THEN 'main' ELSE 'MAINT.9' END, '  ', p_name, ' ')"


def readings(spark: SparkSession, folder: str) -> DataFrame:
    word = F.expr("CASE p_size % 5 WHEN 0 THEN 'npt,' WHEN 1 THEN 'Tee.' WHEN 2 THEN 'valve;' WHEN 3 THEN 'main' ELSE 'MAINT.9' END")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("  conn.x thrd. to "), word, F.lit("  "), "p_name", F.lit(" ")).alias("raw"))


@query(rf"""WITH r AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({_READING}), '(?i)\bconn\.\b', 'connection', 'g'), '(?i)\bmaint\.\b', 'maintenance', 'g'), '(?i)\bthrd\.\b', 'threaded', 'g'), '^\s+|\s+$', '', 'g') AS t, {_READING} AS raw FROM part),
w AS (SELECT id, raw, list_transform(string_split_regex(t, '\s+'), lambda x: struct_pack(x:=x, b:=trim(x, '.,;:'))) AS ws FROM r),
k AS (SELECT id, raw, array_to_string(list_transform(ws, lambda s: CASE WHEN list_contains(['npt','valve','main','drop','clamp','strut','flange','elbow','tee','connection','threaded'], lower(s.b)) THEN CASE WHEN length(s.b)<=4 THEN upper(s.b) ELSE s.b END ELSE s.x END), ' ') AS t FROM w)
SELECT id, concat(upper(t[1]), substr(t,2)) AS normalized FROM k WHERE concat(upper(t[1]), substr(t,2))<>trim(raw)""")
def normalized_readings(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).select("id", X.normalized(F.col("raw")).alias("normalized")).where("normalized is not null")


_DIM = """CASE l_linenumber % 7 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),'''') WHEN 1 THEN concat(' ',CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),''' ',CAST(l_linenumber AS VARCHAR),'"') WHEN 2 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),'"') WHEN 3 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),' FT.') WHEN 4 THEN '''' WHEN 5 THEN concat('a''',CAST(l_linenumber AS VARCHAR),'"') ELSE 'none' END"""


@query(rf"""WITH d AS (SELECT l_orderkey*10+l_linenumber AS id, trim({_DIM}) AS t FROM lineitem)
SELECT id, CASE WHEN regexp_full_match(t,'''') THEN 'illegible' WHEN regexp_full_match(t,'\d+''(\s*\d+)?"?') THEN 'parsed' WHEN regexp_full_match(t,'\d+"') THEN 'parsed' WHEN regexp_full_match(t,'\d+ FT\.') THEN 'parsed' WHEN contains(t,'''') AND contains(t,'"') THEN 'ambiguous' END AS status,
round(CASE WHEN regexp_full_match(t,'\d+''(\s*\d+)?"?') THEN CAST(regexp_extract(t,'^(\d+)',1) AS DOUBLE)+coalesce(TRY_CAST(regexp_extract(t,'''\s*(\d+)',1) AS DOUBLE),0.0)/12.0 WHEN regexp_full_match(t,'\d+"') OR regexp_full_match(t,'\d+ FT\.') THEN CAST(regexp_extract(t,'^(\d+)',1) AS DOUBLE) END,6) AS value,
CASE WHEN regexp_full_match(t,'\d+"') THEN 'in' WHEN regexp_full_match(t,'\d+''(\s*\d+)?"?') OR regexp_full_match(t,'\d+ FT\.') THEN 'ft' END AS unit FROM d""")
def parsed_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    spark_dim = _DIM.replace("VARCHAR", "STRING").replace("''''", "\"'\"").replace("''' '", "\"' \"").replace("'a'''", "\"a'\"")
    l = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(spark_dim).alias("t"))  # noqa: E741
    made = l.withColumn("d", X.parsed_dimension(F.col("t")))
    return made.select("id", "d.status", F.round("d.value", 6).alias("value"), "d.unit")


@query(r"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN replace(url, '/', '\') WHEN 2 THEN concat('up/../', url) WHEN 3 THEN concat(url, chr(7), '/') ELSE url END AS name FROM pages)
SELECT page_id, nullif(substr(regexp_replace(string_split(replace(name, '\', '/'), '/')[-1], '[\x00-\x1f\x7f]', '', 'g'), 1, 255), '') AS filename, NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..') AND name<>'' AS safe FROM n""")
def upload_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of uploads named by pages' addresses, some with backslashes, parent steps or control characters."""
    u = F.col("url")
    name = F.when(F.col("page_id") % 4 == 1, F.replace(u, F.lit("/"), F.lit("\\"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("up/../"), u)).when(F.col("page_id") % 4 == 3, F.concat(u, F.lit("\x07/"))).otherwise(u)
    p = table(spark, folder, "pages").select("page_id", name.alias("name"))
    return p.select("page_id", X.sanitized_filename(F.col("name")).alias("filename"), X.safe_key(F.col("name")).alias("safe"))


@query("""SELECT l_orderkey*10+l_linenumber AS id, concat('rel_', substr(sha256(concat('measures|', CAST(l_partkey AS VARCHAR), '|topology_edge|', CAST(l_suppkey AS VARCHAR))),1,12)) AS relationship_id FROM lineitem""")
def relationship_ids(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), X.relationship_id(F.lit("measures"), F.col("l_partkey").cast("string"), F.lit("topology_edge"), F.col("l_suppkey").cast("string")).alias("relationship_id"))


@query("""WITH h AS (SELECT p_partkey AS id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('edge_', p_name, CAST(p_partkey AS VARCHAR)))) AS h FROM part)
SELECT id, concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',substr('89ab', CAST(strpos('0123456789abcdef', substr(h,17,1))-1 AS INTEGER) % 4 + 1, 1),substr(h,18,3),'-',substr(h,21,12)) AS scene_id FROM h""")
def scene_ids(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("id"), X.uuid5(uuid.NAMESPACE_URL, F.concat(F.lit("edge_"), "p_name", F.col("p_partkey").cast("string"))).alias("scene_id"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),chr(13),'&#13;')) AS escaped, length(html) AS n FROM pages")
def escaped_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    return p.select("page_id", F.sha2(X.xml_text(F.col("html")), 256).alias("escaped"), F.length("html").alias("n"))


@query(r"""WITH n AS (SELECT l_orderkey*10+l_linenumber AS id, rtrim(rtrim(printf('%.3f', l_extendedprice/8.0+0.0001),'0'),'.') AS n, l_quantity AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)
SELECT id, n AS number, concat('#', lpad(lower(hex(CAST(r AS UTINYINT))),2,'0')) AS red FROM n""")
def drawn_numbers(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), X.number(F.col("l_extendedprice") / 8.0 + 0.0001).alias("number"), F.substring(X.rgb_hex(F.col("l_quantity"), F.lit(0), F.lit(0)), 1, 3).alias("red"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '```', '^[ \t\n\x0B\f\r]*```(?:json)?[ \t\n\x0B\f\r]*', ''), '[ \t\n\x0B\f\r]*```[ \t\n\x0B\f\r]*$', '')) AS body,
coalesce(nullif(trim(CASE WHEN doc_id % 3=0 THEN lang ELSE ' ' END, ' '), ''), nullif(substr(trim(text, ' '), 1, 80), ''), 'drawing') AS location FROM documents""")
def provider_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of providers without their fences, and locations filled from the reading."""
    d = table(spark, folder, "documents")
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return d.select("doc_id", F.sha2(X.without_fences(fenced), 256).alias("body"), X.filled_location(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" "), F.col("text")).alias("location"))


@query("""SELECT a.p_brand AS brand, count(*) AS n, round(avg(levenshtein(a.p_type, a.p_name)/CAST(length(a.p_type) AS DOUBLE)),6) AS cer, max(levenshtein(a.p_type, a.p_name)) AS worst FROM part a GROUP BY 1""")
def reading_errors(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.round(F.avg(metrics.character_error_rate(F.col("p_type"), F.col("p_name"))), 6).alias("cer"), F.max(F.levenshtein("p_type", "p_name")).cast("long").alias("worst"))


@query("""WITH j AS (SELECT lang, quality=1 AS t, n_chars>1000 AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), c AS (SELECT lang, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp/nullif(CAST(tp+fp AS DOUBLE),0),6) AS precision, round(tp/nullif(CAST(tp+fn AS DOUBLE),0),6) AS recall FROM c""")
def label_precision(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id").where("quality is not null and n_chars is not null")
    made = metrics.precision_recall(j, F.col("quality") == 1, F.col("n_chars") > 1000, "lang")
    return made.select("lang", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.95),6) AS p95 FROM events GROUP BY event_type")
def error_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    made = metrics.error_quantiles(table(spark, folder, "events"), F.col("value"), "event_type")
    return made.select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("""SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, len(list_filter(json_keys(props), lambda x: x<>'k')) AS extra_keys FROM events WHERE props IS NOT NULL""")
def event_payloads(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(checks.unequal_keys(F.json_object_keys("props"), ["k"])).cast("long").alias("extra_keys"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^<>]*>', 1)) AS name FROM pages) SELECT page_id, lower(name) AS name, count(*) AS n FROM t WHERE NOT list_contains(['svg','metadata','defs','symbol','marker','g','line','polyline','polygon','circle','rect','path','use','text','title'], lower(name)) GROUP BY ALL""")
def forbidden_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of each page that a drawing may not hold."""
    found = markup.forbidden(markup.elements(table(spark, folder, "pages"), "page_id", "html"))
    return found.groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"#][^"]*)"', 1))) AS outside FROM pages""")
def outside_references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.size(markup.outside_references(F.col("html"))).cast("long").alias("outside"))


@query(rf"""WITH s AS ({SEGMENTS_SQL}), l AS (SELECT document_id, id, concat('<line id="pipe-', CAST(id AS VARCHAR), '" data-state="machine"/>') AS line FROM s)
SELECT document_id, count(*) AS pipes, sha256(concat('<svg xmlns="http://www.w3.org/2000/svg">', chr(10), string_agg(line, chr(10) ORDER BY id), chr(10), '</svg>', chr(10))) AS digest FROM l GROUP BY document_id""")
def drawn_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each page's pipes drawn as SVG."""
    s = segments(spark, folder)
    line = F.concat(F.lit('<line id="'), X.xml_attribute(F.concat(F.lit("pipe-"), F.col("id").cast("string"))), F.lit('" data-state="machine"/>'))
    drawn = markup.drawings(s.select("document_id", "id", line.alias("line")), "document_id", "id", "line")
    return drawn.join(s.groupBy("document_id").agg(F.count("*").alias("pipes")), "document_id").select("document_id", "pipes", F.sha2("svg", 256).alias("digest"))


_SCENE = f"""WITH j AS (SELECT document_id, id, x, y FROM ({POINTS_SQL})), p AS (SELECT document_id, id, id AS start_node, id+id % 3 AS end_node, x0, y0, x1, y1 FROM ({SEGMENTS_SQL}))"""


@query(f"""{_SCENE}, i AS (
SELECT 'COORDINATE_OUT_OF_BOUNDS' AS code, CAST(id AS VARCHAR) AS owner, 'position' AS path FROM j WHERE NOT (x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 200)
UNION ALL SELECT 'UNKNOWN_REFERENCE', CAST(id AS VARCHAR), 'end_node' FROM p WHERE end_node NOT IN (SELECT id FROM j)
UNION ALL SELECT 'PIPE_DEGENERATE', CAST(id AS VARCHAR), 'pipe' FROM p WHERE start_node=end_node OR (x0=x1 AND y0=y1)
UNION ALL SELECT 'PIPE_ENDPOINT_MISMATCH', CAST(p.id AS VARCHAR), 'start_node' FROM p JOIN j ON p.start_node=j.id WHERE (x0-x)*(x0-x)+(y0-y)*(y0-y)>0.25
UNION ALL SELECT 'PIPE_ENDPOINT_MISMATCH', CAST(p.id AS VARCHAR), 'end_node' FROM p JOIN j ON p.end_node=j.id WHERE (x1-x)*(x1-x)+(y1-y)*(y1-y)>0.25
UNION ALL SELECT 'DUPLICATE_ID', CAST(k AS VARCHAR), 'id' FROM (SELECT id // 2 AS k, row_number() OVER (PARTITION BY id // 2 ORDER BY id) AS n FROM j WHERE id % 5<2) WHERE n>1
UNION ALL SELECT 'MACHINE_EVIDENCE_MISSING', CAST(id AS VARCHAR), 'interpretation.evidence' FROM j WHERE id % 2=0 AND id % 6=0)
SELECT code, path, count(*) AS n, min(owner) AS first_owner FROM i GROUP BY ALL""")
def scene_issues(spark: SparkSession, folder: str) -> DataFrame:
    """All integrity checks over a scene of junctions and pipes, by code and path."""
    j = points(spark, folder)
    p = segments(spark, folder).select("id", F.col("id").alias("start_node"), (F.col("id") + F.col("id") % 3).alias("end_node"), "x0", "y0", "x1", "y1")
    references = [p.select(F.col("id").alias("owner"), F.lit(n).alias("path"), F.col(n).alias("ref"), F.lit("junction").alias("expected")) for n in ("start_node", "end_node")]
    index = j.select("id", F.lit("junction").alias("kind"))
    doubled = j.where("id % 5 < 2").select(F.expr("id div 2").alias("id"), F.col("id").alias("ord"))
    evidence = j.select("id", F.when(F.col("id") % 2 == 0, "machine").otherwise("confirmed").alias("state"), (F.col("id") % 6).alias("evidence"))
    found = [
        checks.out_of_bounds(j.select(F.col("id").alias("owner"), "x", "y"), 200, 200, "position"), checks.reference_problems(references[0].union(references[1]), index),
        checks.pipe_problems(p, j, 0.5), checks.duplicate_ids(doubled), checks.missing_evidence(evidence),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), found).groupBy("code", "path").agg(F.count("*").alias("n"), F.min("owner").alias("first_owner"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', 0), '') IS NOT NULL AS invalid FROM documents WHERE text IS NOT NULL""")
def invalid_characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", X.first_invalid_xml_character(F.col("text")).isNotNull().alias("invalid"))
