"""Markup: elements and attributes as rows, allow-list checks, and drawing of scenes as SVG lines."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, xml_attribute, xml_text

#: Elements that a drawing may hold.
ELEMENTS = ("svg", "metadata", "defs", "symbol", "marker", "g", "line", "polyline", "polygon", "circle", "rect", "path", "use", "text", "title")


def elements(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, place, name and attributes (raw) of every start tag."""
    tags = F.regexp_extract_all(text, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>"), 0)
    made = documents.select(ident, F.posexplode(tags).alias("place", "tag"))
    return made.select(ident, "place", F.lower(F.regexp_extract("tag", r"<([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"), F.regexp_extract("tag", r"<[a-zA-Z][a-zA-Z0-9]*([^<>]*)>", 1).alias("attributes"))


def outside_references(text: Column) -> Column:
    """Values of href and src that don't stay inside the document."""
    found = F.regexp_extract_all(text, F.lit(r"(?:href|src)=\"([^\"#][^\"]*)\""), 1)
    return F.array_distinct(found)


def forbidden(found: DataFrame, allowed: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """Elements that aren't allowed."""
    return found.where(~F.col("name").isin(*allowed))


def pipe_line(ident: Column, x0: Column, y0: Column, x1: Column, y1: Column, state: Column) -> Column:
    """The SVG line of a pipe."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    parts = [attribute("id", xml_attribute(F.concat(F.lit("pipe-"), ident.cast("string")))), attribute("data-state", state)]
    parts += [attribute(n, number(v)) for n, v in (("x1", x0), ("y1", y0), ("x2", x1), ("y2", y1))]
    return F.concat(F.lit("<line"), *parts, F.lit("/>"))


def drawings(lines: DataFrame, page: str, order: str, line: str) -> DataFrame:
    """page and svg: the lines of each page in order, as one document. A page has a bounded number of objects."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return lines.groupBy(page).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), body, F.lit("\n</svg>\n")).alias("svg"))


#: The groups of a drawing, from below to above. Fixed values.
GROUPS = ("pipes", "connections", "symbols", "dimensions", "callouts", "annotations", "unresolved")


def _tag(name: str, attributes: dict[str, Column], content: Column | None = None) -> Column:
    parts = [F.concat(F.lit(f' {n}="'), v, F.lit('"')) for n, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *parts, *([F.lit("/>")] if content is None else [F.lit(">"), content, F.lit(f"</{name}>")]))


def scene_lines(objects: DataFrame, dots: int = 3) -> DataFrame:
    """document_id, group, ord, key and line of everything that a scene (rows of `scene.OBJECT`) shows.

    Junctions of `dots` pipes or more get a dot, unknown ones and unknown marks a ring, and a callout leads from an
    annotation to the junction, or the middle of the pipe, that it points to.
    """
    name, x, y = xml_attribute(F.col("id")), number(F.col("x")), number(F.col("y"))
    at = {"x": x, "y": y}
    place = F.struct(F.coalesce((F.col("x") + F.col("x1")) / 2, F.col("x")).alias("x"), F.coalesce((F.col("y") + F.col("y1")) / 2, F.col("y")).alias("y"))
    ends = objects.where("type = 'pipe_segment'").select("document_id", F.explode(F.array("start_id", "end_id")).alias("id"))
    degree = ends.groupBy("document_id", "id").agg(F.count("*").alias("degree"))
    targets = objects.select("document_id", F.col("id").alias("target_id"), place.alias("to"))
    shown = {
        "pipes": (objects.where("type = 'pipe_segment'"), _tag("line", {"id": F.concat(F.lit("pipe-"), name), "x1": x, "y1": y, "x2": number(F.col("x1")), "y2": number(F.col("y1"))})),
        "connections": (objects.where("type = 'junction'").join(degree.where(F.col("degree") >= dots), ["document_id", "id"]), _tag("circle", {"cx": x, "cy": y, "r": F.lit("3")})),
        "symbols": (objects.where("type = 'symbol'"), _tag("use", {"id": F.concat(F.lit("symbol-"), name), "href": F.concat(F.lit("#sym-"), xml_attribute(F.col("label"))), "transform": F.concat(F.lit("translate("), x, F.lit(" "), y, F.lit(")"))})),
        "dimensions": (objects.where("type = 'dimension'"), _tag("text", {"id": F.concat(F.lit("dimension-"), name), **at}, xml_text(F.col("label")))),
        "callouts": (objects.where("type = 'annotation'").join(targets, ["document_id", "target_id"]), _tag("line", {"x1": x, "y1": y, "x2": number(F.col("to.x")), "y2": number(F.col("to.y"))})),
        "annotations": (objects.where("type = 'annotation'"), _tag("text", {"id": F.concat(F.lit("text-"), name), **at}, xml_text(F.col("label")))),
        "unresolved": (objects.where("type = 'unknown_mark' or type = 'junction' and label = 'unknown'"), _tag("circle", {"id": F.concat(F.lit("unknown-"), name), "cx": x, "cy": y, "r": F.lit("6"), "fill": F.lit("none")})),
    }
    made = [rows.select("document_id", F.lit(group).alias("group"), F.lit(GROUPS.index(group)).alias("ord"), F.col("id").alias("key"), line.alias("line")) for group, (rows, line) in shown.items()]
    return functools.reduce(lambda a, b: a.union(b), made)


def symbol_definitions(objects: DataFrame) -> DataFrame:
    """document_id and the ids of the symbols it shows, sorted and once each."""
    return objects.where("type = 'symbol'").groupBy("document_id").agg(F.array_sort(F.collect_set("label")).alias("symbols"))


def drawn_scene(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """document_id and svg: definitions, then every group, empty ones too, with its lines by key. A page has a bounded number of objects."""
    body = lambda g: F.array_join(F.transform(F.array_sort(F.filter("_all", lambda s: s["group"] == g)), lambda s: F.concat(s["line"], F.lit("\n"))), "")
    every = lines.groupBy("document_id").agg(F.collect_list(F.struct("group", "key", "line")).alias("_all")).join(definitions, "document_id", "left")
    defs = F.array_join(F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.concat(F.lit('<symbol id="sym-'), xml_attribute(s), F.lit('"/>\n'))), "")
    groups = [F.concat(F.lit(f'<g id="{g}">\n'), body(g), F.lit("</g>\n")) for g in GROUPS]
    return every.select("document_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n<defs>\n'), defs, F.lit("</defs>\n"), *groups, F.lit("</svg>\n")).alias("svg"))


#: Elements of a trace and the attributes that each may have. Fixed values.
TRACE = {"svg": ("xmlns", "width", "height", "viewBox"), "g": ("id", "fill", "stroke", "stroke-width"), "path": ("d", "fill", "stroke", "stroke-width"), "title": ()}


def trace_problems(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, code and detail of traces (ident, text, width, height): declarations, elements and attributes that aren't allowed, and path points further outside the page than 5 % of its side and 4 pixels."""
    found = elements(documents, ident, text)
    allowed = F.coalesce(*[F.when(F.col("name") == n, F.array(*[F.lit(a) for a in attributes]).cast("array<string>")) for n, attributes in TRACE.items()])
    row = lambda rows, code, detail: rows.select(ident, F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    names = F.regexp_extract_all("attributes", F.lit(r'([a-zA-Z][a-zA-Z-]*)="'), 1)
    extra = found.where(allowed.isNotNull()).select(ident, F.explode(F.array_except(names, allowed)).alias("detail"))
    numbers = F.regexp_extract_all(F.regexp_extract("attributes", r' d="([^"]*)"', 1), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    points = found.where("name = 'path'").select(ident, F.posexplode(numbers).alias("at", "value")).join(documents.select(ident, "width", "height"), ident)
    side = F.when(F.col("at") % 2 == 0, F.col("width")).otherwise(F.col("height"))
    value = F.col("value").cast("double")
    outside = points.where((value < -(0.05 * side + 4)) | (value > 1.05 * side + 4))
    made = row(documents.where(F.contains(F.col(text), F.lit("<!DOCTYPE")) | F.contains(F.col(text), F.lit("<!ENTITY"))), "declaration", F.lit(None))
    for part in (row(found.where(allowed.isNull()), "forbidden_element", F.col("name")), row(extra, "forbidden_attribute", F.col("detail")), row(outside, "outside_page", F.col("value"))):
        made = made.unionByName(part)
    return made
