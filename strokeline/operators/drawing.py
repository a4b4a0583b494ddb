"""Drawing of whole scenes as SVG documents: tables of objects, layers, ports, outlines and relationships in, a document for each page out.

Every object becomes lines with a sort key, by joins with what it refers to; lines are put together by page and group, and
groups by page. A page has a bounded number of objects. Rejected objects and relationships aren't drawn, and neither is
what leads to them. Empty groups are there as empty elements, so equal scenes give equal bytes.

    pages          page, width, height, schema_version, revision_id
    layers         page, layer, color
    objects        page, id, type, state, layer, kind, symbol_id, rotation, text, recognized, x, y, x1, y1, start_id, end_id
    ports          page, id (of a symbol), port, node_id (null: not connected)
    outlines       page, id (of an unknown mark), n, points (array of structs x, y in the source), in the order of n
    relationships  page, id, type, state, from_id, to_id
    library        symbol_id, ports (map of names to structs x, y), primitives (array of structs kind, fill, radius, points)

Dimensions measure from (x, y) to (x1, y1); pipes lie between their junctions; everything else stands at (x, y). `page` is
the column's name that the caller gives.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, xml_attribute, xml_text
from .markup import GROUPS


@dataclasses.dataclass(frozen=True)
class Style:
    """How drawings look; lengths are pixels of the page. Fixed values."""

    version: str = "piping-default@1.0.0"
    pipe_width: float = 2.0
    symbol_width: float = 1.5
    dimension_width: float = 0.75
    callout_width: float = 0.75
    unresolved_width: float = 1.0
    unresolved_dashes: str = "4 2"
    font: str = "Arial, Helvetica, 'Liberation Sans', sans-serif"
    font_size: float = 12.0
    dot_radius: float = 3.0
    ring_radius: float = 5.0
    arrow: float = 6.0
    scale: float = 1.0
    ink: str = "#1a1a1a"
    unresolved_ink: str = "#d93025"


#: Pipes, or ports of symbols, that must meet in a junction for a dot. Fixed value.
DOT_DEGREE = 3
PLAIN = Style()


def _attributes(pairs: dict[str, Column | float | str]) -> Column:
    def value(v):
        if isinstance(v, Column):
            return v
        return xml_attribute(F.lit(v)) if isinstance(v, str) else number(F.lit(float(v)))

    return F.concat(*[F.concat(F.lit(f' {name}="'), value(v), F.lit('"')) for name, v in pairs.items()])


def empty(name: str, pairs: dict) -> Column:
    return F.concat(F.lit(f"<{name}"), _attributes(pairs), F.lit("/>\n"))


def texted(name: str, pairs: dict, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), _attributes(pairs) if pairs else F.lit(""), F.lit(">"), xml_text(content), F.lit(f"</{name}>\n"))


def wrapped(name: str, pairs: dict, body: Column) -> Column:
    """An element around lines; without any an empty one."""
    start = F.concat(F.lit(f"<{name}"), _attributes(pairs) if pairs else F.lit(""))
    body = F.coalesce(body, F.lit(""))
    return F.when(body == "", F.concat(start, F.lit("/>\n"))).otherwise(F.concat(start, F.lit(">\n"), body, F.lit(f"</{name}>\n")))


def _own() -> dict[str, Column]:
    """Attributes of the element that stands for an object."""
    name = xml_attribute(F.col("id").cast("string"))
    return {"id": F.concat(F.lit("obj-"), name), "data-object-id": name, "data-state": xml_attribute(F.col("state"))}


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), " ")


def live(rows: DataFrame) -> DataFrame:
    return rows.where("state <> 'rejected'")


def degrees(objects: DataFrame, ports: DataFrame, page: str) -> DataFrame:
    """page, id and degree of junctions: ends of pipes, and ports of symbols, that meet there."""
    pipes = live(objects).where("type = 'pipe_segment'").select(page, F.explode(F.array("start_id", "end_id")).alias("id"))
    symbols = live(objects).where("type = 'symbol'").select(page, "id")
    plugged = ports.where("node_id is not null").join(symbols, [page, "id"]).select(page, F.col("node_id").alias("id"))
    return pipes.union(plugged).groupBy(page, "id").agg(F.count("*").alias("degree"))


def attached_to_rejected(objects: DataFrame, ports: DataFrame, page: str) -> DataFrame:
    """page, id, type, path and node_id of live pipes and symbols that hang on a rejected junction: without it they would be drawn as loose."""
    rejected = objects.where("type = 'junction' and state = 'rejected'").select(page, F.col("id").alias("node_id"))
    pipes = live(objects).where("type = 'pipe_segment'")
    ends = [pipes.select(page, "id", "type", F.lit(path).alias("path"), F.col(c).alias("node_id")) for c, path in (("start_id", "startNodeId"), ("end_id", "endNodeId"))]
    symbols = live(objects).where("type = 'symbol'").select(page, "id", "type")
    plugged = ports.join(symbols, [page, "id"]).select(page, "id", "type", F.concat(F.lit("portNodeIds["), F.col("port"), F.lit("]")).alias("path"), "node_id")
    return ends[0].union(ends[1]).union(plugged).join(rejected, [page, "node_id"]).select(page, "id", "type", "path", "node_id")


def page_outlines(outlines: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """page, id, n and points of outlines (with `matrix`, of 9 numbers, from the source to the page, in pages), kept on the page; fewer than three points are none."""
    met = outlines.join(pages.select(page, "width", "height", "matrix"), page)
    m = lambda k: F.col("matrix")[k]

    def mapped(p: Column) -> Column:
        w = m(6) * p["x"] + m(7) * p["y"] + m(8)
        x, y = ((m(k) * p["x"] + m(k + 1) * p["y"] + m(k + 2)) / F.when(w != 0, w) for k in (0, 3))
        inside = lambda v, side: F.least(F.greatest(v, F.lit(0.0)), F.col(side).cast("double"))
        odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(~odd(x) & ~odd(y), F.struct(inside(x, "width").alias("x"), inside(y, "height").alias("y")))

    made = met.select(page, "id", "n", F.filter(F.transform("points", mapped), lambda p: p.isNotNull()).alias("points"))
    return made.where(F.size("points") >= 3)


def places(objects: DataFrame, outlines: DataFrame, page: str) -> DataFrame:
    """page, id, px and py: where a callout to an object ends; a mark without an outline has no such place."""
    junctions = objects.where("type = 'junction'").select(page, F.col("id").alias("node"), "x", "y")
    end = lambda c, k: junctions.select(page, F.col("node").alias(c), F.col("x").alias(f"px{k}"), F.col("y").alias(f"py{k}"))
    pipes = objects.where("type = 'pipe_segment'").join(end("start_id", 0), [page, "start_id"]).join(end("end_id", 1), [page, "end_id"])
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    first = outlines.groupBy(page, "id").agg(F.min_by("points", "n").alias("points"))
    mean = lambda c: F.aggregate(F.transform("points", lambda p: p[c]), F.lit(0.0), lambda a, b: a + b) / F.size("points")
    parts = [
        objects.where("type in ('junction', 'symbol', 'annotation')").select(page, "id", F.col("x").alias("px"), F.col("y").alias("py")),
        objects.where("type = 'dimension'").select(page, "id", middle("x", "x1"), middle("y", "y1")),
        pipes.select(page, "id", middle("px0", "px1"), middle("py0", "py1")),
        first.select(page, "id", mean("x"), mean("y")),
    ]
    return functools.reduce(lambda a, b: a.union(b), parts)


def unresolved(objects: DataFrame, ports: DataFrame, page: str) -> DataFrame:
    """page, kind, id and port of what a drawing leaves open: unknown junctions, ports without a node, unknown marks."""
    known = live(objects)
    loose = ports.where("node_id is null").join(known.where("type = 'symbol'").select(page, "id"), [page, "id"])
    row = lambda rows, kind, port: rows.select(page, F.lit(kind).alias("kind"), F.col("id"), port.alias("port"))
    none = F.lit(None).cast("string")
    return (
        row(known.where("type = 'junction' and kind = 'unknown'"), "unknown_junction", none)
        .union(row(loose, "unresolved_port", F.col("port"))).union(row(known.where("type = 'unknown_mark'"), "unknown_mark", none))
    )


def lines(layers: DataFrame, objects: DataFrame, ports: DataFrame, outlines: DataFrame, relationships: DataFrame, library: DataFrame, page: str, style: Style = PLAIN) -> DataFrame:
    """page, group, layer (of pipes), key, part and line (one or more, each ended): what is drawn of every live object and callout. outlines are of `page_outlines`."""
    x, y = number(F.col("x")), number(F.col("y"))
    known = live(objects).join(layers.select(page, "layer", xml_attribute(F.col("color")).alias("_color")), [page, "layer"], "left")
    of = lambda kind: known.where(F.col("type") == kind)
    color, none = F.col("_color"), F.lit("")

    def rows(found: DataFrame, group: str, line: Column, layer: Column = none, part: Column = none) -> DataFrame:
        return found.select(page, F.lit(group).alias("group"), layer.alias("layer"), F.col("id").cast("string").alias("key"), part.alias("part"), line.alias("line"))

    ring = {"r": style.ring_radius, "stroke": style.unresolved_ink, "stroke-width": style.unresolved_width, "fill": "none"}
    font = {"fill": style.ink, "font-family": style.font, "font-size": style.font_size}
    thin = {"stroke": style.ink, "stroke-width": style.dimension_width}
    round_ends = {"stroke-linecap": "round", "stroke-linejoin": "round"}

    node = objects.where("type = 'junction'").select(page, F.col("id").alias("_node"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    end = lambda c, k: node.select(page, F.col("_node").alias(c), F.col("_x").alias(f"px{k}"), F.col("_y").alias(f"py{k}"))
    pipes = of("pipe_segment").join(end("start_id", 0), [page, "start_id"]).join(end("end_id", 1), [page, "end_id"])
    ends = {name: number(F.col(c)) for name, c in (("x1", "px0"), ("y1", "py0"), ("x2", "px1"), ("y2", "py1"))}

    junctions = of("junction").join(degrees(objects, ports, page), [page, "id"], "left")
    dot = {"cx": x, "cy": y, "r": style.dot_radius, "fill": color}
    dotted = F.coalesce(F.col("degree"), F.lit(0)) >= DOT_DEGREE
    # the ring stands for an unknown junction
    point = F.when(F.col("kind") == "unknown", F.when(dotted, empty("circle", dot))).when(dotted, empty("circle", _own() | dot)).otherwise(empty("g", _own()))

    turned = F.concat(F.lit("translate("), x, F.lit(" "), y, F.lit(") rotate("), number(F.col("rotation")), F.lit(f") scale({style.scale:g})"))
    symbol = empty("use", _own() | {"href": F.concat(F.lit("#sym-"), xml_attribute(F.col("symbol_id"))), "transform": turned, "stroke": color, "stroke-width": style.symbol_width} | round_ends | {"fill": color})

    witness = empty("line", {"x1": x, "y1": y, "x2": number(F.col("x1")), "y2": number(F.col("y1"))} | thin | {"marker-start": "url(#marker-arrow-start)", "marker-end": "url(#marker-arrow-end)"})
    middle = {"x": number((F.col("x") + F.col("x1")) / 2), "y": number((F.col("y") + F.col("y1")) / 2)}
    dimension = wrapped("g", _own(), F.concat(witness, texted("text", middle | font | {"text-anchor": "middle"}, F.col("text"))))

    notes = live(objects).where("type = 'annotation'").select(page, F.col("id").alias("from_id"), "x", "y")
    targets = places(live(objects), outlines, page).join(live(objects).select(page, "id"), [page, "id"]).withColumnRenamed("id", "to_id")
    callouts = live(relationships).where("type = 'callout_targets'").join(notes, [page, "from_id"]).join(targets, [page, "to_id"])
    callout = empty("line", {"x1": x, "y1": y, "x2": number(F.col("px")), "y2": number(F.col("py")), "stroke": style.ink, "stroke-width": style.callout_width})

    note = texted("text", _own() | {"data-recognized-text": xml_attribute(F.col("recognized")), "x": x, "y": y} | font, F.col("text"))

    loose = of("symbol").join(ports.where("node_id is null").select(page, "id", "port"), [page, "id"]).join(library.select("symbol_id", "ports"), "symbol_id")
    angle, at = F.radians("rotation"), F.col("ports")[F.col("port")]
    px = F.col("x") + style.scale * (at["x"] * F.cos(angle) - at["y"] * F.sin(angle))
    py = F.col("y") + style.scale * (at["x"] * F.sin(angle) + at["y"] * F.cos(angle))

    drawn = outlines.groupBy(page, "id").agg(F.array_sort(F.collect_list(F.struct("n", "points"))).alias("_outlines"))
    polygons = F.array_join(F.transform(F.coalesce("_outlines", F.array().cast(drawn.schema["_outlines"].dataType)), lambda o: empty("polygon", {"points": _coordinates(o["points"])})), "")
    mark = wrapped("g", _own() | {"stroke": style.unresolved_ink, "stroke-width": style.unresolved_width, "stroke-dasharray": style.unresolved_dashes, "fill": "none"}, polygons)

    parts = [
        rows(pipes, "pipes", empty("line", _own() | ends), F.col("layer")), rows(junctions, "connections", point), rows(of("symbol"), "symbols", symbol),
        rows(of("dimension"), "dimensions", dimension), rows(callouts, "callouts", callout), rows(of("annotation"), "annotations", note),
        rows(of("junction").where("kind = 'unknown'"), "unresolved", empty("circle", _own() | {"cx": x, "cy": y} | ring)),
        rows(loose, "unresolved", empty("circle", {"cx": number(px), "cy": number(py)} | ring), part=F.col("port")),
        rows(of("unknown_mark").join(drawn, [page, "id"], "left"), "unresolved", mark),
    ]
    return functools.reduce(lambda a, b: a.union(b), parts).where("line is not null")


def _arrow(name: str, back: bool, style: Style) -> Column:
    size, half = f"{style.arrow:g}", f"{style.arrow / 2:g}"
    tip = f"M{size} 0L0 {half}L{size} {size}Z" if back else f"M0 0L{size} {half}L0 {size}Z"
    pairs = {"id": name, "viewBox": f"0 0 {size} {size}", "refX": 0.0 if back else style.arrow, "refY": style.arrow / 2, "markerWidth": style.arrow, "markerHeight": style.arrow, "markerUnits": "userSpaceOnUse", "orient": "auto", "overflow": "visible"}
    return wrapped("marker", pairs, empty("path", {"d": tip, "fill": style.ink}))


def definitions(objects: DataFrame, library: DataFrame, page: str, style: Style = PLAIN) -> DataFrame:
    """page and definitions: arrowheads where a dimension is drawn, then the symbols that a page shows, by name."""

    def shape(p: Column) -> Column:
        at = p["points"]
        unfilled = F.when(p["fill"], F.lit("/>\n")).otherwise(F.lit(' fill="none"/>\n'))
        begun = lambda name, pairs: F.concat(F.lit(f"<{name}"), _attributes(pairs), unfilled)
        line = empty("line", {"x1": number(at[0]["x"]), "y1": number(at[0]["y"]), "x2": number(F.get(at, F.lit(1))["x"]), "y2": number(F.get(at, F.lit(1))["y"])})
        circle = begun("circle", {"cx": number(at[0]["x"]), "cy": number(at[0]["y"]), "r": number(p["radius"])})
        return F.when(p["kind"] == "line", line).when(p["kind"] == "circle", circle).otherwise(begun("polygon", {"points": _coordinates(at)}))

    entry = wrapped("symbol", {"id": F.concat(F.lit("sym-"), xml_attribute(F.col("symbol_id"))), "overflow": "visible"}, F.array_join(F.transform("primitives", shape), ""))
    shown = live(objects).where("type = 'symbol'").select(page, "symbol_id").distinct().join(library.select("symbol_id", entry.alias("_entry")), "symbol_id")
    symbols = shown.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", "_entry"))), lambda s: s["_entry"]), "").alias("_symbols"))
    arrows = live(objects).where("type = 'dimension'").select(page).distinct().withColumn("_arrows", F.concat(_arrow("marker-arrow-start", True, style), _arrow("marker-arrow-end", False, style)))
    both = symbols.join(arrows, page, "full")
    return both.select(page, F.concat(F.coalesce("_arrows", F.lit("")), F.coalesce("_symbols", F.lit(""))).alias("definitions"))


def documents(
    pages: DataFrame, layers: DataFrame, objects: DataFrame, ports: DataFrame, outlines: DataFrame, relationships: DataFrame, library: DataFrame,
    page: str = "document_id", library_version: str = "piping-symbols@1.0.0", renderer: str = "1.0.0", style: Style = PLAIN,
) -> DataFrame:
    """page and svg: a document for each page, one without objects too. pages have `matrix` beside the columns above."""
    outlines = page_outlines(outlines, pages, page)
    made = lines(layers, objects, ports, outlines, relationships, library, page, style)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "part", "line"))), lambda x: x["line"]), "")
    bodies = made.groupBy(page, "group", "layer").agg(joined.alias("body"))
    stroke = {"stroke": xml_attribute(F.col("color")), "stroke-width": style.pipe_width, "stroke-linecap": "round", "stroke-linejoin": "round"}
    of_layers = layers.join(bodies.where("group = 'pipes'").select(page, "layer", "body"), [page, "layer"], "left")
    of_layers = of_layers.select(page, "layer", wrapped("g", {"id": F.concat(F.lit("layer-"), xml_attribute(F.col("layer")))} | stroke, F.col("body")).alias("line"))
    pipes = of_layers.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "line"))), lambda x: x["line"]), "").alias("g_pipes"))
    others = bodies.groupBy(page).agg(*[F.max(F.when(F.col("group") == g, F.col("body"))).alias(f"g_{g}") for g in GROUPS if g != "pipes"])
    left = unresolved(objects, ports, page).groupBy(page).agg(F.count("*").alias("_left"))
    met = pages.join(pipes, page, "left").join(others, page, "left").join(left, page, "left").join(definitions(objects, library, page, style), page, "left")
    about = F.to_json(F.struct(
        F.col("schema_version").alias("schemaVersion"), F.col(page).cast("string").alias("documentId"), F.col("revision_id").cast("string").alias("revisionId"), F.lit(renderer).alias("rendererVersion"),
        F.lit(library_version).alias("symbolLibraryVersion"), F.lit(style.version).alias("styleProfileVersion"), F.coalesce("_left", F.lit(0)).alias("unresolvedCount"),
    ))
    width, height = (number(F.col(c).cast("double")) for c in ("width", "height"))
    view = {"xmlns": "http://www.w3.org/2000/svg", "viewBox": F.concat(F.lit("0 0 "), width, F.lit(" "), height), "width": width, "height": height}
    body = [wrapped("g", {"id": g}, F.col(f"g_{g}")) for g in GROUPS]
    return met.select(page, F.concat(F.lit("<svg"), _attributes(view), F.lit(">\n"), texted("metadata", {}, about), wrapped("defs", {}, F.col("definitions")), *body, F.lit("</svg>\n")).alias("svg"))
