"""Nested markup as tables: tags in order, depth by a running sum, parents by the last open tag one level up, and rules over them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .markup import ELEMENTS

#: One tag, comment, section, instruction or declaration; quoted values may hold angle brackets.
TAG = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!/]?[A-Za-z_:](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_NAME = r"^<[?!/]?([A-Za-z_:][A-Za-z0-9_:.-]*)"


def tags(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, place, kind, name and tag of every tag of a document. Text between tags, comments and sections have no rows of their own."""
    each = documents.select(ident, F.posexplode(F.regexp_extract_all(text, F.lit(TAG), 0)).alias("place", "tag"))
    kind = (
        F.when(F.col("tag").startswith("<!--") | F.col("tag").startswith("<![CDATA["), None).when(F.col("tag").startswith("<?"), "instruction")
        .when(F.col("tag").startswith("<!"), "declaration").when(F.col("tag").startswith("</"), "end").when(F.col("tag").endswith("/>"), "empty").otherwise("start")
    )
    return each.select(ident, "place", kind.alias("kind"), F.regexp_extract("tag", _NAME, 1).alias("name"), "tag").where("kind is not null")


def nested(found: DataFrame, ident: str) -> DataFrame:
    """Tags with depth (1 for a root), opener (the name that an end tag ends) and parent (the place of the tag around an element).

    A window sees one document, or one level of it.
    """
    order = Window.partitionBy(ident).orderBy("place")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    depth = F.sum(step).over(order) + F.when(F.col("kind").isin("end", "empty"), 1).otherwise(0)
    deep = found.withColumn("depth", F.when(F.col("kind").isin("start", "end", "empty"), depth).cast("int"))
    level = Window.partitionBy(ident, "depth").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("kind").isin("start", "end"), F.struct("kind", "name", "place")), ignorenulls=True).over(level)
    deep = deep.withColumn("_open", open_)
    opener = F.when((F.col("kind") == "end") & (F.col("_open.kind") == "start"), F.col("_open.name"))
    deep = deep.withColumn("opener", opener).drop("_open")
    # every start tag stands on its own level, every element on the one above as well, where it finds the last start tag before it
    above = deep.where("kind in ('start', 'empty')").select(ident, "place", (F.col("depth") - 1).alias("level"), F.lit(None).cast("int").alias("outer"))
    own = deep.where("kind = 'start'").select(ident, "place", F.col("depth").alias("level"), F.col("place").alias("outer"))
    seen = Window.partitionBy(ident, "level").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parents = own.union(above).withColumn("parent", F.last("outer", ignorenulls=True).over(seen)).where("outer is null").select(ident, "place", "parent")
    return deep.join(parents, [ident, "place"], "left")


def paths(deep: DataFrame, ident: str) -> DataFrame:
    """Elements with their path, as /svg/g[2]/line[1]: each element's number among those of its name under one parent; a root has none.

    A path doubles its length with each join, so depth d takes log2(d) of them.
    """
    siblings = Window.partitionBy(ident, "parent", "name").orderBy("place")
    elements = deep.where("kind in ('start', 'empty')")
    label = F.when(F.col("depth") == 1, F.concat(F.lit("/"), F.col("name"))).otherwise(F.concat(F.lit("/"), "name", F.lit("["), F.row_number().over(siblings).cast("string"), F.lit("]")))
    now = stored(elements.select(ident, "place", "name", "depth", "parent", label.alias("path"), F.col("parent").alias("_next")), "paths")
    while not now.where("_next is not null").isEmpty():
        up = now.select(ident, F.col("place").alias("_next"), F.col("path").alias("_path"), F.col("_next").alias("_after"))
        joined = now.join(up, [ident, "_next"], "left")
        now = stored(joined.select(ident, "place", "name", "depth", "parent", F.concat(F.coalesce("_path", F.lit("")), "path").alias("path"), F.col("_after").alias("_next")), "paths")
    return now.drop("_next")


def parse_problems(deep: DataFrame, documents: DataFrame, ident: str) -> DataFrame:
    """ident and problem of documents that aren't well formed or hold what is refused: the first one by place.

    Refused are document types, entities, notations and all instructions but a declaration of XML at the start in UTF-8.
    """
    at = lambda when, text: F.when(when, text)
    lower = F.lower("tag")
    encoding = F.upper(F.regexp_extract("tag", r"encoding\s*=\s*[\"']([^\"']*)[\"']", 1))
    declared = (F.col("kind") == "instruction") & (F.col("name") == "xml") & (F.col("place") == 0)
    problem = F.coalesce(
        at((F.col("kind") == "declaration") & lower.startswith("<!doctype"), "DOCTYPE declaration is not allowed"),
        at((F.col("kind") == "declaration"), "ENTITY declaration is not allowed"),
        at(declared & (encoding != "") & (encoding != "UTF-8"), "encoding is not allowed; use UTF-8"),
        at((F.col("kind") == "instruction") & ~declared, "processing instruction is not allowed"),
        at((F.col("kind") == "end") & (F.col("opener").isNull() | (F.col("opener") != F.col("name"))), "mismatched tag"),
        at(F.col("kind").isin("start", "empty") & (F.col("depth") == 1) & (F.col("roots") > 1), "junk after document element"),
    )
    roots = F.sum(F.when(F.col("kind").isin("start", "empty") & (F.col("depth") == 1), 1).otherwise(0)).over(Window.partitionBy(ident).orderBy("place"))
    first = deep.withColumn("roots", roots).withColumn("problem", problem).groupBy(ident).agg(
        F.min(F.when(F.col("problem").isNotNull(), F.struct("place", "problem"))).alias("first"),
        F.sum(F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)).alias("left"), F.max("roots").alias("roots"),
    )
    told = documents.select(ident).join(first, ident, "left")
    whole = F.coalesce("first.problem", F.when(F.coalesce("roots", F.lit(0)) == 0, "no element found").when(F.col("left") != 0, "unclosed token"))
    return told.select(ident, whole.alias("problem")).where("problem is not null")


def structure_problems(deep: DataFrame, ident: str, allowed: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """Elements (ident, place) with what forbids them, and hidden: inside a forbidden one, and told through that.

    An element must be allowed, svg the root and only the root, and path stands only inside a marker, however deep.
    """
    order = Window.partitionBy(ident).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    level = Window.partitionBy(ident, "depth").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.when((F.col("kind") == "start") & (F.col("name") == "marker"), 1).when((F.col("kind") == "end") & (F.col("opener") == "marker"), -1).otherwise(0)
    inside = deep.withColumn("_marker", F.coalesce(F.sum(marker).over(order), F.lit(0)) > 0)
    root = F.col("depth") == 1
    reason = (
        F.when(~F.col("name").isin(*allowed), F.concat(F.lit("element <"), "name", F.lit("> is not allowed")))
        .when(root & (F.col("name") != "svg"), F.concat(F.lit("root element must be <svg>, not <"), "name", F.lit(">")))
        .when(~root & (F.col("name") == "svg"), "nested <svg> is not allowed").when((F.col("name") == "path") & ~F.col("_marker"), "<path> is only allowed inside a <marker>")
    )
    told = inside.withColumn("problem", F.when(F.col("kind").isin("start", "empty"), reason))
    bad = F.col("problem").isNotNull()
    opened = F.last(F.when(F.col("kind") == "start", bad), ignorenulls=True).over(level)  # whether the tag that an end tag ends is forbidden
    told = told.withColumn("_shut", F.coalesce((F.col("kind") == "end") & opened, F.lit(False)))
    depth = F.sum(F.when((F.col("kind") == "start") & bad, 1).when(F.col("_shut"), -1).otherwise(0)).over(order)
    return told.withColumn("hidden", F.coalesce(depth, F.lit(0)) > 0).where(bad).select(ident, "place", "name", "parent", "problem", "hidden")


def checked(documents: DataFrame, ident: str, text: str, allowed: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """ident, code, path and problem of all documents: svg_xml_invalid for those that can't be read, else one row for each forbidden element that isn't hidden."""
    deep = stored(nested(tags(documents, ident, text), ident), "tags")
    broken = stored(parse_problems(deep, documents, ident), "broken")
    sound = deep.join(broken.select(ident), ident, "left_anti")
    bad = structure_problems(sound, ident, allowed).where("not hidden")
    named = bad.join(paths(sound, ident).select(ident, "place", "path"), [ident, "place"])
    rows = [broken.select(ident, F.lit("svg_xml_invalid").alias("code"), F.lit("/").alias("path"), "problem"), named.select(ident, F.lit("svg_element_forbidden").alias("code"), "path", "problem")]
    return functools.reduce(DataFrame.union, rows)


def local_references(deep: DataFrame, ident: str) -> DataFrame:
    """ident, place, target and found: references to other elements, in href and url(), and the name of the first element with that id (null: none)."""
    elements = deep.where("kind in ('start', 'empty')")
    own = F.regexp_extract("tag", r"""\sid\s*=\s*["']([^"']*)["']""", 1)
    targets = elements.where(own != "").groupBy(ident, own.alias("target")).agg(F.min_by("name", "place").alias("found"))
    wanted: Column = F.array_union(F.regexp_extract_all("tag", F.lit(r"""href\s*=\s*["']#([^"']*)["']"""), 1), F.regexp_extract_all("tag", F.lit(r"url\(#([^)]*)\)"), 1))
    each = elements.select(ident, "place", F.explode(wanted).alias("target"))
    return each.join(targets, [ident, "target"], "left").select(ident, "place", "target", "found")
