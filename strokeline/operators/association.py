"""Association and assembly: relationships, review items of dimensions, greedy witness lines, coverage and polymorphic lookups."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import relationship_id


def relationships(targets: DataFrame, kind: str, source: str, prefix: str) -> DataFrame:
    """One relationship for each source from its ranked targets (source, rank, ref_kind, ref_id, ambiguous): to the first, unresolved if the next is too near."""
    first = targets.where("rank = 1")
    name = F.concat(F.lit(prefix), F.col(source).cast("string"))
    state = F.when(F.col("ambiguous"), "unresolved").otherwise("proposed")
    return first.select(relationship_id(F.lit(kind), name, F.col("ref_kind"), F.col("ref_id").cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(source).alias("from_id"), "ref_kind", "ref_id", state.alias("interpretation"))


def dimension_reviews(texts: DataFrame, witnesses: DataFrame, targets: DataFrame) -> DataFrame:
    """text_id and code of what a dimension lacks: a witness line, arrows on it (`arrows`), or an edge it measures."""
    met = texts.select("text_id").join(witnesses.select("text_id", "witness_id", "arrows"), "text_id", "left")
    met = met.join(targets.select("witness_id", F.lit(True).alias("_target")).distinct(), "witness_id", "left")
    codes = F.array(
        F.when(F.col("witness_id").isNull(), "dimension.no_witness_line"),
        F.when(F.col("witness_id").isNotNull() & (F.col("arrows") == 0), "dimension.missing_arrow"),
        F.when(F.col("witness_id").isNotNull() & F.col("_target").isNull(), "association.unresolved"),
    )
    return met.select("text_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def greedy_witnesses(pairs: DataFrame, page: str = "document_id") -> DataFrame:
    """One segment for each region at most, and one region for each segment: regions in order take the best free segment of pairs (page, region_id, segment_id, length, distance).

    The best has the largest length / max(1, distance), the first of equal ones. The order decides, so a page is one group.
    """
    schema = f"{page} {pairs.schema[page].dataType.simpleString()}, region_id long, segment_id long, score double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(score=rows["length"] / rows["distance"].clip(lower=1.0)).sort_values(["region_id", "score", "segment_id"], ascending=[True, False, True])
        used, made = set(), []
        for region, own in rows.groupby("region_id", sort=True):
            for segment, score in zip(own["segment_id"], own["score"]):
                if segment not in used:
                    used.add(segment)
                    made.append((rows[page].iloc[0], region, segment, score))
                    break
        return pd.DataFrame(made, columns=[page, "region_id", "segment_id", "score"])

    return pairs.groupBy(page).applyInPandas(run, schema)


def uncovered(regions: DataFrame, *covered: DataFrame) -> DataFrame:
    """Regions (region_id) that no candidate set covers."""
    every = functools.reduce(lambda a, b: a.union(b), [c.select("region_id") for c in covered]).distinct()
    return regions.join(every, "region_id", "left_anti")


def first_match(rows: DataFrame, key: str, ids: str, table: DataFrame, ident: str, value: str) -> DataFrame:
    """key and the value of the first id of an array that the table has, null if it has none."""
    met = rows.select(key, F.posexplode_outer(ids).alias("_at", "_id")).join(table.select(F.col(ident).alias("_id"), F.col(value).alias("_v")), "_id", "left")
    return met.groupBy(key).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias(value))


def by_priority(claims: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The claim with the lowest priority number of each key."""
    return claims.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(priority))).where("_n = 1").drop("_n")


def aligned(ends: DataFrame, components: DataFrame, page: str = "document_id") -> DataFrame:
    """Ends (page, ord, x, y) moved to the centre of their component (page, node, component), with the distance moved."""
    met = ends.join(components.select(page, F.col("node").alias("ord"), "component"), [page, "ord"])
    w = Window.partitionBy(page, "component")
    made = met.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w), "members": F.count("*").over(w)})
    return made.withColumn("moved", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")))
