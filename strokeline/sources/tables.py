"""Adapters that read the relational test tables as pages, points, segments, boxes, polylines, documents, jobs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of a page for each unit of a vector's component.
SCALE = 512.0
#: A page holds 64 vectors, however many there are: per-page groups are of bounded size.
PAGE = "vec_id div 64"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _at(k: int) -> Column:
    return F.lit(SCALE) * F.col("embedding")[k].cast("double")


def points(spark: SparkSession, folder: str, shift: int = 0) -> DataFrame:
    """document_id, id, layer_id, x, y: a page for each 64 vectors, a point for each."""
    e = table(spark, folder, "embeddings")
    return e.select(F.expr(PAGE).alias("document_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("layer_id"), _at(shift).alias("x"), _at(shift + 1).alias("y"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, id, layer_id, x0, y0, x1, y1: a segment for each vector."""
    e = table(spark, folder, "embeddings")
    return e.select(F.expr(PAGE).alias("document_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("layer_id"), *[_at(k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, id, kind, x, y, width, height: a region for each vector, of 8 to 72 by 6 to 46 pixels."""
    e = table(spark, folder, "embeddings")
    kinds = F.array(*[F.lit(k) for k in ("text", "symbol", "arrow", "dimension")])
    return e.select(
        F.expr(PAGE).alias("document_id"), F.col("vec_id").alias("id"), kinds[(F.col("vec_id") % 4).cast("int")].alias("kind"), _at(4).alias("x"), _at(5).alias("y"),
        (F.lit(8.0) + (F.col("vec_id") % 65)).alias("width"), (F.lit(6.0) + (F.col("vec_id") * 7 % 41)).alias("height"),
    )


#: The same adapters in SQL, for the oracle.
POINTS_SQL = "SELECT vec_id // 64 AS document_id, vec_id AS id, vec_id % 3 AS layer_id, 512.0 * CAST(embedding[1] AS DOUBLE) AS x, 512.0 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
POINTS2_SQL = "SELECT vec_id // 64 AS document_id, vec_id AS id, 512.0 * CAST(embedding[3] AS DOUBLE) AS x, 512.0 * CAST(embedding[4] AS DOUBLE) AS y FROM embeddings"
SEGMENTS_SQL = "SELECT vec_id // 64 AS document_id, vec_id AS id, vec_id % 3 AS layer_id, 512.0 * CAST(embedding[1] AS DOUBLE) AS x0, 512.0 * CAST(embedding[2] AS DOUBLE) AS y0, 512.0 * CAST(embedding[3] AS DOUBLE) AS x1, 512.0 * CAST(embedding[4] AS DOUBLE) AS y1 FROM embeddings"
BOXES_SQL = "SELECT vec_id // 64 AS document_id, vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'symbol' WHEN 2 THEN 'arrow' ELSE 'dimension' END AS kind, 512.0 * CAST(embedding[5] AS DOUBLE) AS x, 512.0 * CAST(embedding[6] AS DOUBLE) AS y, CAST(8 + vec_id % 65 AS DOUBLE) AS width, CAST(6 + vec_id * 7 % 41 AS DOUBLE) AS height FROM embeddings"
