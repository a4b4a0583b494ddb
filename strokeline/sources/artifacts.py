"""Artifacts: immutable writes by key, uploads checked by their bytes, and reading of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_key

PNG, JPEG = "89504E470D0A1A0A", "FFD8FF"
MAX_BYTES, MAX_PIXELS = 20 << 20, 40_000_000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key (path), size, sha256 and content of the files below a path, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def media_type(content: Column) -> Column:
    start = F.hex(F.substring(content, 1, 8))
    return F.when(start == PNG, "image/png").when(start.startswith(JPEG), "image/jpeg")


def png_size(content: Column) -> Column:
    """struct of width and height from a PNG's header."""
    at = lambda k: F.conv(F.hex(F.substring(content, k, 4)), 16, 10).cast("long")
    return F.struct(at(17).alias("width"), at(21).alias("height"))


def checked_uploads(uploads: DataFrame, content: str = "content") -> DataFrame:
    """Uploads with mime, sha256, size, width, height and error: too_large, not_an_image, too_many_pixels, or null."""
    made = uploads.withColumns({"mime": media_type(F.col(content)), "sha256": F.sha2(content, 256), "size": F.octet_length(content)})
    dims = png_size(F.col(content))
    made = made.withColumns({n: F.when(F.col("mime") == "image/png", dims[n]) for n in ("width", "height")})
    error = F.when(F.col("size") > MAX_BYTES, "too_large").when(F.col("mime").isNull(), "not_an_image").when(F.col("width") * F.col("height") > MAX_PIXELS, "too_many_pixels")
    return made.withColumn("error", error)


def immutable_outcomes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """key, sha256 and outcome of new artifacts (key, sha256) against stored ones: written, unchanged, conflict or bad_key.

    Of new artifacts with one key the smallest digest is taken, and the others conflict with it.
    """
    old = stored.select("key", F.col("sha256").alias("_old"))
    first = new.groupBy("key").agg(F.min("sha256").alias("_first"))
    met = new.distinct().join(first, "key").join(old, "key", "left")
    outcome = F.when(~safe_key(F.col("key")), "bad_key").when(F.col("_old").isNull(), F.when(F.col("sha256") == F.col("_first"), "written").otherwise("conflict")).when(F.col("_old") == F.col("sha256"), "unchanged").otherwise("conflict")
    return met.select("key", "sha256", outcome.alias("outcome"))


def write_immutable(artifacts: DataFrame, path: str) -> DataFrame:
    """Appends artifacts (key, content) that the store at `path` doesn't have, and returns the outcome of each; nothing stored is replaced."""
    spark = artifacts.sparkSession
    hashed = artifacts.select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"), "content")
    try:
        stored = spark.read.parquet(path).select("key", "sha256")
    except Exception as problem:  # the store's first write
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        stored = spark.createDataFrame([], "key string, sha256 string")
    outcomes = immutable_outcomes(hashed.select("key", "sha256"), stored)
    kept = f"{path}-outcomes"
    outcomes.write.mode("overwrite").parquet(kept)
    outcomes = spark.read.parquet(kept)
    fresh = hashed.join(outcomes.where("outcome = 'written'").select("key", "sha256"), ["key", "sha256"]).dropDuplicates(["key"])
    fresh.write.mode("append").parquet(path)
    return outcomes
