"""Profiles as rows: thresholds by profile, version and name, joined to pages, so that pages of different profiles go through one plan."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Profile

#: The version that an id without one means.
DEFAULT_VERSION = "1.0.0"
#: Names of the thresholds that a profile must have: those of `Profile` that are single numbers.
REQUIRED = tuple(f.name for f in fields(Profile) if f.type in ("float", "int"))


def threshold_rows(spark: SparkSession, profiles: dict[str, Profile]) -> DataFrame:
    """profile, version, name and value of every threshold of profiles named as `id@version`, or `id` for the default version."""
    rows = []
    for ident, profile in profiles.items():
        name, _, version = ident.partition("@")
        rows += [(name, version or DEFAULT_VERSION, key, float(getattr(profile, key))) for key in REQUIRED]
    return spark.createDataFrame(rows, "profile string, version string, name string, value double")


def resolved(ident: Column) -> Column:
    """struct profile and version of an id, with the default version where it has none."""
    version = F.nullif(F.regexp_extract(ident, "@(.*)$", 1), F.lit(""))
    return F.struct(F.regexp_extract(ident, "^([^@]*)", 1).alias("profile"), F.coalesce(version, F.lit(DEFAULT_VERSION)).alias("version"))


def missing_thresholds(thresholds: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """profile, version and name of thresholds that a profile lacks or has more than once, or that aren't finite."""
    known = thresholds.select("profile", "version").distinct().crossJoin(F.broadcast(thresholds.sparkSession.createDataFrame([(n,) for n in required], "name string")))
    ok = thresholds.groupBy("profile", "version", "name").agg(F.count("*").alias("n"), F.max("value").alias("value")).where("n = 1 and value is not null and not isnan(value) and abs(value) < double('infinity')")
    return known.join(ok, ["profile", "version", "name"], "left_anti")


def structs(thresholds: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """profile, version and thresholds: a struct with a field for each name. Profiles that lack one are left out."""
    wide = thresholds.groupBy("profile", "version").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in required])
    whole = wide.join(missing_thresholds(thresholds, required), ["profile", "version"], "left_anti")
    return whole.select("profile", "version", F.struct(*required).alias("thresholds"))


def with_thresholds(rows: DataFrame, assigned: DataFrame, thresholds: DataFrame, page: str = "document_id") -> DataFrame:
    """Rows with the thresholds of their page's profile, by `assigned` (page, profile_id); rows of pages without a known profile are left out."""
    chosen = assigned.select(page, resolved(F.col("profile_id")).alias("_p")).select(page, "_p.profile", "_p.version")
    return rows.join(chosen.join(structs(thresholds), ["profile", "version"]).select(page, "thresholds"), page)


class Thresholds:
    """Stands for a `Profile` where rows have a column `thresholds`: every attribute is that field of the row."""

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(f"thresholds.{name}")
