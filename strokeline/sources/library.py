"""Symbol libraries and stage manifests as tables: JSON in, rows and faults out, and canonical JSON back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical_json

#: Keys that a library, a symbol and a port may have.
LIBRARY_KEYS = ("version", "units", "symbols")
SYMBOL_KEYS = ("id", "label", "ports", "primitives", "aliases", "allowed_attachments")
PORT_KEYS = ("name", "x", "y", "required")
LIBRARY = "struct<version:string,units:string,symbols:array<struct<id:string,label:string,ports:array<struct<name:string,x:double,y:double,required:boolean>>,aliases:array<string>>>>"


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """library (file name) and content of library files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("library"), F.decode("content", "UTF-8").alias("content"))


def symbols(libraries: DataFrame) -> DataFrame:
    """library, version, symbol_id, label, aliases and ports (by name) of libraries (library, content); of symbols with one id the first."""
    parsed = libraries.select("library", F.from_json("content", LIBRARY).alias("l"))
    each = parsed.select("library", "l.version", F.posexplode("l.symbols").alias("ord", "s"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("library", "s.id").orderBy("ord"))).where("_n = 1")
    return first.select("library", "version", F.col("s.id").alias("symbol_id"), "s.label", F.coalesce("s.aliases", F.array().cast("array<string>")).alias("aliases"), F.array_sort("s.ports").alias("ports"))


def library_problems(libraries: DataFrame, version: str) -> DataFrame:
    """library, code and detail of what is wrong: no JSON, another version, keys that aren't allowed, repeated symbols and ports."""
    parsed = libraries.withColumns({"l": F.from_json("content", LIBRARY), "k": F.json_object_keys("content")})
    row = lambda rows, code, detail: rows.select("library", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    good = parsed.where("k is not null")
    raw = F.from_json(F.get_json_object("content", "$.symbols"), "array<string>")
    each = good.select("library", F.explode(raw).alias("symbol"))
    ports = each.select("library", F.get_json_object("symbol", "$.id").alias("id"), F.explode(F.from_json(F.get_json_object("symbol", "$.ports"), "array<string>")).alias("port"))
    extra = lambda keys, allowed: F.explode(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    named = lambda rows, c, path: rows.select("library", F.get_json_object(c, path).alias("id"))
    parts = [
        row(parsed.where("k is null"), "not_json", F.lit(None)),
        row(good.where(~F.col("l.version").eqNullSafe(F.lit(version))), "other_version", F.col("l.version")),
        row(good.select("library", extra(F.col("k"), LIBRARY_KEYS).alias("d")), "unknown_key", F.col("d")),
        row(each.select("library", extra(F.json_object_keys("symbol"), SYMBOL_KEYS).alias("d")), "unknown_symbol_key", F.col("d")),
        row(ports.select("library", extra(F.json_object_keys("port"), PORT_KEYS).alias("d")), "unknown_port_key", F.col("d")),
        row(named(each, "symbol", "$.id").groupBy("library", "id").count().where("count > 1"), "repeated_symbol", F.col("id")),
        row(ports.groupBy("library", "id", F.get_json_object("port", "$.name").alias("name")).count().where("count > 1"), "repeated_port", F.concat_ws(".", "id", "name")),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


def manifests(artifacts: DataFrame, job: str = "job_id") -> DataFrame:
    """job_id and manifest: the stages of each job (job_id, stage, key, sha256) with what they wrote, as canonical JSON. A job has a bounded number of stages."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("key", "sha256")))))
    return artifacts.groupBy(job).agg(canonical_json(F.to_json(F.struct(entries.alias("stages"), F.lit("1.0").alias("version")))).alias("manifest"))


def loaded(wanted: DataFrame, store: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    """Wanted artifacts (job_id, kind, key) with their content from the store (key, content); `missing` for one that is neither there nor optional."""
    met = wanted.join(store.select("key", "content"), "key", "left")
    return met.withColumn("missing", F.col("content").isNull() & ~F.col("kind").isin(*optional))


def read_or_build(wanted: DataFrame, cache: DataFrame, built: DataFrame) -> DataFrame:
    """key, content and source of wanted artifacts (key): the cache's, else what was built (key, content), which `source` tells apart for the one that writes."""
    met = wanted.join(cache.select("key", F.col("content").alias("_c")), "key", "left").join(built.select("key", F.col("content").alias("_b")), "key", "left")
    return met.select("key", F.coalesce("_c", "_b").alias("content"), F.when(F.col("_c").isNotNull(), "cache").when(F.col("_b").isNotNull(), "built").alias("source"))


def kept(store: DataFrame, deleted: DataFrame) -> DataFrame:
    """The store without deleted keys; one that isn't there is no fault."""
    return store.join(deleted.select("key").distinct(), "key", "left_anti")
