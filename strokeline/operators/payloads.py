"""JSON as variants: explicit nulls against missing keys, and walks over documents of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_state(text: Column, key: str) -> Column:
    """malformed, not_an_object, missing, null or present, for a key of a JSON object; a null text is malformed."""
    value = F.try_parse_json(text)
    at = F.try_variant_get(value, f"$.{key}", "variant")
    return (
        F.when(value.isNull(), "malformed").when(~F.schema_of_variant(value).startswith("OBJECT"), "not_an_object")
        .when(at.isNull(), "missing").when(F.is_variant_null(at), "null").otherwise("present")
    )


def explicit_nulls(text: Column, keys: list[str]) -> Column:
    """The keys, of those that may be left out, that are there and null."""
    return F.filter(F.array(*[F.when(key_state(text, k) == "null", F.lit(k)) for k in keys]), lambda k: k.isNotNull())


def without_nulls(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that aren't null."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "true"})


def walked(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, path, depth, kind and value of every value of JSON documents; malformed ones have one row of that kind.

    kind is object, array, null, string, number or boolean; value is the text of what has no values inside. Each level of all documents
    is one generator over the level above, and no level is shuffled.
    """
    spark = documents.sparkSession
    parsed = documents.select(ident, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(text).alias("v"))
    now, found = parsed, None
    while True:
        schema = F.schema_of_variant("v")
        kind = (
            F.when(F.col("v").isNull(), "malformed").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(F.is_variant_null("v"), "null")
            .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
        )
        inner = F.col("kind").isin("object", "array")
        level = now.withColumn("kind", kind)
        value = F.when(inner | F.col("kind").isin("malformed", "null"), None).otherwise(F.try_variant_get("v", "$", "string"))
        part = level.select(ident, "path", "depth", "kind", value.alias("value"))
        found = part if found is None else found.union(part)
        deeper = level.where(inner)
        if deeper.isEmpty():
            return found
        below = deeper.select(ident, "path", "depth", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        now = below.select(ident, F.concat("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("value").alias("v"))


def non_finite(values: DataFrame) -> DataFrame:
    """Rows of `walked` that a strict reader refuses: numbers beyond the range of doubles, and strings that say nan or infinity."""
    beyond = (F.col("kind") == "number") & (F.abs(F.try_to_number("value", F.lit("9" * 38)).cast("double")) == float("inf"))
    named = (F.col("kind") == "string") & F.lower(F.trim("value")).isin("nan", "infinity", "-infinity", "inf", "-inf")
    return values.where(beyond | named)
