"""Evaluation: error rates of readings, precision and recall, and quantiles of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def character_error_rate(truth: Column, reading: Column) -> Column:
    """Edits over the characters of the truth; 0 or 1 for an empty truth."""
    n = F.length(truth)
    return F.when(n == 0, F.when(F.length(reading) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, reading) / F.greatest(n, F.lit(1)))


def precision_recall(rows: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """keys, tp, fp, fn, precision and recall; null where nothing was predicted or true."""
    made = rows.groupBy(*keys).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    return made.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def error_quantiles(rows: DataFrame, error: Column, *keys: str) -> DataFrame:
    """keys, n, median and p95 of an error, interpolated."""
    return rows.groupBy(*keys).agg(F.count(error).alias("n"), F.percentile(error, 0.5).alias("median"), F.percentile(error, 0.95).alias("p95"))
