"""Review items: readiness, carrying forward, reopening, resolution, and overlays of confirmed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING_STATES = ("open", "acknowledged_unknown")
BLOCKING_SEVERITIES = ("critical", "high")


def severity(score: Column) -> Column:
    return F.when(score.isNull() | (score < 0.5), "high").when(score < 0.9, "medium").otherwise("low")


def review_state(items: DataFrame, key: str) -> DataFrame:
    """key and review_state: review_required while an item of a blocking state and severity remains."""
    blocks = F.col("state").isin(*BLOCKING_STATES) & F.col("severity").isin(*BLOCKING_SEVERITIES)
    return items.groupBy(key).agg(F.when(F.bool_or(blocks), "review_required").otherwise("ready").alias("review_state"))


def after_edit(items: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Items of the next revision: resolved ones stay, open ones stay and reopen if their object (`keys`) was edited, others go."""
    hit = affected.select(*keys).distinct().withColumn("_hit", F.lit(True))
    made = items.where(F.col("state").isin("confirmed", "corrected", *BLOCKING_STATES)).join(hit, keys, "left")
    return made.withColumn("state", F.when(F.col("_hit") & F.col("state").isin(*BLOCKING_STATES), "open").otherwise(F.col("state"))).drop("_hit")


def after_resolution(items: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    """Items with the state of their resolution (key, new_state), which go last (`moved`)."""
    made = items.join(resolutions.select(key, "new_state"), key, "left")
    return made.select(*[c for c in items.columns if c != "state"], F.coalesce("new_state", "state").alias("state"), F.col("new_state").isNotNull().alias("moved"))


def overlaid(candidates: DataFrame, confirmed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Candidate objects, each replaced by its confirmed version where there is one."""
    own = confirmed.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    made = candidates.join(own, key, "left")
    return made.select(key, *[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.coalesce("_there", F.lit(False)).alias("confirmed"))


def lost_edits(confirmed: DataFrame, candidates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Confirmed objects that a candidate revision misses or changes: key and reason."""
    other = candidates.select(key, F.struct(*columns).alias("_b"), F.lit(True).alias("_there"))
    made = confirmed.select(key, F.struct(*columns).alias("_a")).join(other, key, "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return made.select(key, reason.alias("reason")).where("reason is not null")


#: State of an item after each answer.
ANSWERS = {"confirm": "confirmed", "correct": "corrected", "acknowledge_unknown": "acknowledged_unknown"}


def answered(items: DataFrame, objects: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, objects) after answers (key, seq, action, text): the last answer gives an item (key, object_id, state) its state; a confirmed or corrected object (id, state, score, text) is confirmed without a score, and a correction gives it its text."""
    last = answers.where(F.col("action").isin(*ANSWERS)).groupBy("key").agg(F.max_by(F.struct("action", "text"), "seq").alias("_a"))
    met = items.join(last, "key", "left")
    state = F.coalesce(*[F.when(F.col("_a.action") == a, F.lit(s)) for a, s in ANSWERS.items()], F.col("state"))
    hit = met.where(F.col("_a.action").isin("confirm", "correct")).groupBy(F.col("object_id").alias("id")).agg(F.max(F.when(F.col("_a.action") == "correct", F.col("_a.text"))).alias("_text"), F.lit(True).alias("_hit"))
    own = objects.join(hit, "id", "left")
    changed = {"state": F.when(F.col("_hit"), "confirmed").otherwise(F.col("state")), "score": F.when(F.col("_hit").isNull(), F.col("score")), "text": F.coalesce("_text", "text")}
    return met.withColumn("state", state).drop("_a"), own.select(*[changed.get(c, F.col(c)).alias(c) for c in objects.columns])


def carried(items: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Items that the next revision takes over: those of blocking states, and those whose key is asked for."""
    asked = keys.select(key, F.lit(True).alias("_asked")).distinct()
    return items.join(asked, key, "left").where(F.col("state").isin(*BLOCKING_STATES) | F.col("_asked")).drop("_asked")


def reopened(items: DataFrame, affected: DataFrame, kept: DataFrame, key: str = "key") -> DataFrame:
    """Items of affected objects (object_id) are open again, except those of the kept keys."""
    hit = affected.select("object_id", F.lit(True).alias("_hit")).distinct()
    stays = kept.select(key, F.lit(True).alias("_stays")).distinct()
    met = items.join(hit, "object_id", "left").join(stays, key, "left")
    return met.withColumn("state", F.when(F.col("_hit") & F.col("_stays").isNull(), "open").otherwise(F.col("state"))).drop("_hit", "_stays")


def promoted(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents (document_id, current) after candidates (document_id, revision_id, parent_id, author, ready): one whose parent is still current, and that is ready, becomes current; of several the smallest id."""
    met = candidates.where("ready").join(documents, "document_id").where(F.col("parent_id").eqNullSafe(F.col("current")))
    best = met.groupBy("document_id").agg(F.min("revision_id").alias("_new"))
    return documents.join(best, "document_id", "left").select("document_id", F.coalesce("_new", "current").alias("current"), F.col("_new").isNotNull().alias("promoted"))
