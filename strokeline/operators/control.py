"""The control plane as batch folds: jobs, leases, logs, the outbox, artifact references and revisions.

Jobs have job_id, document_id, state, created_at and attempt; logs job_id, created_at, level and message; artifact
references are rows of a key. Orders are made total by ids, where the order in time has ties.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE, Profile


def first_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered list; limit from 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be from 1 to 100, and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def monotonic_logs(logs: DataFrame, key: str = "job_id", order: str = "seq", time: str = "created_at") -> DataFrame:
    """Logs with `logged_at`: the first keeps its time, each later one comes a microsecond after the one before."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(time).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = logs.withColumns({"_first": first, "_n": F.row_number().over(w) - 1})
    return made.withColumn("logged_at", F.expr("timestampadd(MICROSECOND, _n, _first)")).drop("_first", "_n")


def micros(time: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({time} AS TIMESTAMP_NTZ))")


def idempotent_uploads(uploads: DataFrame, keys: list[str], digest: str, order: list[str]) -> DataFrame:
    """Uploads with outcome: created for the first of its keys, replayed for one of the same digest, else conflict; without a key always created."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(digest).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return uploads.withColumn("outcome", F.when((F.row_number().over(w) == 1) | functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), "created").when(F.col(digest).eqNullSafe(first), "replayed").otherwise("conflict"))


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after lease recovery: an expired running job is queued again, canceled if that was asked for, and failed after the last attempt."""
    expired = (F.col("state") == "running") & (F.col("lease_expires_at") < now)
    state = F.when(expired & F.col("cancel_requested"), "canceled").when(expired & (F.col("attempt") >= PROFILE.max_attempts), "failed").when(expired, "queued").otherwise(F.col("state"))
    error = F.when(expired & ~F.col("cancel_requested") & (F.col("attempt") >= PROFILE.max_attempts), "worker_exhausted")
    return jobs.withColumns({"state": state, "error_code": error})


def folded_jobs(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id"), profile: Profile = PROFILE) -> DataFrame:
    """The state of each job after its events (`command`: enqueue, claim, retry, cancel, complete, fail), in order: key, state, attempt, events.

    A job's events are folded in one expression over its ordered list; a job has a bounded number of events.
    """
    sequence = F.array_sort(F.collect_list(F.struct(*order, "command")))
    start = F.struct(F.lit("new").alias("state"), F.lit(0).alias("attempt"))

    def step(s: Column, e: Column) -> Column:
        c, state, attempt = e["command"], s["state"], s["attempt"]
        open_ = state.isin("queued", "running")
        next_state = (
            F.when((c == "enqueue") & (state == "new"), "queued")
            .when((c == "claim") & (state == "queued"), "running")
            .when((c == "retry") & (state == "running"), F.when(attempt >= profile.max_attempts, "failed").otherwise("queued"))
            .when((c == "cancel") & open_, "canceled")
            .when((c == "complete") & (state == "running"), "succeeded")
            .when((c == "fail") & (state == "running"), "failed")
            .otherwise(state)
        )
        return F.struct(next_state.alias("state"), F.when((c == "claim") & (state == "queued"), attempt + 1).otherwise(attempt).alias("attempt"))

    folded = events.groupBy(key).agg(sequence.alias("_e"))
    made = folded.withColumn("_s", F.aggregate("_e", start, step))
    return made.select(key, F.col("_s.state").alias("state"), F.col("_s.attempt").alias("attempt"), F.size("_e").alias("events"))


def referenced_keys(*sources: DataFrame) -> DataFrame:
    """The distinct keys of all sources, each of one column."""
    return functools.reduce(lambda a, b: a.union(b), sources).distinct()


def unreferenced(store: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Keys of the store that nothing refers to."""
    return store.join(referenced, key, "left_anti")


def swapped(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of compare-and-swap requests (document_id, request_id, expected, proposed) on the current revision of documents.

    Requests of a document are taken in order; the first whose expectation holds, null-safe, wins and later ones that
    still expect the old revision conflict: of concurrent requests with one parent, one is published.
    """
    w = Window.partitionBy("document_id").orderBy("request_id")
    met = requests.join(documents.select("document_id", "current"), "document_id")
    fits = F.col("expected").eqNullSafe(F.col("current"))
    winner = F.min(F.when(fits, F.col("request_id"))).over(Window.partitionBy("document_id"))
    return met.select("document_id", "request_id", F.when(F.col("request_id") == winner, "published").otherwise("conflict").alias("outcome"), F.row_number().over(w).alias("arrival"))


def lineage(revisions: DataFrame, folder: str) -> DataFrame:
    """revision_id, root and depth of each revision (revision_id, parent_id) that reaches one without a parent, however deep.

    Each round doubles the distance over which a revision knows its ancestor, so rounds grow with the logarithm of the
    depth; every round is written to `folder`, which all executors share. Revisions whose ancestors are unknown, or go
    round in a circle, are left out: no round settles any of them.
    """
    spark = revisions.sparkSession
    now = revisions.select("revision_id", F.coalesce("parent_id", "revision_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth"), F.col("parent_id").isNull().alias("done"))
    round_, left = 0, None
    while True:
        path = f"{folder}/lineage-{round_}"
        now.write.mode("overwrite").parquet(path)
        now, before = spark.read.parquet(path), left
        left = now.where("not done").count()
        if not left or left == before:
            return now.where("done").select("revision_id", F.col("up").alias("root"), "depth")
        above = now.select(F.col("revision_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        met = now.where("not done").join(above, "up").select("revision_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        now = now.where("done").unionByName(met)
        round_ += 1
