"""Records of the control plane as batch merges: a step reads the old rows and the requests, and gives the new rows.

A step is a function of its inputs, so that one run twice over the same requests changes nothing more: inserts keep an
existing row, updates name the state they start from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROFILE, Profile
from ..functions.text import uuid5
from . import control

#: The key of every artifact. Fixed values.
ARTIFACT_KEYS = {
    "original": "documents/{document_id}/original",
    "display": "documents/{document_id}/display.png",
    "page": "documents/{document_id}/page.png",
    "reading": "documents/{document_id}/readings/{job_id}.json",
    "normalize": "documents/{document_id}/normalize.json",
    "masks": "documents/{document_id}/masks.json",
    "regions": "documents/{document_id}/regions.json",
    "centerlines": "documents/{document_id}/centerlines.json",
    "primitives": "documents/{document_id}/primitives.json",
    "axes": "documents/{document_id}/axes.json",
    "snapped_primitives": "documents/{document_id}/snapped-primitives.json",
    "topology": "documents/{document_id}/topology.json",
    "text_candidates": "documents/{document_id}/text-candidates.json",
    "symbol_candidates": "documents/{document_id}/symbol-candidates.json",
    "association_candidates": "documents/{document_id}/association-candidates.json",
    "mask": "documents/{document_id}/masks/{name}.png",
    "color_mask": "documents/{document_id}/masks/color/{layer_id}.png",
    "crop": "documents/{document_id}/crops/{crop_id}.png",
    "stage_artifact": "jobs/{job_id}/stages/{stage}/{content_hash}",
    "pipeline_manifest": "jobs/{job_id}/pipeline-manifest.json",
    "trace": "documents/{document_id}/trace.svg",
    "scene": "documents/{document_id}/revisions/{revision_id}/scene.json",
    "export": "documents/{document_id}/exports/{revision_id}/{format}",
}


def artifact_key(kind: str, **parts: Column) -> Column:
    """The key of an artifact from the columns that its pattern names."""
    made, rest = [], ARTIFACT_KEYS[kind]
    while "{" in rest:
        plain, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        made += [F.lit(plain), parts[name].cast("string")]
    return F.concat(*made, F.lit(rest))


def inserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; a row without a key gets a random one, and of rows with one key the first stays."""
    named = rows.withColumn(key, F.coalesce(F.col(key).cast(table.schema[key].dataType), F.expr("uuid()") if table.schema[key].dataType.simpleString() == "string" else F.col(key)))
    first = named.dropDuplicates([key])
    return table.unionByName(first.join(table.select(key), key, "left_anti").select(*table.columns))


def enqueued(jobs: DataFrame, requests: DataFrame, kind: str = "job.queued") -> tuple[DataFrame, DataFrame]:
    """(jobs, outbox rows) of requests (job_id, document_id, created_at): both come from the same new rows, so neither is without the other."""
    new = requests.join(jobs.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"])
    rows = new.select("job_id", "document_id", F.lit("queued").alias("state"), "created_at")
    return jobs.unionByName(rows), new.select(F.col("job_id").alias("event_id"), F.lit(kind).alias("kind"), "created_at", F.lit(None).cast("timestamp_ntz").alias("published_at"))


def published(outbox: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The outbox with pending events (event_id, published_at) of `done` marked; marking twice changes nothing."""
    met = outbox.join(done.select("event_id", F.lit(True).alias("_done")).distinct(), "event_id", "left")
    return met.withColumn("published_at", F.when(F.col("published_at").isNull() & F.col("_done"), now).otherwise(F.col("published_at"))).drop("_done")


def queue_order(deliveries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Messages of a queue in arrival order, one for each key that waits: a delivery of a key that is in the queue is dropped."""
    return deliveries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def renewed(jobs: DataFrame, logs: DataFrame, profile: Profile = PROFILE) -> DataFrame:
    """Jobs whose lease the last log (job_id, created_at) of a running job prolongs; a lease never becomes shorter."""
    last = logs.groupBy("job_id").agg(F.max("created_at").alias("_last"))
    until = F.col("_last") + F.expr(f"interval {profile.lease_seconds} seconds")
    held = F.when((F.col("state") == "running") & F.col("_last").isNotNull(), F.greatest("lease_expires_at", until)).otherwise(F.col("lease_expires_at"))
    return jobs.join(last, "job_id", "left").withColumn("lease_expires_at", held).drop("_last")


def requeued(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Running jobs of the requests go back to the queue without losing an attempt, others stay."""
    met = jobs.join(requests.select("job_id", F.lit(True).alias("_back")).distinct(), "job_id", "left")
    back = F.col("_back") & (F.col("state") == "running")
    made = met.withColumn("attempt", F.when(back, F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt")))
    return made.withColumn("state", F.when(back, "queued").otherwise(F.col("state"))).drop("_back")


def canceled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after requests to cancel: a queued one is canceled at once, a running one is asked to stop, an ended one stays."""
    met = jobs.join(requests.select("job_id", F.lit(True).alias("_asked")).distinct(), "job_id", "left")
    asked = F.coalesce("_asked", F.lit(False))
    made = met.withColumn("cancel_requested", F.col("cancel_requested") | (asked & F.col("state").isin("queued", "running")))
    return made.withColumn("state", F.when(asked & (F.col("state") == "queued"), "canceled").otherwise(F.col("state"))).drop("_asked")


def completed(jobs: DataFrame, results: DataFrame, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> DataFrame:
    """Jobs after results (job_id, revision_id; null for a job that makes no revision): only one that runs and isn't to stop succeeds.

    A missing result id is the uuid5 of the job, so a repeated delivery finds the same one; a job that has succeeded keeps its own.
    """
    met = jobs.join(results.dropDuplicates(["job_id"]).select("job_id", "revision_id", F.lit(True).alias("_there")), "job_id", "left")
    ends = F.col("_there") & (F.col("state") == "running") & ~F.col("cancel_requested")
    made = met.withColumn("result_id", F.when(ends, F.coalesce("revision_id", uuid5(namespace, F.col("job_id").cast("string")))).otherwise(F.col("result_id")))
    state = F.when(ends, "succeeded").when(F.col("_there") & (F.col("state") == "running") & F.col("cancel_requested"), "canceled").otherwise(F.col("state"))
    return made.withColumn("state", state).drop("_there", "revision_id")


def waiting(readings: DataFrame, pipeline: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """job_id and verdict of reading jobs (job_id, document_id, created_at): they wait while a pipeline job of their document is active, but no longer than `minutes`."""
    active = pipeline.where(F.col("state").isin("queued", "running")).select("document_id", F.lit(True).alias("_active")).distinct()
    late = F.col("created_at") + F.expr(f"interval {minutes} minutes") < now
    verdict = F.when(F.col("_active") & ~late, "wait").when(F.col("_active"), "give_up").otherwise("run")
    return readings.join(active, "document_id", "left").select("job_id", verdict.alias("verdict"))


def open_intents(intents: DataFrame, now: Column, profile: Profile = PROFILE) -> DataFrame:
    """Publication intents (key, created_at) whose artifacts are still protected from collection, with their deadline."""
    deadline = F.col("created_at") + F.expr(f"interval {profile.grace_seconds} seconds")
    return intents.withColumn("deadline", deadline).where(F.col("deadline") > now)


def access(rows: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """Answer to requests (`key`, caller): 404 where there is no such row, 403 where another owns it, else 200."""
    met = wanted.join(rows.select(key, F.col("owner_id").alias("_owner"), F.lit(True).alias("_there")), key, "left")
    return met.withColumn("status", F.when(F.col("_there").isNull(), 404).when(~F.col("_owner").eqNullSafe(F.col("caller")), 403).otherwise(200)).drop("_owner", "_there")


def progress(position: Column, phases: Column) -> Column:
    """Percent of the phases that are done with the one at `position`, from 0."""
    return F.floor((position + 1) * 100.0 / phases + 0.5).cast("int")


def exports_of(revisions: DataFrame, exports: DataFrame, traces: DataFrame) -> DataFrame:
    """revision_id, kind and key of what a revision is shown by: its own export of the kind, else its document's trace, else nothing."""
    met = revisions.join(exports.select("revision_id", "kind", F.col("key").alias("_own")), ["revision_id", "kind"], "left").join(traces.select("document_id", F.col("key").alias("_trace")), "document_id", "left")
    source = F.when(F.col("_own").isNotNull(), "export").when(F.col("_trace").isNotNull(), "trace")
    return met.select("revision_id", "kind", F.coalesce("_own", "_trace").alias("key"), source.alias("source"))


def retried(jobs: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Jobs of the requests that failed or were canceled begin anew: queued, no attempts, no request to stop, updated now; others stay."""
    met = jobs.join(requests.select("job_id", F.lit(True).alias("_again")).distinct(), "job_id", "left")
    again = F.col("_again") & F.col("state").isin("failed", "canceled")
    new = {"state": F.lit("queued"), "attempt": F.lit(0), "cancel_requested": F.lit(False), "updated_at": at}
    return met.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in new.items() if c in jobs.columns}).drop("_again")


def stage_logs(runs: DataFrame) -> DataFrame:
    """Log lines (job_id, at, level, message) of stage runs (job_id, stage, started_at, finished_at, warnings): one when a stage begins, one when it ends, one for each warning; `at` in ISO 8601."""
    line = lambda at, level, message: F.struct(at.alias("at"), F.lit(level).alias("level"), message.alias("message"))
    each = F.concat(
        F.array(line(F.col("started_at"), "info", F.concat("stage", F.lit(" started")))),
        F.when(F.col("finished_at").isNotNull(), F.array(line(F.col("finished_at"), "info", F.concat("stage", F.lit(" finished"))))).otherwise(F.array().cast("array<struct<at:timestamp_ntz,level:string,message:string>>")),
        F.transform("warnings", lambda w: line(F.coalesce("finished_at", "started_at"), "warning", F.concat(F.col("stage"), F.lit(": "), w))),
    )
    made = runs.select("job_id", F.explode(each).alias("l"))
    return made.select("job_id", F.date_format("l.at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "l.level", "l.message")


def published_revisions(intents: DataFrame, written: DataFrame) -> DataFrame:
    """Outcome of publications: an intent (revision_id, key, sha256: one row for each artifact) is published once all its artifacts are written (key, sha256) with the digests it states; else incomplete, or damaged."""
    met = intents.join(written.select("key", F.col("sha256").alias("_is")), "key", "left")
    state = F.when(F.bool_or(F.col("_is").isNotNull() & (F.col("_is") != F.col("sha256"))), "damaged").when(F.bool_or(F.col("_is").isNull()), "incomplete").otherwise("published")
    return met.groupBy("revision_id").agg(state.alias("outcome"), F.count("*").alias("artifacts"), F.count("_is").alias("written"))


def run_once(jobs: DataFrame, outbox: DataFrame, now: Column, batch: int = PROFILE.outbox_batch) -> tuple[DataFrame, DataFrame]:
    """(jobs, outbox) after one round of a worker: leases that ran out are recovered, the oldest pending events are dispatched, and the queued jobs among these are claimed.

    The batch is a fixed number of narrow rows; a claim counts an attempt and takes a lease.
    """
    back = control.recovered(jobs, now).drop("error_code")
    first = outbox.where("published_at is null").orderBy("created_at", "event_id").limit(batch).select(F.col("event_id").alias("job_id"), F.lit(True).alias("_sent"))
    met = back.join(first, "job_id", "left")
    claims = F.col("_sent") & (F.col("state") == "queued")
    until = now + F.expr(f"interval {PROFILE.lease_seconds} seconds")
    new = {"attempt": F.when(claims, F.col("attempt") + 1).otherwise(F.col("attempt")), "lease_expires_at": F.when(claims, until).otherwise(F.col("lease_expires_at")), "state": F.when(claims, "running").otherwise(F.col("state"))}
    return met.withColumns(new).drop("_sent"), published(outbox, first.select(F.col("job_id").alias("event_id")), now)


def looked_up(rows: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Wanted keys (request_id and the keys) with the values of their row and `found`; a key that is null, or that no row has, finds nothing."""
    return wanted.join(rows.select(*keys, *values, F.lit(True).alias("_there")), keys, "left").select("request_id", *values, F.coalesce("_there", F.lit(False)).alias("found"))


def change_events(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """An event for each row that a step added or changed: key, old and new as JSON (old null for a new row)."""
    old = before.select(key, F.to_json(F.struct(*columns)).alias("old"))
    new = after.select(key, F.to_json(F.struct(*columns)).alias("new"))
    return new.join(old, key, "left").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "old", "new")
