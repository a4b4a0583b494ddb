"""The control plane as streams: job states kept per key, deduplicated outbox events and windowed counts.

Each stream runs until it has read what is there (`availableNow`) and keeps its progress in a checkpoint, so that a
restart neither loses nor repeats an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILE
from ..operators.control import folded_jobs
from ..sources.shared import new_folder


#: Keeps states in files of the executors, not on their heaps.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_FILES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: str, attempt: int, command: str) -> tuple[str, int]:
    """The rule that jobs are folded by, for one command: the job's state and attempt after a command; commands that don't fit the state change nothing."""
    if command == "enqueue" and state == "new":
        return "queued", attempt
    if command == "claim" and state == "queued":
        return "running", attempt + 1
    if command == "retry" and state == "running":
        return ("failed" if attempt >= PROFILE.max_attempts else "queued"), attempt
    if command == "cancel" and state in ("queued", "running"):
        return "canceled", attempt
    if command == "complete" and state == "running":
        return "succeeded", attempt
    if command == "fail" and state == "running":
        return "failed", attempt
    return state, attempt


def job_states(commands: DataFrame) -> DataFrame:
    """A stream of job_id, state, attempt and events, updated with every batch of commands (job_id, ts, event_id, command).

    What is kept for a job are its commands, a bounded number, so that one that comes late takes its place in their order.
    """
    return folded_jobs(commands)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream until it has read what is there; the rows it emitted, with the number of their batch.

    A batch is written under its own number, so that one that is run again replaces itself.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _FILES)
    try:
        query = writer.start()  # a query takes the session's settings as they are when it starts
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by window and type, with a watermark for late ones; an addition to the control plane."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
