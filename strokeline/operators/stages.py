"""Runs of stages over tables: each stage's table is written once with a manifest, and a run that ended goes on behind the last complete one."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A stage makes a table from those of earlier stages; another version makes it, and all that follows from it, anew."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    version: str = "1"


@dataclass
class Outcome:
    """state: succeeded, canceled or failed; tables of the complete stages; which stages ran and which were taken as they were."""

    state: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed_stage: str | None = None
    error: Exception | None = None


def checked_order(stages: list[Stage]) -> None:
    """Refuses names that repeat, and stages that need one that doesn't stand before them."""
    known: set[str] = set()
    for stage in stages:
        if stage.name in known:
            raise ValueError(f"two stages are named {stage.name}")
        if missing := [n for n in stage.needs if n not in known]:
            raise ValueError(f"{stage.name} needs {', '.join(missing)} before it")
        known.add(stage.name)


def checksum(table: DataFrame) -> dict[str, int | str]:
    """Rows of a table and the sum of their hashes, whatever their order."""
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": row.n, "hash": str(row.h)}


class Store:
    """Manifests and tables of one job below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self, stage: str) -> dict | None:
        files, path = self._file(f"{stage}.json")
        if not files.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/{stage}.json", wholetext=True).first().value)

    def save(self, stage: str, manifest: dict) -> None:
        """A manifest appears as a whole or not at all: it is written under another name and renamed."""
        files, path = self._file(f"{stage}.json")
        _, draft = self._file(f".{stage}.json.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        files.delete(path, False)
        files.rename(draft, path)

    def asked_to_cancel(self) -> bool:
        files, path = self._file("cancel")
        return files.exists(path)

    def cancel(self) -> None:
        files, path = self._file("cancel")
        files.create(path, True).close()


def run(spark: SparkSession, folder: str, stages: list[Stage]) -> Outcome:
    """Runs the stages in order in a job's folder; what an earlier run has completed there is read, not made again.

    A stage's manifest names its version, its table, and the checksums of the tables it was made from. It counts only if all of
    these still hold. A request to cancel is read before each stage. A stage that fails ends the run and leaves the manifests
    of those before it; the next run goes on with it.
    """
    checked_order(stages)
    store, out = Store(spark, folder), Outcome("succeeded")
    sums: dict[str, dict] = {}
    for stage in stages:
        if store.asked_to_cancel():
            out.state = "canceled"
            return out
        inputs = {n: sums[n] for n in stage.needs}
        found = store.manifest(stage.name)
        if found and found["version"] == stage.version and found["inputs"] == inputs:
            out.tables[stage.name] = spark.read.parquet(found["table"])
            out.skipped.append(stage.name)
        else:
            attempt = (found or {}).get("attempt", 0) + 1
            path = f"{store.folder}/{stage.name}-{attempt}"
            try:
                stage.make(spark, {n: out.tables[n] for n in stage.needs}).write.mode("overwrite").parquet(path)
            except Exception as error:  # whatever a stage raises ends this run, and is the caller's
                out.state, out.failed_stage, out.error = "failed", stage.name, error
                return out
            table = spark.read.parquet(path)
            found = {"stage": stage.name, "version": stage.version, "inputs": inputs, "attempt": attempt, "table": path, "output": checksum(table)}
            store.save(stage.name, found)
            out.tables[stage.name] = table
            out.ran.append(stage.name)
        sums[stage.name] = found["output"]
    return out


def manifests(spark: SparkSession, folder: str, stages: list[Stage]) -> DataFrame:
    """stage, ord, version, attempt and rows of the complete stages of a job."""
    store = Store(spark, folder)
    found = [(s.name, n, m["version"], m["attempt"], m["output"]["rows"]) for n, s in enumerate(stages) if (m := store.manifest(s.name))]
    return spark.createDataFrame(found, "stage string, ord int, version string, attempt int, rows long")
