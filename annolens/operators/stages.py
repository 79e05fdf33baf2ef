"""A run as a graph of stages: what is done and still fits its inputs is read, the rest is run.

Each stage writes a table of its own, under a path that names its inputs' fingerprint and the attempt, and only then a row that says so. The states are a table to which rows are appended, so
a run that was killed anywhere goes on at the first stage that did not end or whose inputs are others; a failed attempt stays with its reason.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions.fingerprints import fingerprint

STATES = "stage string, inputs string, output string, status string, reason string, rows long, at timestamp"


@dataclass(frozen=True)
class Stage:
    """One step. needs: names of sources or of earlier stages, in the order of the function's arguments; version: changes when the function's results would."""

    name: str
    needs: tuple[str, ...]
    function: Callable[..., DataFrame]
    version: str = "1"


@dataclass
class Run:
    """A run below `root`, a folder that the driver and all executors share. sources: tables by name, each with the column that tells its rows apart."""

    spark: SparkSession
    root: str
    sources: dict[str, tuple[DataFrame, str]]
    ran: list[str] = field(default_factory=list)

    def states(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATES).parquet(f"{self.root}/states")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATES)

    def _note(self, stage: str, inputs: str, output: str, status: str, reason: str | None = None, rows: int | None = None) -> None:
        row = self.spark.createDataFrame([(stage, inputs, output, status, reason, rows)], STATES.rsplit(", at", 1)[0])
        row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/states")

    def _fits(self, stage: str, inputs: str) -> str | None:
        """The output of a completed attempt on these inputs."""
        done = self.states().where((F.col("stage") == stage) & (F.col("inputs") == inputs) & (F.col("status") == "completed"))
        found = done.agg(F.max_by("output", "at")).first()[0]
        return found

    def go(self, stages: list[Stage]) -> dict[str, DataFrame]:
        """The tables of all stages, in order. What raises is noted as the stage's failure and raised again."""
        prints = {name: fingerprint(rows, key).first().digest for name, (rows, key) in self.sources.items()}
        tables = {name: rows for name, (rows, _) in self.sources.items()}
        for stage in stages:
            if stage.name in tables:
                raise ValueError(f"two tables named {stage.name}")
            inputs = hashlib.sha256("\n".join([stage.name, stage.version, *[prints[n] for n in stage.needs]]).encode()).hexdigest()
            output = self._fits(stage.name, inputs) or self._run(stage, inputs, tables)
            prints[stage.name], tables[stage.name] = inputs, self.spark.read.parquet(output)
        return {s.name: tables[s.name] for s in stages}

    def _run(self, stage: Stage, inputs: str, tables: dict[str, DataFrame]) -> str:
        output = f"{self.root}/tables/{stage.name}/{inputs[:16]}-{uuid.uuid4().hex[:8]}"
        self._note(stage.name, inputs, output, "running")
        try:
            stage.function(*[tables[n] for n in stage.needs]).write.parquet(output)
            rows = self.spark.read.parquet(output).count()
        except Exception as e:
            self._note(stage.name, inputs, output, "failed", str(e).splitlines()[0][:500])
            raise
        self._note(stage.name, inputs, output, "completed", rows=rows)
        self.ran.append(stage.name)
        return output


def attempts(states: DataFrame) -> DataFrame:
    """(stage, completed, failed, broken_off): how often each stage ended well, ended badly, or was killed."""
    by_output = states.groupBy("stage", "output").agg(F.max(F.when(F.col("status") != "running", F.col("status"))).alias("ended"))
    ended = F.col("ended")
    return by_output.groupBy("stage").agg(F.count_if(ended == "completed").alias("completed"), F.count_if(ended == "failed").alias("failed"), F.count_if(ended.isNull()).alias("broken_off"))
