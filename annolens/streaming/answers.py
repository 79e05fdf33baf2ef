"""Saved answers as a stream: each new file is validated once, valid and rejected rows go to tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from annolens.operators.validate import Check, split_valid


def ingest_answers(spark: SparkSession, source: str, schema: T.StructType | str, checks: list[Check], target: str, checkpoint: str) -> None:
    """Process what has come since the last call and stop.

    The checkpoint remembers the files that are done, so a run that was broken off goes on where it stopped, and a batch that is written
    again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        valid, rejected = split_valid(batch, checks)
        valid.write.mode("overwrite").parquet(f"{target}/valid/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
