"""Published tables in versions: one that is out stays as it is, and all of them are read under one schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.sources.study import write_once


def publish(rows: DataFrame, folder: str, version: int) -> None:
    """Write a version that must not be out yet. Earlier ones are not touched."""
    write_once(rows, f"{folder.rstrip('/')}/version={version}")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all versions with `version`, under the merged schema of all: a column that a version lacks is null in its rows."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def published_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The rows of one version under its own schema, as they were published."""
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")
    except AnalysisException as e:
        raise ValueError(f"version {version} is not out") from e


def superseded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of versions(), with `superseded`: whether a later version has a row of the same key. One aggregation and a join on the keys."""
    last = rows.groupBy(*keys).agg(F.max("version").alias("_last"))
    return rows.join(last, keys).withColumn("superseded", F.col("version") < F.col("_last")).drop("_last")


def commit_projection(scored: DataFrame) -> DataFrame:
    """The public columns of scored changes (id, url, arm, applied, invalid, comparison struct): shape is null where a change did not apply; touched lines stay private."""
    shape = {"region_overlap": "region_overlap", "changed_lines": "invasive.changed_lines", "reference_changed_lines": "invasive.reference_changed_lines", "invasive_passed": "invasive.passed", "optimal_passed": "optimal.passed"}
    return scored.select("id", "url", "arm", "applied", "invalid", *[F.when(F.col("applied"), F.col(f"comparison.{path}")).alias(name) for name, path in shape.items()])


def projection_medians(public: DataFrame, reference: str = "reference_changed_lines") -> DataFrame:
    """(applied, median_changed_lines, median_reference_changed_lines) of a projection: of the changes that applied, and of all."""
    return public.agg(F.count_if("applied").alias("applied"), F.median(F.when(F.col("applied"), F.col("changed_lines"))).alias("median_changed_lines"), F.median(reference).alias("median_reference_changed_lines"))
