"""Reading and writing study artifacts: JSON tables, event logs, sources under a lock, saved calls."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("arm", T.StringType()), T.StructField("status", T.StringType()), T.StructField("usage", T.ArrayType(T.MapType(T.StringType(), T.LongType()))), T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("prompt_sha256", T.StringType())])


def json_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file, or a glob of files, that each hold one JSON array of objects. A schema is asked for: inference would read everything twice."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An event log of one JSON object a line."""
    return spark.read.schema(schema).json(path)


def write_once(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Write a result that must not exist yet."""
    writer = df.write.mode("errorifexists").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_json(value: object, path: str) -> None:
    """A small result as JSON for people: two spaces a level, letters as they are, a line break at the end; folders are made, a file that is there is refused."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("x", encoding="utf-8") as file:
        file.write(json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def lock_of(files: DataFrame, commit: str, most: int = 100_000) -> dict:
    """The lock of sources (path, sha256, bytes): one entry a file in the order of paths; a repository has `most` of them at most."""
    rows = files.select("path", "sha256", "bytes").orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files are no study")
    return {"commit": commit, "files": [r.asDict() for r in rows]}


def saved_answers(spark: SparkSession, glob: str, arms: list[str], schema: T.StructType | str = "comment string") -> DataFrame:
    """(case_id, arm struct of each arm) from files .../<case>/<arm>/answer.json; cases that lack an arm are left out."""
    path = F.split(F.input_file_name(), "/")
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    rows = rows.select(F.element_at(path, -3).alias("case_id"), F.element_at(path, -2).alias("arm"), F.struct(*rows.columns).alias("answer"))
    wide = rows.groupBy("case_id").agg(*[F.max_by("answer", F.when(F.col("arm") == a, F.lit(1))).alias(a) for a in arms])
    return wide.dropna(subset=arms)


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    parts = F.split(path, "/")
    return ~F.startswith(path, F.lit("/")) & ~F.exists(parts, lambda p: p == "..") & (F.length(path) > 0)


def source_files(spark: SparkSession, glob: str, root: str) -> DataFrame:
    """(path, source, sha256, bytes) of text files, by their path below root."""
    files = spark.read.format("binaryFile").load(glob)
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)).alias("path"), F.decode("content", "UTF-8").alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def lock_violations(files: DataFrame, lock: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, not in the lock, or other than it says. Empty if all is well."""
    joined = files.select("path", F.col("sha256").alias("found")).join(lock.select("path", F.col("sha256").alias("locked")), "path", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("locked").isNull(), "not in the lock").when(F.col("found") != F.col("locked"), "content differs")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def completed(calls: DataFrame) -> DataFrame:
    return calls.where("status = 'completed'")


def usage(calls: DataFrame) -> DataFrame:
    """(key, total, calls): token usage summed by key over completed calls."""
    entries = completed(calls).select("case_id", "arm", F.explode("usage").alias("u")).select("case_id", "arm", F.explode("u").alias("key", "n"))
    return entries.groupBy("key").agg(F.sum("n").alias("total"), F.count_distinct("case_id", "arm").alias("calls"))


def to_do(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Tasks (case_id, arm, prompt_sha256) without a completed call of the same prompt: what a resumed run still has to ask."""
    return tasks.join(completed(calls).select("case_id", "arm", "prompt_sha256"), ["case_id", "arm", "prompt_sha256"], "left_anti")


def digest(value: object) -> str:
    """SHA-256 of a text or bytes, of anything else as JSON with sorted keys."""
    if isinstance(value, str):
        value = value.encode()
    if not isinstance(value, bytes):
        value = json.dumps(value, sort_keys=True, ensure_ascii=False).encode()
    return hashlib.sha256(value).hexdigest()


def object_digests(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, sha256) of JSON documents, whatever their spacing and order of keys; to_json would keep the order, so this is Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "sha256": [None if x is None else digest(json.loads(x)) for x in batch[document]]})

    return rows.select(key, document).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, sha256 string")
