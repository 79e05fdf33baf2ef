"""What the operators share: narrow inputs, shared storage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, with null texts as empty ones.

    Every other column of the input is left behind here, so names that clash with an
    operator's own columns cannot matter later.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local session's own if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_annolens_shared", None)
        if not root:
            root = context._annolens_shared = tempfile.mkdtemp(prefix="annolens-shared-")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/annolens/{name}-{uuid.uuid4().hex}"


CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, *, clear: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, and an executor's loss costs nothing.

    clear: the shuffle files behind it go as soon as it is written, not when the driver collects its garbage.
    """
    path = new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEARED, None)
    try:
        if clear:
            conf.set(CLEARED, "true")
        df.write.parquet(path)
    finally:
        if clear:
            conf.set(CLEARED, before) if before else conf.unset(CLEARED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Rows of a batch that Python holds as objects at once.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of few rows: what a worker holds beside Arrow's own memory stays small, however long the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def is_crc_bucket(id_col: str, modulus: int, remainder: int):
    """crc32 of an id as text, modulo a number, equals a remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder
