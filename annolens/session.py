"""Sessions, table reading and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line.

    On a cluster the caller brings a session; nothing in the library depends on these settings.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("annolens")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan has fewer parts than half of them, as a small file of one row group has; else df itself.

    For expressions that cost more than moving a row: texts under regular expressions. Large tables come in many parts and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_annolens_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="annolens-"), "annolens_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(ROOT.rglob("*.py")):
            archive.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(path)
    context._annolens_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session has one of its own if that is unset, a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_annolens_pinned", None)
        if not root:
            root = context._annolens_pinned = tempfile.mkdtemp(prefix="annolens-pinned-")
    return root.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of recomputing it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/annolens/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
