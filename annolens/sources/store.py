"""Fetch or reuse: a store addressed by content, and saved calls that count only if they had the same inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions.fingerprints import canonical_json
from annolens.session import pinned

STORE = "sha256 string, content binary"
# What a path of the lock or of the files can be, sound states first.
REUSED, COPIED, MISSING, CHANGED, SURPLUS = "in the store", "copied", "missing", "content differs", "not in the lock"


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(sha256, content) of a store; one that nothing was put into is empty."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def reconcile(lock: DataFrame, files: DataFrame, held: DataFrame) -> DataFrame:
    """(path, sha256, state) of every path of the lock (path, sha256) and of the files (path, content), given the store's hashes.

    Lock and files meet in one full outer join on the path, and the locked hash with the store's. Bytes are hashed where they are read and never shuffled.
    """
    found = files.select("path", F.sha2("content", 256).alias("found"))
    met = lock.select("path", F.col("sha256").alias("locked")).join(found, "path", "full")
    met = met.join(held.select(F.col("sha256").alias("locked"), F.lit(True).alias("there")).distinct(), "locked", "left")
    state = F.when(F.col("locked").isNull(), SURPLUS).when(F.col("found") != F.col("locked"), CHANGED).when(F.col("there"), REUSED).when(F.col("found").isNull(), MISSING).otherwise(COPIED)
    return met.select("path", F.coalesce("locked", "found").alias("sha256"), state.alias("state"))


def fetch_or_reuse(lock: DataFrame, files: DataFrame, store: str) -> DataFrame:
    """The states of all paths, after what is sound and missing from the store was copied into it, each content once.

    Nothing is written where a path is missing, changed or surplus, nor where there is nothing to copy: a second run leaves the store as it is.
    """
    spark = lock.sparkSession
    states = pinned(reconcile(lock, files, stored(spark, store).select("sha256")))
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    if counts.get(COPIED) and not counts.keys() & {MISSING, CHANGED, SURPLUS}:
        new = states.where(F.col("state") == COPIED).groupBy("sha256").agg(F.min("path").alias("path"))
        files.select("path", "content").join(new, "path").select("sha256", "content").write.mode("append").parquet(store)
    return states


def locked_sources(lock: DataFrame, store: str) -> DataFrame:
    """(path, sha256, content) of a lock whose contents are all in the store."""
    return lock.select("path", "sha256").join(stored(lock.sparkSession, store).dropDuplicates(["sha256"]), "sha256", "left").select("path", "sha256", "content")


# Inputs of a call as metadata names them, in the order in which they are compared.
INPUTS = ("model", "reasoning_effort", "prompt_sha256", "schema_sha256", "guidance_sha256")
REUSE, RUN = "reuse", "run"


def saved_calls(tasks: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys with (decision, problem): whether a task's saved call can be used, or why the run must stop.

    tasks: keys, model, reasoning_effort, prompt, guidance, schema (JSON). calls: keys, INPUTS, status, and the saved files prompt, guidance, schema, answer as texts. All five
    inputs and three files are compared in one join; `problem` is the first that differs, or an answer that a completed call lacks. A task without a call, or with one
    that did not complete, is to be run.
    """
    texts = {"prompt_sha256": F.col("t.prompt"), "schema_sha256": canonical_json(F.col("t.schema")), "guidance_sha256": F.col("t.guidance")}
    c = lambda name: F.col(f"c.{name}")
    wanted = {k: F.sha2(texts[k], 256) if k in texts else F.col(f"t.{k}") for k in INPUTS}
    checks = [F.when(~c(k).eqNullSafe(v), F.lit(k)) for k, v in wanted.items()]
    checks += [F.when(~c(k).eqNullSafe(F.col(f"t.{k}")), F.lit(f"{k} file")) for k in ("prompt", "guidance")]
    checks.append(F.when(~canonical_json(c("schema")).eqNullSafe(canonical_json(F.col("t.schema"))), F.lit("schema file")))
    checks.append(F.when((c("status") == "completed") & c("answer").isNull(), F.lit("answer of a completed call")))
    there = calls.withColumn("_there", F.lit(True)).alias("c")
    met = tasks.alias("t").join(there, [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "left")
    problem = F.when(c("_there").isNotNull(), F.coalesce(*checks))
    decision = F.when(problem.isNotNull(), F.lit(None)).when(c("status") == "completed", REUSE).otherwise(RUN)
    return met.select(*[F.col(f"t.{k}").alias(k) for k in keys], decision.alias("decision"), problem.alias("problem"))


def stale(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name) of what a run was started on and has changed since: expected and found hold (name, digest), of tables, documents or versions. Empty if the run may go on."""
    met = expected.select("name", F.col("digest").alias("was")).join(found.select("name", F.col("digest").alias("now")), "name", "left")
    return met.where(~F.col("was").eqNullSafe(F.col("now"))).select("name")
