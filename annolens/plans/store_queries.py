"""Queries over fingerprints, the store and saved calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions.fingerprints import canonical_json, fingerprint_tree, json_digest
from annolens.plans.registry import query
from annolens.session import table
from annolens.sources import store

_DOCUMENT = """CASE doc_id % 4 WHEN 0 THEN '{"b":{"y":' || doc_id || ',"x":[1, 2.5,"a, \\\\"b: c"]},"a":' || quality || '}' WHEN 1 THEN ' { "a" : ' || quality || '.0 , "b" : { "x":[1.0,2.50,"a, \\\\"b: c"], "y":' || doc_id || ' } }' WHEN 2 THEN '{"a":1' ELSE '[{"z":null,"B":true},{}]' END"""
_CANONICAL = """CASE WHEN doc_id % 4 < 2 THEN '{"a": ' || quality || ', "b": {"x": [1, 2.5, "a, \\"b: c"], "y": ' || doc_id || '}}' WHEN doc_id % 4 = 3 THEN '[{"B": true, "z": null}, {}]' END"""


@query("json_digests", f"SELECT doc_id, {_CANONICAL} AS canonical, sha256({_CANONICAL}) AS digest FROM labels")
def json_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ in spacing, order of keys and spelling of numbers, and some that are broken."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_DOCUMENT).alias("document"))
    return rows.select("doc_id", canonical_json(F.col("document")).alias("canonical"), json_digest(F.col("document")).alias("digest"))


_LANES = ", ".join(f"sum(('0x' || substr(d, {1 + 8 * k}, 8))::BIGINT) AS s{k}" for k in range(8))


@query("table_tree", f"""
    WITH rows AS (SELECT ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT >> 20 AS node, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))) AS d FROM documents),
    leaves AS (SELECT node, count(*) AS rows, {_LANES} FROM rows GROUP BY node), deep AS (SELECT 2 AS level, node, rows, sha256(concat_ws(':', node, rows, {', '.join(f's{k}' for k in range(8))})) AS digest FROM leaves),
    mid AS (SELECT 1 AS level, node >> 6 AS node, sum(rows) AS rows, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM deep GROUP BY deep.node >> 6), root AS (SELECT 0 AS level, 0 AS node, sum(rows) AS rows, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM mid)
    SELECT level, node, rows::BIGINT AS rows, digest FROM deep UNION ALL SELECT level, node, rows::BIGINT, digest FROM mid UNION ALL SELECT level, node, rows::BIGINT, digest FROM root
""")
def table_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_tree(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "lang", "source", "text"])


@query("store_states", """
    WITH lock AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 7 <> 1), files AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 2 THEN coalesce(text, '') || '.' ELSE coalesce(text, '') END) AS sha FROM documents WHERE doc_id % 5 <> 3),
    held AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id::VARCHAR AS path, coalesce(l.sha, f.sha) AS sha256, CASE WHEN l.sha IS NULL THEN 'not in the lock' WHEN f.sha <> l.sha THEN 'content differs' WHEN l.sha IN (SELECT sha FROM held) THEN 'in the store' WHEN f.sha IS NULL THEN 'missing' ELSE 'copied' END AS state
    FROM lock l FULL JOIN files f USING (doc_id)
""")
def store_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock, files and a store over all documents: some files changed, missing or surplus, some contents held already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    lock = docs.where("doc_id % 7 <> 1").select("path", F.sha2("text", 256).alias("sha256"))
    files = docs.where("doc_id % 5 <> 3").select("path", F.when(F.col("doc_id") % 11 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")).cast("binary").alias("content"))
    held = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))
    return store.reconcile(lock, files, held)


_SAVED = "doc_id % 10 <> 9"


@query("saved_calls", f"""
    SELECT doc_id, CASE WHEN NOT {_SAVED} THEN 'run' WHEN doc_id % 10 BETWEEN 1 AND 6 THEN NULL WHEN doc_id % 10 = 7 THEN CASE WHEN quality = 0 THEN 'run' END ELSE CASE WHEN toxic = 1 THEN 'run' ELSE 'reuse' END END AS decision,
        CASE doc_id % 10 WHEN 1 THEN 'model' WHEN 2 THEN 'prompt_sha256' WHEN 3 THEN 'schema_sha256' WHEN 4 THEN 'guidance_sha256' WHEN 5 THEN 'prompt file' WHEN 6 THEN 'schema file' WHEN 7 THEN CASE WHEN quality = 1 THEN 'answer of a completed call' END END AS problem FROM labels
""")
def saved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and saved calls over all labels: each input changed in some, answers missing from some, schemas written in another order."""
    k = F.col("doc_id") % 10
    base = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit("m1").alias("model"), F.lit("low").alias("reasoning_effort"), F.concat(F.lit("prompt "), F.col("doc_id").cast("string")).alias("prompt"), F.lit("").alias("guidance"), F.lit('{"type": "object", "a": 1}').alias("schema"))
    other = lambda n, column, value: F.when(k == n, value).otherwise(F.col(column) if isinstance(column, str) else column)
    hash_of = lambda text: F.sha2(text, 256)
    calls = base.where(_SAVED).select(
        "doc_id", other(1, "model", F.lit("m2")).alias("model"), "reasoning_effort", hash_of(other(2, "prompt", F.lit("x"))).alias("prompt_sha256"), hash_of(other(3, canonical_json(F.col("schema")), F.lit("{}"))).alias("schema_sha256"), hash_of(other(4, "guidance", F.lit("x"))).alias("guidance_sha256"),
        other(5, "prompt", F.lit("x")).alias("prompt"), "guidance", F.when(k == 6, F.lit("[]")).otherwise(F.lit('{"a":1,"type":"object"}')).alias("schema"),
        F.when((k == 7) & (F.col("quality") == 0) | (k != 7) & (F.col("toxic") == 1), "failed").otherwise("completed").alias("status"), F.when(k != 7, F.lit("{}")).alias("answer"),
    )
    return store.saved_calls(base.drop("quality", "toxic"), calls, ["doc_id"])
