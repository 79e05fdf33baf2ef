"""Queries over a whole study: its run as stages, its lists, its full summary, and what is published of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import text as T
from annolens.operators import stages, study_run
from annolens.operators.summary import ARMS
from annolens.plans.registry import query
from annolens.plans.run_queries import _BASE_SQL, _graded
from annolens.plans.text_queries import SQL_WORDS, documents
from annolens.session import shared_root, table
from annolens.sources import published

_REASON = "CASE WHEN trim(answer) = '' THEN 'empty' WHEN answer LIKE '%*/%' THEN 'delimiter' END"
_ANSWER = "CASE WHEN (doc_id + a) % 11 = 3 THEN ' ' WHEN (doc_id + a) % 13 = 5 THEN 'ends */' ELSE 'says ' || doc_id END"
_STUDY_SQL = f"""
    {_BASE_SQL}, answers AS (SELECT doc_id AS id, arm, {_ANSWER} AS answer FROM numbered WHERE arm <> 'upstream' AND (doc_id + a) % 17 <> 1),
    generated AS (SELECT n.doc_id AS id, n.arm, CASE WHEN answer IS NULL THEN 'no answer' ELSE {_REASON} END AS reason FROM numbered n LEFT JOIN answers s ON s.id = n.doc_id AND s.arm = n.arm WHERE n.arm <> 'upstream'),
    out AS (SELECT id, max(reason) FILTER (arm = 'with_spec') AS with_spec, max(reason) FILTER (arm = 'without_spec') AS without_spec FROM generated WHERE reason IS NOT NULL GROUP BY id)
"""
_NAMES = "['style', 'words', 'structure', 'simplicity', 'meaning', 'usefulness']"


def _study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, answers, grades) over all labels: some answers are missing, empty or end a comment."""
    grades, _ = _graded(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    answers = labels.select("doc_id", F.posexplode(F.array(*map(F.lit, ARMS[:2]))).alias("a", "arm")).where("(doc_id + a) % 17 <> 1")
    return labels.select(F.col("doc_id").alias("id")), answers.select(F.col("doc_id").alias("id"), F.lit(0).alias("repeat"), "arm", F.expr(_ANSWER).alias("answer")), grades.drop("quality")


@query("study_run", f"""
    WITH {_STUDY_SQL}, kept AS (SELECT id, arm, {_NAMES}[d + 1] AS dimension, grade FROM grades WHERE id NOT IN (SELECT id FROM out)),
    deltas AS (SELECT id, dimension, max(grade) FILTER (arm = 'with_spec') - max(grade) FILTER (arm = 'without_spec') AS delta FROM kept GROUP BY ALL)
    SELECT 'mean_grade' AS metric, arm, dimension, round(avg(grade), 6) AS value FROM kept GROUP BY arm, dimension
    UNION ALL SELECT unnest(['mean_delta', 'wins', 'ties', 'losses', 'severe']), NULL, dimension, round(unnest([avg(delta), count(*) FILTER (delta < 0), count(*) FILTER (delta = 0), count(*) FILTER (delta > 0), count(*) FILTER (delta >= 2)]), 6) FROM deltas GROUP BY dimension
    UNION ALL SELECT 'requested_pairs', NULL, NULL, count(DISTINCT id) FROM generated UNION ALL SELECT 'excluded_pairs', NULL, NULL, count(*) FROM out UNION ALL SELECT 'judged_pairs', NULL, NULL, count(DISTINCT id) FROM kept
""")
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a study, each a table of its own, down to the summary."""
    cases, answers, grades = _study(spark, sf_dir)
    run = stages.Run(spark, f"{shared_root(spark)}/annolens/run-{uuid.uuid4().hex}", {"cases": (cases, "id"), "answers": (answers, "id"), "grades": (grades, "id")})
    return run.go(study_run.study_stages(F.expr(_REASON)))["summary"].withColumn("value", F.round("value", 6))


@query("exclusion_lists", f"WITH {_STUDY_SQL} SELECT id, with_spec, without_spec, (with_spec IS NOT NULL)::INT + (without_spec IS NOT NULL)::INT AS n FROM out")
def exclusion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, answers, _ = _study(spark, sf_dir)
    rows = study_run.study_stages(F.expr(_REASON))[0].function(cases, answers).where("reason is not null")
    found = study_run.exclusions(rows)
    return found.select("id", *[F.try_element_at("arms", F.lit(a)).alias(a) for a in ARMS[:2]], F.size("arms").alias("n"))


@query("regression_lists", f"""
    WITH {_BASE_SQL}, deltas AS (SELECT id, d, max(grade) FILTER (arm = 'with_spec') - max(grade) FILTER (arm = 'without_spec') AS delta FROM grades GROUP BY id, d)
    SELECT {_NAMES}[d + 1] AS dimension, count(*) FILTER (delta > 0) AS regressions, array_to_string((list(id ORDER BY id) FILTER (delta > 0))[1:25], ',') AS ids, count(*) FILTER (delta >= 2) AS severe, array_to_string(coalesce((list(id ORDER BY id) FILTER (delta >= 2))[1:25], []), ',') AS severe_ids FROM deltas GROUP BY d
""")
def regression_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers the guide made worse, and the first 25 of them, by dimension."""
    found = study_run.regressions(_graded(spark, sf_dir)[0].drop("quality"), shown=25)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("dimension", "regressions", listed("ids"), "severe", listed("severe_ids"))


_ARM = "CASE doc_id % 3 WHEN 0 THEN 'without_spec' WHEN 1 THEN 'with_spec' ELSE 'upstream' END"


@query("whole_summary", f"""
    WITH texts AS (SELECT {_ARM} AS arm, len({SQL_WORDS.format(t='text')}) AS word_count, length(text) - length(replace(text, ';', '')) AS semicolons, n_chars FROM documents WHERE text IS NOT NULL)
    SELECT 'style' AS metric, arm, unnest(['word_count', 'semicolons']) AS dimension, round(unnest([avg(word_count), avg(semicolons)]), 6) AS value FROM texts GROUP BY arm
    UNION ALL SELECT 'distance_to_reference', arm, 'chars', round(avg(n_chars), 6) FROM texts WHERE arm <> 'upstream' GROUP BY arm
""")
def whole_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style and distance parts of a summary, of texts of three arms."""
    text = F.col("text")
    rows = documents(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("id"), F.lit(0).alias("repeat"), F.expr(_ARM).alias("arm"), F.size(T.words(text)).cast("double").alias("word_count"), T.count_of(text, ";").cast("double").alias("semicolons"), F.col("n_chars").cast("double").alias("chars"))
    style = rows.unpivot(["id", "repeat", "arm"], ["word_count", "semicolons"], "measure", "value")
    distances = rows.where("arm <> 'upstream'").unpivot(["id", "repeat", "arm"], ["chars"], "measure", "value")
    none = _graded(spark, sf_dir)[0].drop("quality").limit(0)
    return study_run.whole_summary(none, style, distances).withColumn("value", F.round("value", 6))


@query("published_versions", """
    WITH v1 AS (SELECT doc_id AS path, quality FROM labels WHERE doc_id % 3 > 0), v2 AS (SELECT doc_id AS path, quality + toxic AS quality, toxic FROM labels WHERE doc_id % 3 < 2)
    SELECT 1 AS version, path, quality, NULL AS toxic, path IN (SELECT path FROM v2) AS superseded FROM v1 UNION ALL SELECT 2, path, quality, toxic, false FROM v2
""")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table, the second with a column more, under one schema."""
    folder = f"{shared_root(spark)}/annolens/published-{uuid.uuid4().hex}"
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "path")
    published.publish(labels.where("path % 3 > 0").select("path", "quality"), folder, 1)
    published.publish(labels.where("path % 3 < 2").select("path", (F.col("quality") + F.col("toxic")).alias("quality"), "toxic"), folder, 2)
    return published.superseded(published.versions(spark, folder), ["path"])


@query("commit_projection", """
    WITH scored AS (SELECT o_orderkey AS id, o_orderkey % 3 > 0 AS applied, o_custkey % 90 AS changed, o_custkey % 70 AS reference FROM orders)
    SELECT count(*) FILTER (applied) AS applied, median(CASE WHEN applied THEN changed END) AS median_changed_lines, median(CASE WHEN applied THEN reference END) AS median_reference_changed_lines, count(*) FILTER (applied AND changed <= 40) AS passed FROM scored
""")
def commit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored changes as they are published, and their medians."""
    changed, reference = F.col("o_custkey") % 90, F.col("o_custkey") % 70
    invasive = F.struct(changed.alias("changed_lines"), reference.alias("reference_changed_lines"), (changed <= 40).alias("passed"))
    comparison = F.struct(F.lit(0.5).alias("region_overlap"), invasive.alias("invasive"), F.struct((reference <= 40).alias("passed")).alias("optimal"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("u").alias("url"), F.lit("with_spec").alias("arm"), (F.col("o_orderkey") % 3 > 0).alias("applied"), F.lit(None).cast("string").alias("invalid"), comparison.alias("comparison"))
    public = published.commit_projection(rows)
    return published.projection_medians(public).join(public.agg(F.count_if("invasive_passed").alias("passed")))
