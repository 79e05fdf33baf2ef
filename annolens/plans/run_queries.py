"""Queries over whole runs: scored rows, summaries of several runs, file series, funnels, attempts, generated comments, the guide.

Grades are made from the rows of `labels` by arithmetic on their ids that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.operators import code, runs
from annolens.operators.matching import matched
from annolens.operators.summary import ARMS
from annolens.operators.validate import DIMENSIONS
from annolens.plans.registry import query
from annolens.session import table

_ARM_NO = "CASE arm WHEN 'without_spec' THEN 0 WHEN 'with_spec' THEN 1 ELSE 2 END"
_ARMS = f"explode(array({', '.join(map(repr, ARMS))})) AS arm"
_ARMS_DUCK = f"unnest([{', '.join(map(repr, ARMS))}]) AS arm"
_GRADE = "(doc_id * 7 + a * 3 + d * 5 + toxic + quality) % 5"
_MEASURED = "CASE (doc_id + a) % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS band, ((doc_id + a) % 4) / 4.0 AS restatement, (doc_id * (a + 1)) % 3 AS foreign_per_100"
_BASE_SQL = f"""
    arms AS (SELECT doc_id, quality, toxic, {_ARMS_DUCK} FROM labels), numbered AS (SELECT *, {_ARM_NO} AS a FROM arms),
    graded AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS d FROM numbered), grades AS (SELECT doc_id AS id, arm, d, {_GRADE} AS grade, quality FROM graded), measured AS (SELECT doc_id AS id, arm, {_MEASURED} FROM numbered)
"""
_SCORED_SQL = f"""
    {_BASE_SQL}, wide AS (SELECT id, arm, max(grade) FILTER (d = 4) AS meaning, max(grade) FILTER (d = 5) AS usefulness, max(grade) FILTER (d < 4) AS style, array_to_string(list(grade ORDER BY d) FILTER (d < 4), '') AS by_style FROM grades GROUP BY ALL),
    scored AS (SELECT w.id, w.arm, w.meaning < 2 AS precondition, w.style < 2 AS clean, m.band = u.band AND w.usefulness < 2 AS effective, m.restatement <= u.restatement AND m.foreign_per_100 <= u.foreign_per_100 AS invasive, CASE WHEN w.id % 3 > 0 THEN w.id % 3 = 1 END AS optimal,
            len(list_filter(range(1, 5), lambda k: w.by_style[k] > t.by_style[k])) = 0 AS beats_upstream, CAST(list_max(list_transform(range(1, 5), lambda k: CAST(t.by_style[k] AS INT))) AS DOUBLE) AS worst_upstream
        FROM wide w JOIN wide t ON t.id = w.id AND t.arm = 'upstream' JOIN measured m ON m.id = w.id AND m.arm = w.arm JOIN measured u ON u.id = w.id AND u.arm = 'upstream' WHERE w.arm <> 'upstream')
"""


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    numbered = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality", "toxic", _ARMS).selectExpr("*", f"{_ARM_NO} AS a")
    each = numbered.selectExpr("*", "explode(sequence(0, 5)) AS d")
    names = F.array(*map(F.lit, DIMENSIONS))
    grades = each.select(F.col("doc_id").alias("id"), F.lit(0).alias("repeat"), F.lit(0).alias("judge"), "arm", F.get(names, F.col("d")).alias("dimension"), F.expr(_GRADE).alias("grade"), "quality")
    return grades, numbered.selectExpr("doc_id AS id", "0 AS repeat", "arm", *_MEASURED.replace("END AS band, ", "END AS band|").replace("AS restatement, ", "AS restatement|").split("|"))


def _verdicts(grades: DataFrame) -> DataFrame:
    return grades.select("id", "repeat", "arm").distinct().select("id", "repeat", "arm", F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("passed"))


@query("scored_rows", f"WITH {_SCORED_SQL} SELECT id, arm, precondition, clean, effective, invasive, optimal, beats_upstream, worst_upstream, CASE WHEN NOT clean THEN 'clean' WHEN NOT effective THEN 'effective' WHEN NOT invasive THEN 'invasive' WHEN NOT optimal THEN 'optimal' ELSE 'none' END AS first_failure FROM scored")
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades, measured = _graded(spark, sf_dir)
    rows = runs.scored_rows(grades, measured, _verdicts(grades))
    return rows.withColumn("worst_upstream", F.array_max(F.map_values("upstream_deficits"))).drop("repeat", "deficits", "upstream_deficits")


@query("file_verdicts", f"""
    WITH {_SCORED_SQL}, cases AS (SELECT l.doc_id AS id, source AS path FROM labels l JOIN documents d USING (doc_id)), files AS (SELECT path, arm, hash_of % 3 = 0 AS passed FROM (SELECT DISTINCT path, CAST(substr(path, 4) AS INT) AS hash_of FROM cases), (SELECT unnest(['without_spec', 'with_spec']) AS arm) WHERE (hash_of + length(arm)) % 4 > 0)
    SELECT s.arm, path, count(*) AS rows, count(*) FILTER (f.passed) AS optimal, count(*) FILTER (f.passed IS NULL) AS unjudged, count(*) FILTER (clean AND effective AND invasive AND f.passed) AS standing FROM scored s JOIN cases USING (id) LEFT JOIN files f USING (path, arm) GROUP BY s.arm, path
""")
def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of whole files meet the answers of their file, by path and arm."""
    grades, measured = _graded(spark, sf_dir)
    cases = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))
    number = F.substring("path", 4, 9).cast("int")
    files = cases.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, ARMS[:2]))).alias("arm"), (number % 3 == 0).alias("passed")).where((number + F.length("arm")) % 4 > 0)
    rows = runs.scored_rows(grades, measured, files, cases)
    held = F.col("clean") & F.col("effective") & F.col("invasive") & F.col("optimal")
    return rows.groupBy("arm", "path").agg(F.count("*").alias("rows"), F.count_if("optimal").alias("optimal"), F.count_if(F.col("optimal").isNull()).alias("unjudged"), F.count_if(held).alias("standing"))


_ENTRIES = "SELECT conv_id, turn % 2 AS line, turn, role FROM conversations"


@query("first_matches", f"""
    WITH comments AS ({_ENTRIES}), first AS (SELECT conv_id, line, min(turn) AS turn, arg_min(role, turn) AS role, count(*) AS many FROM comments GROUP BY ALL), entries AS (SELECT DISTINCT conv_id, unnest([0, 1, 2]) AS line FROM conversations)
    SELECT conv_id, line, turn, role, many > 1 AS several, CASE WHEN turn IS NULL THEN 'entry without a comment: ' || conv_id || ', ' || line END AS refused FROM entries LEFT JOIN first USING (conv_id, line)
""")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that meet the first of several comments at their place, the only one, or none."""
    comments = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).cast("int").alias("line"), "turn", "role")
    entries = comments.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, range(3)))).alias("line"))
    many = comments.groupBy("conv_id", "line").agg((F.count("*") > 1).alias("several"))
    return matched(entries, comments, ["conv_id", "line"], ["turn"], what="entry without a comment", refuse=False).join(many, ["conv_id", "line"], "left")


@query("scored_run", f"WITH {_SCORED_SQL} SELECT arm, count(*) AS rows, count(*) FILTER (clean) AS clean, count(*) FILTER (clean AND effective) AS effective, count(*) FILTER (clean AND effective AND invasive) AS invasive, round(avg(clean::INT), 6) AS rate FROM scored GROUP BY arm")
def scored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades, measured = _graded(spark, sf_dir)
    parts = []
    for arm in ARMS[:2]:
        rungs = runs.scored_run(grades, measured, arm, _verdicts(grades)).withColumn("arm", F.lit(arm))
        parts.append(rungs.groupBy("arm").agg(F.max("judged").alias("rows"), *[F.max(F.when(F.col("criterion") == c, F.col("passed"))).alias(c) for c in ("clean", "effective", "invasive")], F.round(F.max(F.when(F.col("rung") == 0, F.col("rate_of_all"))), 6).alias("rate")))
    return parts[0].unionByName(parts[1])


_NAMES = f"[{', '.join(map(repr, DIMENSIONS))}]"
_RUN_SQL = """SELECT {run} AS run, {names}[d + 1] AS dimension, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta < 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta > 0) AS losses, count(*) FILTER (delta >= 2) AS severe FROM deltas {where} GROUP BY d"""


@query("combined_runs", f"""
    WITH {_BASE_SQL}, deltas AS (SELECT id, d, quality, max(grade) FILTER (arm = 'with_spec') - max(grade) FILTER (arm = 'without_spec') AS delta FROM grades GROUP BY ALL)
    {' UNION ALL '.join(_RUN_SQL.format(run=repr(run), names=_NAMES, where=where) for run, where in (("combined", ""), ("plain", "WHERE quality = 0"), ("good", "WHERE quality = 1")))}
""")
def combined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades, _ = _graded(spark, sf_dir)
    parts = {name: grades.where(F.col("quality") == k).drop("quality") for name, k in (("plain", 0), ("good", 1))}
    long = runs.combined(parts).where("arm is null and metric not in ('mean_absolute_difference', 'exact_agreement')")
    wide = long.groupBy("run", "dimension").pivot("metric", ["mean_delta", "wins", "ties", "losses", "severe"]).agg(F.first("value"))
    return wide.select("run", "dimension", F.round("mean_delta", 6).alias("mean_delta"), *[F.col(c).cast("long").alias(c) for c in ("wins", "ties", "losses", "severe")])


_ANSWER = """'{"sets":[{"label":"S1","redundancy":' || CAST(conv_id % 4 AS STRING) || ',"consistency":' || CAST(conv_id % 6 AS STRING) || ',"proportion":0,"evidence":[],"explanation":"x"}]}'"""


@query("file_series", """
    WITH sets AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 3), judged AS (SELECT CASE conv_id % 2 WHEN 0 THEN 'with_spec' ELSE 'without_spec' END AS arm, conv_id % 4 AS r, conv_id % 6 AS c FROM sets WHERE conv_id % 6 <= 4)
    SELECT x.arm, count(r) AS files, count(*) FILTER (r < 2 AND c < 2) AS passed, round(avg(r), 6) AS redundancy, round(avg(c), 6) AS consistency, CASE WHEN count(r) > 0 THEN 0.0 END AS proportion FROM (SELECT unnest(['with_spec', 'without_spec', 'upstream']) AS arm) x LEFT JOIN judged USING (arm) GROUP BY x.arm
""")
def file_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.when(F.col("conv_id") % 2 == 0, "with_spec").otherwise("without_spec").alias("arm")
    sets = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("conv_id").alias("path"), arm, F.lit("words").alias("text"))
    answers = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("path"), arm, F.expr(_ANSWER).alias("answer"))
    return runs.file_series(sets, answers, list(ARMS))[0].withColumns({d: F.round(d, 6) for d in ("redundancy", "consistency", "proportion")})


_COMMIT = "1 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS parents, doc_id * 37 % 400000 AS context_bytes, CASE WHEN doc_id % 7 = 1 THEN 'too large' END AS rejection, 1 + doc_id % 2 * quality AS split_count"


@query("commit_funnel", f"SELECT reason, count(*) AS commits FROM (SELECT CASE WHEN parents <> 1 THEN 'merge' WHEN rejection IS NOT NULL THEN 'not eligible' WHEN split_count > 1 THEN 'files of several splits' WHEN context_bytes > 200000 THEN 'context too large' END AS reason FROM (SELECT {_COMMIT} FROM labels)) GROUP BY reason")
def commit_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.expr(f"inline(array(struct({_COMMIT})))"))
    return runs.commit_reasons(rows).groupBy("reason").agg(F.count("*").alias("commits"))


@query("latest_attempts", """
    SELECT o_custkey, count(*) AS attempts, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) FILTER (o_orderkey % 3 > 0) * 2 AS calls FROM orders GROUP BY o_custkey
""")
def latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") * 2).alias("calls"))
    return runs.latest_attempts(rows, "o_custkey", "o_orderkey", ["calls"])


_SOURCE = "'int a' || CAST(doc_id AS STRING) || '; // old' || chr(10) || 'int b;' || chr(10)"
_GENERATED = """CASE doc_id % 7 WHEN 1 THEN '{"comment":"ends */"}' WHEN 2 THEN '{"comment":"two","more":1}' WHEN 3 THEN '{"comment":" "}' WHEN 4 THEN '{"comment":"one' || '\\\\n' || 'two"}' ELSE '{"comment":"says what b is"}' END"""
_START = "7 + length(CAST(doc_id AS STRING))"


@query("generated_comments", f"""
    SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'delimiter or splice' WHEN 2 THEN 'wrong keys' WHEN 3 THEN 'empty' END AS reason,
        CASE WHEN doc_id % 7 IN (1, 2, 3) THEN NULL WHEN doc_id % 7 = 4 THEN replace({_SOURCE}, '// old', '// one' || chr(10) || '// two') ELSE replace({_SOURCE}, '// old', '// says what b is') END AS after FROM labels
""")
def generated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_SOURCE).alias("source"), F.expr(_GENERATED).alias("answer"), F.expr(f"CAST({_START} AS INT)").alias("start"))
    rows = rows.withColumns({"end": F.col("start") + 6, "original": F.lit("// old"), "indent": F.lit("")})
    return code.generated_comments(rows, "doc_id").select("doc_id", "reason", "after")


@query("guide_text", "SELECT sha256('# Guide' || chr(10) || chr(10) || string_agg('## ' || item_id || chr(10) || text, chr(10) || chr(10) ORDER BY item_id)) AS sha256 FROM benchmark WHERE text IS NOT NULL")
def guide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.guide(table(spark, sf_dir, "benchmark").where("text is not null"), "item_id", ["text"]).select("sha256")
