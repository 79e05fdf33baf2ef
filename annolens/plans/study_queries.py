"""Queries over graded rows: paired arms, raters, ladders, regressions, statuses, validation.

The test tables have no study rows, so others stand in for them: events of two types are a user's two arms, labels
are raters and decisions, orders and line items are paired numbers and sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import text as T
from annolens.operators import ladder as L
from annolens.operators.paired import advisory_screen, arm_deltas, exclude_pairs, inter_rater, outcome_counts
from annolens.operators.sampling import POISSON, hash_bootstrap, poisson_bootstrap
from annolens.operators.stats import agreement, correlation, micro_jaccard
from annolens.operators.validate import LABEL_CHECKS, first_reason
from annolens.plans.registry import query
from annolens.plans.text_queries import BAND, CLASS, SQL_WORDS
from annolens.session import table

ARMS = ("click", "view")
_ARMS_SQL = """
    arms AS (SELECT user_id AS id, avg(value) FILTER (event_type = 'click') AS without_arm, avg(value) FILTER (event_type = 'view') AS with_arm FROM events GROUP BY user_id),
    deltas AS (SELECT id, with_arm - without_arm AS delta FROM arms WHERE with_arm IS NOT NULL AND without_arm IS NOT NULL)
"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*ARMS)).select(F.col("user_id").alias("id"), "event_type", "value")
    return arm_deltas(rows, "id", "event_type", "value", *ARMS)


@query("paired_delta", f"WITH {_ARMS_SQL} SELECT id, round(delta, 6) AS delta FROM deltas")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select("id", F.round("delta", 6).alias("delta"))


@query("wins_ties_losses", f"WITH {_ARMS_SQL} SELECT count(*) FILTER (delta < 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta > 0) AS losses, round(avg(delta), 6) AS mean_delta FROM deltas")
def wins_ties_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_counts(_deltas(spark, sf_dir), "delta").withColumn("mean_delta", F.round("mean_delta", 6))


@query("regressions", f"WITH {_ARMS_SQL} SELECT id, delta >= 20 AS severe FROM deltas WHERE delta > 0")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).where("delta > 0").select("id", (F.col("delta") >= 20).alias("severe"))


@query("inter_rater_agreement", "SELECT count(*) AS pairs, round(avg(abs(quality - toxic)), 6) AS mean_absolute_difference, round(avg((quality = toxic)::INT), 6) AS exact_agreement FROM labels")
def inter_rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inter_rater(table(spark, sf_dir, "labels"), "quality", "toxic")
    return got.select("pairs", F.round("mean_absolute_difference", 6).alias("mean_absolute_difference"), F.round("exact_agreement", 6).alias("exact_agreement"))


DRAWS, SEED = 200, 20260911


@query("bootstrap_interval", f"""
    WITH v AS (SELECT list(toxic::DOUBLE ORDER BY doc_id) AS a FROM labels),
         draws AS (SELECT b, a[(('0x' || substr(sha256('{SEED}:' || b || ':' || i), 1, 8))::BIGINT % len(a)) + 1] AS v FROM v, range({DRAWS}) x(b), (SELECT unnest(range(len(a))) AS i FROM v)),
         means AS (SELECT list(m ORDER BY m) AS m FROM (SELECT b, sum(v) / count(*) AS m FROM draws GROUP BY b))
    SELECT round((SELECT avg(toxic) FROM labels), 9) AS mean, round(m[{int(DRAWS * 0.025) + 1}], 9) AS low, round(m[{int(DRAWS * 0.975) + 1}], 9) AS high FROM means
""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hash_bootstrap(table(spark, sf_dir, "labels"), "toxic", "doc_id", DRAWS, SEED)
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


_TIMES = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in POISSON)


@query("poisson_interval", f"""
    WITH each AS (SELECT b, l_quantity AS v, ('0x' || substr(sha256('{SEED}:' || b // 8 || ':' || l_orderkey || '-' || l_linenumber), b % 8 * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM lineitem, range(40) x(b)),
         means AS (SELECT list(m ORDER BY m) AS m FROM (SELECT b, sum(v * ({_TIMES})) / sum({_TIMES}) AS m FROM each GROUP BY b))
    SELECT round((SELECT avg(l_quantity) FROM lineitem), 6) AS mean, round(m[{int(40 * 0.025) + 1}], 6) AS low, round(m[{int(40 * 0.975) + 1}], 6) AS high FROM means
""")
def poisson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"))
    got = poisson_bootstrap(rows, "l_quantity", "k", 40, SEED)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("screen", f"WITH {_ARMS_SQL} SELECT NOT bool_or(delta >= 60) AND avg(delta) <= 0 AS passes FROM deltas")
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisory_screen(_deltas(spark, sf_dir), "delta", severe=60)


@query("strata_summary", f"""
    WITH rows AS (SELECT {BAND.format(n=f"len({SQL_WORDS.format(t='text')})")} AS band, {CLASS.format(t="text")} AS class, quality FROM documents JOIN labels USING (doc_id))
    SELECT coalesce(band, '*') AS band, coalesce(class, '*') AS class, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM rows GROUP BY GROUPING SETS ((), (band), (class))
""")
def strata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.length_band(F.size(T.words(t))).alias("band"), T.functional_class(t).alias("class"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    sets = rows.groupingSets([[], ["band"], ["class"]], "band", "class").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    return sets.select(F.coalesce("band", F.lit("*")).alias("band"), F.coalesce("class", F.lit("*")).alias("class"), "n", "mean_quality")


@query("pooled_runs", "SELECT run, count(*) AS documents, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS chars FROM (SELECT 'a' AS run, * FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT 'b', * FROM documents WHERE source IN ('src1', 'src2')) GROUP BY run")
def pooled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = [docs.where(F.col("source").isin(*s)).select(F.lit(name).alias("run"), "lang", "n_chars") for name, s in (("a", ("src0", "src1")), ("b", ("src1", "src2")))]
    return reduce(DataFrame.unionByName, runs).groupBy("run").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


@query("exclude_pairs", f"WITH {_ARMS_SQL} SELECT count(*) AS kept FROM arms WHERE with_arm IS NOT NULL AND without_arm IS NOT NULL AND id NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view') AND value > 95)")
def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "events").where(F.col("event_type").isin(*ARMS) & (F.col("value") > 95)).select(F.col("user_id").alias("id"))
    return exclude_pairs(_deltas(spark, sf_dir), bad, "id").agg(F.count("*").alias("kept"))


CRITERIA = ["clean", "effective", "invasive", "optimal"]
_CRITERIA_SQL = f"""
    rows AS (SELECT doc_id, n >= 20 AS clean, n BETWEEN 20 AND 300 AS effective, n_chars < 1500 AS invasive, CASE WHEN lang = 'en' THEN doc_id % 2 = 0 END AS optimal FROM (SELECT doc_id, n_chars, lang, len({SQL_WORDS.format(t="text")}) AS n FROM documents))
"""
_C = "coalesce({}, false)"


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", (n >= 20).alias("clean"), n.between(20, 300).alias("effective"), (F.col("n_chars") < 1500).alias("invasive"), F.when(F.col("lang") == "en", F.col("doc_id") % 2 == 0).alias("optimal")
    )


def _ladder_sql() -> str:
    parts = []
    for k, c in enumerate(CRITERIA):
        before = " AND ".join(_C.format(x) for x in CRITERIA[:k]) or "true"
        parts.append(f"SELECT {k} AS rung, '{c}' AS criterion, count(*) FILTER ({before} AND {c} IS NOT NULL) AS judged, count(*) FILTER ({before} AND {_C.format(c)}) AS passed, count(*) AS cases FROM rows")
    return f"WITH {_CRITERIA_SQL} SELECT rung, criterion, judged, passed, round(passed / nullif(judged, 0), 6) AS rate_of_standing, round(passed / nullif(cases, 0), 6) AS rate_of_all FROM ({' UNION ALL '.join(parts)})"


@query("ladder_standing", _ladder_sql())
def ladder_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.standing(_criteria(spark, sf_dir), CRITERIA)
    return got.select("rung", "criterion", "judged", "passed", F.round("rate_of_standing", 6).alias("rate_of_standing"), F.round("rate_of_all", 6).alias("rate_of_all"))


@query("ladder_first_failure", f"WITH {_CRITERIA_SQL} SELECT CASE {' '.join(f'WHEN NOT {c} THEN {c!r}' for c in CRITERIA)} ELSE 'none' END AS first_failure, count(*) AS n FROM rows GROUP BY ALL")
def ladder_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _criteria(spark, sf_dir).groupBy(L.first_failure(CRITERIA).alias("first_failure")).agg(F.count("*").alias("n"))


def _violations_sql() -> str:
    parts = [
        f"SELECT '{h}' AS harder, '{e}' AS easier, (SELECT count(*) FROM rows WHERE {h} AND NOT {e}) AS cases, (SELECT coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') FROM (SELECT doc_id FROM rows WHERE {h} AND NOT {e} ORDER BY doc_id LIMIT 20)) AS ids"
        for e, h in zip(CRITERIA, CRITERIA[1:], strict=False)
    ]
    return f"WITH {_CRITERIA_SQL} {' UNION ALL '.join(parts)}"


@query("ladder_order_violations", _violations_sql())
def ladder_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.order_violations(_criteria(spark, sf_dir), CRITERIA, "doc_id")
    return got.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


_CASCADE_SQL = "SELECT l_orderkey % 10 AS grp, count(*) AS rows, count(*) FILTER (l_quantity > 10) AS applies, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS overlaps, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02 AND l_tax < 0.06) AS invasive, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02 AND l_tax < 0.06 AND l_returnflag = 'N') AS optimal, round(avg(l_discount) FILTER (l_quantity > 10), 6) AS mean_overlap FROM lineitem GROUP BY ALL"


@query("five_step_cascade", _CASCADE_SQL)
def five_step_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {"applies": F.col("l_quantity") > 10, "overlaps": F.col("l_discount") > 0.02, "invasive": F.col("l_tax") < 0.06, "optimal": F.col("l_returnflag") == "N"}
    sums, so_far = [], F.lit(True)
    for name, held in steps.items():
        so_far = so_far & held
        sums.append(F.count_if(so_far).alias(name))
    mean = F.round(F.avg(F.when(steps["applies"], F.col("l_discount"))), 6).alias("mean_overlap")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 10).alias("grp")).agg(F.count("*").alias("rows"), *sums, mean)


@query("agreement_discrimination", """
    SELECT count(*) FILTER (quality = 1) AS commented, count(*) FILTER (quality = 1 AND toxic = 1) AS commented_needed, count(*) FILTER (quality = 0) AS uncommented, count(*) FILTER (quality = 0 AND toxic = 1) AS uncommented_needed,
           round(avg((quality = toxic)::INT), 6) AS agreement, bool_and(toxic = 1) AS always_says_yes,
           round(count(*) FILTER (quality = 1 AND toxic = 1) / greatest(1, count(*) FILTER (quality = 1)) - count(*) FILTER (quality = 0 AND toxic = 1) / greatest(1, count(*) FILTER (quality = 0)), 6) AS discrimination FROM labels
""")
def agreement_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("needed"))
    return agreement(rows).withColumns({c: F.round(c, 6) for c in ("agreement", "discrimination")})


_ORDERS_SQL = "o AS (SELECT o_totalprice AS x, sum(l_extendedprice) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice)"


@query("length_regression", f"WITH {_ORDERS_SQL} SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(corr(x, y), 6) AS correlation, round(stddev_samp(y), 3) AS sd FROM o")
def length_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("y"))
    rows = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_totalprice").alias("x"), "y")
    return rows.agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(correlation("x", "y"), 6).alias("correlation"), F.round(F.coalesce(F.stddev_samp("y"), F.lit(0.0)), 3).alias("sd"))


@query("band_means", f"SELECT band, count(*) AS cases, round(avg(n), 6) AS mean_words FROM (SELECT n, {BAND.format(n='n')} AS band FROM (SELECT len({SQL_WORDS.format(t='text')}) AS n FROM documents)) GROUP BY band")
def band_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.size(T.words(F.col("text"))).alias("n"))
    return rows.groupBy(T.length_band(F.col("n")).alias("band")).agg(F.count("*").alias("cases"), F.round(F.avg("n"), 6).alias("mean_words"))


@query("median_price", "SELECT o_orderpriority, round(median(o_totalprice), 6) AS median_price FROM orders GROUP BY ALL")
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 6).alias("median_price"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("unit"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_partkey").alias("item"))


_SETS_SQL = "sets AS (SELECT l_suppkey % 50 AS unit, l_linenumber % 2 AS side, l_partkey AS item FROM lineitem GROUP BY ALL)"


@query("micro_jaccard", f"WITH {_SETS_SQL}, items AS (SELECT unit, item, count(DISTINCT side) AS sides FROM sets GROUP BY ALL) SELECT unit, round(count(*) FILTER (sides = 2) / count(*), 6) AS overlap FROM items GROUP BY unit")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_jaccard(_sets(spark, sf_dir), "unit", "side", "item").withColumn("overlap", F.round("overlap", 6))


@query("set_difference", f"WITH {_SETS_SQL} SELECT unit, count(*) AS extra FROM (SELECT unit, item FROM sets WHERE side = 0 EXCEPT SELECT unit, item FROM sets WHERE side = 1) GROUP BY unit")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    left, right = (sets.where(F.col("side") == k).select("unit", "item") for k in (0, 1))
    return left.subtract(right).groupBy("unit").agg(F.count("*").alias("extra"))


@query("grouped_ordered_sets", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING count(*) >= 3")
def grouped_ordered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).where(F.size("t") >= 3)
    return rows.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"))


_STATUS_SQL = "status AS (SELECT doc_id, lang AS kind, CASE WHEN l.doc_id IS NULL AND lang <> 'en' THEN 'not_applicable' WHEN l.doc_id IS NULL THEN 'unassessed' WHEN toxic = 0 THEN 'pass' ELSE 'fail' END AS safe, CASE WHEN l.doc_id IS NULL THEN 'unassessed' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS useful FROM documents LEFT JOIN labels l USING (doc_id))"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.col("quality").isNull()
    safe = F.when(missing & (F.col("kind") != "en"), "not_applicable").when(missing, "unassessed").when(F.col("toxic") == 0, "pass").otherwise("fail")
    useful = F.when(missing, "unassessed").when(F.col("quality") == 1, "pass").otherwise("fail")
    return joined.select("doc_id", "kind", safe.alias("safe"), useful.alias("useful"))


@query("review_outcome", f"WITH {_STATUS_SQL} SELECT kind, CASE WHEN 'fail' IN (safe, useful) THEN 'rejected' WHEN 'unassessed' IN (safe, useful) THEN 'incomplete' ELSE 'accepted' END AS outcome, count(*) AS n FROM status GROUP BY ALL")
def review_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when((F.col("safe") == "fail") | (F.col("useful") == "fail"), "rejected").when((F.col("safe") == "unassessed") | (F.col("useful") == "unassessed"), "incomplete").otherwise("accepted")
    return _status(spark, sf_dir).groupBy("kind", outcome.alias("outcome")).agg(F.count("*").alias("n"))


STATUSES = ("fail", "not_applicable", "pass", "unassessed")


@query("status_pivot", f"WITH {_STATUS_SQL}, long AS (SELECT kind, 'safe' AS criterion, safe AS s FROM status UNION ALL SELECT kind, 'useful', useful FROM status) SELECT kind, criterion, {', '.join(f'count(*) FILTER (s = {x!r}) AS {x}' for x in STATUSES)} FROM long GROUP BY kind, criterion")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir).unpivot("kind", ["safe", "useful"], "criterion", "status")
    return rows.groupBy("kind", "criterion").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


@query("answer_validation", """
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'not JSON' WHEN json_type(props) <> 'OBJECT' THEN 'not an object' WHEN len(json_keys(props)) <> 1 THEN 'wrong keys'
        WHEN value IS NULL OR value < 0 THEN 'grade out of range' WHEN value >= 30 THEN 'grade too high' ELSE 'valid' END AS reason FROM events) GROUP BY reason
""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(first_reason(LABEL_CHECKS).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("usage_rollup", "SELECT k AS key, count(*) AS calls, count(DISTINCT v) AS distinct_values FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, unnest(json_keys(props))) AS v FROM events) GROUP BY k")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return entries.groupBy("key").agg(F.count("*").alias("calls"), F.count_distinct("v").alias("distinct_values"))


@query("participation_check", "SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_without_customer, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS customers_without_order")
def participation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lost = orders.join(customers, orders.o_custkey == customers.c_custkey, "left_anti").agg(F.count("*").alias("orders_without_customer"))
    idle = customers.join(orders, orders.o_custkey == customers.c_custkey, "left_anti").agg(F.count("*").alias("customers_without_order"))
    return lost.join(idle)


@query("interval_overlap", """
    WITH spans AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::INT AS b FROM lineitem)
    SELECT x.l_orderkey, count(*) AS overlaps FROM spans x JOIN spans y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.a <= y.b AND y.a <= x.b GROUP BY ALL
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate"))
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day.alias("a"), (day + F.col("l_quantity").cast("int")).alias("b"))
    other = spans.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = spans.join(other, "l_orderkey").where("l_linenumber < n and a <= d and c <= b")
    return met.groupBy("l_orderkey").agg(F.count("*").alias("overlaps"))


@query("frozen_fingerprints", "SELECT (SELECT count(*) FROM (SELECT doc_id, sha256(text) FROM documents EXCEPT ALL SELECT doc_id, sha256(trim(text)) FROM documents)) AS changed, (SELECT count(*) FROM (SELECT doc_id, sha256(trim(text)) FROM documents EXCEPT ALL SELECT doc_id, sha256(text) FROM documents)) AS recomputed")
def frozen_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    frozen, now = docs.select("doc_id", F.sha2("text", 256).alias("s")), docs.select("doc_id", F.sha2(F.trim("text"), 256).alias("s"))
    return frozen.exceptAll(now).agg(F.count("*").alias("changed")).join(now.exceptAll(frozen).agg(F.count("*").alias("recomputed")))
