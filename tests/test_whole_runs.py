"""Fingerprints, the store, stages and published versions on rows whose answers are known."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annolens.functions import fingerprints as fp
from annolens.operators import stages, study_run, summary
from annolens.sources import published, store, study


def bytes_below(folder) -> dict[str, str]:
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*") if p.is_file()}


def test_canonical_json_is_sorted_and_spaced(spark):
    values = [{"b": [1, 2.5, {"y": "é, \"q\": \\", "x": None}], "a": {}, "": True}, [], "a: b, c", 12345678901234567890123, {"long": "x, y: " * 4000}]
    forms = [study.json.dumps(v, ensure_ascii=False) for v in values] + [study.json.dumps(v, indent=3) for v in values]
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(forms)], "k int, j string")
    got = {r.k: r.d for r in rows.select("k", fp.json_digest(F.col("j")).alias("d")).collect()}
    assert [got[k] for k in range(len(forms))] == [study.digest(v) if not isinstance(v, str) else hashlib.sha256(study.json.dumps(v).encode()).hexdigest() for v in values] * 2
    odd = spark.createDataFrame([("{",), (None,), ("",), ('{"a": 1, "a": 2}',)], "j string")
    assert [r[0] for r in odd.select(fp.canonical_json(F.col("j"))).collect()] == [None] * 4


def test_table_fingerprints(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("text"), F.lit("x").alias("other"))
    root = lambda df: fp.fingerprint(df, "id", ["id", "text"]).first()
    one = root(rows)
    assert one.rows == 500 and one == root(rows.repartition(7).orderBy(F.rand(1))) and one == root(rows.drop("other"))
    changed = rows.withColumn("text", F.when(F.col("id") == 77, "").otherwise(F.col("text")))
    more = rows.unionByName(rows.where("id = 78"))
    empty_for_null = rows.withColumn("text", F.coalesce("text", F.lit("")))
    assert len({root(x).digest for x in (rows, changed, more, empty_for_null, rows.limit(0))}) == 5 and root(rows.limit(0)).rows == 0
    trees = [fp.fingerprint_tree(x, "id", ["id", "text"]) for x in (rows, changed, more)]
    node = int(hashlib.sha256(b"77").hexdigest()[:8], 16) >> 20
    assert [r.node for r in fp.differing_ranges(trees[0], trees[1]).collect()] == [node]
    assert [(r.rows_a, r.rows_b) for r in fp.differing_ranges(trees[0], trees[2]).collect()] in ([(1, 2)], [(2, 3)])


def test_a_store_copies_what_is_missing_once(spark, tmp_path):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"one")], "path string, content binary")
    lock = files.select("path", F.sha2("content", 256).alias("sha256"))
    at = str(tmp_path / "store")
    states = lambda f, k=lock: {r.path: r.state for r in store.fetch_or_reuse(k, f, at).collect()}
    assert states(files.where("path <> 'b'")) == {"a": store.COPIED, "b": store.MISSING, "c": store.COPIED} and not (tmp_path / "store").exists()
    assert states(files) == dict.fromkeys("abc", store.COPIED)
    assert store.stored(spark, at).count() == 2
    before = bytes_below(at)
    assert states(files) == dict.fromkeys("abc", store.REUSED)
    # What the store holds need not be there any more; a byte that changed, a file too many and one that is nowhere are named, and nothing is written.
    assert states(files.where("path = 'a'")) == dict.fromkeys("abc", store.REUSED)
    changed = files.where("path <> 'b'").unionByName(spark.createDataFrame([("b", bytearray(b"twO")), ("d", bytearray(b"new"))], files.schema))
    assert states(changed) == {"a": store.REUSED, "b": store.CHANGED, "c": store.REUSED, "d": store.SURPLUS}
    wider = lock.unionByName(spark.createDataFrame([("e", "0" * 64)], lock.schema))
    assert states(files, wider)["e"] == store.MISSING and bytes_below(at) == before
    assert {(r.path, bytes(r.content)) for r in store.locked_sources(lock, at).collect()} == {("a", b"one"), ("b", b"two"), ("c", b"one")}


def test_what_changed_since_a_run_began(spark):
    was = spark.createDataFrame([("cases", "1"), ("lock", "2"), ("ids", "3")], "name string, digest string")
    now = spark.createDataFrame([("cases", "1"), ("lock", "x")], "name string, digest string")
    assert {r.name for r in store.stale(was, now).collect()} == {"lock", "ids"} and store.stale(was, was).count() == 0


def study_tables(spark, wrong=3):
    cases = spark.range(6).select("id")
    answers = cases.crossJoin(spark.createDataFrame([("with_spec",), ("without_spec",)], "arm string")).select("id", F.lit(0).alias("repeat"), "arm", F.when((F.col("id") == wrong) & (F.col("arm") == "with_spec"), "").otherwise("text").alias("answer"))
    grades = spark.createDataFrame([(i, 0, 0, a, d, (i + k + len(a)) % 4) for i in range(6) for k, d in enumerate(summary.DIMENSIONS) for a in summary.ARMS], "id long, repeat int, judge int, arm string, dimension string, grade int")
    return {"cases": (cases, "id"), "answers": (answers.where("not (id = 5 and arm = 'with_spec')"), "id"), "grades": (grades, "id")}


def test_a_run_that_was_killed_gives_the_same_summary(spark, tmp_path):
    plan = study_run.study_stages(F.when(F.col("answer") == "", "empty"))
    value = lambda tables: sorted(map(str, tables["summary"].collect()))
    whole = stages.Run(spark, str(tmp_path / "whole"), study_tables(spark))
    want = value(whole.go(plan))
    assert whole.ran == [s.name for s in plan]
    counts = {r.metric: r.value for r in whole.go(plan)["summary"].where("metric like '%pairs'").collect()}
    assert counts == {"requested_pairs": 6, "excluded_pairs": 2, "judged_pairs": 4} and whole.ran == [s.name for s in plan]

    def dies(*_):
        raise RuntimeError("killed here")

    for k in range(len(plan)):
        root = str(tmp_path / f"killed-{k}")
        first = stages.Run(spark, root, study_tables(spark))
        with pytest.raises(RuntimeError):
            first.go([*plan[:k], stages.Stage(plan[k].name, plan[k].needs, dies, plan[k].version), *plan[k + 1 :]])
        again = stages.Run(spark, root, study_tables(spark))
        assert value(again.go(plan)) == want and again.ran == [s.name for s in plan[k:]]
        ended = {r.stage: (r.completed, r.failed, r.broken_off) for r in stages.attempts(again.states()).collect()}
        assert ended == {s.name: (1, int(n == k), 0) for n, s in enumerate(plan)}
        assert {r.reason for r in again.states().where("status = 'failed'").collect()} == {"killed here"}


def test_a_stage_runs_again_if_its_inputs_differ(spark, tmp_path):
    plan = study_run.study_stages(F.when(F.col("answer") == "", "empty"))
    stages.Run(spark, str(tmp_path), study_tables(spark)).go(plan)
    tables = study_tables(spark)
    tables["grades"] = (tables["grades"][0].withColumn("grade", F.lit(1)), "id")
    other = stages.Run(spark, str(tmp_path), tables)
    other.go(plan)
    assert other.ran == ["judged", "summary"]
    # A killed attempt: its row says running, its table may be there, and nothing reads it.
    other._note("judged", "x", "nowhere", "running")
    assert {r.stage: r.broken_off for r in stages.attempts(other.states()).collect()}["judged"] == 1
    with pytest.raises(ValueError):
        other.go([plan[0], plan[0]])


def test_an_excluded_pair_tells_each_arms_reason(spark):
    rows = spark.createDataFrame([(1, 0, "a", "late", 2), (1, 0, "a", "early", 1), (1, 0, "b", "other", 3), (2, 1, "b", "x", 4)], "id int, repeat int, arm string, reason string, at int")
    assert {(r.id, r.repeat): r.arms for r in study_run.exclusions(rows, "at").collect()} == {(1, 0): {"a": "early", "b": "other"}, (2, 1): {"b": "x"}}


def test_lists_are_in_order_and_bounded(spark):
    rows = spark.createDataFrame([("m", k, 9 - k) for k in range(9)] + [("n", 1, -1)], "dimension string, id int, delta int")
    got = {r.dimension: (r.n, r.ids) for r in study_run.first_ids(rows, "dimension", F.col("delta") > 2, ["id"], shown=3).collect()}
    assert got == {"m": (7, [0, 1, 2]), "n": (0, [])}


def test_published_versions_stay_as_they_are(spark, tmp_path):
    folder = str(tmp_path / "out")
    published.publish(spark.createDataFrame([("a", 1), ("b", 2)], "path string, passed int"), folder, 1)
    first = bytes_below(f"{folder}/version=1")
    published.publish(spark.createDataFrame([("a", 3, "why")], "path string, passed int, note string"), folder, 2)
    with pytest.raises(PySparkException):
        published.publish(spark.createDataFrame([("a", 9)], "path string, passed int"), folder, 1)
    rows = published.superseded(published.versions(spark, folder), ["path"])
    assert {(r.version, r.path, r.passed, r.note, r.superseded) for r in rows.collect()} == {(1, "a", 1, None, True), (1, "b", 2, None, False), (2, "a", 3, "why", False)}
    assert bytes_below(f"{folder}/version=1") == first and published.published_version(spark, folder, 1).columns == ["path", "passed"]
    with pytest.raises(ValueError):
        published.published_version(spark, folder, 3)


def test_a_summary_has_all_its_parts(spark):
    grades = study_tables(spark)["grades"][0]
    style = spark.createDataFrame([(1, 0, "with_spec", "words", 3.0), (2, 0, "with_spec", "words", 5.0)], "id int, repeat int, arm string, measure string, value double")
    limits = summary.seeded_intervals(summary.deltas(summary.unit_means(grades)), samples=50)
    got = {(r.metric, r.arm, r.dimension): r.value for r in study_run.whole_summary(grades, style, style, limits).collect()}
    assert got["style", "with_spec", "words"] == got["distance_to_reference", "with_spec", "words"] == 4
    assert all(got["ci_low", None, d] <= got["mean_delta", None, d] <= got["ci_high", None, d] for d in summary.DIMENSIONS)
