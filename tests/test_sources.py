from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException

from annolens.operators.validate import decision_checks
from annolens.sources import study
from annolens.streaming.answers import ingest_answers


def test_sources_under_a_lock(spark, tmp_path):
    (tmp_path / "a.cpp").write_text("int é;\n")
    (tmp_path / "b.cpp").write_text("int b;\n")
    files = study.source_files(spark, f"{tmp_path}/*.cpp", str(tmp_path))
    lock = spark.createDataFrame([("a.cpp", study.digest("int é;\n")), ("b.cpp", "0"), ("c.cpp", "0")], "path string, sha256 string")
    assert {(r.path, r.problem) for r in study.lock_violations(files, lock).collect()} == {("b.cpp", "content differs"), ("c.cpp", "missing")}


def test_write_once_and_usage(spark, tmp_path):
    calls = [{"case_id": "a", "arm": "x", "status": "completed", "usage": [{"in": 3}, {"in": 4, "out": 1}], "prompt_sha256": "p"}, {"case_id": "b", "arm": "x", "status": "failed", "usage": [{"in": 9}], "prompt_sha256": "p"}]
    (tmp_path / "calls.json").write_text(json.dumps(calls))
    table = study.json_table(spark, f"{tmp_path}/calls.json", study.CALL)
    assert {(r.key, r.total) for r in study.usage(table).collect()} == {("in", 7), ("out", 1)}
    tasks = spark.createDataFrame([("a", "x", "p"), ("b", "x", "p"), ("a", "x", "q")], "case_id string, arm string, prompt_sha256 string")
    assert study.to_do(tasks, table).count() == 2
    study.write_once(table, f"{tmp_path}/out")
    with pytest.raises(AnalysisException):
        study.write_once(table, f"{tmp_path}/out")


def test_paths_and_digests(spark):
    rows = spark.createDataFrame([("a/b", '{"b": 1, "a": 2}'), ("../a", '{"a":2,"b":1}'), ("/a", None), ("a/../b", "1")], "p string, j string")
    assert [r[0] for r in rows.select(study.inside(rows.p)).collect()] == [True, False, False, False]
    got = {r.p: r.sha256 for r in study.object_digests(rows, "p", "j").collect()}
    assert got["a/b"] == got["../a"] == study.digest({"a": 2, "b": 1}) and got["/a"] is None


def test_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)))
    go = lambda: ingest_answers(spark, str(source), "id string, needed boolean, comment string", decision_checks("needed", "comment"), str(tmp_path / "out"), str(tmp_path / "cp"))
    put("1.json", [{"id": "a", "needed": True, "comment": "x"}, {"id": "b", "needed": True, "comment": ""}])
    go()
    put("2.json", [{"id": "c", "needed": False, "comment": ""}])
    go()
    go()
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out/valid").collect()} == {"a", "c"}
    assert [(r.id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == [("b", "asked for a comment and wrote none")]
