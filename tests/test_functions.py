from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annolens.functions import lex, patch
from annolens.functions import text as T
from annolens.operators import ladder, sampling, stats, summary
from annolens.operators.distance import js_divergence
from annolens.operators.validate import decision_checks, exact_keys, first_reason, grade_checks


def test_measures_of_small_texts(spark):
    rows = spark.createDataFrame([("One two. Three; four (five)!\n\nSix-pack don't",), ("",), ("   ",)], "text string")
    staged = rows.withColumns({"w": T.words(F.col("text")), "s": T.sentence_lengths(F.col("text")), "p": F.size(T.paragraphs(F.col("text")))})
    got = [r.asDict() for r in staged.select(*T.measures(F.col("w"), F.col("text"), F.col("s"), F.col("p"))).collect()]
    assert got[0]["word_count"] == 7 and got[0]["sentence_count"] == 3 and got[0]["paragraph_count"] == 2
    assert got[0]["hyphenated_words"] == 1 and got[0]["semicolons"] == 1 and got[0]["parentheses"] == 1 and got[0]["max_sentence_words"] == 3
    assert all(v == 0 for r in got[1:] for v in r.values())


def test_bands_and_classes(spark):
    rows = spark.createDataFrame([(19, "for instance"), (20, "because"), (50, "TODO x"), (300, "plain"), (301, "")], "n int, t string")
    got = rows.select(T.length_band(F.col("n")).alias("b"), T.functional_class(F.col("t")).alias("c"), T.eligible(F.col("t")).alias("e")).collect()
    assert [r.b for r in got] == ["below", "short", "medium", "long", "above"]
    assert [r.c for r in got] == ["example", "rationale", "mechanism", "mechanism", "mechanism"]
    assert [r.e for r in got] == [True, True, False, True, False]
    with pytest.raises(Exception, match="no length band"):
        rows.select(T.length_band(F.col("n"), strict=True)).collect()


def test_js_divergence_bounds(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "b"), (3, "", "b"), (4, "", "")], "k int, c string, r string")
    got = {r.k: r.js for r in js_divergence(pairs, "k", "c", "r").collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(1) and got[3] == pytest.approx(0.5) and got[4] == 0


@pytest.mark.parametrize(("source", "why"), [("/* a", "block"), ('"a', "string"), ('R"x(a', "raw"), ("a ??/ b", "trigraphs"), ("// a\\\nb", "splices")])
def test_scanner_refuses(source, why):
    with pytest.raises(lex.ScanError, match=why):
        lex.scan(source)


def test_scanner_reads_literals_and_groups():
    comments, tokens = lex.scan('x = "// no"; // a\n// b\n// c\n\n// d\n/* e */ R"q(/* no */)q" a<<=b')
    assert [c.text for c in comments] == ["a", "b\nc", "d", "e"]
    assert tokens == ["x", "=", '"// no"', ";", 'R"q(/* no */)q"', "a", "<<=", "b"]
    assert lex.code_changed("a /* x */ b", "a /* y */ b") is None
    assert lex.code_changed("#define a /* x */ b\n", "#define a b\n") == "preprocessor text or spacing changed"
    assert lex.spliced("int a; // x\nint b;\n", 7, 11, "// new") == "int a; // new\nint b;\n"
    for bad in ("int c;", "// new\nint c;", "/* open"):
        with pytest.raises(lex.ScanError):
            lex.spliced("int a; // x\nint b;\n", 7, 11, bad)
    assert lex.following_code("// a\nint x;\n\n/* b */ int y;\n", 4, 1) == "int x;"


def test_edits_and_shapes():
    sources = {"a.cpp": "a\nb\nc\n"}
    shape = lambda old, new: patch.shape(sources, patch.edited(sources, [{"path": "a.cpp", "old_text": old, "new_text": new}]))
    assert shape("b\n", "x\n")["touched"] == shape("a\nb\nc", "a\nx\nc")["touched"] == {"a.cpp": [2]}
    assert shape("a\n", "new\na\n")["touched"] == {"a.cpp": [1]}
    assert patch.overlap({}, {}) == 0
    with pytest.raises(patch.PatchError):
        patch.edited(sources, [{"path": "a.cpp", "old_text": "a", "new_text": "z"}, {"path": "a.cpp", "old_text": "z", "new_text": "a"}])


def test_patch_content_that_looks_like_headers():
    (part,) = patch.sections("diff --git a/x.h b/x.h\n--- a/x.h\n+++ b/x.h\n@@ -1,2 +1,2 @@\n--- old\n+++ new\n same\n")
    assert part["removed"] == ["-- old"] and part["added"] == ["++ new"] and part["touched"] == [1]


def test_patches_made_and_applied():
    before, after = "a\nb\nc\n", "a\nx\nc\nd\n"
    diff = patch.unified(before, after, "a.cpp")
    assert patch.applied_patch(diff, {"a.cpp": before}) == patch.shape({"a.cpp": before}, {"a.cpp": after})
    with pytest.raises(patch.PatchError):
        patch.applied_patch(diff, {"a.cpp": "other\n"})


def test_tasks(spark):
    got = summary.tasks(spark.createDataFrame([("a",), ("b",)], "id string"), repeats=2).collect()
    assert len(got) == 8 and len({r.place for r in got}) == 8


def test_capped_prefix_equals_a_walk(spark):
    random.seed(1)
    rows = [(k, random.choice("ab"), random.choice("pqr"), f"{random.random():.9f}") for k in range(300)]
    got = {r.k for r in sampling.capped_prefix(spark.createDataFrame(rows, "k int, s string, p string, o string"), "s", "p", "o", 4, 9).collect()}
    want = set()
    for s in "ab":
        seen, taken = {}, 0
        for k, _, p, _ in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            if taken < 9 and seen.get(p, 0) < 4:
                seen[p], taken = seen.get(p, 0) + 1, taken + 1
                want.add(k)
    assert got == want


def test_type_targets():
    assert sampling.type_targets(10, {"example": 1, "rationale": 9, "mechanism": 9}) == {"example": 1, "rationale": 4, "mechanism": 5} or sum(sampling.type_targets(10, {"example": 1, "rationale": 9, "mechanism": 9}).values()) == 10
    with pytest.raises(ValueError):
        sampling.type_targets(3, {"example": 1})


def test_ladder(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("d", True, None)], "id string, x boolean, y boolean")
    got = ladder.standing(rows, ["x", "y"]).orderBy("rung").collect()
    assert [(r.judged, r.passed) for r in got] == [(4, 3), (2, 1)]
    assert {r.id: r.f for r in rows.select("id", ladder.first_failure(["x", "y"]).alias("f")).collect()} == {"a": "none", "b": "y", "c": "x", "d": "none"}
    assert ladder.order_violations(rows, ["x", "y"], "id").first().ids == ["c"]
    assert ladder.standing(rows.limit(0), ["x"]).first().rate_of_all is None


def test_statistics(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(stats.correlation("x", "y")).first()[0] is None
    yes = spark.createDataFrame([(True, True), (False, True)], "expected boolean, needed boolean")
    got = stats.agreement(yes).first()
    assert got.discrimination == 0 and got.agreement == 0.5 and got.always_says_yes


def test_validation(spark):
    good = '{"C1": {"style": 0, "words": 1, "structure": 2, "simplicity": 3, "meaning": 4, "usefulness": 0}}'
    rows = spark.createDataFrame([(good,), (good.replace("4", "5"),), (good.replace("4", "true"),), ('{"C2": {}}',), ("nope",), (None,)], "a string")
    got = [r[0] for r in rows.select(first_reason(grade_checks("a", ["C1"]))).collect()]
    assert got[0] == "valid" and got[1] == got[2] == "a grade is not a whole number from 0 to 4"
    assert got[3] == "labels differ from those asked for" and got[4] == got[5] == "answer is not JSON"
    said = spark.createDataFrame([(True, ""), (False, "x"), (True, "x"), (None, "x")], "n boolean, c string")
    assert [r[0] for r in said.select(first_reason(decision_checks("n", "c"))).collect()] == ["asked for a comment and wrote none", "declined the position and wrote a comment", "valid", "wrong types"]
    assert rows.limit(1).select(exact_keys(F.col("a"), ["C1"])).first()[0]


def test_summary(spark):
    rows = [(i, 0, j, arm, d, g) for i in ("a", "b", "c") for j in (0, 1) for arm, g in (("without_spec", 2), ("with_spec", 1), ("upstream", 0)) for d in summary.DIMENSIONS]
    grades = spark.createDataFrame(rows, "id string, repeat int, judge int, arm string, dimension string, grade int")
    got = {(r.metric, r.arm, r.dimension): r.value for r in summary.summarize(grades).collect()}
    assert got["mean_grade", "with_spec", "words"] == 1 and got["mean_delta", None, "words"] == -1 and got["wins", None, "words"] == 3 and got["exact_agreement", None, "words"] == 1
    assert summary.passes_screen(grades).first().passes
    low = summary.seeded_intervals(summary.deltas(summary.unit_means(grades)), samples=50).where("dimension = 'words'").first()
    assert low.low == low.high == low.mean == -1
    assert next(iter(summary.markdown(grades.limit(1)))).startswith("| id |")


def test_seeded_interval_is_pythons(spark):
    values = [0.0, 1.0, -1.0, 2.0, 0.5]
    delta = spark.createDataFrame([(f"{k}", 0, "style", v) for k, v in enumerate(values)], "id string, repeat int, dimension string, delta double")
    draw = random.Random(summary.SEED)
    want = sorted(sum(draw.choice(values) for _ in values) / 5 for _ in range(200))
    got = summary.seeded_intervals(delta, samples=200).first()
    assert (got.low, got.high) == (want[5], want[195])
