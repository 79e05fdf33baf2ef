"""Queries over sources and changes. The test tables hold none, so these read small fixtures and answer to labelled rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import text as T
from annolens.operators import code as C
from annolens.plans.registry import query
from annolens.plans.text_queries import SQL_WORDS
from annolens.session import table

SOURCE = """#include <x>
// First line
// second line
int a = 1; // trailing
// after trailing
const char *s = R"x(// not a comment)x";
/* block
 * text */
char c = '"'; // quote
"""


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.cpp", SOURCE), ("bad.cpp", "int a; /* never closed"), ("splice.cpp", "// a \\\nb"), ("empty.cpp", None)], "path string, source string")


def _filled(df: DataFrame) -> DataFrame:
    """Refused rows with 0 and false in place of null numbers and flags."""
    return df.fillna(0).fillna(False)


@query("comment_scan", """
    SELECT * FROM (VALUES ('a.cpp', 2, 3, 'First line' || chr(10) || 'second line', NULL), ('a.cpp', 4, 4, 'trailing', NULL), ('a.cpp', 5, 5, 'after trailing', NULL), ('a.cpp', 7, 8, 'block' || chr(10) || 'text', NULL),
        ('a.cpp', 9, 9, 'quote', NULL), ('bad.cpp', 0, 0, NULL, 'unterminated block comment'), ('splice.cpp', 0, 0, NULL, 'line splices and trigraphs are not supported')) t(path, line, end_line, comment, error)
""")  # fmt: skip
def comment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(C.comments(_sources(spark)).select("path", "line", "end_line", "comment", "error"))


@query("token_counts", "SELECT * FROM (VALUES ('a.cpp', 22), ('empty.cpp', 0)) t(path, tokens) WHERE tokens > 0")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(_sources(spark)).where("error is null").groupBy("path").agg(F.count("*").alias("tokens"))


BASE = "int f() {\n  // old words\n  return 1;\n}\n"
DIFF = "--- a/f.cpp\n+++ b/f.cpp\n@@ -1,3 +1,4 @@\n int f() {\n-  // old words\n+  // new words\n+  // and more\n   return 1;\n"
CODE_DIFF = DIFF.replace("   return 1;", "-  return 1;\n+  return 2;").replace("+1,4", "+1,4")


@query("changed_comments", "SELECT * FROM (VALUES ('good', 'f.cpp', 2, 3, 'new words' || chr(10) || 'and more', 1, NULL), ('code', NULL, 0, 0, NULL, 0, 'executable tokens changed in f.cpp'), ('lost', NULL, 0, 0, NULL, 0, 'no text for f.cpp')) t(id, path, line, end_line, comment, old_touched, error)")
def changed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("good", DIFF, json.dumps({"f.cpp": BASE})), ("code", CODE_DIFF, json.dumps({"f.cpp": BASE})), ("lost", DIFF, "{}")]
    found = C.changed_comments(spark.createDataFrame(rows, "id string, diff string, base string"))
    return _filled(found.select("id", "path", "line", "end_line", "comment", "old_touched", "error"))


PATCH = """From 1 Mon Sep 17 00:00:00 2001
Subject: [PATCH] Fix the frobnicator so that
 it counts the lines again

Body of the message.
Reviewed By: someone

---
diff --git a/llvm/lib/F.cpp b/llvm/lib/F.cpp
--- a/llvm/lib/F.cpp
+++ b/llvm/lib/F.cpp
@@ -1,3 +1,5 @@
 one
-two
+TWO
+two_b
 three
+four
diff --git a/llvm/lib/G.cpp b/llvm/lib/G.cpp
new file mode 100644
--- /dev/null
+++ b/llvm/lib/G.cpp
@@ -0,0 +1 @@
+new
"""


@query("patch_sections", "SELECT * FROM (VALUES ('s1', 'llvm/lib/F.cpp', '2,3', 3, 1, false)) t(sha, path, touched, added, removed, mode_change)")
def patch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.patch_sections(spark.createDataFrame([("s1", PATCH)], "sha string, patch string"))
    return found.select("sha", "path", F.array_join(F.col("touched").cast("array<string>"), ",").alias("touched"), F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"), "mode_change")


@query("patch_messages", "SELECT * FROM (VALUES ('s1', 'Fix the frobnicator so that it counts the lines again', 'Body of the message.', NULL), ('s2', 'Revert the change that broke the nightly build today', '', 'revert or recommit')) t(sha, subject, body, rejection)")
def patch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("s1", PATCH), ("s2", "Subject: Revert the change that broke the nightly build today\n\n---\n")]
    return C.patch_messages(spark.createDataFrame(rows, "sha string, patch string")).select("sha", "subject", "body", "rejection")


TEXT = {"a.cpp": "int one;\nint two;\nint three;\n", "a.h": "int one;\n"}


@query("scored_edits", """
    SELECT * FROM (VALUES ('same', 1, 'a.cpp', '', 1.0::DOUBLE, true, true, NULL), ('wide', 2, 'a.cpp', 'new_name', 0.5::DOUBLE, false, true, NULL), ('header', 1, 'a.h', '', 0.0::DOUBLE, false, false, NULL),
        ('twice', 0, NULL, NULL, 0.0, false, false, 'old text does not occur exactly once in a.cpp'), ('none', 0, NULL, NULL, 0.0, false, false, 'no edits')) t(id, changed_lines, files, new_symbols, overlap, invasive, optimal, error)
""")  # fmt: skip
def scored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = lambda path, old, new: {"path": path, "old_text": old, "new_text": new}
    answers = {
        "same": [edit("a.cpp", "int two;", "int zwei;")],
        "wide": [edit("a.cpp", "two;\nint three", "x;\nint new_name")],
        "header": [edit("a.h", "one", "uno")],
        "twice": [edit("a.cpp", "int", "long")],
        "none": [],
    }
    after = json.dumps({"a.cpp": TEXT["a.cpp"].replace("two", "deux")})
    rows = [(k, json.dumps(TEXT), json.dumps(v), after) for k, v in answers.items()]
    got = C.scored_edits(spark.createDataFrame(rows, "id string, sources string, edits string, reference string"))
    joined = {c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("files", "new_symbols")}
    return _filled(got.withColumns(joined).select("id", "changed_lines", "files", "new_symbols", "overlap", "invasive", "optimal", "error"))


ANCHORED = "\n".join(["// head"] + ["int x;"] * 19 + ["void f() {", "  int a;", "", "  int b;", "  // near", "  int c;", "", "  int d;", "}", "", "}"]) + "\n"


@query("anchor_lines", "SELECT * FROM (VALUES ('a.cpp', 24)) t(path, line)")
def anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.anchor_lines(spark.createDataFrame([("a.cpp", ANCHORED), ("short.cpp", "int a;\n")], "path string, source string")).select("path", "line")


@query("masked_context", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS context, '<HERE>' || substr(text, 6) AS masked FROM documents")
def masked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.context_slice(t, 2, 1, 1).alias("context"), T.masked(t, F.lit(0), F.lit(5), "<HERE>").alias("masked"))


@query("coupling", "SELECT * FROM (VALUES ('a', 3, 1, 0.25::DOUBLE, 1, 'farAway'), ('b', 0, 0, 0.0::DOUBLE, 0, '')) t(id, code_identifiers, restated, restatement_fraction, foreign_count, foreign_names)")
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "localName near_name calls farAway", "int near_name; // farAway", "int localName; int near_name; // farAway"), ("b", "plain words", "int x;", "int x;")]
    got = C.coupling(spark.createDataFrame(rows, "id string, comment string, context string, source string"))
    return got.select("id", "code_identifiers", "restated", "restatement_fraction", F.col("foreign").alias("foreign_count"), F.array_join("foreign_names", ",").alias("foreign_names"))


@query("line_islands", f"""
    WITH lines AS (SELECT source, doc_id FROM documents WHERE len({SQL_WORDS.format(t="text")}) > 150),
         marked AS (SELECT *, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS g FROM lines)
    SELECT source AS path, min(doc_id) AS first, max(doc_id) AS last, count(*) AS lines FROM marked GROUP BY source, g
""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.size(T.words(F.col("text"))) > 150).select(F.col("source").alias("path"), F.col("doc_id").alias("line"))
    return C.comment_islands(rows)


@query("blind_labels", "SELECT * FROM (VALUES ('a', 'with_spec,upstream,without_spec'), ('b', 'with_spec,without_spec,upstream')) t(id, arms)")
def blind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", 1), ("b", 42)], "id string, seed long")
    got = C.blind_labels(rows, ["without_spec", "with_spec", "upstream"])
    return got.select("id", F.array_join(F.array(*[F.col("labels")[f"C{k}"] for k in (1, 2, 3)]), ",").alias("arms"))
