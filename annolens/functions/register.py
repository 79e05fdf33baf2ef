"""The lexer and the patch reader as table functions of SQL: SELECT * FROM scanned_comments(source), and so on."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from annolens.functions import lex, patch


@udtf(returnType="line int, end_line int, raw string, comment string, error string")
class ScannedComments:
    """One row a comment; a source that is refused gives one row with the reason."""

    def eval(self, source: str | None) -> Iterator[tuple]:
        try:
            for c in lex.scan(source or "")[0]:
                yield c.line, c.end_line, c.raw, c.text, None
        except lex.ScanError as e:
            yield None, None, None, None, str(e)


@udtf(returnType="path string, touched array<int>, added int, removed int, error string")
class PatchFiles:
    """One row a file of a patch."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        try:
            for s in patch.sections(text or ""):
                yield s["path"], s["touched"], len(s["added"]), len(s["removed"]), None
        except patch.PatchError as e:
            yield None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """Make scanned_comments(source) and patch_files(patch) known to a session's SQL."""
    spark.udtf.register("scanned_comments", ScannedComments)
    spark.udtf.register("patch_files", PatchFiles)
