"""What a model is shown and what comes back into a source, as native expressions: masks, context, prompts, names, comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark in place of a comment, and the head of a further range of lines.
MARK = "// <COMMENT_TO_WRITE>"
RANGE_HEAD = "// Additional source context, lines "


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def indent_of(source: Column, start: Column) -> Column:
    """White space between a comment (0-based start) and its line's begin; null if other text stands there."""
    return F.nullif(F.regexp_extract(F.substring(source, F.lit(1), start), r"(?:^|\n)([^\S\n]*)\z", 1), F.when(~F.substring(source, F.lit(1), start).rlike(r"(?:^|\n)[^\S\n]*\z"), F.lit("")))


def masked(source: Column, start: Column, end: Column, mark: str = MARK) -> Column:
    """The source with a mark in place of a span; what stands before it, the indent too, stays."""
    return F.concat(F.substring(source, F.lit(1), start), F.lit(mark), F.substring(source, end + 1, F.length(source)))


def window(text: Column, line: Column, before: int | Column = 15, after: int | Column = 45) -> Column:
    """The lines around a line (from 1), as many as there are."""
    rows = lines_of(text)
    first = F.greatest(F.lit(0), line - 1 - before)
    return F.array_join(F.slice(rows, first + 1, F.greatest(F.lit(0), F.least(F.size(rows), line + after) - first)), "\n")


def range_reason(ranges: Column, lines: Column, line: Column, end_line: Column) -> Column:
    """Why further ranges [begin, end] do not count: outside the source, or over the comment they are context of; null if they do."""
    outside = F.exists(ranges, lambda r: (r[0] < 1) | (r[1] < r[0]) | (r[1] > lines))
    over = F.exists(ranges, lambda r: (r[0] <= end_line) & (r[1] >= line))
    return F.when(outside, "range outside the source").when(over, "range over the target")


def with_ranges(context: Column, source: Column, ranges: Column) -> Column:
    """A context and the further ranges of lines under their heads."""
    rows = lines_of(source)
    more = F.transform(ranges, lambda r: F.concat(F.lit(f"\n\n{RANGE_HEAD}"), r[0].cast("string"), F.lit("-"), r[1].cast("string"), F.lit(":\n"), F.array_join(F.slice(rows, r[0], r[1] - r[0] + 1), "\n")))
    return F.concat(context, F.array_join(more, ""))


def rendered(text: Column, original: Column, indent: Column) -> Column:
    """Prose as a comment in the manner of another; null where rendered_reason() has a reason."""
    rows = F.split(F.regexp_replace(text, r"\A\s+|\s+\z", ""), r"\r?\n")
    mark = F.when(F.startswith(original, F.lit("///")), "///").otherwise("//")
    slashes = F.array_join(F.transform(rows, lambda x: F.when(x == "", mark).otherwise(F.concat(mark, F.lit(" "), x))), "\x00")
    stars = F.concat(F.lit("/* "), F.array_join(F.transform(rows, lambda x: F.concat(F.lit(""), x)), "\x01"), F.lit(" */"))
    joined = F.when(F.startswith(original, F.lit("//")), F.replace(slashes, F.lit("\x00"), F.concat(F.lit("\n"), indent))).otherwise(F.replace(stars, F.lit("\x01"), F.concat(F.lit("\n"), indent, F.lit(" * "))))
    return F.when(rendered_reason(text).isNull(), joined)


def rendered_reason(text: Column) -> Column:
    """Why prose cannot become a comment: blank, able to end or continue it, or already dressed as one; null if it can."""
    bare = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return (
        F.when(text.isNull() | (bare == ""), "empty")
        .when(F.contains(text, F.lit("*/")) | F.contains(text, F.lit("\\\n")) | F.endswith(bare, F.lit("\\")), "delimiter or splice")
        .when(F.startswith(bare, F.lit("//")) | F.startswith(bare, F.lit("/*")) | F.startswith(bare, F.lit("```")), "delimiters or fences")
    )


def prompt(parts: dict[str, Column]) -> Column:
    """Named parts under their heads, in order; null parts are left out."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"## {name}\n"), value) for name, value in parts.items()])


def file_stem(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def case_id(prefix: str, path: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), file_stem(path), F.lit("-"), line.cast("string"))


def commit_id(sha: Column) -> Column:
    return F.concat(F.lit("commit-"), F.substring(sha, 1, 12))


def line_link(base: str, commit: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{base}/blob/"), commit, F.lit("/"), path, F.lit("#L"), line.cast("string"))


def label_pair(text: Column) -> Column:
    """(label, value) of LABEL=VALUE; both null without a label, an equals sign or a value."""
    fine = text.rlike(r"(?s)^[^=]+=.+")
    return F.struct(F.when(fine, F.substring_index(text, "=", 1)).alias("label"), F.when(fine, F.regexp_replace(text, r"(?s)^[^=]*=", "")).alias("value"))


def set_text(entries: Column) -> Column:
    """The texts of a set (line, comment), in order, as one."""
    return F.array_join(F.transform(entries, lambda e: e["comment"]), "\n\n")


def in_split(split: Column, wanted: str | None) -> Column:
    """Rows of a split; no split asked for is all of them."""
    return F.lit(True) if wanted is None else split == wanted
