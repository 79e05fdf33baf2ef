"""Validation that keeps rejected rows: ordered checks give each row its first reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.functions.text import normalise

Check = tuple[str, Column | str]


def first_reason(checks: list[Check], otherwise: str | None = "valid") -> Column:
    """The name of the first check that holds; checks come in order of precedence."""
    found = None
    for reason, test in checks:
        test = F.expr(test) if isinstance(test, str) else test
        found = F.when(test, reason) if found is None else found.when(test, reason)
    return found.otherwise(otherwise) if otherwise is not None else found


def split_valid(rows: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason)."""
    marked = rows.withColumn("reason", first_reason(checks, None))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


#: Checks of the answers in the events table.
LABEL_CHECKS: list[Check] = [
    ("not JSON", "props is null or try_parse_json(props) is null"),
    ("not an object", "schema_of_variant(try_parse_json(props)) not like 'OBJECT%'"),
    ("wrong keys", "size(json_object_keys(props)) <> 1"),
    ("grade out of range", "value is null or value < 0"),
    ("grade too high", "value >= 30"),
]


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it. False for null.

    A parser that stops after the first value would overlook the rest, so the text is parsed as the only element of a list and as the only field of an object: what could close or go on
    in the one breaks the other.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = listed.isNotNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def exact_keys(answer: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(answer)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def quoted_in(quotes: Column, text: Column) -> Column:
    """Whether every quote occurs in a text, white space apart; blank quotes do not count as found."""
    return F.forall(quotes, lambda q: (F.length(normalise(q)) > 0) & F.contains(normalise(text), normalise(q)))


#: Dimensions of a grade. Studies name the first, the overall deficit of style, after their own rubric: pass their names where they differ.
DIMENSIONS = ("style", "words", "structure", "simplicity", "meaning", "usefulness")


def grade_checks(answer: str, labels: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> list[Check]:
    """Checks of a grading answer, a JSON object label -> {dimension: 0..4 whole number}, in VARIANT so that booleans and fractions are no numbers."""
    raw = F.col(answer)
    checks: list[Check] = [("answer is not JSON", ~whole_json(raw)), ("labels differ from those asked for", ~exact_keys(raw, labels))]
    bad = []
    for label in labels:
        for d in dimensions:
            at = F.try_variant_get(F.try_parse_json(raw), f"$.{label}.{d}", "string")
            kind = F.schema_of_variant(F.coalesce(F.try_variant_get(F.try_parse_json(raw), f"$.{label}.{d}", "variant"), F.parse_json(F.lit("null"))))
            bad.append((kind != "BIGINT") | F.coalesce(~at.cast("int").between(0, 4), F.lit(True)))
    checks.append(("a grade is not a whole number from 0 to 4", reduce(lambda a, b: a | b, bad)))
    return checks


def decision_checks(needed: str, comment: str) -> list[Check]:
    """Checks that a placement decision agrees with the comment beside it."""
    blank = F.length(normalise(F.coalesce(F.col(comment), F.lit("")))) == 0
    return [("wrong types", F.col(needed).isNull() | F.col(comment).isNull()), ("declined the position and wrote a comment", ~F.col(needed) & ~blank), ("asked for a comment and wrote none", F.col(needed) & blank)]
