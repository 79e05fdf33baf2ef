"""Contracts of answers that come as JSON: ordered checks in VARIANT, the first that fails names the reason.

Answers hold a list of objects. Each object is checked alone, the first bad one tells its reason, and a row's
checks come before those of its objects. Everything is an expression of the row, so answers of any number spread as they are
read; a rejected row keeps its raw answer beside the reason. An answer is one JSON value and nothing but white space around it; an
object that repeats a key is no JSON here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.functions.text import normalise
from annolens.operators.validate import DIMENSIONS, Check, exact_keys, first_reason, quoted_in, whole_json

# What a review judges, and of which kinds of artifact.
CRITERIA = ("clean", "effective", "invasive", "optimal")
APPLIES = {"comment": CRITERIA, "text": ("invasive", "optimal"), "code": ("invasive", "optimal")}
ARTIFACT = ("id", "kind", "path", "before", "after", "context")
EVIDENCE = ("artifact_id", "source", "quote")
DEFICITS = ("redundancy", "consistency", "proportion")
# The fields of a rule of the guide, what a rule may be about, and how its links may begin.
RULE = ("id", "dimension", "guidance", "before", "after", "exceptions", "signals", "evidence", "example_origin")
RULE_DIMENSIONS = DIMENSIONS[1:]
LINKS = ("https://", "experiments/")
#: Fields of a manifest that may change between an attempt and its resumption.
MUTABLE = ("status", "started_at", "jobs", "name")


def at(item: Column, key: str) -> Column:
    return F.get_json_object(item, f"$.{key}")


def kind(item: Column, key: str) -> Column:
    """The VARIANT type of a field; MISSING where there is none."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{key}", "variant")), F.lit("MISSING"))


def items(answer: Column, key: str) -> Column:
    """The objects of a list field, as JSON."""
    return F.from_json(answer, f"struct<{key}: array<string>>")[key]


def strings(item: Column, key: str) -> Column:
    return F.from_json(at(item, key), "array<string>")


def not_strings(item: Column, key: str) -> Column:
    """A field that is no list of strings."""
    return (kind(item, key) != "ARRAY<STRING>") & ~((kind(item, key) == "ARRAY<VOID>") & (F.size(strings(item, key)) == 0))


def not_grade(item: Column, key: str) -> Column:
    """A field that is no whole number from 0 to 4; true is none."""
    return (kind(item, key) != "BIGINT") | ~F.coalesce(at(item, key).cast("int").between(0, 4), F.lit(False))


def blank(item: Column, key: str) -> Column:
    return (kind(item, key) != "STRING") | (F.length(normalise(at(item, key))) == 0)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_of(rows: Column, checks) -> Column:
    """The reason of the first object that fails a check; null if none does."""
    return F.get(F.filter(F.transform(rows, lambda r: first_reason(checks(r), None)), lambda x: x.isNotNull()), 0)


def _list_checks(answer: str, key: str, label: str, wanted: Column, item_checks) -> Column:
    raw = F.col(answer)
    rows = items(raw, key)
    told = F.array_sort(F.transform(rows, lambda r: F.coalesce(at(r, label), F.lit(""))))
    malformed = ~whole_json(raw) | ~F.coalesce(exact_keys(raw, [key]), F.lit(False)) | ~F.startswith(kind(raw, key), F.lit("ARRAY"))
    named = F.forall(rows, lambda r: kind(r, label) == "STRING")
    checks: list[Check] = [("malformed", malformed), (f"not each {label} once", ~F.coalesce(named & (told == F.array_sort(wanted)), F.lit(False)))]
    return F.coalesce(first_reason(checks, None), first_of(rows, item_checks))


def judge_reason(answer: str, texts: str, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Why a judge's answer does not count; null if it does. texts: map label -> the text that the label stands for."""
    keys = ["label", *dimensions, "evidence", "explanation", "missing_facts", "unsupported_claims"]

    def one(r: Column) -> list[Check]:
        return [
            ("missing or extra fields", ~exact_keys(r, keys)),
            ("invalid grade", any_of([not_grade(r, d) for d in dimensions])),
            ("invalid field", any_of([not_strings(r, f) for f in ("evidence", "missing_facts", "unsupported_claims")])),
            ("no explanation", blank(r, "explanation")),
            ("evidence is not in the text", ~quoted_in(strings(r, "evidence"), F.try_element_at(F.col(texts), at(r, "label")))),
        ]

    return _list_checks(answer, "grades", "label", F.map_keys(texts), one)


def file_set_reason(answer: str, texts: str) -> Column:
    """Why a judgment of file sets does not count: each label once, three deficits, evidence in the set."""

    def one(r: Column) -> list[Check]:
        return [
            ("missing or extra fields", ~exact_keys(r, ["label", *DEFICITS, "evidence", "explanation"])),
            ("invalid grade", any_of([not_grade(r, d) for d in DEFICITS])),
            ("invalid field", not_strings(r, "evidence")),
            ("no explanation", blank(r, "explanation")),
            ("evidence is not in the text", ~quoted_in(strings(r, "evidence"), F.try_element_at(F.col(texts), at(r, "label")))),
        ]

    return _list_checks(answer, "sets", "label", F.map_keys(texts), one)


def change_reason(change: str) -> Column:
    """Why the input of a review does not count: a task, and artifacts of known kinds with ids of their own."""
    raw = F.col(change)
    rows = items(raw, "artifacts")
    ids = F.transform(rows, lambda r: at(r, "id"))

    def one(r: Column) -> list[Check]:
        return [
            ("artifact with missing or extra fields", ~exact_keys(r, list(ARTIFACT))),
            ("artifact field is no string", any_of([kind(r, f) != "STRING" for f in ARTIFACT])),
            ("blank id or path", blank(r, "id") | blank(r, "path")),
            ("unknown kind", ~at(r, "kind").isin(*APPLIES)),
        ]

    checks: list[Check] = [
        ("malformed", ~whole_json(raw) | ~F.coalesce(exact_keys(raw, ["task", "artifacts"]), F.lit(False))),
        ("no task", blank(raw, "task")),
        ("no artifacts", ~F.startswith(kind(raw, "artifacts"), F.lit("ARRAY")) | (F.size(rows) < 1)),
    ]
    repeated = F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated id")
    return F.coalesce(first_reason(checks, None), first_of(rows, one), repeated)


def _artifact(change: str, name: Column) -> Column:
    return F.get(F.filter(items(F.col(change), "artifacts"), lambda a: at(a, "id") == name), 0)


def review_reason(answer: str, change: str) -> Column:
    """Why a review does not count. Evidence quotes an artifact's before, after or context letter by letter."""

    def evidence(change_: str, e: Column) -> Column:
        its = _artifact(change_, at(e, "artifact_id"))
        source, quote = at(e, "source"), at(e, "quote")
        held = F.when(source == "before", at(its, "before")).when(source == "after", at(its, "after")).when(source == "context", at(its, "context"))
        return blank(e, "quote") | ~F.coalesce(F.contains(held, quote), F.lit(False))

    def graded(r: Column, name: str) -> list[Check]:
        g = at(r, name)
        quotes = F.from_json(at(g, "evidence"), "array<string>")
        of_kind = F.array_contains(F.array(*[F.lit(k) for k, names in APPLIES.items() if name in names] or [F.lit("")]), at(_artifact(change, at(r, "id")), "kind"))
        applies, noticed = of_kind, F.coalesce(at(g, "deficit").cast("int") >= 2, F.lit(False))
        return [
            (f"{name} does not apply", ~applies & (kind(r, name) != "VOID")),
            (f"malformed assessment: {name}", applies & ~F.coalesce(exact_keys(g, ["deficit", "explanation", "evidence"]), F.lit(False))),
            ("deficit is no grade", applies & (kind(g, "deficit") != "VOID") & not_grade(g, "deficit")),
            ("no explanation", applies & blank(g, "explanation")),
            ("evidence is no list", applies & ~F.startswith(kind(g, "evidence"), F.lit("ARRAY"))),
            ("noticeable deficit without evidence", applies & noticed & (F.size(quotes) == 0)),
            ("malformed evidence", applies & F.exists(quotes, lambda e: ~exact_keys(e, list(EVIDENCE)) | any_of([kind(e, f) != "STRING" for f in EVIDENCE]))),
            ("evidence is no quote", applies & F.exists(quotes, lambda e: evidence(change, e))),
        ]

    def one(r: Column) -> list[Check]:
        checks: list[Check] = [
            ("missing or extra fields", ~exact_keys(r, ["id", "blockers", *CRITERIA])),
            ("blank blocker", not_strings(r, "blockers") | F.exists(strings(r, "blockers"), lambda b: F.length(normalise(b)) == 0)),
        ]
        return checks + [c for name in CRITERIA for c in graded(r, name)]

    return _list_checks(answer, "artifacts", "id", F.transform(items(F.col(change), "artifacts"), lambda a: at(a, "id")), one)


def review_statuses(rows: DataFrame, key: str, answer: str, change: str) -> DataFrame:
    """(key, id, kind, clean, effective, invasive, optimal, outcome) of each artifact of valid reviews.

    A blocker outranks a failed criterion, that one an unassessed one; what does not apply to a kind never counts as passed.
    """
    each = rows.select(key, change, F.explode(items(F.col(answer), "artifacts")).alias("r"))
    each = each.select(key, "r", at(F.col("r"), "id").alias("id"), at(_artifact(change, at(F.col("r"), "id")), "kind").alias("kind"))

    def status(name: str) -> Column:
        deficit = at(F.col("r"), f"{name}.deficit").cast("int")
        return F.when(~F.col("kind").isin(*[k for k, names in APPLIES.items() if name in names]), "not_applicable").when(deficit.isNull(), "unassessed").when(deficit < 2, "pass").otherwise("fail")

    each = each.withColumns({name: status(name) for name in CRITERIA})
    outcome = F.when(F.size(strings(F.col("r"), "blockers")) > 0, "blocked")
    for word in ("fail", "unassessed"):
        outcome = outcome.when(any_of([F.col(name) == word for name in CRITERIA]), word)
    return each.select(key, "id", "kind", *CRITERIA, outcome.otherwise("criteria_passed").alias("outcome"))


def rule_reason(rule: str) -> Column:
    """Why a rule of the guide, a JSON object, does not count. That ids differ is a property of the table: see repeated()."""
    r = F.col(rule)
    return first_reason(
        [
            ("missing or extra fields", ~whole_json(r) | ~F.coalesce(exact_keys(r, list(RULE)), F.lit(False))),
            ("id is no slug", ~F.coalesce(at(r, "id").rlike(r"^[a-z][a-z0-9-]*\z"), F.lit(False))),
            ("unknown dimension", ~F.coalesce(at(r, "dimension").isin(*RULE_DIMENSIONS), F.lit(False))),
            ("blank text", any_of([blank(r, f) for f in ("guidance", "before", "after")])),
            ("no list of strings", any_of([not_strings(r, f) | F.exists(strings(r, f), lambda x: x == "") for f in ("exceptions", "signals", "evidence")])),
            ("no exception", F.size(strings(r, "exceptions")) == 0),
            ("example is not synthetic", at(r, "example_origin") != "synthetic"),
            ("evidence links nowhere", F.exists(strings(r, "evidence"), lambda x: ~any_of([F.startswith(x, F.lit(p)) for p in LINKS]))),
        ],
        None,
    )


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


# Items that a call may hold, and the reasons why it does not count.
ALLOWED_ITEMS = ("agent_message", "reasoning")
NO_TURN, FAILED, TOOL = "no unique thread or completed turn", "failed turn", "tool use"


def call_reasons(events: DataFrame, call: str, event: str, item: str, order: str) -> DataFrame:
    """(call, reason) of each recorded call: one thread and a completed turn, or else what its first event in `order` says that is a failure or holds anything but messages and reasoning. null: sound."""
    e, i = F.col(event), F.col(item)
    problem = F.when(e.isin("error", "turn.failed"), FAILED).when(i.isNotNull() & (i != "") & ~i.isin(*ALLOWED_ITEMS), TOOL)
    seen = events.groupBy(call).agg(F.count_if(e == "thread.started").alias("threads"), F.count_if(e == "turn.completed").alias("turns"), F.min_by(problem, F.when(problem.isNotNull(), F.col(order))).alias("problem"))
    return seen.select(call, F.when((F.col("threads") != 1) | (F.col("turns") == 0), NO_TURN).otherwise(F.col("problem")).alias("reason"))


def manifest_mismatch(saved: str, expected: str, mutable: tuple[str, ...] = MUTABLE) -> Column:
    """The first key, by name, of an expected manifest (map) whose saved value is another; null if the attempt may be resumed."""
    fixed = F.filter(F.array_sort(F.map_keys(expected)), lambda k: ~k.isin(*mutable))
    return F.get(F.filter(fixed, lambda k: ~F.try_element_at(F.col(saved), k).eqNullSafe(F.try_element_at(F.col(expected), k))), 0)
