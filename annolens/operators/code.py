"""Table operators over sources, diffs, patches and edits.

The lexer and the diff have no Catalyst expression, so these run Arrow batches through Python, a row at a time inside a batch. No
row can fail a job: what a row's function refuses comes back as a row with a null result and the reason.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions import lex, patch
from annolens.functions.prompts import rendered, rendered_reason
from annolens.operators.validate import exact_keys

_COMMENT = "start long, end long, line long, end_line long, raw string, comment string"


def _mapped(rows: DataFrame, keys: list[str], inputs: list[str], function: Callable[..., list[dict]], schema: str, refused: tuple = (lex.ScanError, patch.PatchError)) -> DataFrame:
    """keys, the columns that function returns for each row (none, one or many), and `error`, on a row of its own if the row is refused."""
    kinds = dict(rows.dtypes)
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                values = row._asdict()
                base = {k: values[k] for k in keys}
                try:
                    out += [base | r | {"error": None} for r in function(*(values[i] for i in inputs))]
                except refused as e:
                    out.append(base | {n: None for n in names} | {"error": str(e)})
            yield pd.DataFrame(out, columns=[*keys, *names, "error"])

    full = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema, "error string"])
    return rows.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, full)


def _top_level(schema: str) -> list[str]:
    depth, parts = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def comments(sources: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """(key, start, end, line, end_line, raw, comment, error) of each comment; null sources have none."""

    def one(text: str | None) -> list[dict]:
        return [{"start": c.start, "end": c.end, "line": c.line, "end_line": c.end_line, "raw": c.raw, "comment": c.text} for c in lex.scan(text or "")[0]]

    return _mapped(sources, [key], [source], one, _COMMENT)


def tokens(sources: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """(key, ordinal, token, error)."""
    return _mapped(sources, [key], [source], lambda s: [{"ordinal": k, "token": t} for k, t in enumerate(lex.scan(s or "")[1])], "ordinal long, token string")


def candidate_comments(sources: DataFrame, words: Callable[[Column], Column], key: str = "path", least: int = 12, most: int = 65) -> DataFrame:
    """Comments past the header with a word count in range that are no banners."""
    n = F.size(words(F.col("comment")))
    return comments(sources, key).where(F.col("error").isNull() & n.between(least, most) & (F.col("line") > 20) & ~F.col("comment").rlike("^(===|---)"))


def anchor_lines(sources: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """(key, line, error): places without a comment where one could stand."""
    return _mapped(sources, [key], [source], lambda s: [{"line": n} for n in lex.anchors(s or "")], "line long")


def changed_comments(diffs: DataFrame, key: str = "id", diff: str = "diff", base: str = "base") -> DataFrame:
    """Comments that comment-only diffs change; base is a JSON object path -> text."""
    schema = "path string, line long, end_line long, comment string, context string, old_touched long"

    def one(text: str, sources: str) -> list[dict]:
        found, touched = patch.changed_comments(text, json.loads(sources))
        return [{k: c[k] for k in ("path", "line", "end_line", "comment", "context")} | {"old_touched": touched} for c in found]

    return _mapped(diffs, [key], [diff, base], one, schema)


def patch_sections(patches: DataFrame, key: str = "sha", text: str = "patch") -> DataFrame:
    """(key, path, touched, added, removed, binary, mode_change, error) of each file of a patch."""
    return _mapped(patches, [key], [text], patch.sections, "path string, touched array<long>, added array<string>, removed array<string>, binary boolean, mode_change boolean")


def patch_messages(patches: DataFrame, key: str = "sha", text: str = "patch") -> DataFrame:
    """(key, subject, body, rejection, error); rejection is null for eligible changes."""

    def one(p: str) -> list[dict]:
        subject, body = patch.message(p)
        return [{"subject": subject, "body": body, "rejection": patch.rejection(subject, body, patch.sections(p))}]

    return _mapped(patches, [key], [text], one, "subject string, body string, rejection string")


def scored_edits(answers: DataFrame, key: str = "id", sources: str = "sources", edits: str = "edits", reference: str = "reference", threshold: float = 0.5) -> DataFrame:
    """Edits applied to their sources and compared with a reference change; sources, edits and reference (the sources after it) are JSON."""

    def one(before: str, todo: str, after: str) -> list[dict]:
        texts = json.loads(before)
        mine, theirs = (patch.shape(texts, x) for x in (patch.edited(texts, json.loads(todo)), texts | json.loads(after)))
        return [{"changed_lines": mine["changed_lines"], "files": mine["files"], "new_symbols": mine["new_symbols"]} | patch.compared(mine, theirs, threshold)]

    return _mapped(answers, [key], [sources, edits, reference], one, "changed_lines long, files array<string>, new_symbols array<string>, overlap double, floor boolean, invasive boolean, optimal boolean")


def coupling(cases: DataFrame, key: str = "id", comment: str = "comment", context: str = "context", source: str = "source") -> DataFrame:
    """How a comment leans on code: restated and foreign identifiers, with multiplicity but for the names."""

    def one(text: str, near: str, whole: str) -> list[dict]:
        every = patch._IDENTIFIER.findall(text)
        shaped = [w for w in every if w in patch.identifiers(w)]
        visible, local = (patch.identifiers(lex.without_comments(x)) for x in (near, whole))
        foreign = [w for w in shaped if w not in local]
        restated = sum(w in visible for w in shaped)
        return [{"code_identifiers": len(shaped), "restated": restated, "restatement_fraction": restated / max(1, len(every)), "foreign": len(foreign), "foreign_names": sorted(set(foreign))}]

    return _mapped(cases, [key], [comment, context, source], one, "code_identifiers long, restated long, restatement_fraction double, foreign long, foreign_names array<string>")


def generated_comments(rows: DataFrame, key: str = "id", refused: str = "reason") -> DataFrame:
    """(key, reason, after): answers {"comment": prose} put in place of a comment; reason is null where an answer counts.

    rows: (key, source, start, end, original, indent, answer). Keys and prose are judged by expressions; only answers that pass
    go through the lexer, which sees that the code stays and the text is a comment.
    """
    prose = F.get_json_object("answer", "$.comment")
    reason = F.when(~exact_keys(F.col("answer"), ["comment"]), "wrong keys").otherwise(rendered_reason(prose))
    marked = rows.withColumns({refused: reason, "comment": rendered(prose, F.col("original"), F.col("indent"))})
    sound = marked.where(F.col(refused).isNull())
    done = _mapped(sound, [key], ["source", "start", "end", "comment"], lambda s, a, b, c: [{"after": lex.spliced(s, int(a), int(b), c)}], "after string")
    return done.select(key, F.col("error").alias(refused), "after").unionByName(marked.where(F.col(refused).isNotNull()).select(key, refused, F.lit(None).cast("string").alias("after")))


def blind_labels(units: DataFrame, arms: list[str], key: str = "id", seed: str = "seed", mark: str = "C") -> DataFrame:
    """(key, labels map label -> arm): arms shuffled by Python's generator under each row's seed, so saved labels can be read back."""

    def one(number: int) -> list[dict]:
        order = list(arms)
        random.Random(int(number)).shuffle(order)
        return [{"labels": {f"{mark}{k}": a for k, a in enumerate(order, 1)}}]

    return _mapped(units, [key], [seed], one, "labels map<string,string>")


def comment_islands(lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """(path, first, last, lines): runs of adjacent rows, as gaps and islands over a window a path."""
    w = Window.partitionBy(path).orderBy(line)
    starts = lines.withColumn("_new", F.when(F.col(line) - F.lag(line).over(w) == 1, 0).otherwise(1))
    marked = starts.withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(path, "_island").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("lines")).drop("_island")
