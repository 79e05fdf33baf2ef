"""Queries over answers in JSON and over what models are shown.

The test tables hold no answers, so each row of `labels` or `documents` makes one by a template, with a fault that its id
chooses; the template is one SQL expression that both engines read. What is wrong with an answer is found by parsing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import prompts as P
from annolens.operators import contracts as C
from annolens.operators.validate import DIMENSIONS
from annolens.plans.registry import query
from annolens.session import table


def _built(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """Rows of a table with templates filled in."""
    return table(spark, sf_dir, name).select("*", *[F.expr(sql).alias(k) for k, sql in columns.items()])


_KEYS = "['" + "', '".join(sorted(["label", *DIMENSIONS, "evidence", "explanation", "missing_facts", "unsupported_claims"])) + "']"
_TEXT = "'some  words of text ' || CAST(doc_id AS STRING)"
_JUDGED = """'{"grades":[{"label":"' || CASE doc_id % 10 WHEN 1 THEN 'C9' ELSE 'C1' END || '","style":' || CASE doc_id % 10 WHEN 3 THEN '5' WHEN 4 THEN 'true' ELSE CAST(quality * 2 AS STRING) END
    || ',"words":1,"structure":0,"simplicity":2,"meaning":' || CAST(toxic AS STRING) || ',"usefulness":3,"evidence":[' || CASE doc_id % 10 WHEN 5 THEN '7' WHEN 7 THEN '"no such words"' WHEN 8 THEN '' ELSE '"some words of"' END
    || '],"explanation":"' || CASE doc_id % 10 WHEN 6 THEN ' ' ELSE 'because' END || '","missing_facts":[],"unsupported_claims":[]' || CASE doc_id % 10 WHEN 2 THEN ',"more":1' ELSE '' END || '}]' || CASE doc_id % 10 WHEN 9 THEN '' ELSE '}' END"""
_GRADES = " OR ".join(f"coalesce(json_type(g, '$.{d}'), '') NOT IN ('UBIGINT', 'BIGINT') OR NOT coalesce(CAST(json_extract_string(g, '$.{d}') AS INT) BETWEEN 0 AND 4, false)" for d in DIMENSIONS).replace("CAST(", "TRY_CAST(")
_JUDGE_SQL = f"""
    built AS (SELECT doc_id, quality, toxic, {_JUDGED} AS answer, {_TEXT} AS text FROM labels),
    first AS (SELECT *, CASE WHEN json_valid(answer) THEN json_extract(answer, '$.grades[0]') END AS g FROM built),
    reasons AS (SELECT *, CASE WHEN NOT json_valid(answer) THEN 'malformed' WHEN json_extract_string(g, '$.label') <> 'C1' THEN 'not each label once' WHEN list_sort(json_keys(g)) <> {_KEYS} THEN 'missing or extra fields'
        WHEN {_GRADES} THEN 'invalid grade' WHEN json_array_length(g, '$.evidence') > 0 AND json_type(g, '$.evidence[0]') <> 'VARCHAR' THEN 'invalid field' WHEN trim(json_extract_string(g, '$.explanation')) = '' THEN 'no explanation'
        WHEN json_array_length(g, '$.evidence') > 0 AND NOT contains(regexp_replace(text, '\\s+', ' ', 'g'), json_extract_string(g, '$.evidence[0]')) THEN 'evidence is not in the text' END AS reason FROM first)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "labels", answer=_JUDGED, words=_TEXT).withColumn("texts", F.create_map(F.lit("C1"), F.col("words")))
    return rows.withColumn("reason", C.judge_reason("answer", "texts"))


@query("judge_answers", f"WITH {_JUDGE_SQL} SELECT doc_id, reason FROM reasons")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "reason")


_OBJECT = """'{"label":"{label}","style":' || {style} || ',"words":1,"structure":0,"simplicity":2,"meaning":0,"usefulness":3,"evidence":["' || {quote} || '"],"explanation":"' || {why} || '","missing_facts":[],"unsupported_claims":[]}'"""


def _object(label: str, k: str) -> str:
    """One of an answer's objects: sound, of a bad grade, without an explanation, or with a quote that is nowhere, by the id."""
    parts = {"label": label, "style": f"CASE {k} % 4 WHEN 1 THEN '5' ELSE '2' END", "quote": f"CASE {k} % 4 WHEN 3 THEN 'no such words' ELSE 'some' || chr(160) || 'words' END", "why": f"CASE {k} % 4 WHEN 2 THEN chr(160) || chr(8195) ELSE 'because' END"}
    text = _OBJECT
    for name, sql in parts.items():
        text = text.replace("{" + name + "}", sql)
    return text


_PAIR = f"""'{{"grades":[' || CASE WHEN doc_id % 7 = 3 THEN {_object('A', 'doc_id')} ELSE {_object('B', 'doc_id')} END || ',' || {_object('A', 'CAST(floor(doc_id / 4) AS INT)')} || ']}}' || CASE doc_id % 11 WHEN 1 THEN ' junk' WHEN 2 THEN '}}' WHEN 3 THEN ' ' || chr(10) WHEN 4 THEN ',{{}}' ELSE '' END"""
_FAULT = "CASE {k} % 4 WHEN 1 THEN 'invalid grade' WHEN 2 THEN 'no explanation' WHEN 3 THEN 'evidence is not in the text' END"


@query("judge_pairs", f"SELECT doc_id, CASE WHEN doc_id % 11 IN (1, 2, 4) THEN 'malformed' WHEN doc_id % 7 = 3 THEN 'not each label once' ELSE coalesce({_FAULT.format(k='doc_id')}, {_FAULT.format(k='(doc_id // 4)')}) END AS reason FROM labels")
def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two objects: the first bad one tells its reason; text behind the answer, and white space of all kinds."""
    texts = F.create_map(F.lit("A"), F.col("words"), F.lit("B"), F.col("words"))
    rows = _built(spark, sf_dir, "labels", answer=_PAIR.replace("chr(160)", "decode(unhex('C2A0'), 'UTF-8')").replace("chr(8195)", "decode(unhex('E28083'), 'UTF-8')"), words=_TEXT)
    return rows.withColumn("texts", texts).select("doc_id", C.judge_reason("answer", "texts").alias("reason"))


@query("recovered_judgments", f"WITH {_JUDGE_SQL} SELECT doc_id % 10 AS id, count(*) FILTER (reason IS NULL) AS valid_judgments, count(*) FILTER (reason IS NOT NULL) AS invalid_judgments, round(avg(CASE WHEN reason IS NULL THEN CAST(json_extract_string(g, '$.meaning') AS INT) END), 6) AS meaning FROM reasons GROUP BY ALL")
def recovered_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preserved answers validated again: those that hold now count, the others stay counted as invalid."""
    rows = _judged(spark, sf_dir).withColumn("meaning", C.at(F.get(C.items(F.col("answer"), "grades"), 0), "meaning").cast("int"))
    sound = F.col("reason").isNull()
    return rows.groupBy((F.col("doc_id") % 10).alias("id")).agg(F.count_if(sound).alias("valid_judgments"), F.count_if(~sound).alias("invalid_judgments"), F.round(F.avg(F.when(sound, F.col("meaning"))), 6).alias("meaning"))


_SETS = """'{"sets":[' || CASE doc_id % 7 WHEN 1 THEN '' ELSE '{"label":"S1","redundancy":' || CASE doc_id % 7 WHEN 2 THEN '1.5' ELSE CAST(quality AS STRING) END || ',"consistency":' || CAST(toxic * 4 AS STRING) || ',"proportion":'
    || CASE doc_id % 7 WHEN 3 THEN '-1' ELSE '2' END || ',"evidence":["' || CASE doc_id % 7 WHEN 4 THEN '' WHEN 5 THEN 'elsewhere' ELSE 'words' END || '"],"explanation":"x"}' END || ']}'"""


@query("file_set_answers", f"""
    WITH built AS (SELECT doc_id, {_SETS} AS answer, {_TEXT} AS text FROM labels), first AS (SELECT *, json_extract(answer, '$.sets[0]') AS s FROM built),
    reasons AS (SELECT *, CASE WHEN s IS NULL THEN 'not each label once' WHEN json_type(s, '$.redundancy') NOT IN ('UBIGINT', 'BIGINT') OR NOT TRY_CAST(json_extract_string(s, '$.proportion') AS INT) BETWEEN 0 AND 4 OR NOT TRY_CAST(json_extract_string(s, '$.consistency') AS INT) BETWEEN 0 AND 4 THEN 'invalid grade'
        WHEN json_extract_string(s, '$.evidence[0]') = '' OR NOT contains(text, json_extract_string(s, '$.evidence[0]')) THEN 'evidence is not in the text' END AS reason FROM first)
    SELECT doc_id % 5 AS arm, count(*) AS sets, count(*) FILTER (reason IS NOT NULL) AS refused, count(*) FILTER (reason IS NULL AND json_extract_string(s, '$.redundancy')::INT < 2 AND json_extract_string(s, '$.consistency')::INT < 2 AND json_extract_string(s, '$.proportion')::INT < 2) AS passed,
        round(avg(CASE WHEN reason IS NULL THEN json_extract_string(s, '$.consistency')::INT END), 6) AS consistency FROM reasons GROUP BY ALL
""")
def file_set_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets judged, refused and passed, and the mean of a deficit, for each arm."""
    rows = _built(spark, sf_dir, "labels", answer=_SETS, words=_TEXT).withColumn("texts", F.create_map(F.lit("S1"), F.col("words"))).withColumn("reason", C.file_set_reason("answer", "texts"))
    first, sound = F.get(C.items(F.col("answer"), "sets"), 0), F.col("reason").isNull()
    rows = rows.select("*", *[F.when(sound, C.at(first, d).cast("int")).alias(d) for d in C.DEFICITS])
    passed = F.coalesce(F.greatest(*C.DEFICITS) < 2, F.lit(False))
    return rows.groupBy((F.col("doc_id") % 5).alias("arm")).agg(F.count("*").alias("sets"), F.count_if(~sound).alias("refused"), F.count_if(passed).alias("passed"), F.round(F.avg("consistency"), 6).alias("consistency"))


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'comment' WHEN 1 THEN 'code' ELSE 'text' END"
_CHANGE = f"""'{{"task":"' || CASE doc_id % 11 WHEN 4 THEN ' ' ELSE 'do' END || '","artifacts":[' || CASE doc_id % 11 WHEN 5 THEN '' ELSE '{{"id":"a","kind":"' || CASE doc_id % 11 WHEN 6 THEN 'other' ELSE {_KIND} END || '","path":"p","before":"old words","after":'
    || CASE doc_id % 11 WHEN 7 THEN '3' ELSE '"new words"' END || ',"context":""}}' || CASE doc_id % 11 WHEN 8 THEN ',{{"id":"a","kind":"code","path":"q","before":"","after":"","context":""}}' ELSE '' END END || ']' || CASE doc_id % 11 WHEN 9 THEN ',"x":0' ELSE '' END || '}}'"""


@query("change_inputs", f"""
    WITH built AS (SELECT doc_id, {_CHANGE} AS c FROM labels)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(json_keys(c)) <> 2 THEN 'malformed' WHEN trim(json_extract_string(c, '$.task')) = '' THEN 'no task' WHEN json_array_length(c, '$.artifacts') = 0 THEN 'no artifacts'
        WHEN json_type(c, '$.artifacts[0].after') <> 'VARCHAR' THEN 'artifact field is no string' WHEN json_extract_string(c, '$.artifacts[0].kind') NOT IN ('comment', 'text', 'code') THEN 'unknown kind'
        WHEN json_extract_string(c, '$.artifacts[0].id') = json_extract_string(c, '$.artifacts[1].id') THEN 'repeated id' END AS reason FROM built) GROUP BY reason
""")
def change_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "labels", change=_CHANGE).groupBy(C.change_reason("change").alias("reason")).agg(F.count("*").alias("n"))


_SOUND = f"""'{{"task":"do","artifacts":[{{"id":"a","kind":"' || {_KIND} || '","path":"p","before":"old words","after":"new words","context":""}}]}}'"""
_GRADE = """'{"deficit":' || CASE doc_id % 13 WHEN 1 THEN 'null' WHEN 2 THEN '7' ELSE CAST(toxic * 3 AS STRING) END || ',"explanation":"' || CASE doc_id % 13 WHEN 3 THEN '' ELSE 'why' END || '","evidence":['
    || CASE WHEN doc_id % 13 = 4 OR (toxic = 0 AND doc_id % 13 <> 5) THEN '' ELSE '{"artifact_id":"a","source":"after","quote":"' || CASE doc_id % 13 WHEN 5 THEN 'new  words' ELSE 'new words' END || '"}' END || ']}'"""
_REVIEW = f"""'{{"artifacts":[{{"id":"' || CASE doc_id % 13 WHEN 6 THEN 'b' ELSE 'a' END || '","blockers":[' || CASE doc_id % 13 WHEN 7 THEN '"stuck"' WHEN 8 THEN '" "' ELSE '' END || '],"clean":' || CASE WHEN doc_id % 3 = 0 OR doc_id % 13 = 9 THEN {_GRADE} ELSE 'null' END
    || ',"effective":' || CASE WHEN doc_id % 3 = 0 THEN {_GRADE} ELSE 'null' END || ',"invasive":' || {_GRADE} || ',"optimal":{{"deficit":1,"explanation":"x","evidence":[]}}}}]}}'"""
_REVIEW_SQL = f"""
    built AS (SELECT doc_id, {_KIND} AS kind, {_REVIEW} AS r FROM labels),
    parts AS (SELECT *, json_extract(r, '$.artifacts[0]') AS a, json_extract(r, '$.artifacts[0].invasive') AS g FROM built),
    reasons AS (SELECT *, CASE WHEN json_extract_string(a, '$.id') <> 'a' THEN 'not each id once' WHEN trim(json_extract_string(a, '$.blockers[0]')) = '' THEN 'blank blocker' WHEN kind <> 'comment' AND json_type(a, '$.clean') <> 'NULL' THEN 'clean does not apply'
        WHEN json_type(g, '$.deficit') <> 'NULL' AND NOT json_extract_string(g, '$.deficit')::INT BETWEEN 0 AND 4 THEN 'deficit is no grade' WHEN json_extract_string(g, '$.explanation') = '' THEN 'no explanation'
        WHEN json_extract_string(g, '$.deficit')::INT >= 2 AND json_array_length(g, '$.evidence') = 0 THEN 'noticeable deficit without evidence' WHEN json_array_length(g, '$.evidence') > 0 AND NOT contains('new words', json_extract_string(g, '$.evidence[0].quote')) THEN 'evidence is no quote' END AS reason FROM parts)
"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "labels", review=_REVIEW, change=_SOUND).withColumn("reason", C.review_reason("review", "change"))


@query("review_answers", f"WITH {_REVIEW_SQL} SELECT doc_id, reason FROM reasons")
def review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("doc_id", "reason")


@query("review_statuses", f"""
    WITH {_REVIEW_SQL}, graded AS (SELECT *, CASE WHEN json_type(g, '$.deficit') = 'NULL' THEN 'unassessed' WHEN json_extract_string(g, '$.deficit')::INT < 2 THEN 'pass' ELSE 'fail' END AS s FROM reasons WHERE reason IS NULL)
    SELECT doc_id, 'a' AS id, kind, CASE WHEN kind = 'comment' THEN s ELSE 'not_applicable' END AS clean, CASE WHEN kind = 'comment' THEN s ELSE 'not_applicable' END AS effective, s AS invasive, 'pass' AS optimal,
        CASE WHEN json_array_length(a, '$.blockers') > 0 THEN 'blocked' WHEN s IN ('fail', 'unassessed') THEN s ELSE 'criteria_passed' END AS outcome FROM graded
""")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.review_statuses(_reviews(spark, sf_dir).where("reason is null"), "doc_id", "review", "change")


_RULE = """'{"id":"' || CASE item_id % 9 WHEN 1 THEN 'No Slug' ELSE 'r-' || CAST(item_id % 40 AS STRING) END || '","dimension":"' || CASE item_id % 9 WHEN 2 THEN 'taste' ELSE 'words' END || '","guidance":"' || CASE item_id % 9 WHEN 3 THEN ' ' ELSE 'say less' END
    || '","before":"a","after":"b","exceptions":[' || CASE item_id % 9 WHEN 4 THEN '' WHEN 5 THEN '1' ELSE '"x"' END || '],"signals":[],"evidence":["' || CASE item_id % 9 WHEN 6 THEN 'ftp://x' ELSE 'https://x' END || '"],"example_origin":"' || CASE item_id % 9 WHEN 7 THEN 'real' ELSE 'synthetic' END || '"' || CASE item_id % 9 WHEN 8 THEN ',"z":0' ELSE '' END || '}'"""


@query("guide_rules", f"""
    WITH built AS (SELECT item_id, {_RULE} AS r FROM benchmark)
    SELECT item_id, CASE WHEN len(json_keys(r)) <> 9 THEN 'missing or extra fields' WHEN NOT regexp_full_match(json_extract_string(r, '$.id'), '[a-z][a-z0-9-]*') THEN 'id is no slug' WHEN json_extract_string(r, '$.dimension') NOT IN ('words', 'structure', 'simplicity', 'meaning', 'usefulness') THEN 'unknown dimension'
        WHEN trim(json_extract_string(r, '$.guidance')) = '' THEN 'blank text' WHEN json_type(r, '$.exceptions[0]') <> 'VARCHAR' THEN 'no list of strings' WHEN json_array_length(r, '$.exceptions') = 0 THEN 'no exception' WHEN json_extract_string(r, '$.example_origin') <> 'synthetic' THEN 'example is not synthetic'
        WHEN NOT (json_extract_string(r, '$.evidence[0]') LIKE 'https://%' OR json_extract_string(r, '$.evidence[0]') LIKE 'experiments/%') THEN 'evidence links nowhere' END AS reason FROM built
""")
def guide_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "benchmark", rule=_RULE).select("item_id", C.rule_reason("rule").alias("reason"))


_EVENT = "CASE WHEN turn % 4 = 0 THEN 'thread.started' WHEN turn % 4 = 1 THEN 'item.completed' WHEN conv_id % 7 = 3 THEN 'turn.failed' ELSE 'turn.completed' END"
_ITEM = "CASE WHEN turn % 4 <> 1 THEN NULL WHEN conv_id % 5 = 2 THEN 'command' ELSE 'agent_message' END"


@query("call_logs", f"""
    SELECT conv_id, CASE WHEN count(*) FILTER (e = 'thread.started') <> 1 OR count(*) FILTER (e = 'turn.completed') = 0 THEN 'no unique thread or completed turn'
        ELSE arg_min(CASE WHEN e IN ('error', 'turn.failed') THEN 'failed turn' ELSE 'tool use' END, turn) FILTER (e IN ('error', 'turn.failed') OR i NOT IN ('agent_message', 'reasoning')) END AS reason FROM (SELECT conv_id, turn, {_EVENT} AS e, {_ITEM} AS i FROM conversations) GROUP BY conv_id
""")
def call_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.call_reasons(_built(spark, sf_dir, "conversations", event=_EVENT, item=_ITEM), "conv_id", "event", "item", "turn")


@query("resumable_manifests", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'corpus' WHEN o_orderkey % 5 = 0 THEN 'seed' END AS mismatch FROM orders")
def resumable_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and expected manifests: status may differ, corpus and seed may not."""
    key = F.col("o_orderkey")
    saved = F.create_map(F.lit("corpus"), F.col("o_orderpriority"), F.lit("status"), F.lit("failed"), F.lit("seed"), key.cast("string"))
    expected = F.create_map(F.lit("status"), F.lit("running"), F.lit("seed"), (key + (key % 5 == 0).cast("int")).cast("string"), F.lit("corpus"), F.concat("o_orderpriority", F.when(key % 3 == 0, "+").otherwise("")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", saved.alias("saved"), expected.alias("expected"))
    return rows.select("o_orderkey", C.manifest_mismatch("saved", "expected").alias("mismatch"))


_PROSE = "CASE doc_id % 6 WHEN 1 THEN '   ' WHEN 2 THEN 'ends */ here' WHEN 3 THEN '// dressed' WHEN 4 THEN 'one' || chr(10) || chr(10) || 'two' ELSE 'line ' || CAST(doc_id AS STRING) END"
_MANNER = "CASE doc_id % 4 WHEN 0 THEN '/// old' WHEN 1 THEN '/* old */' ELSE '// old' END"


@query("rendered_comments", f"""
    WITH built AS (SELECT doc_id, {_PROSE} AS t, {_MANNER} AS o FROM labels), marked AS (SELECT *, CASE WHEN trim(t) = '' THEN 'empty' WHEN contains(t, '*/') THEN 'delimiter or splice' WHEN starts_with(t, '//') THEN 'delimiters or fences' END AS reason, CASE WHEN starts_with(o, '///') THEN '///' ELSE '//' END AS m FROM built)
    SELECT doc_id, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN starts_with(o, '//') THEN array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN x = '' THEN m ELSE m || ' ' || x END), chr(10) || '  ') ELSE '/* ' || replace(t, chr(10), chr(10) || '   * ') || ' */' END AS comment FROM marked
""")
def rendered_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _built(spark, sf_dir, "labels", prose=_PROSE, manner=_MANNER)
    return rows.select("doc_id", P.rendered_reason(F.col("prose")).alias("reason"), P.rendered(F.col("prose"), F.col("manner"), F.lit("  ")).alias("comment"))


@query("masked_sources", """
    WITH built AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, 1 + doc_id % len(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, sha256(substr(text, 1, doc_id % 20) || '// <COMMENT_TO_WRITE>' || substr(text, doc_id % 20 + 6)) AS masked, sha256(array_to_string(lines[greatest(1, line - 2):least(len(lines), line + 1)], chr(10))) AS around,
        CASE WHEN len(lines) < 2 THEN 'range outside the source' WHEN line <= 2 THEN 'range over the target' END AS reason, CASE WHEN len(lines) >= 2 AND line > 2 THEN sha256(chr(10) || chr(10) || '// Additional source context, lines 1-2:' || chr(10) || lines[1] || chr(10) || lines[2]) END AS more FROM built
""")
def masked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked source, the lines around a place, and a further range of lines if it may be shown."""
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("line", (1 + F.col("doc_id") % F.size(P.lines_of(F.col("text")))).cast("int"))
    ranges, start = F.array(F.array(F.lit(1), F.lit(2))), (F.col("doc_id") % 20).cast("int")
    reason = P.range_reason(ranges, F.size(P.lines_of(F.col("text"))), F.col("line"), F.col("line"))
    return rows.select(
        "doc_id", F.sha2(P.masked(F.col("text"), start, start + 5), 256).alias("masked"), F.sha2(P.window(F.col("text"), F.col("line"), 2, 1), 256).alias("around"), reason.alias("reason"),
        F.when(reason.isNull(), F.sha2(P.with_ranges(F.lit(""), F.col("text"), ranges), 256)).alias("more"),
    )


@query("prompts_and_names", """
    SELECT page_id, 'scaled-' || lower(regexp_extract(url, '([^/]*?)(?:\\.[^./]*)?$', 1)) || '-' || (page_id % 90)::VARCHAR AS case_id, 'commit-' || substr(sha256(url), 1, 12) AS commit_id, 'https://host/blob/' || substr(sha256(url), 1, 8) || '/src/a.h#L' || (page_id % 90)::VARCHAR AS link,
        '## Task' || chr(10) || 'describe' || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '## Address' || chr(10) || url ELSE '' END AS prompt, CASE WHEN page_id % 3 > 0 THEN 'run' END AS label, CASE WHEN page_id % 3 > 0 THEN 'a=' || page_id::VARCHAR END AS value FROM pages
""")
def prompts_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sha, line = table(spark, sf_dir, "pages"), F.sha2("url", 256), F.col("page_id") % 90
    pair = P.label_pair(F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("=")).otherwise(F.lit("run=")), F.lit("a="), F.col("page_id").cast("string")))
    return pages.select(
        "page_id", P.case_id("scaled", F.col("url"), line).alias("case_id"), P.commit_id(sha).alias("commit_id"), P.line_link("https://host", F.substring(sha, 1, 8), F.lit("src/a.h"), line).alias("link"),
        P.prompt({"Task": F.lit("describe"), "Address": F.when(F.col("page_id") % 2 == 0, F.col("url"))}).alias("prompt"), pair["label"].alias("label"), pair["value"].alias("value"),
    )
