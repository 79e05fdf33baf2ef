"""Queries over whole samples: the stratified walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import text as T
from annolens.operators.selection import select_stratified
from annolens.plans.registry import query
from annolens.plans.text_queries import SEED, SPLIT, documents

TOTALS = {"train": 22, "validation": 9, "test": 8}
CAP = 2
_BAND = "CASE WHEN length(text) < 1300 THEN 'short' WHEN length(text) < 2200 THEN 'medium' ELSE 'long' END"
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'rationale' WHEN 1 THEN 'example' ELSE 'mechanism' END"
_OPEN = "CASE {k} WHEN 'example' THEN te WHEN 'rationale' THEN tr ELSE tm END"


@query("stratified_walk", f"""
    WITH RECURSIVE base AS (SELECT doc_id, source, {SPLIT.format(t='doc_id::VARCHAR')} AS split, {_BAND} AS band, {_KIND} AS kind, sha256('{SEED}:' || source || ':' || doc_id) AS sha FROM documents WHERE text IS NOT NULL),
    shares AS (SELECT w.split, s.band, s.b, w.total // 3 + CAST(s.k < w.total % 3 AS INT) AS n FROM (VALUES {', '.join(f"('{k}', {n})" for k, n in TOTALS.items())}) w(split, total), (VALUES ('short', 0, 3), ('medium', 1, 2), ('long', 2, 1)) s(band, k, b)),
    kinds AS (SELECT unnest(['example', 'rationale', 'mechanism']) AS kind),
    wanted AS (SELECT split, band, b, n, kind, CAST(CASE kind WHEN 'example' THEN round_even(n * 0.2, 0) WHEN 'rationale' THEN round_even(n * 0.4, 0) ELSE n - round_even(n * 0.2, 0) - round_even(n * 0.4, 0) END AS BIGINT) AS share FROM shares, kinds),
    held AS (SELECT w.*, (SELECT count(*) FROM base x WHERE x.split = w.split AND x.band = w.band AND x.kind = w.kind) AS has FROM wanted w),
    got AS (SELECT *, least(share, has) AS first, n - sum(least(share, has)) OVER (PARTITION BY split, b) AS short FROM held),
    spare AS (SELECT split, b, kind, short, row_number() OVER (PARTITION BY split, b ORDER BY level / greatest(1, share), kind) AS r FROM (SELECT split, b, kind, short, share, unnest(range(first, has)) AS level FROM got)),
    open AS (SELECT split, b, kind, has, first + (SELECT count(*) FROM spare s WHERE s.split = g.split AND s.b = g.b AND s.kind = g.kind AND r <= short) AS t FROM got g),
    bands AS (SELECT split, b, list(kind ORDER BY has, kind) AS rare, max(t) FILTER (kind = 'example') AS te, max(t) FILTER (kind = 'rationale') AS tr, max(t) FILTER (kind = 'mechanism') AS tm FROM open GROUP BY ALL),
    pools AS (SELECT base.split, b, list({{'p': source, 'k': kind, 's': sha, 'i': doc_id}} ORDER BY source, doc_id) AS r FROM base JOIN shares USING (split, band) GROUP BY ALL),
    walk AS (
        SELECT split, 1 AS b, te, tr, tm, []::BIGINT[] AS ids, []::VARCHAR[] AS paths, 0 AS step FROM bands WHERE b = 1
        UNION ALL
        SELECT split, CASE WHEN kind IS NULL THEN b + 1 ELSE b END,
            CASE WHEN kind IS NULL THEN (SELECT te FROM bands n WHERE n.split = m.split AND n.b = m.b + 1) ELSE te - CAST(owed = 'example' AS INT) END,
            CASE WHEN kind IS NULL THEN (SELECT tr FROM bands n WHERE n.split = m.split AND n.b = m.b + 1) ELSE tr - CAST(owed = 'rationale' AS INT) END,
            CASE WHEN kind IS NULL THEN (SELECT tm FROM bands n WHERE n.split = m.split AND n.b = m.b + 1) ELSE tm - CAST(owed = 'mechanism' AS INT) END,
            CASE WHEN kind IS NULL THEN ids ELSE list_append(ids, best.i) END, CASE WHEN kind IS NULL THEN paths ELSE list_append(paths, best.p) END, step + 1
        FROM (SELECT *, CASE WHEN len(mine) > 0 THEN kind WHEN {_OPEN.format(k="free[1].k")} > 0 THEN free[1].k ELSE list_filter(['example', 'rationale', 'mechanism'], lambda k: {_OPEN.format(k="k")} > 0)[1] END AS owed,
                list_sort(list_transform(CASE WHEN len(mine) > 0 THEN mine ELSE free END, lambda x: {{'h': len(list_filter(paths, lambda c: c = x.p)), 's': x.s, 'i': x.i, 'p': x.p}}))[1] AS best
            FROM (SELECT *, list_filter(free, lambda x: x.k = kind) AS mine FROM (SELECT w.*, list_filter(rare, lambda k: {_OPEN.format(k="k").replace("te", "w.te").replace("tr", "w.tr").replace("tm", "w.tm")} > 0)[1] AS kind, list_filter(r, lambda x: NOT list_contains(ids, x.i) AND len(list_filter(paths, lambda c: c = x.p)) < {CAP}) AS free
                FROM walk w JOIN bands USING (split, b) JOIN pools USING (split, b)))) m
        WHERE kind IS NOT NULL OR b < 3)
    SELECT split, doc_id, pick, band, kind FROM (SELECT split, unnest(ids) AS doc_id, CAST(unnest(range(1, len(ids) + 1)) AS INT) AS pick FROM (SELECT split, arg_max(ids, step) AS ids FROM walk GROUP BY split)) JOIN base USING (split, doc_id)
""")
def stratified_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where("text is not null").select(
        "doc_id", "source", T.hash_split(F.col("doc_id").cast("string")).alias("split"), F.expr(_BAND).alias("band"), F.expr(_KIND).alias("kind"), T.order_hash(F.lit(str(SEED)), F.col("source"), F.col("doc_id").cast("string")).alias("sha")
    )
    return select_stratified(rows, TOTALS, path="source", pool=["source", "doc_id"], cap=CAP).select("split", "doc_id", "pick", "band", "kind")
