"""Queries over texts: measures, bands, classes, identifiers, distances, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolens.functions import text as T
from annolens.operators.distance import js_divergence
from annolens.operators.leaks import leaks
from annolens.operators.sampling import band_targets, capped_prefix, nested_take, stratified_quota
from annolens.plans.registry import query
from annolens.session import spread, table

SEED = 20260911

# The measures in the oracle's words.
SQL_WORDS = "regexp_extract_all(lower({t}), '[a-z]+(?:[''-][a-z]+)*|[0-9]+')"
SQL_SENTENCES = r"list_filter(regexp_split_to_array({t}, '[.!?]+(?:\s|$)'), lambda x: regexp_matches(x, '\S'))"
SQL_PARAGRAPHS = r"list_filter(regexp_split_to_array({t}, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))"
PROFILE = f"""
    profile AS (
        SELECT * EXCLUDE (w, s, p, bg),
               len(w) AS word_count, len(s) AS sentence_count, len(p) AS paragraph_count,
               len(w) / greatest(1, len(p)) AS words_per_paragraph,
               coalesce(list_max(list_transform(s, lambda x: len({SQL_WORDS.format(t="x")}))), 0) AS max_sentence_words,
               len(w) / greatest(1, len(s)) AS words_per_sentence,
               coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(1, len(w)) AS mean_word_length,
               len(list_filter(w, lambda x: length(x) >= 9)) / greatest(1, len(w)) AS long_word_fraction,
               len(list_filter(w, lambda x: contains(x, '-'))) AS hyphenated_words,
               length(text) - length(replace(text, ';', '')) AS semicolons,
               length(text) - length(replace(text, '(', '')) AS parentheses,
               (len(bg) - len(list_distinct(bg))) / greatest(1, len(w) - 1) AS repeated_bigram_fraction,
               len(list_distinct(w)) / greatest(1, len(w)) AS lexical_diversity
        FROM (SELECT *, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS bg FROM
              (SELECT *, {SQL_WORDS.format(t="text")} AS w, {SQL_SENTENCES.format(t="text")} AS s, {SQL_PARAGRAPHS.format(t="text")} AS p FROM {{source}})))
"""
BAND = "CASE WHEN {n} BETWEEN 20 AND 49 THEN 'short' WHEN {n} BETWEEN 50 AND 99 THEN 'medium' WHEN {n} BETWEEN 100 AND 300 THEN 'long' WHEN {n} < 20 THEN 'below' ELSE 'above' END"
CLASS = r"CASE WHEN regexp_matches({t}, '\be\.g\.|\b(examples?|for instance|such as)\b', 'i') THEN 'example' WHEN regexp_matches({t}, '\b(because|otherwise|so that|in order to|avoid|prevent|ensure|reason|necessary|required|cannot|must)\b', 'i') THEN 'rationale' ELSE 'mechanism' END"
BUCKET = "(('0x' || substr(sha256({t}), 1, 8))::BIGINT % 100)"
SPLIT = f"CASE WHEN {BUCKET} < 50 THEN 'train' WHEN {BUCKET} < 75 THEN 'validation' ELSE 'test' END"
MEASURES = ", ".join(f"round({m}, 6) AS {m}" if "_per_" in m or m.endswith(("fraction", "length", "diversity")) else m for m in T.MEASURES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def profiled(docs: DataFrame) -> DataFrame:
    """docs with the thirteen measures; words, sentences and paragraphs are computed once a row."""
    staged = docs.withColumns({"_w": T.words(F.col("text")), "_s": T.sentence_lengths(F.col("text")), "_p": F.size(T.paragraphs(F.col("text")))})
    return staged.select(*docs.columns, *T.measures(F.col("_w"), F.col("text"), F.col("_s"), F.col("_p")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _wide(df: DataFrame) -> DataFrame:
    """Integers as long, the way SQL counts."""
    return df.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


@query("word_count", f"SELECT doc_id, len({SQL_WORDS.format(t='text')})::BIGINT AS word_count FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("word_count"))


@query("sentence_paragraph_counts", f"SELECT doc_id, len({SQL_SENTENCES.format(t='text')})::BIGINT AS sentence_count, len({SQL_PARAGRAPHS.format(t='text')})::BIGINT AS paragraph_count FROM documents")
def sentence_paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.size(T.sentences(t)).cast("long").alias("sentence_count"), F.size(T.paragraphs(t)).cast("long").alias("paragraph_count"))


@query("style_profile", f"WITH {PROFILE.format(source='documents')} SELECT doc_id, {MEASURES} FROM profile")
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(_rounded(profiled(documents(spark, sf_dir)).select("doc_id", *T.MEASURES)))


@query("style_profile_by_lang", f"WITH {PROFILE.format(source='documents')} SELECT lang, count(*) AS documents, {', '.join(f'round(avg({m}), 6) AS {m}' for m in T.MEASURES)} FROM profile GROUP BY lang")
def style_profile_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiled(documents(spark, sf_dir).select("lang", "text"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), *[F.round(F.avg(m), 6).alias(m) for m in T.MEASURES])


@query("length_band_by_lang", f"SELECT lang, {BAND.format(n='n')} AS band, count(*) AS documents FROM (SELECT lang, len({SQL_WORDS.format(t='text')}) AS n FROM documents) GROUP BY ALL")
def length_band_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("lang", T.length_band(F.size(T.words(F.col("text")))).alias("band")).groupBy("lang", "band").agg(F.count("*").alias("documents"))


@query("repeated_bigrams", f"WITH {PROFILE.format(source='documents')} SELECT source, round(avg(repeated_bigram_fraction), 6) AS repeated_bigram_fraction, round(avg(lexical_diversity), 6) AS lexical_diversity FROM profile GROUP BY source")
def repeated_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = documents(spark, sf_dir).select("source", T.words(F.col("text")).alias("w")).withColumn("b", T.bigrams(F.col("w")))
    n = F.size("w")
    rows = staged.select("source", ((F.size("b") - F.size(F.array_distinct("b"))) / T.at_least_one(n - 1)).alias("r"), (F.size(F.array_distinct("w")) / T.at_least_one(n)).alias("d"))
    return rows.groupBy("source").agg(F.round(F.avg("r"), 6).alias("repeated_bigram_fraction"), F.round(F.avg("d"), 6).alias("lexical_diversity"))


@query("bag_of_words", f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({SQL_WORDS.format(t='text')}) AS word FROM documents) GROUP BY ALL")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("lang", F.explode(T.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("page_identifiers", r"""
    SELECT page_id, len(ids)::BIGINT AS identifiers, array_to_string(list_sort(ids), ' ') AS names FROM (
        SELECT page_id, list_distinct(list_filter(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*'),
               lambda x: contains(x, '_') OR (length(x) > 1 AND regexp_matches(x, '^[A-Z0-9]*[A-Z][A-Z0-9]*$')) OR regexp_matches(x, '[a-z][A-Z]'))) AS ids FROM pages)
""")  # fmt: skip
def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.identifiers(F.col("html")).alias("ids"))
    return rows.select("page_id", F.size("ids").cast("long").alias("identifiers"), F.array_join(F.array_sort("ids"), " ").alias("names"))


@query("functional_classes", f"SELECT 'documents' AS origin, {CLASS.format(t='text')} AS class, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'pages', {CLASS.format(t='html')}, count(*) FROM pages GROUP BY ALL")
def functional_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), T.functional_class(F.col("text")).alias("class"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), T.functional_class(F.col("html")).alias("class"))
    return docs.unionByName(pages).groupBy("origin", "class").agg(F.count("*").alias("n"))


@query("eligibility", r"""
    SELECT doc_id, round(ratio, 6) AS alpha_ratio,
           length(bare) > 0 AND NOT regexp_matches(upper(bare), '^(TODO|FIXME|XXX)') AND NOT regexp_matches(bare, 'generated (file|code)|do not edit', 'i') AND coalesce(ratio, 0) >= 0.45 AS eligible
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare,
                 length(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\P{L}', '', 'g')) / nullif(length(regexp_replace(text, '\s+', '', 'g')), 0) AS ratio FROM documents)
""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.round(T.alpha_ratio(t), 6).alias("alpha_ratio"), T.eligible(t).alias("eligible"))


@query("hash_split", f"SELECT {SPLIT.format(t='source')} AS split, count(*) AS documents FROM documents GROUP BY ALL")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(T.hash_split(F.col("source")).alias("split")).groupBy("split").agg(F.count("*").alias("documents"))


_ORDER = f"sha256('{SEED}:' || source || ':' || doc_id)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.withColumn("split", T.hash_split(F.col("doc_id").cast("string"))).withColumn("sha", T.order_hash(F.lit(str(SEED)), F.col("source"), F.col("doc_id").cast("string")))


@query("capped_prefix_sample", f"""
    WITH rows AS (SELECT doc_id, source, {SPLIT.format(t="doc_id::VARCHAR")} AS split, {_ORDER} AS sha FROM documents),
         capped AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY sha) AS r FROM rows QUALIFY r <= 3)
    SELECT split, source, doc_id FROM capped QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha) <= 15
""")
def capped_prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(spark, sf_dir).select("doc_id", "source", "split", "sha")
    return capped_prefix(rows, "split", "source", "sha", cap=3, take=15).select("split", "source", "doc_id")


_BANDS = ["long", "medium", "short"]


def _quota_oracle(quotas: dict[tuple[str, str], int], cap: int) -> str:
    steps = [f"base AS (SELECT doc_id, source, {BAND.format(n='n')} AS band, class, sha FROM (SELECT doc_id, source, len({SQL_WORDS.format(t='text')}) AS n, {CLASS.format(t='text')} AS class, {_ORDER} AS sha FROM documents))"]
    before = []
    for k, ((band, kind), n) in enumerate(quotas.items()):
        had = " UNION ALL ".join(f"SELECT source FROM s{j}" for j in before) or "SELECT source FROM base WHERE false"
        steps.append(
            f"s{k} AS (SELECT doc_id, source, band, class FROM (SELECT b.*, coalesce(c.n, 0) + row_number() OVER (PARTITION BY b.source ORDER BY sha) - 1 AS key FROM base b"
            f" LEFT JOIN (SELECT source, count(*) AS n FROM ({had}) GROUP BY source) c USING (source) WHERE band = '{band}' AND class = '{kind}') WHERE key < {cap} ORDER BY key, sha LIMIT {n})"
        )
        before.append(k)
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT doc_id, source, band, class FROM s{k}" for k in before)


QUOTAS = {(b, k): n for b, total in band_targets(30, _BANDS).items() for k, n in (("example", 1), ("rationale", 1), ("mechanism", total - 2))}


@query("stratified_quota_sample", _quota_oracle(QUOTAS, 6))
def stratified_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _ordered(spark, sf_dir).select("doc_id", "source", T.length_band(F.size(T.words(t))).alias("band"), T.functional_class(t).alias("class"), "sha")
    return stratified_quota(rows, QUOTAS, path="source", band="band", kind="class", order="sha", cap=6).select("doc_id", "source", "band", "class")


@query("selection_inventory", f"""
    SELECT split, band, count(*) AS eligible, count(*) FILTER (class = 'example') AS example, count(*) FILTER (class = 'mechanism') AS mechanism, count(*) FILTER (class = 'rationale') AS rationale
    FROM (SELECT {SPLIT.format(t="doc_id::VARCHAR")} AS split, {BAND.format(n=f"len({SQL_WORDS.format(t='text')})")} AS band, {CLASS.format(t="text")} AS class FROM documents) GROUP BY split, band
""")
def selection_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = documents(spark, sf_dir).select(T.hash_split(F.col("doc_id").cast("string")).alias("split"), T.length_band(F.size(T.words(t))).alias("band"), T.functional_class(t).alias("class"))
    return rows.groupBy("split", "band").agg(F.count("*").alias("eligible"), *[F.count_if(F.col("class") == c).alias(c) for c in ("example", "mechanism", "rationale")])


@query("nested_take", "SELECT quality, doc_id FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 20")
def balanced_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_take(table(spark, sf_dir, "labels"), "quality", ["doc_id"], 40).select("quality", "doc_id")


@query("split_violations", f"SELECT source, count(DISTINCT s) AS splits FROM (SELECT source, {SPLIT.format(t='source')} AS s FROM documents UNION ALL SELECT source, {SPLIT.format(t='lang')} FROM documents) GROUP BY source HAVING count(DISTINCT s) > 1")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    both = d.select("source", T.hash_split(F.col("source")).alias("s")).unionByName(d.select("source", T.hash_split(F.col("lang")).alias("s")))
    return both.groupBy("source").agg(F.count_distinct("s").alias("splits")).where("splits > 1")


@query("first_rejection", r"""
    SELECT page_id, CASE WHEN length(html) < 200 THEN 'too short' WHEN NOT starts_with(url, 'https://') THEN 'outside the allowed prefix'
                         WHEN contains(lower(html), 'do not edit') THEN 'generated' WHEN length(html) > 20000 THEN 'too large' END AS reason FROM pages
""")
def first_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    reason = (
        F.when(F.length(h) < 200, "too short").when(~F.startswith(F.col("url"), F.lit("https://")), "outside the allowed prefix").when(F.contains(F.lower(h), F.lit("do not edit")), "generated").when(F.length(h) > 20000, "too large")
    )
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


_PAIRS = """
    turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    pairs AS (SELECT conv_id || ':' || turn AS pair_id, text AS reference, next_text AS candidate FROM turns WHERE role = 'user' AND next_role = 'assistant')
"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns right after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return turns.where("role = 'user' and next_role = 'assistant'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), F.col("text").alias("reference"), F.col("next_text").alias("candidate"))


_JS = f"""
    bags AS (SELECT pair_id, 0 AS side, unnest({SQL_WORDS.format(t="candidate")}) AS word FROM pairs UNION ALL SELECT pair_id, 1, unnest({SQL_WORDS.format(t="reference")}) FROM pairs),
    norms AS (SELECT pair_id, greatest(1, len({SQL_WORDS.format(t="candidate")})) AS na, greatest(1, len({SQL_WORDS.format(t="reference")})) AS nb FROM pairs),
    mass AS (SELECT pair_id, word, count(*) FILTER (side = 0) / any_value(na) AS p, count(*) FILTER (side = 1) / any_value(nb) AS q FROM bags JOIN norms USING (pair_id) GROUP BY pair_id, word),
    js AS (SELECT pair_id, coalesce(sum((CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)), 0) AS js FROM norms LEFT JOIN mass USING (pair_id) GROUP BY pair_id)
"""


@query("js_divergence_pairs", f"WITH {_PAIRS}, {_JS} SELECT pair_id, round(js, 9) AS js FROM js")
def js_divergence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js_divergence(turn_pairs(spark, sf_dir), "pair_id", "candidate", "reference").select("pair_id", F.round("js", 9).alias("js"))


def _gaps(pairs: DataFrame) -> DataFrame:
    sides = [profiled(pairs.select("pair_id", F.col(side).alias("text"))).select("pair_id", *[F.col(m).alias(f"{side[0]}_{m}") for m in T.MEASURES]) for side in ("candidate", "reference")]
    return sides[0].join(sides[1], "pair_id")


_GAPS = f"""
    sides AS (SELECT pair_id, 'c' AS side, candidate AS text FROM pairs UNION ALL SELECT pair_id, 'r', reference FROM pairs),
    {PROFILE.format(source="sides")}
"""


@query("measure_gaps", f"WITH {_PAIRS}, {_GAPS} SELECT c.pair_id, {', '.join(f'round(abs(c.{m} - r.{m})::DOUBLE, 6) AS abs_{m}_gap' for m in T.MEASURES)} FROM profile c JOIN profile r ON c.pair_id = r.pair_id AND c.side = 'c' AND r.side = 'r'")
def measure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(turn_pairs(spark, sf_dir)).select("pair_id", *[F.round(F.abs(F.col(f"c_{m}") - F.col(f"r_{m}")).cast("double"), 6).alias(f"abs_{m}_gap") for m in T.MEASURES])


@query("mean_distance_by_band", f"WITH {_PAIRS}, {_JS} SELECT {BAND.format(n=f'len({SQL_WORDS.format(t="reference")})')} AS band, count(*) AS pairs, round(avg(js), 9) AS mean_js FROM pairs JOIN js USING (pair_id) GROUP BY ALL")
def mean_distance_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir)
    bands = pairs.select("pair_id", T.length_band(F.size(T.words(F.col("reference")))).alias("band"))
    joined = bands.join(js_divergence(pairs, "pair_id", "candidate", "reference"), "pair_id")
    return joined.groupBy("band").agg(F.count("*").alias("pairs"), F.round(F.avg("js"), 9).alias("mean_js"))


@query("leak_check", r"""
    WITH lines AS (SELECT DISTINCT item_id, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(trim(l)) > 30),
         docs AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents)
    SELECT doc_id, item_id, count(*) AS lines FROM docs JOIN lines ON contains(body, line) GROUP BY ALL
""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a whole long line of a benchmark item."""
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
