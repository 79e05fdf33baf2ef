"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annolens.llm import byte_bpe, language_id, toxicity
from annolens.llm.base import is_crc_bucket, new_path
from annolens.llm.collocations import collocations
from annolens.llm.embedding_dedup import embedding_dedup
from annolens.llm.exact_dedup import exact_dedup
from annolens.llm.license_scan import license_digest, license_scan
from annolens.llm.packing import pack
from annolens.llm.pii import pii, pii_digest
from annolens.llm.quality_rules import quality_rules
from annolens.llm.resample import resample
from annolens.llm.simhash import simhash_dedup
from annolens.llm.token_files import read_tokens, token_index, write_tokens

BYTE_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), is_crc_bucket("doc_id", 3, 1)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "top_word")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(_table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), digest=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(pii(_table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), is_crc_bucket("doc_id", 4, 2)
    model = language_id.fit(docs, ~held_out)
    return language_id.language_id(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(*byte_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.PATTERN))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_index(read_tokens(spark, path))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_files": op8_token_files,
    "op9_simhash": op9_simhash,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_resample": op11_resample,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # All pairs, so for tables of a few thousand vectors.
    "op10_embedding_dedup": """
        WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
        reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
        least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), counted AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.u LEFT JOIN counted ON vec_id = counted.u
    """,
    "op11_resample": r"""
    WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    texts AS (SELECT 1 AS doc, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 0, row_number() OVER (), NULL, text FROM benchmark),
    split AS (SELECT doc, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    features AS (SELECT doc, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
    hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM features), bits),
    placed AS (SELECT doc, k, b FROM features JOIN hashed USING (f)),
    counts AS (SELECT b, count(*) FILTER (doc = 1) AS s, count(*) FILTER (doc = 0) AS t FROM placed GROUP BY b),
    gains AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
    weighed AS (SELECT k, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (b) WHERE doc = 1 GROUP BY k),
    scored AS (SELECT doc_id, len(w) AS n, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM split LEFT JOIN weighed USING (k) WHERE doc = 1),
    placed_rows AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS eligible FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed_rows
    """,
    "op12_quality_rules": r"""
    WITH texts AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
    split AS (SELECT k, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
    windows AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS three FROM split WHERE len(w) > 2),
    twins AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, three) > 1),
    covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY k),
    rows AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM split LEFT JOIN covered USING (k)),
    tested AS (SELECT *, {'short': n_words < 50, 'repetitive': 100 * n_repeat_words > 50 * n_words, 'symbols': 10 * n_symbols > n_words, 'word_length': word_chars < 2 * n_words OR word_chars > 12 * n_words, 'lines': 100 * n_dup_lines > 30 * n_lines} AS f FROM rows),
    long AS (SELECT source, unnest(['short', 'repetitive', 'symbols', 'word_length', 'lines']) AS rule, unnest([f.short, f.repetitive, f.symbols, f.word_length, f.lines]) AS failed FROM tested WHERE source IS NOT NULL),
    hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS x FROM long GROUP BY ALL),
    sums AS (SELECT rule, count(*) AS h, sum(n) AS docs, sum(n * n) AS docs2, sum(x) / sum(n) AS mean, sum(x * x / n) - sum(x) * sum(x) / sum(n) AS spread FROM hosts GROUP BY rule),
    alike AS (SELECT *, CASE WHEN mean * (1 - mean) > 0 AND docs - docs2 / docs - (h - 1) > 0 THEN least(greatest((spread - mean * (1 - mean) * (h - 1)) / (mean * (1 - mean) * (docs - docs2 / docs - (h - 1))), 1 / 1000001.0::DOUBLE), 1) END AS rho FROM sums),
    priors AS (SELECT rule, mean, coalesce((1 - rho) / rho, 2) AS strength FROM alike),
    verdicts AS (SELECT source, max((x + mean * strength) / (n + strength)) AS host_rate FROM hosts JOIN priors USING (rule) GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.short OR f.repetitive AS base_failed, NOT (f.short OR f.repetitive) AND coalesce(host_rate <= 0.5, true) AS kept, coalesce(host_rate > 0.5, false) AS host_rejected, round(host_rate, 6) AS host_rate
    FROM tested LEFT JOIN verdicts USING (source)
    """,
    "op13_collocations": r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
    phrases AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM split, sizes),
    f AS (SELECT lang, k, p, count(*)::HUGEINT AS a FROM phrases GROUP BY ALL),
    totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
    cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM candidates),
    scored AS (SELECT x.lang, x.p, x.a, x.c, l.a AS l, r.a AS r, 2000000 * x.a // (l.a + r.a) AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.p = x.p[1:x.c] JOIN f r ON r.lang = x.lang AND r.p = x.p[x.c + 1:x.k]),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
    inner_sizes AS (SELECT lang, k, p, a, unnest(range(2, k)) AS size FROM candidates WHERE k > 2),
    parts AS (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: p[i:i + size - 1])) AS p FROM inner_sizes),
    covered AS (SELECT DISTINCT c.lang, c.p FROM candidates c JOIN (SELECT lang, p, max(a) AS longer FROM parts GROUP BY ALL) o ON c.lang = o.lang AND c.p = o.p WHERE 100 * longer >= 80 * c.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM lowest ANTI JOIN covered USING (lang, p))
    SELECT lang, rank, array_to_string(p, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
