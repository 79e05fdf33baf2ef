"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm import toxicity
from annolens.llm.base import is_crc_bucket, materialize
from annolens.llm.exact_dedup import exact_dedup
from annolens.llm.near_copies import near_copies
from annolens.llm.packing import pack
from annolens.llm.pii import redacted

TOKENIZER = "word_bpe_49k.json"
#: Dropped or repeated rows up to which their ids are broadcast.
FEW_IDS = 500_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_IDS else rows


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided (doc_id, mark, kept) keeps; mark is a hash of the text, null as empty.

    A decision is one of an id and a text, null ids too: rows that share an id but not a text have their own. Of
    rows that repeat both, one stays. Broadcasts of few rows, of many shuffled joins.
    """
    marked = docs.withColumn("_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = decided.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_its"), "kept")
    same = F.col("_mark").eqNullSafe(F.col("_its")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    dropped = materialize(named.where("not kept").select("_id", "_its").distinct(), "dropped")
    repeated = materialize(named.where("kept").groupBy("_id", "_its").count().where("count > 1").select("_id", "_its"), "repeated")
    kept = marked.join(_few(dropped), same, "left_anti")
    if not repeated.isEmpty():
        repeated = _few(repeated)
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_mark"]))
    return kept.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; it learns from the labelled rows outside the held-out third.

    Null and empty texts give no evidence and stay, as does every row of a table without labels. An empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~is_crc_bucket("doc_id", 3, 1))
    return toxicity.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and one row if that id and text repeat.

    Null and empty texts are equal. Null ids rank below all others; of null ids alone one row stays. An empty table stays empty.
    """
    return without(docs, exact_dedup(docs, mark=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more) the one with the least doc_id stays.

    Null ids rank last, ties of one id go to the least hash of the text, and of rows that repeat both one stays.
    Null, empty and wordless texts are one class. An empty table stays empty.
    """
    return without(docs, near_copies(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes. Null texts stay null, repeated rows and null ids stay rows of their own."""
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null or empty text is its end id alone. An empty table gives no pieces."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
