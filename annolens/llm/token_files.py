"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt into ranges of doc_id, encoded in order and written, one file a range. Each row has the
number of its file and the ids before it in that file, so global positions need only the files' totals. ORC keeps
minimum and maximum of doc_id for each stripe and row group and a Bloom filter beside them: readers split files at
stripes and skip what cannot hold the ids they ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolens.llm.base import narrow, slices
from annolens.llm.word_tokens import word_tokenizer

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_GROUP = 1000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> None:
    """Write (doc_id, ids, shard, before) in ascending doc_id order; path must not exist.

    Every document ends with end_id; a null or empty text is that id alone. Null ids come first, rows of one id in the order
    of their texts' hashes. An empty table writes an empty folder of files.
    """
    kind, exact = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"], word_tokenizer(tokenizer).exact
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = word_tokenizer(tokenizer, exact), 0
        for batch in slices(batches):
            ids = [encoder.encode(x) + end for x in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(before + offsets[:-1])], ["doc_id", "ids", "before"])
            before += int(offsets[-1])

    ordered = narrow(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    encoded = ordered.mapInArrow(run, f"doc_id {kind}, ids array<int>, before long").withColumn("shard", F.spark_partition_id())
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """(doc_id, ids, before, shard) as written; filters on doc_id are pushed to stripes, row groups and Bloom filters."""
    schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("before", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each written document; start counts the ids of all documents before it."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).view("<u4"), lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "before", "shard"])

    rows = tokens.select("doc_id", "ids", "before", "shard").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, before long, shard int")
    # One row a file: its last document tells its total. So many rows as there are files, whatever the documents.
    sums = tokens.groupBy("shard").agg(F.max(F.col("before") + F.size("ids")).alias("total"))
    past = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("total").over(past), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
