"""Exact dedup by progressive refinement, with DataFrame functions alone.

Rows are grouped by length, then those whose length recurs by a hash of their first characters, and only
rows whose (length, prefix hash) recurs are grouped by their full hash. One pass over the texts writes lengths and prefix hashes,
which all steps but the last read. Between the steps the recurring groups travel as a bitmap: one bit for each of `slots`
hashed group keys, eight a row and MOST_SLOTS (32 MB) at most, so what is broadcast has a bound
that does not depend on the data. A bit that two groups share only lets a row through to the next step.
Texts are never shuffled: the full hash is taken where the row is read, and groups are reduced on the map
side, so a group that holds a third of all rows moves one partial row a task; rows meet their groups in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import materialize, narrow

LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28
PREFIX = 64


def slots_for(rows: int) -> int:
    return max(LEAST_SLOTS, min(MOST_SLOTS, 1 << (8 * rows).bit_length()))


def _slot(slots: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)) + 1


def _recurring(rows: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The bitmap of the groups with two rows or more: at most slots / 32768 rows of 4 KB."""
    slot = _slot(slots, *keys)
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )


def _marked(rows: DataFrame, bitmap: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """rows with `recurs`, false if a row's group surely has no other row."""
    slot = _slot(slots, *keys)
    place = F.bitmap_bit_position(slot)
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("place", place)
    joined = rows.join(F.broadcast(bitmap), "bucket", "left")
    byte = F.expr("cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(place % 8 as int)")
    return joined.withColumn("recurs", F.coalesce(F.call_function("getbit", byte, bit) == 1, F.lit(False))).drop("bucket", "place", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX, slots: int | None = None, digest: bool = False, mark: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept [, text_sha256] [, mark]), one row for each input row.

    Of rows with equal texts the one with the largest doc_id stays. A null text equals the empty text.
    Null ids rank below all others; a group of null ids alone keeps them (keep_id null, kept true).
    Repeated rows of one id and text are one document: they share its decision, and each counts in
    group_size. An empty table gives an empty result. Other columns are ignored.
    With digest, text_sha256 is set on all rows, hashed in the one pass over the texts; else only rows that reach the last
    step are hashed, in a second pass. With mark, a 64-bit hash of the text tells rows of one id apart. slots follows
    from the count of rows if it is not given.
    """
    base = narrow(docs, id_col, text_col).withColumns({"size": F.octet_length("text"), "head": F.xxhash64(F.substring("text", 1, prefix))})
    whole = F.unhex(F.sha2("text", 256)).alias("sha")
    extra = [F.xxhash64("text").alias("mark")] * mark
    rows = materialize(base.select("doc_id", "size", "head", *([whole] if digest else []), *extra), "dedup-rows")
    slots = slots or slots_for(rows.count())

    by_size = materialize(_recurring(rows, ["size"], slots), "dedup-sizes")
    by_head = materialize(_recurring(_marked(rows, by_size, ["size"], slots).where("recurs"), ["size", "head"], slots), "dedup-heads")

    def refined(part: DataFrame) -> DataFrame:
        sized = _marked(part, by_size, ["size"], slots).withColumnRenamed("recurs", "sized")
        return _marked(sized, by_head, ["size", "head"], slots).withColumn("recurs", F.col("sized") & F.col("recurs"))

    names = ["text_sha256"] * digest + ["mark"] * mark
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = refined(rows).where("not recurs").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *[hexed] * digest, *["mark"] * mark)
    survivors = refined(rows if digest else base).where("recurs").select("doc_id", "size", "sha" if digest else whole, *(["mark"] * mark if digest else extra))
    survivors = survivors if digest else materialize(survivors, "dedup-survivors")
    # A table of its own, so that the join can split a group that holds many rows.
    groups = materialize(survivors.groupBy("size", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    joined = survivors.join(groups, ["size", "sha"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hexed, *["mark"] * mark)
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", "kept", *names))
