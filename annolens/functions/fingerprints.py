"""Fingerprints of documents and of whole tables as native expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of a table's tree, and children of a node, as powers of two.
LEAF_BITS, NODE_BITS = 12, 6
# What stands between the values of a row, and for a null.
BETWEEN, NULL = "\x1f", "\x00"
# Each match goes on where the one before ended, so that none begins inside a string.
_SEPARATED = r'\G((?:[^",:]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+[,:])'


def canonical_json(document: Column) -> Column:
    """A JSON document with sorted keys at every level and one space behind each comma and colon; null if it is no JSON or repeats a key.

    A VARIANT keeps an object's fields in the order of their names, so spacing, order and the spelling of numbers (1.0 and 1) do not matter. The text is that of Python's
    sorted json.dumps wherever numbers are whole or plain decimals without a closing zero, and strings hold no control characters but those with a short escape.
    """
    return F.regexp_replace(F.to_json(F.try_parse_json(document)), _SEPARATED, "$1 ")


def json_digest(document: Column) -> Column:
    return F.sha2(canonical_json(document), 256)


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's values as text, told apart from each other and from nulls."""
    return F.sha2(F.concat_ws(BETWEEN, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns]), 256)


def fingerprint_tree(rows: DataFrame, key: str, columns: list[str] | None = None, bits: int = LEAF_BITS, node_bits: int = NODE_BITS) -> DataFrame:
    """(level, node, rows, digest): the fingerprints of ranges of a table, of ranges of those, up to the root (level 0, node 0).

    A row's leaf is the range of its key's hash; a leaf's digest is that of the count and of eight sums over its rows' digests, so a task sends 2^bits small rows whatever it read, order and
    repetition of keys cost nothing, and repeated rows count. Nodes hash their children in order. Two tables are equal if their roots are; where they are not, the leaves
    that differ say which rows to look at. An empty table has no leaves and one root.
    """
    columns = columns or rows.columns
    lanes = [F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_{k}") for k in range(8)]
    leaf = F.conv(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit(NULL)), 256), 1, 8), 16, 10).cast("long")
    each = rows.select(F.shiftright(leaf, 32 - bits).alias("node"), row_digest(*columns).alias("_digest")).select("node", *lanes)
    sums = each.groupBy("node").agg(F.count("*").alias("rows"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(8)])
    level = sums.select(F.lit(-(-bits // node_bits)).alias("level"), "node", "rows", F.sha2(F.concat_ws(":", "node", "rows", *[f"_{k}" for k in range(8)]), 256).alias("digest"))
    every = level
    for depth in range(-(-bits // node_bits) - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])
        joined = F.sha2(F.array_join(children, ""), 256).alias("digest")
        parents = level.withColumn("parent", F.shiftright("node", node_bits) if depth else F.lit(0).cast("long"))
        if depth:
            level = parents.groupBy("parent").agg(F.sum("rows").alias("rows"), joined).select(F.lit(depth).alias("level"), F.col("parent").alias("node"), "rows", "digest")
        else:
            level = parents.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), joined).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "rows", "digest")
        every = every.unionByName(level)
    return every


def fingerprint(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest) of a whole table: one row."""
    return fingerprint_tree(rows, key, columns).where("level = 0").select("rows", "digest")


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, rows_a, rows_b) of the leaves in which two tables' trees differ."""
    deepest = lambda t, s: t.where(F.col("level") == t.agg(F.max("level")).first()[0]).select("node", F.col("rows").alias(f"rows_{s}"), F.col("digest").alias(f"digest_{s}"))
    met = deepest(a, "a").join(deepest(b, "b"), "node", "full")
    return met.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("node", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))
