"""A stratified sample by a walk whose every choice depends on the choices before it, over a prefix that provably holds them all.

The walk of a split fills its bands one after the other. In a band the rarest functional class comes first; the next row is the one whose path has the fewest
rows so far, then the least in order; a path never has more than `cap`. A class that the cap leaves without rows takes any row of its band instead.

Rows that the walk can reach, with T rows wanted from a split (all others are cut by ranks that Spark limits on the map side):
* Of each (band, class), rows ordered by (rank in their path, order), the first T * (cap + 1). A row is passed over in favour of all rows before it, but for those
  that are chosen (T at most) and those whose path got rows elsewhere (T paths of `cap` rows each at most).
* Of each band, in the order of the pool, the first (2 T + 1) * (cap + 1), of which `cap` + 1 a path: they hold the first row that is still free, since at most T rows are
  chosen and T paths full. That row's class tells which class a substitute counts for.
So a split's walk is one group of a size that the wanted rows bound, and rows never reach the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.operators.sampling import SHARES, band_targets, type_targets

# Bands in the order in which totals are shared out, and in which a sample fills them.
SHARED = ["short", "medium", "long"]
FILLED = ["long", "medium", "short"]


@dataclass
class _Walk:
    """One split's walk. rows: dicts of place, path, band, kind, order, in the order of the pool."""

    name: str
    cap: int
    had: Counter = field(default_factory=Counter)
    picks: list[int] = field(default_factory=list)

    def free(self, rows: list[dict]) -> list[dict]:
        return [r for r in rows if self.had[r["path"]] < self.cap]

    def take(self, rows: list[dict]) -> dict | None:
        """The next row of these, which leaves them."""
        row = min(self.free(rows), key=lambda r: (self.had[r["path"]], r["order"]), default=None)
        if row:
            rows.remove(row)
            self.had[row["path"]] += 1
            self.picks.append(row["place"])
        return row

    def fill(self, band: str, rows: list[dict], open_: dict[str, int], available: dict[str, int]) -> None:
        rarest_first = sorted(open_, key=lambda kind: (available[kind], kind))
        while kind := next((k for k in rarest_first if open_[k]), None):
            mine = [r for r in rows if r["kind"] == kind]
            if row := self.take(mine):
                rows.remove(row)
            else:
                # The substitute counts for the class of the first free row, or else for the first class that is open.
                first = next(iter(self.free(rows)), None)
                if first is None:
                    raise ValueError(f"{self.name}/{band} cannot be filled with at most {self.cap} rows a path")
                self.take(rows)
                kind = first["kind"] if open_.get(first["kind"]) else next(k for k in open_ if open_[k])
            open_[kind] -= 1


def _reachable(rows: DataFrame, total: Column, split: str, path: str, band: str, kind: str, order: str, pool: list[str], cap: int) -> DataFrame:
    """rows that the walk may look at, as the two prefixes of this module's description."""
    best = Window.partitionBy(split, band, kind, path).orderBy(order)
    level = rows.withColumn("_level", F.row_number().over(best)).where(F.col("_level") <= cap)
    level = level.withColumn("_at", F.row_number().over(Window.partitionBy(split, band, kind).orderBy("_level", order))).where(F.col("_at") <= total * (cap + 1)).drop("_level", "_at")
    first = rows.withColumn("_level", F.row_number().over(Window.partitionBy(split, band, path).orderBy(*pool))).where(F.col("_level") <= cap + 1)
    first = first.withColumn("_at", F.row_number().over(Window.partitionBy(split, band).orderBy(*pool))).where(F.col("_at") <= (2 * total + 1) * (cap + 1)).drop("_level", "_at")
    return level.unionByName(first).dropDuplicates([split, path, *pool])


def select_stratified(rows: DataFrame, totals: dict[str, int], *, path: str = "path", split: str = "split", band: str = "band", kind: str = "kind", order: str = "sha", pool: list[str], cap: int) -> DataFrame:
    """The rows of a stratified sample, `totals` of each split, with `pick`, their place in the walk of their split from 1.

    pool: the columns that put all rows in the order of the pool; with the path they tell rows apart. Rows of other splits, bands and classes take no part, nor do rows with a null
    among these columns. A band that cannot be filled, for want of rows or because of the cap, ends the query with its name; nothing is returned short.
    """
    if any(n < 1 for n in totals.values()) or cap < 1:
        raise ValueError("totals and the rows a path may have are positive")
    wanted = F.element_at(F.create_map(*[x for name, n in totals.items() for x in (F.lit(name), F.lit(n))]), F.col(split))
    known = rows.where(F.col(split).isin(*totals) & F.col(band).isin(*FILLED) & F.col(kind).isin(*SHARES)).dropna(subset=[path, order, *pool])
    reached = _reachable(known, wanted, split, path, band, kind, order, pool, cap)
    # What the whole table has of each class: nine numbers a split.
    held = known.groupBy(F.col(split).alias("_split"), F.concat_ws("/", band, kind).alias("_held")).agg(F.count("*").alias("_n"))
    held = held.groupBy("_split").agg(F.map_from_entries(F.collect_list(F.struct("_held", "_n"))).alias("_available"))
    every = rows.sparkSession.createDataFrame([(name,) for name in totals], "_split string").join(held, "_split", "left")
    sides = reached.withColumn("_split", F.col(split)).groupBy("_split").cogroup(every.groupBy("_split"))

    def walk(mine: pa.Table, counts: pa.Table) -> pa.Table:
        name = counts.column("_split")[0].as_py()
        available = Counter(dict(counts.column("_available")[0].as_py() or {}))
        columns = {"path": path, "band": band, "kind": kind, "order": order}
        mine = mine.sort_by([(c, "ascending") for c in pool])
        found = [{k: row[c] for k, c in columns.items()} | {"place": at} for at, row in enumerate(mine.select(list(dict.fromkeys(columns.values()))).to_pylist())]
        state = _Walk(name, cap)
        shares = band_targets(totals[name], SHARED)
        for b in FILLED:
            here = {k: available[f"{b}/{k}"] for k in SHARES}
            if sum(here.values()) < shares[b]:
                raise ValueError(f"{name}/{b} has fewer rows than the sample asks for")
            state.fill(b, [r for r in found if r["band"] == b], type_targets(shares[b], here), here)
        return mine.drop_columns(["_split"]).take(pa.array(state.picks, pa.int64())).append_column("pick", pa.array(range(1, len(state.picks) + 1), pa.int32()))

    return sides.applyInArrow(walk, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, pick int")
