"""A listing that comes page by page, as a Spark data source: one partition a page, each read once.

Pages are saved files page-1.json, page-2.json... of one JSON array each, on any file system that Arrow opens by its URI or on a local path. The listing ends with
the first page that is empty or missing, or after `scan` entries, whichever comes first; how many entries a page has does not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annolens.session import pinned

FORMAT = "annolens_pages"


def _read(path: str) -> bytes | None:
    """A file's bytes, or nothing if there is no such file."""
    try:
        if "://" not in path:
            with open(path, "rb") as file:
                return file.read()
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as file:
            return file.read()
    except FileNotFoundError:
        return None


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, folder: str, pages: int):
        self.folder, self.pages = folder, pages

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, self.pages + 1)]

    def read(self, partition: Page) -> Iterator[tuple[int, int, str]]:
        name = f"{self.folder}/page-{partition.number}.json"
        content = _read(name)
        if content is None:
            return
        try:
            entries = json.loads(content)
        except ValueError as e:
            raise ValueError(f"{name} is no JSON: {e}") from None
        if not isinstance(entries, list) or not all(isinstance(x, dict) for x in entries):
            raise ValueError(f"{name} is no array of objects")
        for place, entry in enumerate(entries, 1):
            yield partition.number, place, json.dumps(entry, ensure_ascii=False)


class Pages(DataSource):
    """(page, place, entry) of the first `pages` pages under `path`; entry is the JSON of one object."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page int, place int, entry string"

    def reader(self, schema: object) -> PageReader:
        path, pages = self.options.get("path"), int(self.options.get("pages", "0"))
        if not path or pages < 1:
            raise ValueError("a listing needs a path and a positive number of pages")
        return PageReader(path.rstrip("/"), pages)


def listing(spark: SparkSession, path: str, scan: int, per_page: int = 100) -> DataFrame:
    """(position, page, entry) of the first `scan` entries, positions from 1. per_page: entries that a page has at least, but for the last.

    Pages go to a table as they are read. Where the listing ends, and where each page begins in it, comes from one row a page; entries are never sorted.
    """
    if scan < 1 or per_page < 1:
        raise ValueError("a scan and a page have one entry at least")
    spark.dataSource.register(Pages)
    rows = pinned(spark.read.format(FORMAT).option("path", path).option("pages", -(-scan // per_page)).load())
    order = Window.orderBy("page")
    sizes = rows.groupBy("page").agg(F.count("*").alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "nth": F.row_number().over(order)})
    # Without a gap the k-th page is page k.
    reached = sizes.where("page = nth").select("page", "before")
    return rows.join(reached, "page").select((F.col("before") + F.col("place")).alias("position"), "page", "entry").where(F.col("position") <= scan)
