from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from annolens.session import session  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("4", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(frame) -> list[tuple]:
    """Rows of a pandas frame, columns by name, floats rounded, in an order of their own."""

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return round(float(x), 5)
        return x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)
