from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def normal(rows, columns):
    """Rows as sorted tuples of text; doubles to six digits."""
    import math

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "replace") and hasattr(v, "tzinfo") and v.tzinfo:
            v = v.replace(tzinfo=None)
        return str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)
