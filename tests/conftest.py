import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata")
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # Spark's Python workers import the package too
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.driver.host": "127.0.0.1",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def catalog(spark, tmp_path):
    from vecloom.sources.catalog import Catalog

    return Catalog(spark, f"file://{tmp_path}/catalog")


def same_rows(got, want) -> None:
    """Equal columns, types of value and rows, in any order; floats to nine digits."""

    def text(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str([text(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)

    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    rows = [sorted(tuple(text(r[c]) for c in names) for r in t.select(names).to_pylist()) for t in (got, want)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of sf0.001 as views."""
    duckdb = pytest.importorskip("duckdb")
    folder = DATA / "sf0.001"
    if not folder.is_dir():
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con
