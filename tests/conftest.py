import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""
    import pandas as pd

    df = df[sorted(df.columns)]

    def show(x):
        if isinstance(x, float) and x == x and x not in (float("inf"), float("-inf")):
            return f"{x:.6f}".rstrip("0").rstrip(".")
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "NULL"
        return str(x)

    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    return canonical
