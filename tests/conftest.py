import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    s = b.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if v is None or v != v:
        return None
    name = type(v).__name__
    if name.startswith("float") or name == "Decimal":
        return round(float(v), 6) + 0.0
    return int(v) if name.startswith(("int", "uint")) else bool(v) if name.startswith("bool") else v


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(str(tuple(map(plain, r))) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return lambda sql: con.sql(sql).df()
