from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from modelloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture
def part(spark):
    return spark.read.parquet(f"{DATA}/part.parquet")


@pytest.fixture
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


@pytest.fixture
def lineitem(spark):
    return spark.read.parquet(f"{DATA}/lineitem.parquet")


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
