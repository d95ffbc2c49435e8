import glob
import os

import duckdb
import pytest

from platter.plans.oracles import ORACLES
from platter.plans.queries import QUERIES
from platter.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    want = duck.sql(ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert got == sorted(want, key=repr)


def test_all_have_sql_but_the_piecewise_hash():
    assert set(QUERIES) - set(ORACLES) == {"spamsum"}


def test_stream_gives_what_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream).writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))
