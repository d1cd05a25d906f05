"""Every registered query gives rows with a stable schema; those with SQL match it at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = sorted(catalog.SQL)


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x if isinstance(x, (bool, int, float)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(x) for x in r]) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_stream_state_matches_batch(spark, tmp_path):
    from tidemark.operators import sessions
    from tidemark.sources import views
    from tidemark.streaming import stateful, windows

    requests = catalog._requests(spark, DATA)
    requests.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    got = {(r.log_index, r.decision) for r in windows.drain(stateful.decide(stream), "append").collect()}
    assert got == {(r.log_index, r.decision) for r in sessions.decide(requests).collect()}
    views.v_log(spark, DATA).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(views.v_log(spark, DATA).schema).parquet(str(tmp_path / "log"))
    last = {r.key: r.value for r in windows.drain(stateful.counters(log), "update").collect()}
    from tidemark.operators import replay

    assert {k: x for k, x in last.items() if x is not None} == {r.key: r.value for r in replay.counters(views.v_log(spark, DATA)).collect()}
