"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from timbral import plans
from timbral.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in plans.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    key = lambda r: [(v is None, v if isinstance(v, str) else float(v or 0)) for v in r]
    frame = plans.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
    if name not in plans.oracle_sql():
        assert got
        return
    sql = duck.execute(f"select {', '.join(columns)} from ({plans.oracle_sql()[name]})").fetchall()
    assert got == sorted(sql, key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["packet_reassembly", "sequence_holes", "hole_runs"])
def test_ranges_of_a_serial(spark, duck, name, monkeypatch):
    monkeypatch.setattr(catalogue, "RANGE", 8)
    frame = plans.queries()[name](spark, DATA)
    columns = ", ".join(frame.columns)
    sql = duck.execute(f"select {columns} from ({plans.oracle_sql()[name]})").fetchall()
    assert len(sql) > 8 and sorted(map(tuple, frame.collect())) == sorted(sql)


def test_queries_stay_in_the_jvm(spark):
    for name in ("rice_best_param", "packet_reassembly", "crc32_ogg"):
        plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_streaming_holes(spark, tmp_path):
    from timbral.streaming.pages import sequence_holes

    for n, rows in enumerate([[(1, 0), (1, 1), (2, 5)], [(1, 4), (2, 6), (2, 9)]]):
        spark.createDataFrame(rows, "serial bigint, sequence bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = sequence_holes(spark.readStream.schema("serial bigint, sequence bigint").parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 4, 2), (2, 9, 2)]
