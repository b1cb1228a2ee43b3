"""The folder that tasks share: the session's own, a temporary one on one machine, an error on a cluster."""

from types import SimpleNamespace

import pytest

from stintlab.operators import written


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder)))


def test_where_tasks_share_tables(monkeypatch):
    monkeypatch.setattr(written, "_OWN", [])
    assert written.shared_folder(session("spark://x:1", "hdfs://store/shared/")) == "hdfs://store/shared"
    first = written.shared_folder(session("local[4]"))
    assert first.startswith("file:///") and written.shared_folder(session("local")) == first
    with pytest.raises(ValueError, match="all executors share"):
        written.shared_folder(session("spark://x:1"))


def test_written_rows_are_read_again(spark):
    df = spark.range(5).selectExpr("id", "id * 2 AS twice")
    again = written.written(df, "rows")
    assert sorted(tuple(r) for r in again.collect()) == [(i, 2 * i) for i in range(5)] and again.schema.simpleString() == df.schema.simpleString()
    assert "Range" not in again._jdf.queryExecution().executedPlan().toString()
