"""Days that change by run: results as if made anew, nothing else read."""

import random

import pytest
from pyspark.sql import types as T

from stintlab.operators import laps
from stintlab.streaming import replaced

LAPS = "group_id long, run_id long, lap_no long, clock double, seconds double, excluded boolean"


def rank(rows):
    told = laps.rank_group(rows).select("group_id", "run_id", "lap_no", "position")
    return rows.join(told, ["group_id", "run_id", "lap_no"], "left")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("group_id", "run_id", "lap_no", "seconds", "position").collect()), key=repr)


def test_a_replaced_run_changes_its_groups_and_reads_no_others(spark, tmp_path):
    rng, folder = random.Random(5), f"file://{tmp_path}/day"
    schema = T._parse_datatype_string(LAPS)
    full = T.StructType([*schema.fields, T.StructField("position", T.IntegerType())])

    def made(run, group, n, scale=1.0):
        return [(group, run, k, float(k), scale * rng.uniform(90, 110), rng.random() < 0.1) for k in range(n)]

    day = {run: made(run, run % 3, 5 + run) for run in range(9)}

    def expected():
        return rows_of(rank(spark.createDataFrame([r for own in day.values() for r in own], schema)))

    first = replaced.replace_runs(spark.createDataFrame([r for own in day.values() for r in own], schema), folder, "v1", rank)
    assert first.read == [] and first.groups == [0, 1, 2]
    assert rows_of(replaced.rankings(spark, folder, full)) == expected()
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    # the same run from another recording: only its own group
    day[4] = made(4, 1, 7, 0.9)
    change = replaced.replace_runs(spark.createDataFrame(day[4], schema), folder, "v2", rank)
    assert change.groups == [1]
    assert len(change.read) == 2 and sorted(p.split("/")[-3] for p in change.read) == ["groups", "runs"]
    assert rows_of(replaced.rankings(spark, folder, full)) == expected()
    told = {(r.change, r.run_id): r.n for r in change.feed.groupBy("change", "run_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert told == {("went", 4): 9, ("came", 4): 7}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    # again with the same token nothing changes, as after a call that was cut off
    replaced.replace_runs(spark.createDataFrame(day[4], schema), folder, "v2", rank)
    assert rows_of(replaced.rankings(spark, folder, full)) == expected()
    # into another group, and one that goes
    day[4] = made(4, 2, 3)
    gone = day.pop(8)
    change = replaced.replace_runs(spark.createDataFrame(day[4], schema), folder, "v3", rank, gone=[8])
    assert change.groups == [1, 2] and gone
    assert rows_of(replaced.rankings(spark, folder, full)) == expected()
    # the last runs of a group go: it has no rows
    for run in (0, 3, 6):
        del day[run]
    replaced.replace_runs(spark.createDataFrame([], schema), folder, "v4", rank, gone=[0, 3, 6])
    assert rows_of(replaced.rankings(spark, folder, full)) == expected()


def test_groups_are_ranked_anew_from_their_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    folder, schema = f"file://{tmp_path}/day", T._parse_datatype_string(LAPS)
    rows = [(g, r, k, float(k), 100.0 - r + k, False) for g in (1, 2) for r in (3 * g, 3 * g + 1) for k in range(3)]
    replaced.replace_runs(spark.createDataFrame(rows, schema), folder, "v1", rank)
    full = T.StructType([*schema.fields, T.StructField("position", T.IntegerType())])

    def without(df):
        return rank(df.withColumn("excluded", F.col("excluded") | (F.col("lap_no") == 0)))

    change = replaced.rerank(spark, folder, "v2", [1], schema, without)
    assert len(change.read) == 1 and "/groups/" in change.read[0]
    got = rows_of(replaced.rankings(spark, folder, full))
    assert {(g, k) for g, _, k, _, p in got if p is None} == {(1, 0)}
    assert sorted(p for g, *_, p in got if g == 1 and p) == [1, 2, 3, 4]


def test_a_call_has_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replaced, "MOST_RUNS", 2)
    rows = spark.createDataFrame([(1, r, 1, 0.0, 90.0, False) for r in range(3)], LAPS)
    with pytest.raises(ValueError, match="at most 2"):
        replaced.replace_runs(rows, f"file://{tmp_path}/x", "v1", rank)
