"""One measuring pass against the operators that measure one thing each, and what a group makes of it."""

import random

import pytest
from pyspark.sql import functions as F

from stintlab.operators import along, measures

PROGRESS = "axis_id long, run_id long, lap_no long, t double, progress_m double, v double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = []
    for axis in (1, 2):
        for run in range(4):
            for lap in range(1, 5):
                t = p = 0.0
                while p < 1000:
                    rows.append((axis, run, lap, t, p, None if rng.random() < 0.05 else round(rng.uniform(10, 60), 2)))
                    t += 1.0
                    p += rng.choice([8.0, 15.0, 30.0, 30.0, 200.0, -2.0]) if rng.random() < 0.2 else 20.0
    segments = [(a, k, "corner" if k % 2 else "straight", 100.0 * k, 100.0 * k + 100 - 10 * (k % 3 == 0)) for a in (1, 2) for k in range(1, 9)] + [(3, 1, "corner", 0.0, 50.0)]
    return spark.createDataFrame(rows, PROGRESS).repartition(3), spark.createDataFrame(segments, "axis_id long, segment_id long, kind string, start_m double, end_m double")


def by(df, *columns):
    return {tuple(r[c] for c in (*along.LAP, "segment_id")): tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def test_one_pass_measures_what_each_operator_does(tables):
    progress, segments = tables
    got = measures.measured(progress, segments, F.col("v") > 50).cache()
    assert by(got.where("seconds is not null"), "seconds") == by(along.segment_times(progress, segments), "seconds")
    speeds = ("n", "entry", "least", "least_m", "greatest", "exit")
    assert by(got.where("n > 0"), *speeds) == by(along.segment_speeds(progress, segments), *speeds)
    assert by(got.where("covered_m is not null"), "covered_m") == by(along.covered(progress, segments), "covered_m")
    picked = progress.join(segments.where("kind = 'corner'"), "axis_id").where("progress_m between start_m and end_m and v > 50").groupBy(*along.LAP, "segment_id").agg(F.min("progress_m").alias("pickup_m"))
    exits = along.exit_metrics(progress, segments, picked)
    corners = got.where("kind = 'corner' and n > 0")
    assert by(corners, "pickup_m", "exit", "straight_s") == by(exits, "pickup_m", "exit_v", "straight_s")
    assert got.where("pickup_m is not null").count() > 10 and got.where("straight_s is not null").count() > 10


def test_a_groups_best_and_its_sector_table(spark, tables):
    progress, segments = tables
    bundle = measures.measured(progress, segments)
    laps = spark.createDataFrame([(a, r, k, 100.0 + 7 * r - k + a) for a in (1, 2) for r in range(3) for k in (1, 2, 3)] + [(3, 1, 1, 50.0)], "axis_id long, run_id long, lap_no long, seconds double")
    times = {k: s for k, (s,) in by(bundle.where("seconds is not null"), "seconds").items() if k[1] < 3 and k[2] < 4}
    best = measures.outing_best(bundle, segments, laps).collect()
    for r in best:
        own = sorted((s, k[1], k[2]) for k, s in times.items() if (k[0], k[3]) == (r.axis_id, r.segment_id))
        assert r.n == len(own)
        if own:
            assert r.best_s == pytest.approx(own[0][0]), own
            assert r.best_s == pytest.approx(times[r.axis_id, r.run_id, r.lap_no, r.segment_id]), own
            assert r.actual_s == pytest.approx(times.get((r.axis_id, 0, 3, r.segment_id)))
    for a in (1, 2, 3):
        rows = [r for r in best if r.axis_id == a]
        whole = all(r.best_s is not None for r in rows)
        assert all((r.total_s is not None) == whole and (r.reason is None) == whole for r in rows)
        if whole:
            assert rows[0].total_s == pytest.approx(sum(r.best_s for r in rows)) and rows[0].gain_s == pytest.approx(rows[0].best_lap_s - rows[0].total_s)
    table = measures.sector_table(bundle, segments, laps).collect()
    assert len(table) == 2 * 9 * 8 + 1
    fastest = {(r.axis_id, r.segment_id): r.best_s for r in best}
    for r in table:
        s = times.get((r.axis_id, r.run_id, r.lap_no, r.segment_id))
        assert r.seconds == pytest.approx(s) and (r.loss_s is None if s is None else r.loss_s == pytest.approx(s - fastest[r.axis_id, r.segment_id], abs=1e-6))
    assert {(r.axis_id, r.run_id, r.lap_no) for r in table if r.best_of_day} == {(1, 0, 3), (2, 0, 3), (3, 1, 1)}


def test_composites_scan_their_samples_once(spark):
    from stintlab.plans import registered

    queries, _ = registered()
    for name in ("coach_plan", "corner_analyzer", "day_reports", "coach_findings", "outing_best", "sector_table"):
        df = queries[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        # what is measured was written: of the samples' tables none is left in the plan
        assert "l_extendedprice" not in plan and plan.count("FileScan parquet") <= 12, name
    one = queries["measured_laps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert one.count("l_extendedprice") > 0 and sum("l_extendedprice" in line and "FileScan" in line for line in one.splitlines()) == 1
    assert measures.measured(spark.createDataFrame([], PROGRESS), spark.createDataFrame([], "axis_id long, segment_id long, kind string, start_m double, end_m double")).collect() == []
