"""Values between samples, maps in pieces, directions, import choices and focus inputs."""

import pytest
from pyspark.sql import functions as F

from stintlab.functions import units
from stintlab.operators import measures, timeseries, track
from stintlab.sources import intake


def test_values_by_plausible_neighbours(spark):
    rows = [(0.0, 1.0), (1.0, 3.0), (2.0, 0.0), (3.0, 5.0), (4.0, 500.0), (5.0, 7.0), (20.0, 9.0), (21.0, float("nan")), (22.0, 8.0)]
    samples = spark.createDataFrame([(1, "c", t, v) for t, v in rows], "run_id long, channel string, t double, v double")
    asked = [-1.0, 0.0, 0.5, 1.5, 2.0, 2.5, 3.5, 4.0, 5.0, 12.0, 20.0, 21.0, 21.5, 22.0, 23.0]
    probes = spark.createDataFrame([(1, "c", t) for t in asked] + [(2, "c", 1.0)], "run_id long, channel string, t double")

    def told(**kw):
        return {(r.run_id, r.t): r.v for r in timeseries.plausible_at(samples, probes, 0.0, 100.0, **kw).collect()}

    got = told()
    assert [got[1, t] for t in asked] == [None, 1.0, 2.0, 1.5, 0.0, 2.5, None, None, 7.0, None, 9.0, None, None, 8.0, None]
    assert got[2, 1.0] is None
    zero = told(zero_missing=True)
    assert [zero[1, t] for t in (0.5, 1.5, 2.0, 2.5)] == [2.0, None, None, None]


def test_maps_in_pieces(spark):
    rows = [(1, 1, float(t), 10.0 * t, 5.0) for t in range(5)] + [(1, 1, 5.0, None, 1.0)] + [(1, 1, float(t), 10.0 * t, 5.0) for t in (6, 7, 30, 31)] + [(1, 2, 40.0, 0.0, 105.0)]
    got = track.map_pieces(spark.createDataFrame(rows, "run_id long, lap_no long, t double, east double, north double")).collect()
    assert sorted((r.lap_no, r.piece, r.k) for r in got) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 0, 4), (1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 0, 0)]
    by = {(r.lap_no, r.piece, r.k): (r.x, r.y) for r in got}
    # 310 m wide and 100 m high: the width fills the square
    assert by[1, 0, 0] == pytest.approx((0.0, 0.5 + 50 / 310)) and by[1, 2, 1] == pytest.approx((1.0, 0.5 + 50 / 310)) and by[2, 0, 0][1] == pytest.approx(0.5 - 50 / 310)


def test_turns_near_a_direction(spark):
    rows = [(350.0, 10.0), (10.0, 350.0), (725.0, 0.0), (-190.0, 0.0), (180.0, 0.0), (-180.0, 0.0), (5.0, 5.0)]
    df = spark.createDataFrame(rows, "v double, r double").select(units.turns_near(F.col("v"), F.col("r")).alias("x"))
    assert [r.x + 0.0 for r in df.collect()] == [-360.0, 360.0, -720.0, 360.0, -360.0, 360.0, 0.0]


def test_choices_of_an_import(spark):
    cases = {
        1: ({10: 10, 11: 10, 12: 12}, None), 2: ({10: 10, 11: 10, 12: 10}, "too many recordings"), 3: ({10: 11, 11: None, 12: 12}, "target not run"), 4: ({10: 99, 11: 11, 12: 12}, "changed"),
        5: ({10: None, 11: None, 12: None}, "nothing selected"), 6: ({10: -1, 11: 11, 12: 12}, None), 7: ({10: -2, 11: 11, 12: 12}, "too many recordings"), 8: ({10: -1, 11: -1, 12: 12}, "too many recordings"),
        9: ({10: 10, 11: 11}, "changed"), 10: ({10: 10, 11: 11, 12: 12, 13: 13}, "changed"), 11: ({10: 12, 11: 99, 12: 12}, "changed"), 12: ({10: 11, 11: 10, 12: 99}, "target not run"),
    }
    ready = spark.createDataFrame([(b, r) for b in cases for r in (10, 11, 12)], "batch_id long, recording_id long")
    choices = spark.createDataFrame([(b, r, i, g) for b, (c, _) in cases.items() for i, (r, g) in enumerate(c.items())], "batch_id long, recording_id long, ord long, run_id long")
    runs = spark.createDataFrame([(b, r, r == -2) for b in cases for r in (-1, -2)], "batch_id long, run_id long, grouped boolean")
    got = {r.batch_id: r.problem for r in intake.checked_choices(ready, choices, runs).collect()}
    assert got == {b: p for b, (_, p) in cases.items()}


def test_focus_inputs_need_a_timed_best_lap(spark):
    segments = spark.createDataFrame([(a, k, "corner" if k == 1 else "straight", 100.0 * k, 100.0 * k + 100) for a in (1, 2) for k in (1, 2)], "axis_id long, segment_id long, kind string, start_m double, end_m double")
    times = {(1, 1, 1): (10.0, 20.0), (1, 1, 2): (9.0, 22.0), (1, 2, 1): (11.0, 19.5), (2, 1, 1): (None, None), (2, 1, 2): (5.0, None)}
    bundle = spark.createDataFrame([(*k, s, v) for k, own in times.items() for s, v in enumerate(own, 1)], "axis_id long, run_id long, lap_no long, segment_id long, seconds double")
    laps = spark.createDataFrame([(1, 1, 1, 90.0), (1, 1, 2, 91.0), (1, 2, 1, 92.0), (2, 1, 1, 50.0), (2, 1, 2, 60.0)], "axis_id long, run_id long, lap_no long, seconds double")
    got = sorted((r.axis_id, r.kind, r.segment_id, r.run_id, r.lap_no, r.value, r.n) for r in measures.focus_inputs(bundle, segments, laps).collect())
    assert got == [(1, "corner", 1, None, None, 1.0, 3), (1, "gap", 1, 1, 2, 1.0, None), (1, "gap", 2, 2, 1, 0.5, None), (1, "loss", 1, 2, 1, 1.0, None)]
