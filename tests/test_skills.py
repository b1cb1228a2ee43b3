"""Skills: every measure, levels by bands and laps, windows of days and trends."""

import pytest
from pyspark.sql import functions as F

from stintlab.operators import skills

CORNER = (
    "session_id long, corner_id long, braking_spread_m double, lift_s double, release_spread_m double, entry_spread_mps double, line_spread_m double, pickup_spread_m double, sequence_loss_s double, "
    "throttle_known long, released long, deceleration_g double, best_deceleration_g double, minimum_mps double, best_minimum_mps double, exit_mps double, best_exit_mps double"
)


def test_bands_and_caps(spark):
    rows = [("liftTiming", 0.05), ("liftTiming", 0.1), ("liftTiming", 0.3), ("liftTiming", 0.9), ("paceConsistency", 3.0), ("nothing", 1.0)]
    df = spark.createDataFrame(rows, "skill string, value double")
    got = [r.x for r in df.select((5 - skills.exceeded(F.col("value"), F.col("skill"))).alias("x")).collect()]
    assert got == [5, 5, 3, 1, 2, None]
    caps = spark.createDataFrame([(n,) for n in (0, 4, 5, 14, 15, 99)], "n long").select(skills.level_cap(F.col("n")).alias("c"))
    assert [r.c for r in caps.collect()] == [3, 3, 4, 4, 5, 5]


def test_measures_of_a_session(spark):
    sessions = spark.createDataFrame([(1, 7, 9, 6, 1.5), (2, 7, 9, 2, None), (3, 8, 9, 4, 0.2), (4, 7, None, 4, 0.3)], "session_id long, car_id long, track_id long, ranked_laps long, lap_spread_s double")
    n = None
    rows = [
        (1, 1, 3.0, 0.2, 5.0, 1.0, 0.5, 4.0, 0.0, 4, 1, 0.9, 1.0, 20.0, 21.0, 30.0, 31.0),
        (1, 2, 5.0, n, 7.0, 2.0, n, 6.0, 0.3, 4, 1, 0.8, 0.85, 22.0, 22.5, 33.0, 33.0),
        (1, 3, 9.0, 0.4, n, 3.0, 0.7, n, n, n, n, n, n, n, n, n, n),
        (2, 1, n, n, n, n, n, n, n, 9, 9, 1.1, 1.2, 25.0, 26.0, 29.0, 35.0),
        (3, 1, n, n, n, n, n, n, n, 2, 0, 1.0, 1.5, n, 40.0, n, n),
        (4, 1, 2.0, n, n, n, n, n, n, n, n, 0.5, 0.6, n, n, n, n),
    ]
    got = {(r.session_id, r.skill): r.value for r in skills.session_measures(sessions, spark.createDataFrame(rows, CORNER)).collect()}
    one = {k: v for (s, k), v in got.items() if s == 1}
    assert one == pytest.approx({
        "brakePointConsistency": 5.0, "liftTiming": 0.3, "brakeReleaseTiming": 6.0, "lineConsistency": 0.6, "throttleReapplication": 5.0, "turnInConsistency": 7.2, "cornerSequenceManagement": 0.15,
        "throttleCommitment": 25.0, "paceConsistency": 1.5,
        # the best of this car at the corner, whichever session showed it: 1.2 g, 26 and 35 m/s at the first
        "brakingEffectiveness": (0.3 + 0.05) / 2, "minimumSpeedControl": 3.6 * (6.0 + 0.5) / 2, "exitSpeedExecution": 3.6 * (5.0 + 0.0) / 2,
    })
    # too few laps or pick-ups for a share, no best without a track, none below zero
    assert (2, "throttleCommitment") not in got and (3, "throttleCommitment") not in got and (4, "brakingEffectiveness") not in got
    assert got[2, "exitSpeedExecution"] == pytest.approx(3.6 * 6.0) and got[4, "brakePointConsistency"] == 2.0 and (2, "paceConsistency") not in got


def test_levels_over_windows_of_days(spark):
    rows = [(d, "liftTiming", v, n) for d, v, n in ((10, 0.05, 9), (9, 0.05, 3), (9, 0.45, 0), (7, 0.05, 5), (5, 0.6, 4), (4, 0.6, 4), (1, 99.0, 50))] + [(10, "paceConsistency", 1.5, 2), (None, "paceConsistency", 9.0, 90), (3, "paceConsistency", 0.1, 1)]
    measures = spark.createDataFrame(rows, "day long, skill string, value double, ranked_laps long")
    got = {r.skill: r for r in skills.skill_levels(measures, []).collect()}
    lift, pace = got["liftTiming"], got["paceConsistency"]
    value = (0.05 * 17 + 0.45) / 18  # a session without laps counts once
    assert lift.value == pytest.approx(value) and (lift.ranked_laps, lift.days, lift.level, lift.confidence, lift.last_day) == (17, 3, 5, "high", 10)
    assert lift.trend == "improving"  # days 5, 4 and 1 were worse
    assert (pace.level, pace.ranked_laps, pace.confidence, pace.trend) == (3, 3, "low", None)
    assert pace.value == pytest.approx((1.5 * 2 + 0.1) / 3)
    assert skills.skill_levels(measures.limit(0), []).collect() == []
