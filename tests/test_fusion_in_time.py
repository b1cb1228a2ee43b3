"""Recordings merged in time: coverage, holes, clocks, pieces and segments."""

import pytest

from stintlab.operators import fusion

SIDE = "run_id long, t double, v double"


def told(df):
    return [(r.t, r.v, r.source[0], r.piece) for r in df.orderBy("t", "source").collect()]


def test_gaps_of_one_side_are_filled_by_the_other(spark):
    # the primary has a hole of missing values at 3 and 4 and ends at 8; the other covers 2.5 to 20 but for a gap of its own
    own = spark.createDataFrame([(1, float(t), None if t in (3, 4) else 10.0 + t) for t in range(9)], SIDE)
    other = spark.createDataFrame([(1, t / 2, 100.0 + t) for t in range(5, 25)] + [(1, t / 2, 100.0 + t) for t in range(36, 41)] + [(2, 0.0, 5.0)], SIDE)
    got = told(fusion.merged(own, other).where("run_id = 1"))
    filled = [t for t, _, s, _ in got if s == "o"]
    assert filled == [2.5, 3.0, 3.5, 4.0, 4.5, 8.5, 9.0, 9.5, 10.0, 10.5, 11.0, 11.5, 12.0, 18.0, 18.5, 19.0, 19.5, 20.0]
    assert [t for t, _, s, _ in got if s == "p"] == [0.0, 1.0, 2.0, 5.0, 6.0, 7.0, 8.0]
    assert {p for t, _, _, p in got if t < 13} == {0} and {p for t, _, _, p in got if t > 13} == {1}
    back = told(fusion.merged(own, other, "preferAlternative").where("run_id = 1"))
    assert [t for t, _, s, _ in back if s == "p"] == [0.0, 1.0, 2.0]
    assert {s for _, _, s, _ in told(fusion.merged(own, other, "primaryOnly"))} == {"p"}
    assert told(fusion.merged(own, other).where("run_id = 2")) == [(0.0, 5.0, "o", 0)]
    segments = [(r.segment, r.source, r.start_s, r.end_s, r.n) for r in fusion.fused_segments(fusion.merged(own, other).where("run_id = 1")).orderBy("segment").collect()]
    assert segments == [(0, "primary", 0.0, 2.0, 3), (1, "other", 2.5, 4.5, 5), (2, "primary", 5.0, 8.0, 4), (3, "other", 8.5, 12.0, 8), (4, "other", 18.0, 20.0, 5)]
    with pytest.raises(ValueError, match="no rule"):
        fusion.merged(own, other, "blend")
    assert fusion.merged(own.limit(0), other.limit(0)).collect() == []


def test_clocks_with_an_offset_and_drift(spark):
    rows = spark.createDataFrame([(1, 100.0, 1.0), (2, 100.0, 1.0), (3, 100.0, 1.0), (4, 1.0, 1.0)], SIDE)
    clocks = spark.createDataFrame([(1, 5.0, 1000.0), (2, -5.0, None), (3, 0.0, -2e6)], "run_id long, offset_s double, drift_ppm double")
    assert sorted((r.run_id, r.t) for r in fusion.on_primary_clock(rows, clocks).collect()) == [(1, pytest.approx(105.1)), (2, 95.0)]
