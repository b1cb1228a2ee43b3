"""Lines of laps that agree: axes from the gate on, the middle lap's distance, and segments of a group with one detour."""

import math

import numpy as np
import pytest

from stintlab.operators import consensus

GATE = (290.0, 0.0, 310.0, 0.0)


def circle(radius=300.0, phase=0.0, n=400, bump=0.0):
    w = phase + np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = radius + bump * np.exp(-(((w % (2 * math.pi)) - 2) ** 2) / 0.002)
    return r * np.cos(w), r * np.sin(w)


def test_an_axis_begins_where_the_lap_crosses_the_gate():
    axis = consensus.axis_of_lap(*circle(phase=1.3), GATE)
    assert axis[0] == pytest.approx(300.0, abs=0.1) and len(axis) == pytest.approx(300 * math.pi, abs=2)
    assert np.abs(np.diff(axis)).std() < 0.01 and axis[1].imag > 0
    # without a crossing, the point nearest to the gate's middle
    away = consensus.axis_of_lap(*circle(phase=1.3), (400.0, -5.0, 400.0, 5.0))
    assert abs(away[0] - 300) < 2.1
    assert consensus.axis_of_lap(*circle(radius=5.0), GATE) is None and consensus.axis_of_lap(*circle(n=11), GATE) is None
    e, n = circle()
    e[3] = math.nan
    assert consensus.axis_of_lap(e, n, GATE) is None


def test_the_middle_lap_decides():
    axis = consensus.axis_of_lap(*circle(), GATE)
    lines = [np.array([complex(*p) for p in zip(*circle(r), strict=True)]) for r in (301, 302, 304, 309, 380)]
    checked, worst, at = consensus.agreement(axis, lines)
    assert checked == 5 and worst == pytest.approx(4.0, abs=0.1)
    assert consensus.agreement(axis, lines[:4])[1] == pytest.approx(2.0, abs=0.2)  # the nearer of the two in the middle
    assert consensus.agreement(axis, lines[:1]) == (0, None, None)
    bumped = consensus.axis_of_lap(*circle(bump=60.0, n=2000), GATE)
    checked, worst, at = consensus.agreement(bumped, lines[:3])
    assert worst == pytest.approx(58.0, abs=2.0) and at == pytest.approx(600.0, abs=60.0)
    plain = np.array([complex(*p) for p in zip(*circle(), strict=True)])
    assert consensus.distances(np.array([0.0 + 0j]), plain)[0] == pytest.approx(300.0, abs=0.1) and consensus.distances(np.array([3 + 4j]), np.array([0j]))[0] == 5.0


def test_a_group_with_one_detour_has_the_segments_of_the_others(spark):
    def stadium(shift=0.0, n=260, detour=False):
        out = []
        for i in range(n):
            p = (shift + i / n * (800 + 200 * math.pi)) % (800 + 200 * math.pi)
            if p < 400:
                x, y = p, -100.0
            elif p < 400 + 100 * math.pi:
                x, y = 400 + 100 * math.sin((p - 400) / 100), -100 * math.cos((p - 400) / 100)
            elif p < 800 + 100 * math.pi:
                x, y = 800 + 100 * math.pi - p, 100.0
            else:
                x, y = -100 * math.sin((p - 800 - 100 * math.pi) / 100), 100 * math.cos((p - 800 - 100 * math.pi) / 100)
            out.append((x, y + (70.0 if detour and 250 < p < 300 else 0.0)))
        return out

    gate = (200.0, -110.0, 200.0, -90.0)
    laps, fixes = [], []
    for group, odd in ((1, None), (2, 5), (3, 1)):  # none, another lap, or the best lap leaves the line
        for lap in range(1, 7):
            laps.append((group, group * 10, lap, 60.0 + lap))
            fixes += [(group * 10, lap, float(i), x, y) for i, (x, y) in enumerate(stadium(200.0 + lap, detour=lap == odd))]
    laps.append((4, 40, 1, 60.0))
    laps = spark.createDataFrame(laps, "group_id long, run_id long, lap_no long, seconds double")
    fixes = spark.createDataFrame(fixes, "run_id long, lap_no long, t double, east double, north double")
    gates = spark.createDataFrame([(g, *gate) for g in (1, 2, 3, 4)], "group_id long, ax double, ay double, bx double, by double")
    found = consensus.group_axes(laps, fixes, gates)
    told = {r.group_id: (r.lap_no, r.checked, r.reason) for r in found.collect()}
    assert told == {1: (1, 5, None), 2: (1, 5, None), 3: (1, 5, consensus.DISAGREES), 4: (1, 0, consensus.NO_AXIS)}
    parts = {}
    for r in consensus.automatic_segments(found).orderBy("segment_id").collect():
        parts.setdefault(r.axis_id, []).append((r.kind, round(r.start_m), round(r.end_m)))
    assert set(parts) == {1, 2} and parts[1] == parts[2]
    assert [k for k, _, _ in parts[1]] == ["straight", "corner", "straight", "corner", "straight"]
    assert parts[1][1][1] == pytest.approx(200, abs=10) and parts[1][1][2] == pytest.approx(200 + 100 * math.pi, abs=10)
    assert consensus.group_axes(laps.limit(0), fixes, gates).collect() == []
