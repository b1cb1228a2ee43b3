"""Quickest chains of groups of which only some passages are looked at."""

import random

import numpy as np
import pytest

from stintlab.operators import sectors

SCHEMA = "group_id long, run_id long, lap_no long, segment int, seconds double, entry double, exit double"


def passages(seed, laps=60, segments=4):
    rng = random.Random(seed)
    for group in (1, 2, None):
        for lap in range(laps):
            for k in range(segments):
                speed = [None if rng.random() < 0.1 else rng.choice([3.0, 3.4, 3.9, 4.6, 6.0, 9.0]) for _ in range(2)]
                yield group, lap % 3, lap, k, rng.choice([float("nan"), None]) if rng.random() < 0.02 else 10 + rng.expovariate(0.2), *speed
    # nothing but whole laps joins, no speed is known, and a segment is missing
    for group, known, missing in ((3, True, False), (4, False, False), (5, True, True)):
        for lap in range(laps):
            for k in range(segments - missing):
                yield group, 0, lap, k, 20.0 + (lap * 7 + k * 5) % 31, *((lap * 100.0 + k, lap * 100.0 + k + 50) if known else (None, None))


def whole(rows, segments, closes):
    own = {}
    for row in rows:
        own.setdefault(row[0], []).append(row)
    out = {}
    for group, held in own.items():
        parts = [sorted((r for r in held if r[3] == k and r[4] is not None and np.isfinite(r[4])), key=lambda r: (r[4], r[1], r[2])) for k in range(segments)]
        got = None
        if any(x is not None for r in held for x in r[5:]):
            nan = [[[np.nan if v is None else v for v in (r[4], r[5], r[6])] for r in p] for p in parts]
            got = sectors.quickest_chain(*([[v[i] for v in p] for p in nan] for i in range(3)), 2 / 3.6, [[r[1] * 1000 + r[2] for r in p] for p in parts], None, closes)
        out[group] = (round(got[0], 6), [p[i][2] for p, i in zip(parts, got[1], strict=True)]) if got else (None, [])
    return out


@pytest.mark.parametrize("closes", [False, True])
def test_chains_are_those_of_all_passages(spark, monkeypatch, closes):
    rows = list(passages(5))
    want = whole(rows, 4, closes)
    for first in (1, 6):
        monkeypatch.setattr(sectors, "FIRST", first)
        got = sectors.realistic_best(spark.createDataFrame(rows, SCHEMA), 4, closes=closes).collect()
        assert {r.group_id: (r.realistic_s and round(r.realistic_s, 6), r.laps) for r in got} == want
    assert [want[g][0] is None for g in (1, 2, None, 3, 4, 5)] == [False, False, False, False, True, True]


def test_a_task_gets_the_passages_that_matter(spark):
    """Two thousand laps, of which the chain's limit leaves a few."""
    rows = [(1, 0, lap, k, 10.0 + lap, 3.0, 3.0) for lap in range(2000) for k in range(3)]
    found = sectors.realistic_best(spark.createDataFrame(rows, SCHEMA), 3)
    assert [tuple(r) for r in found.collect()] == [(1, 30.0, [0, 0, 0])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "most_s" in plan
