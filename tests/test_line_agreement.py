"""Distances from a line with circles around its parts against every pair, and a group's laps from one sorted table."""

import numpy as np
import pytest

from stintlab import plans
from stintlab.operators import consensus


def plain(points, line):
    a, d = line[:-1], np.diff(line)
    square = np.abs(d) ** 2
    share = np.clip((np.conj(d) * (points[:, None] - a)).real / np.where(square > 0, square, 1.0), 0.0, 1.0)
    return np.abs(points[:, None] - a - d * share).min(axis=1)


@pytest.mark.parametrize("n", [2, 3, 7, 160, 2500])
def test_distances_are_those_of_all_pairs(n):
    rng = np.random.default_rng(n)
    step = rng.normal(size=n) * 8 + 1j * rng.normal(size=n) * 8
    step[rng.random(n) < 0.1] = 0  # a car that stands
    for line in (np.cumsum(step), np.cumsum(step + 9) * np.exp(0.3j), rng.normal(size=n) * 400 + 1j * rng.normal(size=n)):
        points = np.concatenate((line[::2] + 3j, rng.normal(size=300) * 900 + 1j * rng.normal(size=300) * 900))
        assert np.allclose(consensus.distances(points, line), plain(points, line), rtol=1e-9, atol=1e-9)


def test_few_pairs_are_tried():
    """Ten thousand points of a line of twenty thousand would make 200 million pairs."""
    turn = np.exp(2j * np.pi * np.arange(20_000) / 20_000) * 6000
    assert consensus.distances(turn[::2] * 1.001, turn).max() == pytest.approx(6.0, abs=0.01)


@pytest.mark.parametrize("name", ["line_agreement", "automatic_segments"])
def test_fixes_are_not_broadcast(spark, name):
    plan = plans.registered()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
