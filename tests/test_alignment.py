"""Alignment of recordings: all verdicts and reasons, and correlations against plain sums."""

import numpy as np
import pytest

from stintlab.operators import alignment
from stintlab.operators.alignment import Signal, aligned


def speed(t, laps=False):
    return 30 + 10 * np.sin(t / 7.1) + 6 * np.sin(t / 3.3 + 1) if laps is False else 30 + 12 * np.sin(2 * np.pi * t / 40) + 5 * np.sin(4 * np.pi * t / 40)


def wander(n, seed=1):
    """A speed that never repeats, by second."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 20, n + 40)
    for _ in range(2):
        x = np.convolve(x, np.ones(7) / 7, "same")
    return x[20 : n + 20]


def pair(offset=0.0, drift=0.0, n=600, step=0.5, rate=0.7, jump=0.0):
    v = wander(2000)
    t = np.arange(0, n, step)
    primary = Signal(t + 100, np.interp(t, np.arange(2000), v))
    c = np.arange(20, n - 20, rate)
    true = c + offset + drift * c + jump * (c > n / 2)
    return primary, Signal(c, np.interp(true - 100, np.arange(2000), v))


def test_correlations_are_those_of_plain_sums():
    rng = np.random.default_rng(3)
    ta, tb = np.cumsum(rng.uniform(0.5, 1.5, 80)), np.cumsum(rng.uniform(0.5, 1.5, 120))
    ta[40:] += 9  # a gap isn't bridged
    a, b = Signal(ta, rng.normal(0, 1, 80) + 50), Signal(tb, rng.normal(0, 1, 120) + 20)
    r, n = alignment.correlations(a, b, -30.0, 80, 1.0)
    for k in range(80):
        times = ta[0] + np.arange(int(ta[-1] - ta[0]) + 1)
        (x, kx), (y, ky) = a.at(times), b.at(times - 30 + k)
        both = kx & ky
        assert n[k] == both.sum() and not kx[(times > ta[39] + 0.1) & (times < ta[40] - 0.1)].any()
        assert r[k] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1] if both.sum() > 2 else r[k], abs=1e-6)


def test_an_offset_and_its_drift():
    for offset in (103.4, 97.0):
        got = aligned(*pair(offset), offset + 0.5)
        assert (got["status"], got["by_clock"]) == ("aligned", False) and got["offset_s"] == pytest.approx(offset, abs=0.06)
        assert got["drift_ppm"] is None and got["used_windows"] >= 8
    got = aligned(*pair(100.0, 800e-6), None)
    assert got["status"] == "aligned" and got["drift_ppm"] == pytest.approx(800, abs=80)
    assert got["offset_s"] == pytest.approx(100, abs=0.1)


def test_verdicts_and_reasons():
    def verdict(primary, candidate, declared=None):
        got = aligned(primary, candidate, declared)
        return got["status"], got["reason"]

    primary, candidate = pair(100.0)
    none = Signal(np.zeros(0), np.zeros(0))
    assert verdict(primary, none) == ("insufficient", "no speed") == verdict(none, candidate)
    assert verdict(primary, Signal(np.arange(10.0), np.arange(10.0))) == ("insufficient", "too few samples")
    assert verdict(primary, Signal(np.r_[candidate.t[:30], candidate.t[29:]], np.r_[candidate.v[:30], candidate.v[29:]])) == ("insufficient", "times don't increase")
    assert verdict(primary, candidate.part(100, 115)) == ("insufficient", "short overlap")
    noise = Signal(candidate.t, np.random.default_rng(1).normal(0, 1, len(candidate.t)))
    assert verdict(primary, noise) == ("ambiguous", "weak match")
    assert verdict(primary, candidate.part(100, 150)) == ("ambiguous", "too few windows")
    assert verdict(*pair(100.0, jump=1.5)) == ("ambiguous", "windows disagree")
    assert verdict(*pair(100.0, 2500e-6)) == ("ambiguous", "implausible drift")
    assert verdict(primary, candidate, 110.0) == ("conflicting", "declared clock disagrees")
    t = np.arange(0, 600, 0.5)
    lap = Signal(t, speed(t, True)), Signal(t[100:-100] - 7, speed(t[100:-100], True))
    assert verdict(*lap) == ("ambiguous", "repeated match")
    got = aligned(*lap, declared=7.0)
    assert (got["status"], got["by_clock"]) in {("aligned", True), ("conflicting", False)}


def test_tables_of_pairs(spark):
    primary, candidate = pair(103.4)
    rows = [(r, float(t), float(v)) for r, s in ((1, primary), (2, candidate)) for t, v in zip(s.t, s.v, strict=True)] + [(1, 5.0, None), (1, 6.0, float("nan"))]
    speeds = spark.createDataFrame(rows, "run_id long, t double, v double")
    pairs = spark.createDataFrame([(10, 1, 2, 103.0), (11, 1, 3, None), (12, 2, 2, None)], "pair_id long, primary_id long, candidate_id long, declared_s double")
    got = {r.pair_id: r for r in alignment.align_recordings(pairs, speeds).collect()}
    assert got[10].status == "aligned" and got[10].offset_s == pytest.approx(103.4, abs=0.06)
    assert (got[11].status, got[11].reason) == ("insufficient", "no speed")
    assert got[12].offset_s == pytest.approx(0.0, abs=0.02)
    assert alignment.align_recordings(pairs.limit(0), speeds).collect() == []
