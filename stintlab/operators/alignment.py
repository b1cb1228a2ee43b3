"""How a second recording of a drive lines up in time with the first, by their speeds: primary time is the candidate's plus an
offset that may drift.

Speeds are correlated at every shift that leaves enough overlap, by Fourier transforms of the values and of where they are
known, then more finely around the best shift. Windows along the overlap are matched on their own near that shift; their
offsets give the offset, its drift and its uncertainty. Two pieces of evidence are kept apart: this match and the clocks that
the loggers declare, which only choose between matches a lap apart, or contradict.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.operators.timeseries import GAP_FACTOR

#: Fixed values of a match: samples of a signal, seconds of overlap, rates of the wide and the close search, reach of the
#: latter, how far a rival lies, how much better the best must be to count fully, and what decides by itself.
SAMPLES, OVERLAP_S, RATES, CLOSE_S, RIVAL_S, UNIQUE, STRONG, DECIDES = 20, 20.0, (1.0, 10.0), 5.0, 5.0, 0.25, 0.8, 0.75
#: Fixed values of windows: the correlation that counts, seconds of one and how many, how far from the whole match; and of a
#: verdict: residual, drift, how far the declared clock may be, and the finest offset.
CORRELATED, WINDOW_S, WINDOWS, NEAR_S = 0.9, 60.0, 8, 10.0
RESIDUAL_S, DRIFT_PPM, DECLARED_S, FINEST_S = 0.3, 1000.0, 2.0, 0.05


class Unmatched(ValueError):
    """Signals that can't be correlated."""


class Signal:
    """Speeds by time; values between samples that a gap parts are unknown."""

    def __init__(self, t: np.ndarray, v: np.ndarray):
        self.t, self.v = t, v
        steps = np.sort(np.diff(t))
        steps = steps[steps > 0]
        self.gap = GAP_FACTOR * steps[len(steps) // 2] if len(steps) else math.inf

    def part(self, a: float, b: float) -> Signal:
        own = (self.t >= a) & (self.t <= b)
        return Signal(self.t[own], self.v[own])

    def check(self) -> None:
        if len(self.t) < SAMPLES:
            raise Unmatched("too few samples")
        if not np.isfinite(self.t).all() or (np.diff(self.t) <= 0).any():
            raise Unmatched("times don't increase")

    def at(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at times and whether they are known."""
        hi = np.clip(np.searchsorted(self.t, times, "left"), 0, len(self.t) - 1)
        lo = np.maximum(hi - 1, 0)
        known = (times >= self.t[0]) & (times <= self.t[-1]) & ((self.t[hi] - self.t[lo] <= self.gap) | (self.t[hi] == times))
        values = np.interp(times, self.t, self.v)
        known &= np.isfinite(values)
        return np.where(known, values, 0.0), known


def correlations(a: Signal, b: Signal, first: float, shifts: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The correlation of a with b at ``shifts`` offsets from ``first`` on, and over how many samples."""
    n = int((a.t[-1] - a.t[0]) / step) + 1
    x, kx = a.at(a.t[0] + np.arange(n) * step)
    y, ky = b.at(a.t[0] + first + np.arange(n + shifts - 1) * step)
    # values around their means, so that sums of squares keep their places
    x = np.where(kx, x - (x[kx].mean() if kx.any() else 0.0), 0.0)
    y = np.where(ky, y - (y[ky].mean() if ky.any() else 0.0), 0.0)
    size = 1 << int(n + shifts).bit_length()

    def wave(z):
        return np.fft.rfft(z, size)

    def met(p, q):
        return np.fft.irfft(np.conj(p) * q, size)[:shifts]

    fx, fy, fkx, fky = wave(x), wave(y), wave(kx.astype(float)), wave(ky.astype(float))
    count = np.rint(met(fkx, fky))
    some = np.maximum(count, 1.0)
    sx, sy = met(fx, fky), met(fkx, fy)
    vx, vy = met(wave(x * x), fky) - sx * sx / some, met(fkx, wave(y * y)) - sy * sy / some
    least = 1e-9 * (1.0 + np.abs(x).max() ** 2 + np.abs(y).max() ** 2)
    good = (count >= 2) & (vx > least) & (vy > least)
    r = np.where(good, (met(fx, fy) - sx * sy / some) / np.sqrt(np.where(good, vx * vy, 1.0)), -1.0)
    return np.clip(r, -1.0, 1.0), count.astype(np.int64)


def _searched(a: Signal, b: Signal, centre: float, reach: float, rate: float, by_evidence: bool) -> dict:
    step = 1.0 / rate
    first = centre - reach
    shifts = int((2 * reach + step / 2) / step) + 1
    r, n = correlations(a, b, first, shifts, step)
    offset = first + np.arange(shifts) * step
    enough = n >= rate * OVERLAP_S + 1
    if enough.any():
        r, n, offset = r[enough], n[enough], offset[enough]
    z = np.where(n > 3, np.arctanh(np.clip(r, -0.999999, 0.999999)) * np.sqrt(np.maximum(n - 3, 0)), -np.inf)
    order = np.argsort(-(z if by_evidence else r), kind="stable")
    best = order[0]
    rivals = order[np.abs(offset[order] - offset[best]) >= RIVAL_S]
    unique = min(max((r[best] - (r[rivals[0]] if len(rivals) else -1.0)) / UNIQUE, 0.0), 1.0)
    strength, length = min(max((r[best] + 1) / 2, 0.0), 1.0), min(1.0, n[best] / (rate * OVERLAP_S))
    confidence = math.floor(100 * strength * (0.35 + 0.4 * unique + 0.25 * length) + 0.5) / 100
    if n[best] < rate * OVERLAP_S + 1 or r[best] < STRONG:
        confidence = min(confidence, DECIDES - 0.01)
    return {"offset": math.floor(offset[best] * 1000 + 0.5) / 1000, "correlation": float(r[best]), "unique": float(unique), "confidence": confidence}


def match(candidate: Signal, primary: Signal) -> dict:
    """Offset, correlation, uniqueness and confidence of the best shift of all."""
    candidate.check()
    primary.check()
    a, b = candidate.t, primary.t
    overlap = min(OVERLAP_S, a[-1] - a[0], b[-1] - b[0])
    low, high = sorted((b[0] - a[-1] + overlap, b[-1] - a[0] - overlap))
    wide = _searched(candidate, primary, (low + high) / 2, max(1.0, (high - low) / 2), RATES[0], True)
    close = _searched(candidate, primary, wide["offset"], CLOSE_S, RATES[1], False)
    # the close search can't vouch for what lies beyond its reach
    return {**close, "unique": min(close["unique"], wide["unique"]), "confidence": min(close["confidence"], wide["confidence"])}


def _line(at: np.ndarray, off: np.ndarray) -> tuple[float, float | None, float]:
    """Offset, drift in ppm if it shows, and how far windows lie from them."""
    if len(off) >= 3:
        spread = at - at.mean()
        slope = float((spread * (off - off.mean())).sum() / (spread**2).sum()) if (spread**2).sum() > 0 else 0.0
        offset = off.mean() - slope * at.mean()
        residual = math.sqrt(((off - offset - slope * at) ** 2).sum() / (len(off) - 2))
        if abs(slope) * (at[-1] - at[0]) >= 2 * max(FINEST_S, residual):
            return float(offset), slope * 1e6, residual
        return float(off.mean()), None, math.sqrt(((off - off.mean()) ** 2).sum() / (len(off) - 1))
    return float(off.mean()), None, float(off.max() - off.min()) / 2


def aligned(primary: Signal, candidate: Signal, declared: float | None) -> dict:
    """The alignment of a candidate to a primary recording: status and reason, offset, drift, uncertainty and evidence."""
    out: dict = {"status": "insufficient", "reason": "", "declared_s": declared, "windows": 0, "used_windows": 0, "by_clock": False}
    if not len(primary.t) or not len(candidate.t):
        return {**out, "reason": "no speed"}
    try:
        whole = match(candidate, primary)
    except Unmatched as e:
        return {**out, "reason": str(e)}
    out |= {k: whole[k] for k in ("correlation", "unique", "confidence")}
    low, high = max(candidate.t[0], primary.t[0] - whole["offset"]), min(candidate.t[-1], primary.t[-1] - whole["offset"])
    out["overlap_s"] = float(max(0.0, high - low))
    if out["overlap_s"] < OVERLAP_S:
        return {**out, "reason": "short overlap"}
    count = min(max(int(out["overlap_s"] / WINDOW_S), 1), WINDOWS)
    width, at, off = out["overlap_s"] / count, [], []
    for k in range(count):
        a, b = low + k * width, low + (k + 1) * width
        try:
            part = match(candidate.part(a, b), primary.part(a + whole["offset"] - NEAR_S, b + whole["offset"] + NEAR_S))
        except Unmatched:
            continue
        if part["correlation"] >= CORRELATED and abs(part["offset"] - whole["offset"]) < NEAR_S:
            at.append((a + b) / 2)
            off.append(part["offset"])
    offset, drift, residual = _line(np.array(at), np.array(off)) if at else (whole["offset"], None, 0.0)
    unsure = max(FINEST_S, residual)
    out |= {"offset_s": offset, "drift_ppm": drift, "uncertainty_s": unsure, "windows": count, "used_windows": len(at)}
    agrees = declared is not None and abs(declared - offset) <= max(DECLARED_S, 3 * unsure)
    if whole["correlation"] < CORRELATED:
        verdict = "ambiguous", "weak match"
    elif len(at) < 2:
        verdict = "ambiguous", "too few windows"
    elif residual > RESIDUAL_S:
        verdict = "ambiguous", "windows disagree"
    elif drift is not None and abs(drift) > DRIFT_PPM:
        verdict = "ambiguous", "implausible drift"
    elif declared is not None and not agrees:
        verdict = "conflicting", "declared clock disagrees"
    elif whole["confidence"] < DECIDES and not agrees:
        verdict = "ambiguous", "repeated match"
    else:
        verdict = "aligned", ""
        out["by_clock"] = whole["confidence"] < DECIDES
    return {**out, "status": verdict[0], "reason": verdict[1]}


_COLUMNS = {
    "status": "string", "reason": "string", "declared_s": "double", "offset_s": "double", "drift_ppm": "double", "uncertainty_s": "double", "correlation": "double", "unique": "double",
    "confidence": "double", "overlap_s": "double", "windows": "long", "used_windows": "long", "by_clock": "boolean",
}


def align_recordings(pairs: DataFrame, speeds: DataFrame) -> DataFrame:
    """A row a pair (pair_id, primary_id, candidate_id, declared_s, which may be null): how the candidate lines up.

    ``speeds`` are (run_id, t, v); a run of many pairs is sent to each. A task holds one pair's speeds. Null and non-finite
    values are left out; samples of equal times stop a match.
    """
    sides = [F.struct(F.lit(c).alias("side"), F.col(f"{c}_id").alias("run_id")) for c in ("primary", "candidate")]
    asked = pairs.select("pair_id", F.explode(F.array(*sides)).alias("s")).select("pair_id", "s.side", "s.run_id")
    known = speeds.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e300").select("run_id", F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    rows = asked.join(known, "run_id").select("pair_id", "side", "t", "v")

    def one(key: tuple, pair: pa.Table, own: pa.Table) -> pa.Table:
        if not pair.num_rows:
            return pa.table({"pair_id": pa.array([], pa.int64()), **{c: pa.array([], t) for c, t in kinds.items()}})
        found = {}
        for side in ("primary", "candidate"):
            part = own.filter(pc.equal(own["side"], side)).sort_by("t")
            found[side] = Signal(part["t"].to_numpy(), part["v"].to_numpy())
        out = aligned(found["primary"], found["candidate"], pair["declared_s"][0].as_py())
        return pa.table({"pair_id": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([out.get(c)], t) for c, t in kinds.items()}})

    kinds = {c: {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[t] for c, t in _COLUMNS.items()}
    schema = "pair_id long, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
    given = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("declared_s").cast("double").alias("declared_s"))
    return given.groupBy("pair_id").cogroup(rows.withColumn("pair_id", F.col("pair_id").cast("long")).groupBy("pair_id")).applyInArrow(one, schema)
