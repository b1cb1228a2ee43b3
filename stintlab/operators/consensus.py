"""Automatic segments of a group: an axis from the best lap's own line, begun where it crosses the gate, adopted only if the other
laps' lines agree with it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators import corners
from stintlab.operators.track import nearest_approach
from stintlab.operators.written import sorted_join

#: Fixed values of an axis: metres between fixes, how many must be left, its length, metres and number of its points.
JITTER_M, FIXES, LENGTH_M, SPACING_M, POINTS = 0.5, 12, (50.0, 30_000.0), 2.0, (32, 15_000)
#: Fixed values of agreement: metres between checked places, laps that check at least and at most, and how far the middle one of
#: them may pass.
CHECKED_M, CHECKING, AGREES_M = 5.0, (2, 8), 30.0
DISAGREES, NO_AXIS = "lines disagree", "no axis"


def axis_of_lap(e: np.ndarray, n: np.ndarray, gate: tuple[float, float, float, float]) -> np.ndarray | None:
    """A lap's closed line as complex points at even distances of about two metres, the first where it crosses the gate nearest to
    its middle, else the one nearest to that; None of too few fixes or another length."""
    if len(e) < FIXES or not (np.isfinite(e) & np.isfinite(n)).all():
        return None
    kept = [complex(e[0], n[0])]
    for p in (e + 1j * n)[1:].tolist():
        if abs(p - kept[-1]) >= JITTER_M:
            kept.append(p)
    if len(kept) < FIXES:
        return None
    line = np.array([*kept, kept[0]])
    length = float(np.abs(np.diff(line)).sum())
    if not LENGTH_M[0] <= length <= LENGTH_M[1]:
        return None
    middle = complex((gate[0] + gate[2]) / 2, (gate[1] + gate[3]) / 2)
    crossings = []
    # a step that crosses the gate comes as near to its middle as its ends are
    reach = (np.abs(np.diff(line)) + math.hypot(gate[2] - gate[0], gate[3] - gate[1])) / 2
    for k in np.flatnonzero(np.abs((line[:-1] + line[1:]) / 2 - middle) <= reach + JITTER_M).tolist():
        a, b = complex(line[k]), complex(line[k + 1])
        metres, s, _ = nearest_approach(a.real, a.imag, b.real, b.imag, *gate)
        if metres == 0 and s < 1:
            crossings.append((abs(a + (b - a) * s - middle), k, a + (b - a) * s))
    if crossings:
        _, k, start = min(crossings, key=lambda c: c[:2])
        line = np.concatenate(([start], line[k + 1 : -1], line[: k + 1], [start]))
        line = line[np.append(True, np.abs(np.diff(line)) > 1e-9)]
    along = np.concatenate(([0.0], np.cumsum(np.abs(np.diff(line)))))
    count = min(max(round(length / SPACING_M), POINTS[0]), POINTS[1])
    at = along[-1] * np.arange(count) / count
    points = np.interp(at, along, line.real) + 1j * np.interp(at, along, line.imag)
    return points if crossings else np.roll(points, -int(np.abs(points - middle).argmin()))


def distances(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """How far points lie from an open line's path."""
    if len(line) < 2:
        return np.abs(points - line[0])
    ax, ay, dx, dy = line.real[:-1], line.imag[:-1], np.diff(line.real), np.diff(line.imag)
    square = dx * dx + dy * dy
    scale = 1.0 / np.where(square > 0, square, 1.0)
    ux, uy = dx * scale, dy * scale
    out = np.empty(len(points))
    # neighbouring segments lie in circles; those whose circle is farther than another's far side aren't tried
    size = max(4, math.isqrt(len(dx)) // 3)
    begins = np.arange(0, len(dx), size)
    ends = np.minimum(begins + size, len(dx))
    centre = (line[begins] + line[ends]) / 2
    within = np.array([np.abs(line[a : b + 1] - c).max() for a, b, c in zip(begins, ends, centre, strict=True)])
    for start in range(0, len(points), 256):  # a bounded number of pairs at once
        p = points[start : start + 256]
        away = np.hypot(p.real[:, None] - centre.real, p.imag[:, None] - centre.imag)
        at, circle = np.nonzero(away - within <= ((away + within).min(axis=1) + 1e-6)[:, None])
        k = np.minimum(begins[circle][:, None] + np.arange(size), len(dx) - 1)
        x, y = p.real[at][:, None] - ax[k], p.imag[at][:, None] - ay[k]
        share = np.clip(x * ux[k] + y * uy[k], 0.0, 1.0)
        square = (x - share * dx[k]) ** 2 + (y - share * dy[k]) ** 2
        # pairs are in order of their points, and each point has some
        out[start : start + 256] = np.minimum.reduceat(square.min(axis=1), np.searchsorted(at, np.arange(len(p))))
    return np.sqrt(out)


def agreement(axis: np.ndarray, others: list[np.ndarray]) -> tuple[int, float | None, float | None]:
    """How many laps checked a line, the farthest that the middle one of them passes from it (the nearer of two), and where along it."""
    if len(others) < CHECKING[0]:
        return 0, None, None
    spacing = np.abs(np.diff(np.append(axis, axis[0])))
    stride = max(1, round(CHECKED_M / max(spacing.mean(), 1e-9)))
    checked = axis[::stride]
    away = np.sort(np.stack([distances(checked, line) for line in others]), axis=0)[(len(others) - 1) // 2]
    worst = int(away.argmax())
    return len(others), float(away[worst]), float(np.concatenate(([0.0], np.cumsum(spacing)))[worst * stride])


_AXES = "group_id long, run_id long, lap_no long, checked long, worst_m double, worst_at_m double, reason string, east array<double>, north array<double>"


def group_axes(laps: DataFrame, fixes: DataFrame, gates: DataFrame) -> DataFrame:
    """(group_id, run_id, lap_no, checked, worst_m, worst_at_m, reason, east, north): of each group its best lap, how its line agrees
    with others', and the axis, null with a reason where there is none or most of the others are over 30 m off somewhere.

    ``laps`` are the eligible ones (group_id, run_id, lap_no, seconds), ``fixes`` (run_id, lap_no, t, east, north) in metres around
    one origin a group, ``gates`` (group_id, ax, ay, bx, by). At most eight other laps, spread over their order by run and number,
    leave the tables with the best; with fewer than two the axis is adopted unchecked.
    """
    by = Window.partitionBy("group_id")
    best = laps.groupBy("group_id").agg(F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"))
    rows = sorted_join(laps, best, "group_id").withColumn("best", (F.col("run_id") == F.col("b.run_id")) & (F.col("lap_no") == F.col("b.lap_no")))
    rows = rows.withColumns({"i": F.row_number().over(by.orderBy("best", "run_id", "lap_no")) - 1, "m": F.count("*").over(by) - 1})
    most = CHECKING[1]
    # lap i is taken if it is (k (m - 1)) div 7 of some k: then the least such k gives i back
    k = F.ceil(F.col("i") * (most - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    taken = F.col("best") | (F.col("m") <= most) | (F.floor(k * (F.col("m") - 1) / (most - 1)) == F.col("i"))
    chosen = rows.where(taken).select("group_id", "run_id", "lap_no", "best")
    own = sorted_join(chosen, fixes.select("run_id", "lap_no", "t", "east", "north"), ["run_id", "lap_no"], "left")
    own = own.select(*(F.col(c).alias(c) for c in ("group_id", "run_id", "lap_no", "best", "t", "east", "north")))
    lines = gates.select(*(F.col(c).alias(c) for c in ("group_id", "ax", "ay", "bx", "by")))

    def one(key: tuple, table: pa.Table, gate: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        table = table.sort_by([("best", "descending"), ("run_id", "ascending"), ("lap_no", "ascending"), ("t", "ascending")])
        runs, numbers = (table[c].to_numpy() for c in ("run_id", "lap_no"))
        places = np.column_stack([table[c].to_numpy().astype(float) for c in ("east", "north")])
        best = table["best"].to_numpy()
        cuts = np.flatnonzero((np.diff(runs) != 0) | (np.diff(numbers) != 0) | (best[1:] != best[:-1])) + 1
        line, *others = np.split(places, cuts)
        run, lap = int(runs[0]), int(numbers[0])
        axis = axis_of_lap(line[:, 0], line[:, 1], tuple(gate[c][0].as_py() for c in ("ax", "ay", "bx", "by"))) if gate.num_rows else None
        told: tuple = (0, None, None)
        reason = NO_AXIS if axis is None else None
        if axis is not None:
            whole = [w[np.isfinite(w).all(axis=1)] for w in others]
            told = agreement(axis, [w[:, 0] + 1j * w[:, 1] for w in whole if len(w)])
            reason = DISAGREES if told[1] is not None and told[1] > AGREES_M else None
        good = axis is not None and reason is None
        row = (key[0].as_py(), run, lap, *told, reason, axis.real.tolist() if good else None, axis.imag.tolist() if good else None)
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in _AXES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return own.groupBy("group_id").cogroup(lines.groupBy("group_id")).applyInArrow(one, _AXES)


def axes(adopted: DataFrame) -> DataFrame:
    """The axes of :func:`group_axes` as (axis_id, idx, east, north, cum_m)."""
    rows = adopted.where("east IS NOT NULL").select(F.col("group_id").alias("axis_id"), F.posexplode(F.arrays_zip("east", "north")).alias("idx", "p"))
    rows = rows.select("axis_id", F.col("idx").cast("long").alias("idx"), F.col("p.east").alias("east"), F.col("p.north").alias("north"))
    w = Window.partitionBy("axis_id").orderBy("idx")
    step = F.coalesce(F.hypot(F.col("east") - F.lag("east").over(w), F.col("north") - F.lag("north").over(w)), F.lit(0.0))
    return rows.withColumn("step", step).withColumn("cum_m", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def automatic_segments(adopted: DataFrame) -> DataFrame:
    """(axis_id, segment_id, kind, start_m, end_m, turn_rad): corners and straights of the adopted axes."""
    return corners.proposals(corners.features(axes(adopted)))
