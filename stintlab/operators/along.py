"""Laps along an axis: places and times, coverage, speeds and times of segments and their parts, laps side by side.

A lap is progress(axis_id, run_id, lap_no, t, progress_m) and may carry v; segments are (axis_id, segment_id, kind,
start_m, end_m). Axes meet by axis_id, so tracks of any number are measured at once. A piece is a stretch of a lap
without a step of over ``max_step_m``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAP = ["axis_id", "run_id", "lap_no"]
#: Metres of a gap in coverage, and of a step within which nothing is missing.
GAP_M, STEP_M = 15.0, 150.0
#: Fixed value: how far above its least speed a corner's bottom still counts as flat, as a share.
FLAT = 0.02
#: How far before a corner its braking may begin, a peak of heavy braking in percent, and speeds in metres
#: a second between slow, medium and fast corners.
APPROACH_M, HEAVY, SPEED_BANDS = 200.0, 60.0, (80 / 3.6, 120 / 3.6)


def _order():
    return Window.partitionBy(*LAP).orderBy("t")


def steps(progress: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """Each sample with the one before it in its piece: p0, t0 and, with a speed, v0; only steps forward."""
    w = _order()
    before = {"p0": F.lag("progress_m").over(w), "t0": F.lag("t").over(w)}
    if "v" in progress.columns:
        before["v0"] = F.lag("v").over(w)
    rows = progress.withColumns(before)
    return rows.where((F.col("progress_m") > F.col("p0")) & (F.col("progress_m") - F.col("p0") <= max_step_m))


def coverage_gaps(progress: DataFrame, least_m: float = GAP_M) -> DataFrame:
    """(lap, from_m, to_m): where neighbouring samples of a lap lie at least ``least_m`` apart."""
    rows = progress.withColumn("p0", F.lag("progress_m").over(_order()))
    return rows.where(F.col("progress_m") - F.col("p0") >= least_m).select(*LAP, F.col("p0").alias("from_m"), F.col("progress_m").alias("to_m"))


def covered(progress: DataFrame, segments: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, segment_id, covered_m, length_m): how much of each segment a lap's steps cover."""
    s = segments.select("axis_id", "segment_id", "start_m", "end_m")
    part = F.least("progress_m", "end_m") - F.greatest("p0", "start_m")
    rows = steps(progress, max_step_m).join(s, "axis_id").where("p0 < end_m and progress_m > start_m")
    return rows.groupBy(*LAP, "segment_id").agg(F.sum(part).alias("covered_m"), F.first(F.col("end_m") - F.col("start_m")).alias("length_m"))


def progress_at_time(probes: DataFrame, progress: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """The place at each probe (axis_id, run_id, lap_no, t): probes and samples are merged by time; null outside of a
    piece."""
    marks = progress.select(*LAP, "t", F.struct("t", "progress_m").alias("s"), F.lit(0).alias("probe"))
    asks = probes.select(*LAP, "t", F.lit(None).cast("struct<t:double,progress_m:double>").alias("s"), F.lit(1).alias("probe"))
    w = Window.partitionBy(*LAP)
    both = marks.unionByName(asks).withColumns({
        "a": F.last("s", True).over(w.orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)),
        "b": F.first("s", True).over(w.orderBy("t", F.desc("probe")).rowsBetween(0, Window.unboundedFollowing)),
    })
    width, rise = F.col("b.t") - F.col("a.t"), F.col("b.progress_m") - F.col("a.progress_m")
    between = F.when((width > 0) & (rise >= 0) & (rise <= max_step_m), F.col("a.progress_m") + rise * (F.col("t") - F.col("a.t")) / width)
    value = F.when(F.col("a.t") == F.col("t"), F.col("a.progress_m")).otherwise(between)
    return both.where("probe = 1").select(*LAP, "t", value.alias("progress_m"))


def on_grid(progress: DataFrame, grid_m: float, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, at_m, t and, with a speed, v) on an even grid, linear within steps; the first passage counts."""
    rows = steps(progress, max_step_m)
    first, last = F.ceil(F.col("p0") / grid_m), F.ceil(F.col("progress_m") / grid_m) - 1
    rows = rows.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("k") * F.lit(grid_m)
    share = (at - F.col("p0")) / (F.col("progress_m") - F.col("p0"))
    found = {"t": F.col("t0") + (F.col("t") - F.col("t0")) * share}
    if "v" in progress.columns:
        found["v"] = F.col("v0") + (F.col("v") - F.col("v0")) * share
    out = rows.select(*LAP, at.alias("at_m"), F.struct(*(c.alias(k) for k, c in found.items())).alias("s"))
    out = out.groupBy(*LAP, "at_m").agg(F.min("s").alias("s"))
    return out.select(*LAP, "at_m", *(F.col(f"s.{k}").alias(k) for k in found))


def timed_delta(progress: DataFrame, pairs: DataFrame, grid_m: float, anchor_m: float = 15.0, max_step_m: float = STEP_M) -> DataFrame:
    """(axis_id, a_run, a_lap, b_run, b_lap, at_m, delta_s) of pairs of laps: how much later a is than b, each from its
    own first grid time, which must lie within ``anchor_m`` of the gate."""
    grid = on_grid(progress, grid_m, max_step_m).select(*LAP, "at_m", "t")
    first = Window.partitionBy(*LAP).orderBy("at_m")
    grid = grid.withColumns({"s": F.first("t").over(first), "m": F.first("at_m").over(first)}).where(F.col("m") <= anchor_m)
    grid = grid.select(*LAP, "at_m", (F.col("t") - F.col("s")).alias("d"))
    a = grid.withColumnsRenamed({"run_id": "a_run", "lap_no": "a_lap", "d": "da"})
    b = grid.withColumnsRenamed({"run_id": "b_run", "lap_no": "b_lap", "d": "db"})
    both = pairs.join(a, ["axis_id", "a_run", "a_lap"]).join(b, ["axis_id", "b_run", "b_lap", "at_m"])
    return both.select("axis_id", "a_run", "a_lap", "b_run", "b_lap", "at_m", (F.col("da") - F.col("db")).alias("delta_s"))


def crossings(progress: DataFrame, marks: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, mark_m, t): when a lap first reached each mark (axis_id, mark_m) of its axis, linear within steps."""
    rows = steps(progress, max_step_m).join(marks.select("axis_id", "mark_m").distinct(), "axis_id").where("mark_m >= p0 and mark_m <= progress_m")
    at = F.col("t0") + (F.col("t") - F.col("t0")) * (F.col("mark_m") - F.col("p0")) / (F.col("progress_m") - F.col("p0"))
    return rows.groupBy(*LAP, "mark_m").agg(F.min(at).alias("t"))


def segment_times(progress: DataFrame, segments: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, segment_id, seconds) of the segments whose both ends a lap reaches going forward."""
    marks = segments.select("axis_id", F.explode(F.array("start_m", "end_m")).alias("mark_m"))
    at = crossings(progress, marks, max_step_m)
    s = segments.select("axis_id", "segment_id", "start_m", "end_m")
    rows = s.join(at.withColumnsRenamed({"mark_m": "start_m", "t": "ts"}), ["axis_id", "start_m"])
    rows = rows.join(at.withColumnsRenamed({"mark_m": "end_m", "t": "te"}), [*LAP, "end_m"])
    return rows.where("te > ts").select(*LAP, "segment_id", (F.col("te") - F.col("ts")).alias("seconds"))


def segment_speeds(progress: DataFrame, segments: DataFrame) -> DataFrame:
    """(lap, segment_id, n, entry, least, least_m, greatest, exit): of a lap's samples in a segment, the first of equal
    least ones."""
    rows = progress.join(segments.select("axis_id", "segment_id", "start_m", "end_m"), "axis_id").where("progress_m >= start_m and progress_m <= end_m and v is not null")
    out = rows.groupBy(*LAP, "segment_id").agg(
        F.count("*").alias("n"), F.min_by("v", "progress_m").alias("entry"), F.min(F.struct("v", "progress_m")).alias("m"),
        F.max("v").alias("greatest"), F.max_by("v", "progress_m").alias("exit"),
    )
    return out.select(*LAP, "segment_id", "n", "entry", F.col("m.v").alias("least"), F.col("m.progress_m").alias("least_m"), "greatest", "exit")


def minimum_speed(progress: DataFrame, segments: DataFrame, step_m: float, flat: float = FLAT) -> DataFrame:
    """(lap, segment_id, least, least_m, from_m, to_m, tolerance_m, state): where a corner's speed is least, and the stretch around
    it on which the speed rises by no more than ``flat`` of the corner's range.

    ``progress`` has samples every ``step_m``. The first of equal least speeds counts. State is ``flat speed``, without a place,
    where all are equal, ``at the boundary`` where the stretch reaches the first or the last sample, else ``resolved``. Corners
    that end before they begin cross the gate, where a lap is cut, and aren't looked at.
    """
    rows = progress.join(segments.where("kind = 'corner' and end_m >= start_m").select("axis_id", "segment_id", "start_m", "end_m"), "axis_id")
    rows = rows.where("progress_m >= start_m and progress_m <= end_m and v is not null")
    part = Window.partitionBy(*LAP, "segment_id")
    p, v = F.col("progress_m"), F.col("v")
    rows = rows.withColumns({"m": F.min(F.struct("v", "progress_m")).over(part), "top": F.max("v").over(part), "first_m": F.min(p).over(part), "last_m": F.max(p).over(part)})
    out_of = v > F.col("m.v") + flat * (F.col("top") - F.col("m.v"))
    before, after = p < F.col("m.progress_m"), p > F.col("m.progress_m")
    rows = rows.withColumns({"lo": F.max(F.when(out_of & before, p)).over(part), "hi": F.min(F.when(out_of & after, p)).over(part)})
    kept = rows.where((p > F.coalesce("lo", F.lit(float("-inf")))) & (p < F.coalesce("hi", F.lit(float("inf")))))
    out = kept.groupBy(*LAP, "segment_id").agg(F.first("m").alias("m"), F.first("top").alias("top"), F.first("first_m").alias("first_m"), F.first("last_m").alias("last_m"), F.min(p).alias("from_m"), F.max(p).alias("to_m"))
    told = F.col("top") - F.col("m.v") > 1e-9 * F.greatest(F.lit(1.0), F.abs("top"))
    ends = (F.col("from_m") == F.col("first_m")) | (F.col("to_m") == F.col("last_m"))
    place = F.col("m.progress_m")
    return out.select(
        *LAP, "segment_id", F.col("m.v").alias("least"), F.when(told, place).alias("least_m"), F.when(told, F.col("from_m")).alias("from_m"), F.when(told, F.col("to_m")).alias("to_m"),
        F.when(told, step_m + F.greatest(place - F.col("from_m"), F.col("to_m") - place)).alias("tolerance_m"), F.when(~told, "flat speed").when(ends, "at the boundary").otherwise("resolved").alias("state"),
    )


def exit_metrics(progress: DataFrame, segments: DataFrame, pickups: DataFrame) -> DataFrame:
    """(lap, segment_id, pickup_m, exit_v, straight_s): of each corner, where the throttle came back (rows with lap,
    segment_id, pickup_m), the speed at its end and the time on the straight that follows it."""
    w = Window.partitionBy("axis_id").orderBy("start_m")
    after = segments.withColumns({"next_id": F.lead("segment_id").over(w), "next_kind": F.lead("kind").over(w)}).where("kind = 'corner'")
    speeds = segment_speeds(progress, segments).select(*LAP, "segment_id", F.col("exit").alias("exit_v"))
    times = segment_times(progress, segments).select(*LAP, F.col("segment_id").alias("next_id"), F.col("seconds").alias("straight_s"))
    straights = after.where("next_kind = 'straight'").select("axis_id", "segment_id", "next_id")
    rows = speeds.join(after.select("axis_id", "segment_id"), ["axis_id", "segment_id"]).join(pickups, [*LAP, "segment_id"], "left")
    return rows.join(straights, ["axis_id", "segment_id"], "left").join(times, [*LAP, "next_id"], "left").select(*LAP, "segment_id", "pickup_m", "exit_v", "straight_s")


def placed(events: DataFrame, progress: DataFrame) -> DataFrame:
    """Events (run_id, t and more) with the axis, lap, place and speed of their run's last sample before, in one pass over
    each run's time; those before the first are left out."""
    extra = [c for c in events.columns if c not in ("run_id", "t")]
    at = F.struct("axis_id", "lap_no", "progress_m", "v")
    marks = progress.select("run_id", "t", F.lit(0).alias("o"), at.alias("at"), *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in extra))
    asks = events.select("run_id", "t", F.lit(1).alias("o"), F.lit(None).cast(marks.schema["at"].dataType).alias("at"), *extra)
    back = Window.partitionBy("run_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("at", F.last("at", True).over(back)).where("o = 1 and at is not null")
    return both.select("run_id", "t", *extra, "at.axis_id", "at.lap_no", "at.progress_m", "at.v")


def braking(progress: DataFrame, onsets: DataFrame, segments: DataFrame, approach_m: float = APPROACH_M) -> DataFrame:
    """(lap, segment_id, at_m, seconds, peak, v0): of each lap and corner the last braking (run_id, onset, t1, peak) that
    begins within ``approach_m`` before it or in it, but not in the corner before: where, how long and from what speed."""
    at = placed(onsets.select("run_id", F.col("onset").alias("t"), "t1", "peak"), progress)
    w = Window.partitionBy("axis_id").orderBy("start_m")
    corners = segments.where("kind = 'corner'").withColumn("before", F.coalesce(F.lag("end_m").over(w), F.lit(0.0)))
    corners = corners.select("axis_id", "segment_id", F.greatest("before", F.col("start_m") - approach_m).alias("from_m"), "end_m")
    near = at.join(corners, "axis_id").where("progress_m >= from_m and progress_m <= end_m")
    last = F.row_number().over(Window.partitionBy(*LAP, "segment_id").orderBy(F.desc("t")))
    out = near.withColumn("r", last).where("r = 1")
    return out.select(*LAP, "segment_id", F.col("progress_m").alias("at_m"), (F.col("t1") - F.col("t")).alias("seconds"), "peak", F.col("v").alias("v0"))


def pickups(progress: DataFrame, rises: DataFrame, segments: DataFrame) -> DataFrame:
    """(lap, segment_id, onset, pickup_m): of each lap and corner the first throttle rise (run_id, onset) inside it."""
    at = placed(rises.select("run_id", F.col("onset").alias("t")), progress)
    near = at.join(segments.where("kind = 'corner'").select("axis_id", "segment_id", "start_m", "end_m"), "axis_id").where("progress_m >= start_m and progress_m <= end_m")
    return near.groupBy(*LAP, "segment_id").agg(F.min("t").alias("onset"), F.min_by("progress_m", "t").alias("pickup_m"))


def driving_classes(speeds: DataFrame, brakes: DataFrame, lifts: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """(axis_id, segment_id, driving, n, speed): what most laps do in a corner (heavy braking, braking, lift or flat; the
    first by name of equals), and how fast it is by the median of least speeds. lifts are (lap, segment_id)."""
    keys = [*LAP, "segment_id"]
    rows = speeds.join(brakes.select(*keys, "peak"), keys, "left").join(lifts.select(*keys).distinct().withColumn("lift", F.lit(True)), keys, "left")
    did = F.when(F.col("peak") >= heavy, "heavy braking").when(F.col("peak").isNotNull(), "braking").when(F.col("lift"), "lift").otherwise("flat")
    votes = rows.withColumn("did", did).groupBy("axis_id", "segment_id", "did").agg(F.count("*").alias("n"))
    most = votes.groupBy("axis_id", "segment_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "did")).alias("b"))
    typical = rows.groupBy("axis_id", "segment_id").agg(F.percentile("least", F.lit(0.5)).alias("v"))
    band = F.when(F.col("v") < SPEED_BANDS[0], "slow").when(F.col("v") < SPEED_BANDS[1], "medium").otherwise("fast")
    return most.join(typical, ["axis_id", "segment_id"]).select("axis_id", "segment_id", F.col("b.did").alias("driving"), (-F.col("b.m")).alias("n"), band.alias("speed"))


def parts_of(corners: DataFrame) -> DataFrame:
    """Corners (axis_id, segment_id, start_m, apex_from_m, apex_to_m, end_m) as parts 1 to 3: entry, middle, exit."""
    ends = F.array(F.struct(F.lit(1).alias("part"), F.col("start_m").alias("a"), F.col("apex_from_m").alias("z")), F.struct(F.lit(2).alias("part"), F.col("apex_from_m").alias("a"), F.col("apex_to_m").alias("z")), F.struct(F.lit(3).alias("part"), F.col("apex_to_m").alias("a"), F.col("end_m").alias("z")))
    rows = corners.select("axis_id", "segment_id", F.explode(ends).alias("e"))
    return rows.select("axis_id", "segment_id", "e.part", F.col("e.a").alias("start_m"), F.col("e.z").alias("end_m")).where("end_m > start_m")


def phase_times(progress: DataFrame, parts: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, segment_id, part, seconds) of the parts whose both ends a lap reaches."""
    named = parts.withColumn("key", F.col("segment_id") * 10 + F.col("part"))
    times = segment_times(progress, named.select("axis_id", F.col("key").alias("segment_id"), "start_m", "end_m"), max_step_m)
    return times.select(*LAP, F.floor(F.col("segment_id") / 10).alias("segment_id"), (F.col("segment_id") % 10).cast("int").alias("part"), "seconds")


def phase_reference(times: DataFrame, parts: DataFrame) -> DataFrame:
    """(axis_id, segment_id, part, best_s, run_id, lap_no, total_s): the quickest lap in each part of each corner, and
    the corner's sum, null where a part has no time."""
    best = times.groupBy("axis_id", "segment_id", "part").agg(F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"))
    whole = parts.groupBy("axis_id", "segment_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("axis_id", "segment_id")
    rows = best.join(whole, ["axis_id", "segment_id"])
    total = F.when(F.count("*").over(w) == F.col("n"), F.sum("b.seconds").over(w))
    return rows.select("axis_id", "segment_id", "part", F.col("b.seconds").alias("best_s"), "b.run_id", "b.lap_no", total.alias("total_s"))


def compared(metrics: DataFrame, pairs: DataFrame, keys: list[str], values: list[str], provenance: str | None = None) -> DataFrame:
    """Pairs of laps (axis_id, a_run, a_lap, b_run, b_lap) side by side: of each value a_, b_ and d_ (a less b). A value
    whose sources differ is withheld: its difference is null."""
    names = [*values, *([provenance] if provenance else [])]
    a = metrics.select("axis_id", F.col("run_id").alias("a_run"), F.col("lap_no").alias("a_lap"), *keys, *(F.col(v).alias(f"a_{v}") for v in names))
    b = metrics.select("axis_id", F.col("run_id").alias("b_run"), F.col("lap_no").alias("b_lap"), *keys, *(F.col(v).alias(f"b_{v}") for v in names))
    both = pairs.join(a, ["axis_id", "a_run", "a_lap"]).join(b, ["axis_id", "b_run", "b_lap", *keys])
    same = F.col(f"a_{provenance}").eqNullSafe(F.col(f"b_{provenance}")) if provenance else F.lit(True)
    ds: list[Column] = [F.when(same, F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"d_{v}") for v in values]
    return both.select("axis_id", "a_run", "a_lap", "b_run", "b_lap", *keys, *(c for v in values for c in (f"a_{v}", f"b_{v}")), *ds)


def corner_bundle(times: DataFrame, speeds: DataFrame, exits: DataFrame) -> DataFrame:
    """Everything measured of a lap in a corner as one row: time, speeds, pickup and straight."""
    keys = [*LAP, "segment_id"]
    return times.join(speeds, keys, "full").join(exits, keys, "left").select(*keys, "seconds", "entry", "least", "least_m", "exit", "pickup_m", "straight_s")


def analyzed(bundle: DataFrame, pairs: DataFrame) -> DataFrame:
    """The corner analyzer's rows: a pair of laps, a corner and a measure, with both values and their difference."""
    names = ["seconds", "entry", "least", "least_m", "exit", "pickup_m", "straight_s"]
    wide = compared(bundle, pairs, ["segment_id"], names)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"a_{n}").cast("double").alias("a"), F.col(f"b_{n}").cast("double").alias("b"), F.col(f"d_{n}").cast("double").alias("d")) for n in names)))
    return wide.select("axis_id", "a_run", "a_lap", "b_run", "b_lap", "segment_id", rows.alias("r")).select("axis_id", "a_run", "a_lap", "b_run", "b_lap", "segment_id", "r.*").where("a is not null or b is not null")


def day_corners(times: DataFrame, laps: DataFrame) -> DataFrame:
    """(lap, segment_id, seconds, of_best_lap_s, best_s): a lap in each corner against its axis's best lap there and
    the best of all laps. laps are (lap, seconds), the eligible ones."""
    best = laps.groupBy("axis_id").agg(F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"))
    rows = times.join(laps.select(*LAP), LAP, "left_semi")
    own = rows.join(best, "axis_id").where((F.col("run_id") == F.col("b.run_id")) & (F.col("lap_no") == F.col("b.lap_no"))).select("axis_id", "segment_id", F.col("seconds").alias("of_best_lap_s"))
    least = rows.groupBy("axis_id", "segment_id").agg(F.min("seconds").alias("best_s"))
    return rows.join(least, ["axis_id", "segment_id"]).join(own, ["axis_id", "segment_id"], "left").select(*LAP, "segment_id", "seconds", "of_best_lap_s", "best_s")


def map_layer(progress: DataFrame, laps: DataFrame, most: int = 800) -> DataFrame:
    """(lap, k, progress_m, v): at most ``most`` of each wanted lap's samples at even places of its order, ends kept."""
    rows = progress.join(laps.select(*LAP), LAP, "left_semi").where("v is not null")
    rows = rows.withColumns({"i": F.row_number().over(_order()) - 1, "n": F.count("*").over(Window.partitionBy(*LAP))})
    n = F.col("n")
    # the place of output k is floor(k (n - 1) / (most - 1)), so sample i is kept if some k falls on it
    k = F.ceil(F.col("i") * (most - 1) / F.greatest(n - 1, F.lit(1)))
    kept = (n <= most) | (F.floor(k * (n - 1) / (most - 1)) == F.col("i"))
    return rows.where(kept).select(*LAP, (F.row_number().over(_order()) - 1).alias("k"), "progress_m", "v")


def remeasured(segments: DataFrame, old: DataFrame, new: DataFrame, max_step_m: float = STEP_M) -> DataFrame:
    """(axis_id, segment_id, start_m, end_m): segments of an old axis on a new one: when the lap that both know, given as
    progress on either, passed a boundary on the old axis, and where it was then on the new one; null where it wasn't
    seen."""
    marks = segments.select("axis_id", F.explode(F.array("start_m", "end_m")).alias("mark_m"))
    at = crossings(old, marks, max_step_m)
    there = progress_at_time(at.select(*LAP, "t"), new, max_step_m * 2)
    moved = at.join(there, [*LAP, "t"]).groupBy("axis_id", "mark_m").agg(F.min("progress_m").alias("new_m"))
    rows = segments.select("axis_id", "segment_id", "start_m", "end_m")
    for c in ("start_m", "end_m"):
        rows = rows.join(moved.withColumnsRenamed({"mark_m": c, "new_m": f"new_{c}"}), ["axis_id", c], "left")
    return rows.select("axis_id", "segment_id", F.col("new_start_m").alias("start_m"), F.col("new_end_m").alias("end_m"))
