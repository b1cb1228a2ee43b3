"""Everything that is measured of a lap in a segment, from one pass over its samples, and what a group makes of it.

A lap's samples are sorted once; each step then meets the segments it touches, and one aggregate by lap and segment takes
times, covered length, speeds and pick-up together. Composites read these rows and never the samples again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators.along import LAP, STEP_M

#: Laps of a sector from which its spread is told.
SPREAD_LAPS = 3


def measured(progress: DataFrame, segments: DataFrame, picked: Column | None = None, max_step_m: float = STEP_M) -> DataFrame:
    """(lap, segment_id, kind, seconds, covered_m, n, entry, least, least_m, greatest, exit, pickup_m, straight_s).

    ``progress`` has a lap's samples (axis_id, run_id, lap_no, t, progress_m, v and whatever ``picked`` reads), ``segments``
    (axis_id, segment_id, kind, start_m, end_m). Seconds are null where a lap doesn't reach both ends going forward in steps of
    at most ``max_step_m``; speeds where it has no sample inside; ``pickup_m`` is the first place in a corner where ``picked``
    holds, ``straight_s`` the time on the straight right after a corner.
    """
    lap = Window.partitionBy(*LAP).orderBy("t")
    rows = progress.withColumns({"p0": F.lag("progress_m").over(lap), "t0": F.lag("t").over(lap)})
    p, p0, t, t0 = (F.col(c) for c in ("progress_m", "p0", "t", "t0"))
    rows = rows.withColumn("step", F.coalesce((p > p0) & (p - p0 <= max_step_m), F.lit(False)))
    after = Window.partitionBy("axis_id").orderBy("start_m")
    known = segments.select(
        "axis_id", "segment_id", "kind", "start_m", "end_m",
        F.when((F.col("kind") == "corner") & (F.lead("kind").over(after) == "straight"), F.lead("segment_id").over(after)).alias("next_id"),
    )
    a, z = F.col("start_m"), F.col("end_m")
    met = rows.join(known, "axis_id").where((p >= a) & (F.when(F.col("step"), p0).otherwise(p) <= z))
    inside = (p >= a) & (p <= z) & F.col("v").isNotNull()

    def passed(mark: Column) -> Column:
        return F.min(F.when(F.col("step") & (mark >= p0) & (mark <= p), t0 + (t - t0) * (mark - p0) / (p - p0)))

    def inside_only(value: Column) -> Column:
        return F.when(inside, value)

    first = F.col("kind") == "corner"
    pick = F.min(F.when(inside & first & picked, p)) if picked is not None else F.lit(None).cast("double")
    out = met.groupBy(*LAP, "segment_id", "kind", "start_m", "next_id").agg(
        passed(a).alias("ts"), passed(z).alias("te"), F.sum(F.when(F.col("step") & (p0 < z) & (p > a), F.least(p, z) - F.greatest(p0, a))).alias("covered_m"), F.count(inside_only(p)).alias("n"),
        F.min_by("v", inside_only(p)).alias("entry"), F.min(inside_only(F.struct("v", "progress_m"))).alias("m"), F.max(inside_only(F.col("v"))).alias("greatest"),
        F.max_by("v", inside_only(p)).alias("exit"), pick.alias("pickup_m"),
    )
    out = out.withColumn("seconds", F.when(F.col("te") > F.col("ts"), F.col("te") - F.col("ts")))
    # the next measured segment is the straight only if it is the one that follows
    next_ = F.lead(F.struct("segment_id", "seconds")).over(Window.partitionBy(*LAP).orderBy("start_m"))
    out = out.withColumn("next", next_).withColumn("straight_s", F.when(F.col("next.segment_id") == F.col("next_id"), F.col("next.seconds")))
    out = out.where("seconds IS NOT NULL OR covered_m IS NOT NULL OR n > 0")
    return out.select(*LAP, "segment_id", "kind", "seconds", "covered_m", "n", "entry", F.col("m.v").alias("least"), F.col("m.progress_m").alias("least_m"), "greatest", "exit", "pickup_m", "straight_s")


def _best_laps(laps: DataFrame) -> DataFrame:
    best = laps.where("seconds IS NOT NULL").groupBy("axis_id").agg(F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"))
    return best.select("axis_id", F.col("b.seconds").alias("best_lap_s"), F.col("b.run_id").alias("best_run"), F.col("b.lap_no").alias("best_lap"))


def outing_best(bundle: DataFrame, segments: DataFrame, laps: DataFrame) -> DataFrame:
    """(axis_id, segment_id, kind, best_s, run_id, lap_no, n, median_s, spread_s, actual_s, loss_s, total_s, best_lap_s, gain_s,
    reason): a group's theoretical best by sector.

    ``bundle`` are measured rows, ``laps`` (axis_id, run_id, lap_no, seconds) the eligible ones. A sector's best is the least
    time of all laps, the first by run and number of equals; ``actual_s`` is the group's best lap's time there. The total is
    withheld, with a reason in every row, where a sector has no time; ``gain_s`` is what the best lap would gain by it.
    """
    own = bundle.join(laps.select(*LAP), LAP, "left_semi").where("seconds IS NOT NULL").select(*LAP, "segment_id", "seconds")
    best = _best_laps(laps)
    rows = own.join(best, "axis_id")
    of_best = (F.col("run_id") == F.col("best_run")) & (F.col("lap_no") == F.col("best_lap"))
    told = rows.groupBy("axis_id", "segment_id").agg(
        F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"), F.count("*").alias("n"), F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max(F.when(of_best, F.col("seconds"))).alias("actual_s"),
    )
    groups = best.select("axis_id", "best_lap_s")
    out = segments.select("axis_id", "segment_id", "kind").join(groups, "axis_id").join(told, ["axis_id", "segment_id"], "left")
    w = Window.partitionBy("axis_id")
    whole = F.count("b").over(w) == F.count("*").over(w)
    total = F.when(whole, F.sum("b.seconds").over(w))
    spread = F.when(F.col("n") >= SPREAD_LAPS, F.col("q")[2] - F.col("q")[0])
    return out.select(
        "axis_id", "segment_id", "kind", F.col("b.seconds").alias("best_s"), "b.run_id", "b.lap_no", F.coalesce("n", F.lit(0)).alias("n"), F.col("q")[1].alias("median_s"), spread.alias("spread_s"),
        "actual_s", (F.col("actual_s") - F.col("b.seconds")).alias("loss_s"), total.alias("total_s"), "best_lap_s", (F.col("best_lap_s") - total).alias("gain_s"), F.when(~whole, "untimed sector").alias("reason"),
    )


def sector_table(bundle: DataFrame, segments: DataFrame, laps: DataFrame) -> DataFrame:
    """(lap, segment_id, seconds, loss_s, total_loss_s, best_of_day): every eligible lap in every sector of its axis, what it lost
    to the fastest there, null where either is untimed, and in all, null where a sector is."""
    best = _best_laps(laps)
    times = bundle.where("seconds IS NOT NULL").join(laps.select(*LAP), LAP, "left_semi").select(*LAP, "segment_id", "seconds")
    fastest = times.groupBy("axis_id", "segment_id").agg(F.min("seconds").alias("fastest"))
    every = laps.select(*LAP).join(segments.select("axis_id", "segment_id"), "axis_id").join(times, [*LAP, "segment_id"], "left").join(fastest, ["axis_id", "segment_id"], "left")
    every = every.join(best, "axis_id", "left").withColumn("loss_s", F.col("seconds") - F.col("fastest"))
    w = Window.partitionBy(*LAP)
    total = F.when(F.count("loss_s").over(w) == F.count("*").over(w), F.sum("loss_s").over(w))
    is_best = (F.col("run_id") == F.col("best_run")) & (F.col("lap_no") == F.col("best_lap"))
    return every.select(*LAP, "segment_id", "seconds", "loss_s", total.alias("total_loss_s"), F.coalesce(is_best, F.lit(False)).alias("best_of_day"))


def focus_inputs(bundle: DataFrame, segments: DataFrame, laps: DataFrame) -> DataFrame:
    """(axis_id, kind, segment_id, run_id, lap_no, value, n): what a driver's focus is chosen from: each ``gap`` of the group's best lap
    to the fastest time of a sector, with the lap that drove it; each ``loss`` of every run's fastest lap against it, where it is
    one; and of each ``corner`` the spread of its times and how many there are. Groups whose best lap isn't timed have none."""
    best = outing_best(bundle, segments, laps)
    ready = best.where("actual_s IS NOT NULL").select("axis_id").distinct()
    gaps = best.where("loss_s IS NOT NULL").select("axis_id", F.lit("gap").alias("kind"), "segment_id", "run_id", "lap_no", F.col("loss_s").alias("value"), F.lit(None).cast("long").alias("n"))
    fastest = laps.groupBy("axis_id", "run_id").agg(F.min(F.struct("seconds", "lap_no")).alias("f")).select("axis_id", "run_id", F.col("f.lap_no").alias("lap_no"))
    reference = best.where("actual_s IS NOT NULL").select("axis_id", "segment_id", "actual_s")
    own = bundle.where("seconds IS NOT NULL").join(fastest, LAP, "left_semi").join(reference, ["axis_id", "segment_id"])
    losses = own.where(F.col("seconds") > F.col("actual_s")).select("axis_id", F.lit("loss").alias("kind"), "segment_id", "run_id", "lap_no", (F.col("seconds") - F.col("actual_s")).alias("value"), F.lit(None).cast("long").alias("n"))
    corners = best.where("kind = 'corner' AND n > 0").select("axis_id", F.lit("corner").alias("kind"), "segment_id", F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("long").alias("lap_no"), F.col("spread_s").alias("value"), "n")
    return gaps.unionByName(losses).unionByName(corners).join(ready, "axis_id", "left_semi")
