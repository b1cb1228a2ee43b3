"""Driving states from pedal and acceleration channels: onsets, states as intervals, coasting, cooling, car watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators import intervals
from stintlab.operators.timeseries import KEY, episodes, moving_average, with_pieces

#: Fixed on and off levels of each state's channel, and the least duration.
LEVELS = {"braking": (10.0, 5.0), "throttle": (15.0, 8.0), "accelerating": (0.10, 0.05), "cornering": (0.30, 0.20), "moving": (10.0, 9.99)}
MIN_S = 0.2


def onsets(samples: DataFrame, on: float, off: float) -> DataFrame:
    """Where each episode begins: the time at which the channel crossed ``on`` since the sample before, if that lies
    in the same piece, else the first sample's; ``cut`` says that the beginning wasn't seen."""
    keys = [*KEY, "piece"]
    w = Window.partitionBy(*keys).orderBy("t")
    rows = with_pieces(samples).withColumns({"pt": F.lag("t").over(w), "pv": F.lag("v").over(w)}).select(*keys, F.col("t").alias("t0"), "pt", "pv", F.col("v").alias("v0"))
    found = episodes(samples, on, off).join(rows, [*keys, "t0"])
    cross = F.col("pt") + (on - F.col("pv")) / (F.col("v0") - F.col("pv")) * (F.col("t0") - F.col("pt"))
    return found.select(*keys, "episode", F.coalesce(cross, "t0").alias("onset"), F.col("pt").isNull().alias("cut"), "t1", "peak")


def states(channels: dict[str, DataFrame], levels: dict[str, tuple[float, float]] | None = None, min_s: float = MIN_S) -> DataFrame:
    """(run_id, state, t0, t1) from the channel of each state; coasting is moving without braking, throttle or
    cornering."""
    levels = levels or LEVELS
    # all channels at once, so that each is cut into pieces in one pass
    rows, on, off = None, F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, s in channels.items():
        own = s.select("run_id", F.lit(k).alias("channel"), "t", "v")
        rows = own if rows is None else rows.unionByName(own)
        on, off = F.when(F.col("channel") == k, levels[k][0]).otherwise(on), F.when(F.col("channel") == k, levels[k][1]).otherwise(off)
    every = episodes(rows, on, off, min_s).select("run_id", "channel", "t0", "t1")
    found = {k: every.where(F.col("channel") == k).select("run_id", "t0", "t1") for k in channels}
    if "moving" in found:
        busy = None
        for k in ("braking", "throttle", "accelerating", "cornering"):
            if k in found:
                busy = found[k] if busy is None else busy.unionByName(found[k])
        if busy is not None:
            found["coasting"] = intervals.subtract(found["moving"], busy, ["run_id"]).where(F.col("t1") - F.col("t0") >= min_s)
    out = None
    for k, rows in found.items():
        rows = rows.select("run_id", F.lit(k).alias("state"), "t0", "t1")
        out = rows if out is None else out.unionByName(rows)
    return out


def state_shares(found: DataFrame) -> DataFrame:
    """Seconds, number and longest interval of each state."""
    d = F.col("t1") - F.col("t0")
    return found.groupBy("run_id", "state").agg(F.count("*").alias("n"), F.sum(d).alias("seconds"), F.max(d).alias("longest_s"))


def cooling(samples: DataFrame, radius_s: float = 2.5, drop: float = 5.0, least_s: float = 30.0) -> DataFrame:
    """Falls of a smoothed channel, from a local peak to where it rises again, of at least ``drop`` over ``least_s``."""
    keys = [*KEY, "piece"]
    w = Window.partitionBy(*keys).orderBy("t")
    rows = moving_average(samples, radius_s).withColumn("up", F.when(F.round("mean_v", 6) > F.round(F.lag("mean_v").over(w), 6), 1).otherwise(0))
    rows = rows.withColumn("fall", F.sum("up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "fall").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("mean_v").alias("peak"), F.min("mean_v").alias("trough"))
    return out.where((F.col("peak") - F.col("trough") >= drop) & (F.col("t1") - F.col("t0") >= least_s)).drop("fall")


def car_watch(laps: DataFrame, rise: float = 8.0) -> DataFrame:
    """Laps(run_id, ord, value) whose value exceeds that of two laps before by ``rise`` and all laps before."""
    w = Window.partitionBy("run_id").orderBy("ord")
    rows = laps.withColumns({"two": F.lag("value", 2).over(w), "most": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where((F.col("value") - F.col("two") >= rise) & (F.col("value") > F.col("most"))).select("run_id", "ord", "value", (F.col("value") - F.col("two")).alias("rise"))
