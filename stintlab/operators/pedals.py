"""What drivers do with pedals, in windows of a run: presses, lifts, pick-ups, coasting, and how a pedal is scaled.

Windows are (run_id, window_id, t0, t1) and don't overlap within a run, so samples find theirs in one pass over time
(:func:`in_windows`), whatever the numbers of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators.timeseries import KEY, with_pieces

#: Events of either kind that judge a pedal's scale, their agreeing share, the lead in seconds, the released
#: share of samples, what an unlabelled fraction may reach, and its least samples and range.
EVENTS, AGREEMENT, LEAD_S, RELEASED, FRACTION, SAMPLES, RANGE = 3, 0.5, 0.5, 0.8, 1.5, 20, 0.2
#: Seconds between samples of a window without a hole, and for which a lift is held.
HOLE_S, HELD_S = 0.5, 0.2
WINDOW = ["run_id", "window_id"]


def in_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """The samples within a window, with window_id, t0 and t1: of all windows that begin before, the last counts."""
    extra = [c for c in samples.columns if c not in ("run_id", "t")]
    marks = windows.select("run_id", F.col("t0").alias("t"), F.lit(0).alias("is_sample"), F.struct("window_id", "t0", "t1").alias("w"), *(F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in extra))
    rows = samples.select("run_id", "t", F.lit(1).alias("is_sample"), F.lit(None).cast(marks.schema["w"].dataType).alias("w"), *extra)
    back = Window.partitionBy("run_id").orderBy("t", "is_sample").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("w", F.last("w", True).over(back)).where("is_sample = 1 and t <= w.t1")
    return both.select("run_id", "t", *extra, "w.window_id", "w.t0", "w.t1")


def longitudinal_runs(samples: DataFrame, sign: int, peak: float, hold: float, seconds: float) -> DataFrame:
    """(run_id, channel, t0, t1): from a sample of at least ``peak`` for as long as none is below ``hold`` or follows a
    gap, if that is ``seconds`` or more."""
    keys = [*KEY, "piece"]
    w = Window.partitionBy(*keys).orderBy("t")
    rows = with_pieces(samples).withColumn("s", F.col("v") * sign)
    rows = rows.withColumn("held", F.when(F.col("s") >= hold, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum(1 - F.col("held")).over(w)).where("held = 1")
    ends = rows.groupBy(*keys, "island").agg(F.min(F.when(F.col("s") >= peak, F.col("t"))).alias("t0"), F.max("t").alias("t1"))
    return ends.where(F.col("t1") - F.col("t0") >= seconds).select(*KEY, "t0", "t1")


def scale_ambiguous(samples: DataFrame) -> DataFrame:
    """(run_id, channel, ambiguous): whether an unlabelled pedal may be a fraction rather than a percentage."""
    out = samples.groupBy(*KEY).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    yes = (F.col("n") >= SAMPLES) & (F.col("hi") <= FRACTION) & (F.col("hi") - F.col("lo") >= RANGE)
    return out.select(*KEY, F.coalesce(yes, F.lit(False)).alias("ambiguous"))


def judged_scale(pedal: DataFrame, pressed: DataFrame, released: DataFrame, on: float, lead_s: float = LEAD_S) -> DataFrame:
    """(run_id, pressed_n, pressed_yes, released_n, released_yes, scale): whether the pedal reads as a fraction: it is at
    ``on`` or more in half of the windows where the car says it is pressed, and below it for most of half of those
    where it is not; ``unknown`` with few windows of either."""

    def counted(windows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        rows = windows.join(found, WINDOW, "left")
        return rows.groupBy("run_id").agg(F.count("*").alias(f"{name}_n"), F.count_if(F.coalesce("yes", F.lit(False))).alias(f"{name}_yes"))

    lead = pressed.select("run_id", "window_id", (F.col("t0") - lead_s).alias("t0"), F.col("t0").alias("t1"))
    hits = in_windows(pedal, pressed).unionByName(in_windows(pedal, lead)).groupBy(*WINDOW).agg((F.max("v") >= on).alias("yes"))
    low = in_windows(pedal, released).where("v is not null").groupBy(*WINDOW).agg((F.count_if(F.col("v") < on) >= RELEASED * F.count("*")).alias("yes"))
    out = counted(pressed, hits, "pressed").join(counted(released, low, "released"), "run_id", "full").na.fill(0)
    enough = (F.col("pressed_n") >= EVENTS) & (F.col("released_n") >= EVENTS)
    agrees = (F.col("pressed_yes") >= AGREEMENT * F.col("pressed_n")) & (F.col("released_yes") >= AGREEMENT * F.col("released_n"))
    return out.withColumn("scale", F.when(enough & agrees, "fraction").otherwise("unknown"))


def off_throttle(throttle: DataFrame, windows: DataFrame, off: float) -> DataFrame:
    """(run_id, window_id, t0, t1, seconds): the longest stretch of a window below ``off``, to the first sample that
    isn't or the window's end; the first of equals."""
    w = Window.partitionBy(*WINDOW).orderBy("t")
    rows = in_windows(throttle.select("run_id", "t", "v"), windows.withColumnRenamed("t1", "end").withColumn("t1", F.col("end")).select("run_id", "window_id", "t0", "t1"))
    below = F.when(F.col("v") < off, 1).otherwise(0)
    rows = rows.withColumns({"below": below, "until": F.coalesce(F.lead("t").over(w), F.col("t1"))}).withColumn("island", F.sum(1 - F.col("below")).over(w)).where("below = 1")
    spans = rows.groupBy(*WINDOW, "island").agg(F.min("t").alias("a"), F.max("until").alias("z"))
    best = spans.groupBy(*WINDOW).agg(F.max(F.struct((F.col("z") - F.col("a")).alias("seconds"), (-F.col("a")).alias("n"), "z")).alias("b"))
    return best.select(*WINDOW, (-F.col("b.n")).alias("t0"), F.col("b.z").alias("t1"), "b.seconds")


def sustained_rise(samples: DataFrame, windows: DataFrame, on: float, off: float, least_s: float) -> DataFrame:
    """(run_id, window_id, t, cut): the first rise to ``on`` after the channel was at ``off`` or below, if it stays at
    ``off`` or above for ``least_s``, by the crossing between two samples; a rise that the window's end cuts counts
    too, and ``cut`` says so."""
    w = Window.partitionBy(*WINDOW).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = in_windows(samples.select("run_id", "t", "v"), windows).where("v is not null")
    rows = rows.withColumn("lifted", F.max(F.when(F.col("v") <= off, 1).otherwise(0)).over(so_far)).where("lifted = 1")
    latch = F.coalesce(F.last(F.when(F.col("v") >= on, 1).when(F.col("v") < off, 0), True).over(so_far), F.lit(0))
    rows = rows.withColumns({"active": latch, "pt": F.lag("t").over(w), "pv": F.lag("v").over(w)})
    begins = F.when((F.col("active") == 1) & (F.coalesce(F.lag("active").over(w), F.lit(0)) == 0), 1).otherwise(0)
    rows = rows.withColumn("begins", begins).withColumns({"rise": F.sum("begins").over(so_far), "nt": F.lead("t").over(w)}).where("active = 1")
    start = F.when(F.col("begins") == 1, F.coalesce(F.col("pt") + (F.col("t") - F.col("pt")) * (on - F.col("pv")) / (F.col("v") - F.col("pv")), F.col("t")))
    out = rows.groupBy(*WINDOW, "rise").agg(F.max(start).alias("at"), F.max(F.coalesce("nt", "t")).alias("end"), F.max(F.col("nt").isNull()).alias("open"))
    out = out.where((F.col("end") - F.col("at") >= least_s) | F.col("open"))
    first = out.groupBy(*WINDOW).agg(F.min(F.struct("at", "end", "open")).alias("b"))
    return first.select(*WINDOW, F.col("b.at").alias("t"), (F.col("b.open") & (F.col("b.end") - F.col("b.at") < least_s)).alias("cut"))


def last_lift(samples: DataFrame, windows: DataFrame, high: float, low: float, held_s: float = HELD_S) -> DataFrame:
    """(run_id, window_id, t): when the pedal was last let go: down to ``low`` for ``held_s`` after it was at ``high``
    since the lift before."""
    w = Window.partitionBy(*WINDOW).orderBy("t")
    rows = in_windows(samples.select("run_id", "t", "v"), windows).where("v is not null")
    down = F.when(F.col("v") <= low, 1).otherwise(0)
    rows = rows.withColumn("down", down).withColumn("island", F.sum(F.when(F.col("down") != F.coalesce(F.lag("down").over(w), F.lit(-1)), 1).otherwise(0)).over(w))
    spans = rows.groupBy(*WINDOW, "island", "down").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.max("v").alias("top"))
    by_time = Window.partitionBy(*WINDOW).orderBy("a")
    long = (F.col("down") == 1) & (F.col("z") - F.col("a") >= held_s)
    spans = spans.withColumn("held", F.when(long, 1).otherwise(0))
    # a held lift counts if the pedal was high since the held one before it
    spans = spans.withColumn("turn", F.coalesce(F.sum("held").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    high_yet = F.max(F.when(F.col("top") >= high, 1).otherwise(0)).over(Window.partitionBy(*WINDOW, "turn").orderBy("a"))
    found = spans.withColumn("high", high_yet).where("held = 1 and high = 1")
    return found.groupBy(*WINDOW).agg(F.max("a").alias("t"))


def pickup_then_lift(throttle: DataFrame, speed: DataFrame, windows: DataFrame, on: float, off: float, gain: float, held_s: float = HELD_S) -> DataFrame:
    """(run_id, window_id, pickup_t, lift_t, gained): windows in which the throttle was picked up and let go again before
    the speed had risen by ``gain``."""
    from stintlab.operators.timeseries import as_of

    up = sustained_rise(throttle, windows, on, off, held_s).where("not cut").select(*WINDOW, F.col("t").alias("pickup_t"))
    rest = windows.join(up, WINDOW).select("run_id", "window_id", F.col("pickup_t").alias("t0"), "t1")
    lift = last_lift(throttle, rest, on, off, held_s).select(*WINDOW, F.col("t").alias("lift_t"))
    both = up.join(lift, WINDOW)
    asks = both.select("run_id", F.col("pickup_t").alias("t"), "window_id", F.lit("a").alias("which")).unionByName(both.select("run_id", F.col("lift_t").alias("t"), "window_id", F.lit("b").alias("which")))
    told = as_of(asks, speed, "previous", float("inf")).groupBy(*WINDOW).agg((F.max(F.when(F.col("which") == "b", F.col("value"))) - F.max(F.when(F.col("which") == "a", F.col("value")))).alias("gained"))
    return both.join(told, WINDOW).where(F.col("gained") < gain)


def coasting_throughout(channels: dict[str, tuple[DataFrame, float]], windows: DataFrame, hole_s: float = HOLE_S) -> DataFrame:
    """(run_id, window_id): windows in which every channel stays at or below its limit, has two samples and no hole."""
    out = windows.select(*WINDOW)
    for samples, limit in channels.values():
        w = Window.partitionBy(*WINDOW).orderBy("t")
        rows = in_windows(samples.select("run_id", "t", "v"), windows).where("t < t1")
        rows = rows.withColumns({"step": F.col("t") - F.coalesce(F.lag("t").over(w), F.col("t0")), "good": F.coalesce(F.col("v") <= limit, F.lit(False))})
        calm = rows.groupBy(*WINDOW).agg(F.count("*").alias("n"), F.max("step").alias("hole"), F.min("good").alias("good"), F.first("t1").alias("t1"), F.max("t").alias("last"))
        out = out.join(calm.where((F.col("n") >= 2) & F.col("good") & (F.col("hole") <= hole_s) & (F.col("t1") - F.col("last") <= hole_s)).select(*WINDOW), WINDOW, "left_semi")
    return out


def update_rate(samples: DataFrame) -> DataFrame:
    """(run_id, channel, changes, rate_hz): how often a channel really changes: held values count once, and the rate is
    that of the median step between changes, which a pause moves less than a mean."""
    w = Window.partitionBy(*KEY).orderBy("t")
    rows = samples.where("v is not null").withColumn("changed", F.coalesce(F.col("v") != F.lag("v").over(w), F.lit(True))).where("changed")
    rows = rows.withColumn("step", F.col("t") - F.lag("t").over(w))
    return rows.groupBy(*KEY).agg(F.count("*").alias("changes"), (1 / F.percentile("step", F.lit(0.5))).alias("rate_hz"))


def braking_technique(brake: DataFrame, windows: DataFrame, hit_share: float = 0.9) -> DataFrame:
    """(run_id, window_id, peak, hit_s, release_s, hold_share): of a braking, its peak, the seconds until ``hit_share``
    of it, those from the last sample at that share to the end, and the share of samples at it."""
    part = Window.partitionBy(*WINDOW)
    rows = in_windows(brake.select("run_id", "t", "v"), windows).where("v is not null").withColumn("peak", F.max("v").over(part))
    near = F.col("v") >= F.col("peak") * hit_share
    out = rows.groupBy(*WINDOW).agg(
        F.max("peak").alias("peak"), (F.min(F.when(near, F.col("t"))) - F.min("t")).alias("hit_s"),
        (F.max("t") - F.max(F.when(near, F.col("t")))).alias("release_s"), (F.count_if(near) / F.count("*")).alias("hold_share"),
    )
    return out.where("peak > 0")


def typical_technique(technique: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Medians of brakings by group and source, which are never pooled; null below ``least`` of them."""
    def middle(c: str) -> Column:
        return F.when(F.count(c) >= least, F.percentile(c, F.lit(0.5))).alias(c)

    return technique.groupBy(*by).agg(F.count("*").alias("n"), middle("peak"), middle("hit_s"), middle("release_s"), middle("hold_share"))
