"""Channels as samples(run_id, channel, t, v): gaps, pieces, as-of values, episodes, summaries.

A step longer than three times a channel's median step is a hole, and nothing reads across one. Null and NaN
values are missing. All windows are by run and channel, so partitions never need another's samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import upper_median

KEY = ["run_id", "channel"]
GAP_FACTOR = 3.0


def _by_time(keys: list[str] = KEY):
    return Window.partitionBy(*keys).orderBy("t")


def clean(samples: DataFrame) -> DataFrame:
    """Without missing values; of rows with one time the first by value stays."""
    known = samples.where("t is not null and v is not null and not isnan(v)")
    return known.groupBy(*KEY, "t").agg(F.min("v").alias("v"))


def gap_thresholds(samples: DataFrame, factor: float = GAP_FACTOR) -> DataFrame:
    """(run_id, channel, interval_s, gap_s): the upper median of positive steps, and ``factor`` times it."""
    steps = samples.withColumn("dt", F.col("t") - F.lag("t").over(_by_time())).where("dt > 0")
    return steps.groupBy(*KEY).agg(upper_median("dt").alias("interval_s")).withColumn("gap_s", F.col("interval_s") * factor)


def with_pieces(samples: DataFrame, factor: float = GAP_FACTOR) -> DataFrame:
    """Adds dt (null at a piece's start), gap_s and the number of the unbroken piece, from 0."""
    limits = gap_thresholds(samples, factor).select(*KEY, "gap_s")
    step = F.col("t") - F.lag("t").over(_by_time())
    rows = samples.join(limits, KEY, "left").withColumn("step", step)
    broken = F.col("step").isNull() | (F.col("step") > F.coalesce("gap_s", F.lit(float("inf"))))
    rows = rows.withColumn("piece", F.sum(F.when(broken, 1).otherwise(0)).over(_by_time()) - 1)
    return rows.withColumn("dt", F.when(~broken, F.col("step"))).drop("step")


def channel_summary(samples: DataFrame) -> DataFrame:
    """Least and greatest value with their first times, the trapezoid mean over time, covered seconds.

    A channel without any step inside a piece has its least value as mean.
    """
    rows = with_pieces(samples).withColumn("before", F.lag("v").over(_by_time()))
    area = F.sum(F.when(F.col("dt").isNotNull(), F.col("dt") * (F.col("v") + F.col("before")) / 2))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("v").alias("min_v"), F.min_by("t", F.struct("v", "t")).alias("min_t"),
        F.max("v").alias("max_v"), F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("max_t"),
        F.coalesce(F.sum("dt"), F.lit(0.0)).alias("covered_s"), area.alias("area"),
    ).withColumn("mean_v", F.coalesce(F.col("area") / F.nullif(F.col("covered_s"), F.lit(0.0)), F.col("min_v"))).drop("area")


def combined_summaries(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of parts as one: means weigh by covered time, or alike where nothing is covered."""
    weighed = F.sum(F.col("mean_v") * F.col("covered_s")) / F.nullif(F.sum("covered_s"), F.lit(0.0))
    return summaries.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"),
        F.sum("covered_s").alias("covered_s"), F.coalesce(weighed, F.avg("mean_v")).alias("mean_v"),
    )


def as_of(probes: DataFrame, samples: DataFrame, mode: str = "previous", tolerance_s: float | None = None) -> DataFrame:
    """The value of one channel at each probe (run_id, t and more): ``previous``, ``nearest`` or ``linear``.

    Probes and samples of a run are merged by time and the neighbours found with running last and first values, so
    the cost is a sort, not a range join. Null if the samples around are more than the gap limit, or
    ``tolerance_s``, apart or away; an exact time always counts; of two nearest the earlier wins.
    """
    limit = gap_thresholds(samples.withColumn("channel", F.lit("x")) if "channel" not in samples.columns else samples)
    limit = limit.groupBy("run_id").agg(F.min("gap_s").alias("gap_s"))
    extra = [c for c in probes.columns if c not in ("run_id", "t")]
    marks = samples.select("run_id", "t", F.lit(0).alias("probe"), F.struct("t", "v").alias("s"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    asks = probes.select("run_id", "t", F.lit(1).alias("probe"), F.lit(None).cast("struct<t:double,v:double>").alias("s"), *extra)
    both = marks.unionByName(asks)
    back = Window.partitionBy("run_id").orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("run_id").orderBy("t", F.desc("probe")).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"a": F.last("s", True).over(back), "b": F.first("s", True).over(ahead)}).where("probe = 1")
    near = near.join(limit, "run_id", "left")
    reach = F.lit(tolerance_s) if tolerance_s is not None else F.coalesce("gap_s", F.lit(float("inf")))
    t = F.col("t")
    exact = F.col("a.t") == t
    if mode == "previous":
        value = F.when(t - F.col("a.t") <= reach, F.col("a.v"))
    elif mode == "nearest":
        da, db = t - F.col("a.t"), F.col("b.t") - t
        first = F.coalesce(da <= db, da.isNotNull())
        value = F.when(first & (da <= reach), F.col("a.v")).when(~first & (db <= reach), F.col("b.v"))
    elif mode == "linear":
        width = F.col("b.t") - F.col("a.t")
        between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (t - F.col("a.t")) / width
        value = F.when(exact, F.col("a.v")).when((width > 0) & (width <= reach), between)
    else:
        raise ValueError(f"no mode {mode}")
    return near.select("run_id", "t", *extra, value.alias("value"))


def episodes(samples: DataFrame, on: float | Column, off: float | Column, min_s: float = 0.0, factor: float = GAP_FACTOR) -> DataFrame:
    """Hysteresis (levels may differ by channel, as columns): from the first sample of at least ``on`` to the first below ``off``, or the piece's last sample."""
    if not isinstance(on, Column) and not on > off:
        raise ValueError("on must exceed off")
    keys = [*KEY, "piece"]
    w = _by_time(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    latch = F.last(F.when(F.col("v") >= on, 1).when(F.col("v") < off, 0), True).over(so_far)
    rows = with_pieces(samples, factor).withColumn("active", F.coalesce(latch, F.lit(0)))
    rows = rows.withColumn("begins", F.when((F.col("active") == 1) & (F.coalesce(F.lag("active").over(w), F.lit(0)) == 0), 1).otherwise(0))
    rows = rows.withColumns({"episode": F.sum("begins").over(so_far), "next_t": F.lead("t").over(w)}).where("active = 1")
    # the sample that switches it off still ends it
    out = rows.groupBy(*keys, "episode").agg(F.min("t").alias("t0"), F.max(F.coalesce("next_t", "t")).alias("t1"), F.max("v").alias("peak"))
    return out.where(F.col("t1") - F.col("t0") >= min_s).select(*KEY, "piece", "episode", "t0", "t1", "peak")


def thinned(samples: DataFrame, buckets: int) -> DataFrame:
    """For each of a channel's equal time buckets, its first least and first greatest sample."""
    w = Window.partitionBy(*KEY)
    span = F.max("t").over(w) - F.min("t").over(w)
    place = F.floor((F.col("t") - F.min("t").over(w)) / F.nullif(span, F.lit(0.0)) * buckets)
    rows = samples.withColumn("bucket", F.least(F.coalesce(place, F.lit(0)), F.lit(buckets - 1)))
    ends = rows.groupBy(*KEY, "bucket").agg(
        F.min(F.struct("v", "t")).alias("low"), F.min(F.struct((-F.col("v")).alias("v"), "t")).alias("high")
    )
    return ends.select(*KEY, "bucket", F.col("low.t").alias("low_t"), F.col("low.v").alias("low_v"), F.col("high.t").alias("high_t"), (-F.col("high.v")).alias("high_v"))


def moving_average(samples: DataFrame, radius_s: float, factor: float = GAP_FACTOR) -> DataFrame:
    """The mean over ``radius_s`` either side, within a piece."""
    micros = F.round(F.col("t") * 1_000_000).cast("long")
    radius = round(radius_s * 1_000_000)
    around = Window.partitionBy(*KEY, "piece").orderBy(micros).rangeBetween(-radius, radius)
    return with_pieces(samples, factor).withColumn("mean_v", F.avg("v").over(around)).select(*KEY, "piece", "t", "v", "mean_v")


def unwrapped(samples: DataFrame, value: Column | None = None) -> DataFrame:
    """An angle in degrees without its jumps: whole turns are added so that no step exceeds half a turn."""
    rows = samples.withColumn("v", F.pmod(F.col("v") if value is None else value, F.lit(360.0)))
    step = F.col("v") - F.lag("v").over(_by_time())
    rows = rows.withColumn("turn", F.coalesce(-F.floor(step / 360 + 0.5), F.lit(0)))
    return rows.withColumn("unwrapped", F.col("v") + 360 * F.sum("turn").over(_by_time())).select(*KEY, "t", "v", "unwrapped")


def travelled(samples: DataFrame, factor: float = 1.0) -> DataFrame:
    """Distance of a speed channel: trapezoids within pieces; ``factor`` turns the unit into metres a second."""
    rows = with_pieces(samples).withColumn("before", F.lag("v").over(_by_time()))
    return rows.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.col("dt") * (F.col("v") + F.col("before")) / 2 * factor), F.lit(0.0)).alias("metres"),
        F.coalesce(F.sum(F.when((F.col("v") + F.col("before")) > 0, F.col("dt"))), F.lit(0.0)).alias("moving_s"),
    )


def windowed(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples in windows (run_id, window_id, t0, t1): equal runs meet, the times are a residual condition."""
    w = windows.select("run_id", "window_id", "t0", "t1")
    return samples.join(w, "run_id").where("t >= t0 and t <= t1").groupBy("run_id", "window_id", "channel").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.max("v").alias("max_v")
    )


def channel_names(samples: DataFrame) -> DataFrame:
    """(run_id, channel, ord): a run's channels by name whatever the case, then by the name as it is."""
    w = Window.partitionBy("run_id").orderBy(F.lower("channel"), "channel")
    return samples.select("run_id", "channel").distinct().withColumn("ord", F.row_number().over(w))


def shared_channels(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_run, b_run, channel): the channels that both of a pair of runs have."""
    have = samples.select("run_id", "channel").distinct()
    a, b = (have.withColumnRenamed("run_id", f"{s}_run") for s in "ab")
    return pairs.join(a, "a_run").join(b, ["b_run", "channel"]).select("a_run", "b_run", "channel")


def plausible_at(samples: DataFrame, probes: DataFrame, low: float, high: float, zero_missing: bool = False, factor: float = GAP_FACTOR) -> DataFrame:
    """(run_id, channel, t, v): a channel's value at each probe (run_id, channel, t) from its two neighbouring samples.

    A sample at the probe's own time is the value. Null where a neighbour is missing, out of ``low`` to ``high``, a zero that
    stands for nothing, or where a gap lies between them. Both neighbours come from running values over one sorted union.
    """
    limits = gap_thresholds(samples, factor).select(*KEY, "gap_s")
    sound = F.col("v").between(low, high) & ~F.isnan("v")
    if zero_missing:
        sound = sound & (F.col("v") != 0)
    rows = samples.select(*KEY, "t", F.lit(1).alias("o"), F.struct(F.col("t").alias("t"), F.when(sound, F.col("v")).alias("v")).alias("s"))
    rows = rows.unionByName(probes.select(*KEY, "t").distinct().select(*KEY, "t", F.lit(0).alias("o"), F.lit(None).cast(rows.schema["s"].dataType).alias("s")))
    # a sample at a probe's time counts as the one after it
    ahead = Window.partitionBy(*KEY).orderBy(F.desc("t"), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*KEY).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.last("s", True).over(behind), "b": F.last("s", True).over(ahead)}).where("o = 0").join(limits, KEY, "left")
    wide = F.col("b.t") - F.col("a.t")
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / F.nullif(wide, F.lit(0.0))
    near = F.coalesce(wide <= F.col("gap_s"), F.lit(True))
    return rows.select(*KEY, "t", F.when(F.col("b.t") == F.col("t"), F.col("b.v")).when(near, between).alias("v"))
