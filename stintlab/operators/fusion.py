"""Two recordings of one drive: clock offset, agreement, and one channel from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median, rounded_rank
from stintlab.operators.timeseries import gap_thresholds


def grid(samples: DataFrame, step_s: float) -> DataFrame:
    """Means on an even grid: (run_id, k, v)."""
    return samples.groupBy("run_id", F.floor(F.col("t") / step_s).alias("k")).agg(F.avg("v").alias("v"))


def offsets(a: DataFrame, b: DataFrame, reach: int, least: int = 8) -> DataFrame:
    """Each run's correlation at every shift of b's grid by up to ``reach`` steps; NaN where a side has no spread.

    The shifts multiply one side, so that the join is by equal run and place.
    """
    shifted = b.select("run_id", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"), "k", F.col("v").alias("w"))
    shifted = shifted.withColumn("k", F.col("k") - F.col("shift"))
    out = a.join(shifted, ["run_id", "k"]).groupBy("run_id", "shift").agg(
        F.count("*").alias("n"), F.covar_pop("v", "w").alias("c"), (F.stddev_pop("v") * F.stddev_pop("w")).alias("s")
    )
    # not corr(), which ends the query where a side has no spread
    r = F.when(F.col("s") > 0, F.col("c") / F.nullif("s", F.lit(0.0))).otherwise(F.lit(float("nan")))
    return out.where(F.col("n") >= least).select("run_id", "shift", "n", r.alias("r"))


def best_offset(table: DataFrame) -> DataFrame:
    """The shift of greatest Fisher-z significance, atanh(r) sqrt(n - 3); the smaller shift of equals."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.nanvl(F.coalesce("r", F.lit(-1.0)), F.lit(-1.0))))
    rows = table.withColumn("z", F.round(F.atanh(r) * F.sqrt(F.col("n") - 3), 9))
    w = Window.partitionBy("run_id").orderBy(F.desc("z"), F.abs("shift"), "shift")
    return rows.withColumn("o", F.row_number().over(w)).where("o = 1").select("run_id", "shift", "n", "r", "z")


def conflict(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """How far two gridded channels differ: median, p95 by rounded rank, share over three tolerances."""
    d = a.join(b.select("run_id", "k", F.col("v").alias("w")), ["run_id", "k"]).withColumn("d", F.abs(F.col("v") - F.col("w")))
    out = d.groupBy("run_id").agg(F.count("*").alias("n"), median(F.col("d")).alias("median_d"), F.avg((F.col("d") > 3 * tolerance).cast("double")).alias("share_over"))
    high = rounded_rank(d, ["run_id"], "d", 0.95).withColumnRenamed("d", "p95_d")
    return out.join(high, "run_id", "left").select("run_id", "n", "median_d", "p95_d", "share_over")


def fuse(primary: DataFrame, other: DataFrame, rule: str = "fillGaps") -> DataFrame:
    """One gridded channel by ``primaryOnly``, ``fillGaps`` (the other where the primary has nothing),
    ``preferAlternative`` (the reverse) or ``add`` (the other only for runs without a primary)."""
    p, o = primary.withColumn("source", F.lit("primary")), other.withColumn("source", F.lit("other"))
    if rule == "primaryOnly":
        return p
    if rule == "fillGaps":
        return p.unionByName(o.join(primary.select("run_id", "k"), ["run_id", "k"], "left_anti").select(*o.columns))
    if rule == "preferAlternative":
        return o.unionByName(p.join(other.select("run_id", "k"), ["run_id", "k"], "left_anti").select(*p.columns))
    if rule == "add":
        return p.unionByName(o.join(primary.select("run_id").distinct(), "run_id", "left_anti").select(*o.columns))
    raise ValueError(f"no rule {rule}")


def fuse_by_rules(primary: DataFrame, other: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`fuse` with a stored decision a run: rules are (run_id, rule), and runs without one keep the primary. Both
    sides meet once, whatever rules occur."""
    p = primary.select("run_id", "k", F.col("v").alias("pv"))
    o = other.select("run_id", "k", F.col("v").alias("ov"))
    has = primary.select("run_id").distinct().withColumn("has", F.lit(True))
    rows = p.join(o, ["run_id", "k"], "full").join(rules, "run_id", "left").join(has, "run_id", "left")
    rule = F.coalesce("rule", F.lit("primaryOnly"))
    first = F.when(rule == "preferAlternative", F.col("ov")).otherwise(F.col("pv"))
    second = F.when(rule == "fillGaps", F.col("ov")).when(rule == "preferAlternative", F.col("pv")).when((rule == "add") & F.col("has").isNull(), F.col("ov"))
    value = F.coalesce(first, second)
    source = F.when(value.isNull(), None).when(F.when(rule == "preferAlternative", F.col("ov").isNull()).otherwise(F.col("pv").isNotNull()), "primary").otherwise("other")
    return rows.select("run_id", "k", value.alias("v"), source.alias("source")).where("v is not null")


def cut_to_primary(fused: DataFrame, primary: DataFrame) -> DataFrame:
    """The fused channel within the primary's span of each run."""
    span = primary.groupBy("run_id").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    return fused.join(span, "run_id").where("k >= a and k <= z").drop("a", "z")


def on_primary_clock(samples: DataFrame, clocks: DataFrame) -> DataFrame:
    """samples (run_id, t, v) of other recordings with the primary's times, by clocks (run_id, offset_s, drift_ppm); a clock that
    would run backwards leaves its run out."""
    rows = samples.join(clocks.select("run_id", "offset_s", F.coalesce("drift_ppm", F.lit(0.0)).alias("drift_ppm")), "run_id")
    return rows.where("1 + drift_ppm * 1e-6 > 0").select("run_id", (F.col("t") + F.col("offset_s") + F.col("drift_ppm") * 1e-6 * F.col("t")).alias("t"), "v")


def merged(primary: DataFrame, other: DataFrame, rule: str = "fillGaps") -> DataFrame:
    """(run_id, t, v, source, piece): one channel of both sides' samples (run_id, t, v), on one clock, by where each has data.

    A side covers stretches of known values without a gap of its own. ``fillGaps`` keeps the primary and adds the other's samples
    where the primary covers nothing; ``preferAlternative`` the reverse; ``primaryOnly`` keeps the primary. Pieces end where two
    neighbours are further apart than the gap of either's side, since a mixed channel's own cadence would bridge what
    neither recorded. Missing values are left out: they only end stretches. All is running values over one sorted union.
    """
    known = F.col("v").isNotNull() & ~F.isnan("v")
    sides = {"primary": primary, "other": other}
    told = []
    for name, side in sides.items():
        limit = gap_thresholds(side.where(known).select("run_id", F.lit(name).alias("channel"), "t")).select("run_id", "gap_s")
        told.append(side.join(limit, "run_id", "left").select("run_id", "t", F.when(known, F.col("v")).alias("v"), F.lit(name).alias("source"), F.coalesce("gap_s", F.lit(float("inf"))).alias("gap_s")))
    own = Window.partitionBy("run_id", "source").orderBy("t")
    rows = told[0].unionByName(told[1]).withColumns({"bt": F.lag("t").over(own), "bv": F.lag("v").over(own)})
    begins = F.col("v").isNotNull() & (F.col("bv").isNull() | (F.col("t") - F.col("bt") > F.col("gap_s")))
    rows = rows.withColumn("stretch", F.sum(F.when(begins, 1).otherwise(0)).over(own)).where("v IS NOT NULL")
    if rule != "primaryOnly":
        if rule not in ("fillGaps", "preferAlternative"):
            raise ValueError(f"no rule {rule}")
        first = "primary" if rule == "fillGaps" else "other"
        rows = rows.withColumn("end", F.max("t").over(Window.partitionBy("run_id", "source", "stretch")))
        # of the preferred side the stretch that began last, at this time or before
        back = Window.partitionBy("run_id").orderBy("t", F.when(F.col("source") == first, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
        covered = F.last(F.when(F.col("source") == first, F.col("end")), True).over(back) >= F.col("t")
        rows = rows.withColumn("covered", F.coalesce(covered, F.lit(False))).where((F.col("source") == first) | ~F.col("covered"))
    else:
        rows = rows.where("source = 'primary'")
    order = Window.partitionBy("run_id").orderBy("t", "source")
    wide = F.greatest("gap_s", F.lag("gap_s").over(order))
    breaks = F.coalesce(F.col("t") - F.lag("t").over(order) > wide, F.lit(True))
    rows = rows.withColumn("breaks", breaks).withColumn("piece", F.sum(F.when(F.col("breaks"), 1).otherwise(0)).over(order) - 1)
    return rows.select("run_id", "t", "v", "source", "piece")


def fused_segments(fused: DataFrame) -> DataFrame:
    """(run_id, segment, source, start_s, end_s, n): what comes of one source without a break, in order."""
    w = Window.partitionBy("run_id").orderBy("t", "source")
    new = F.coalesce((F.col("source") != F.lag("source").over(w)) | (F.col("piece") != F.lag("piece").over(w)), F.lit(True))
    rows = fused.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("segment", F.sum("new").over(w) - 1)
    return rows.groupBy("run_id", "segment", "source").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n"))
