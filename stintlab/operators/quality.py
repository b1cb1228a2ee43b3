"""Whether a channel can be believed: placeholders, trusted sources, scales; how laps differ from the typical one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median, nearest_rank, upper_median
from stintlab.operators.timeseries import KEY


def placeholders(samples: DataFrame, cold: float = 20.0) -> DataFrame:
    """Each channel's kind: ``none`` without values, ``constant``, ``zeros`` where zero stands for nothing (the upper
    median is over ``cold`` and zeros occur), else ``values``."""
    known = F.when(~F.isnan("v"), F.col("v"))
    out = samples.withColumn("known", known).groupBy(*KEY).agg(F.count("known").alias("n"), F.min("known").alias("low"), F.max("known").alias("high"), upper_median("known").alias("mid"), F.count_if(F.col("known") == 0).alias("zeros"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("low") == F.col("high"), "constant").when((F.abs("mid") > cold) & (F.col("zeros") > 0), "zeros").otherwise("values")
    return out.select(*KEY, "n", "zeros", kind.alias("kind"))


def plausible(samples: DataFrame, low: float, high: float) -> DataFrame:
    """Samples in range; a placeholder zero isn't."""
    kinds = placeholders(samples).select(*KEY, "kind")
    return samples.join(kinds, KEY).where(F.col("v").between(low, high) & ~((F.col("v") == 0) & (F.col("kind") == "zeros"))).drop("kind")


def source_trust(events: DataFrame, samples: DataFrame, pressed: float, share: float = 0.5, least: int = 3, part_s: float = 10.0) -> DataFrame:
    """Events(run_id, t0, t1) in which a channel should react: its source is trusted if it reaches ``pressed`` in at least
    ``share`` of ``least`` or more of them, and unknown with fewer."""
    # an event's own rows of a run may overlap others', so samples are cut into equal parts of time that both sides share
    e = events.withColumn("event", F.monotonically_increasing_id()) if "event" not in events.columns else events
    part = F.explode(F.sequence(F.floor(F.col("t0") / part_s), F.floor(F.col("t1") / part_s)))
    cells = e.select("run_id", "event", "t0", "t1", part.alias("part"))
    near = samples.select("run_id", "t", "v", F.floor(F.col("t") / part_s).alias("part"))
    hit = cells.join(near, ["run_id", "part"]).where("t >= t0 and t <= t1").groupBy("run_id", "event").agg(F.max("v").alias("top"))
    out = e.join(hit, ["run_id", "event"], "left").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= pressed).alias("pressed"))
    trust = F.when(F.col("n") < least, "unknown").when(F.col("pressed") >= share * F.col("n"), "trusted").otherwise("distrusted")
    return out.withColumn("trust", trust)


def scales_differ(a: DataFrame, b: DataFrame, factor: float = 2.0) -> DataFrame:
    """Of two channels of a run, the ratio of their 5 to 95 percent spreads, and whether it is beyond ``factor``."""

    def spread(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("run_id").agg((nearest_rank("v", 0.95) - nearest_rank("v", 0.05)).alias(name))

    both = spread(a, "sa").join(spread(b, "sb"), "run_id").where("sa > 0 and sb > 0").withColumn("ratio", F.col("sa") / F.col("sb"))
    return both.select("run_id", "ratio", ((F.col("ratio") > factor) | (F.col("ratio") < 1 / factor)).alias("differ"))


def variability(values: DataFrame, least: int = 3) -> DataFrame:
    """Values(segment, source, value): spread of each segment over the source that most rows have, never pooled."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = values.groupBy("segment", "source").agg(F.count("*").alias("n"), q.alias("q"))
    first = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), "source"))
    kept = out.withColumn("r", first).where((F.col("r") == 1) & (F.col("n") >= least))
    return kept.select("segment", "source", "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def styles(times: DataFrame, clear: float = 0.05) -> DataFrame:
    """Each lap's style: segments clearly quicker and slower than their group's median, and which are more."""
    typical = times.groupBy("group_id", "segment").agg(median(F.col("seconds")).alias("m"))
    share = (F.col("seconds") - F.col("m")) / F.col("m")
    out = times.join(typical, ["group_id", "segment"]).groupBy("group_id", "run_id", "lap_no").agg(
        F.count("*").alias("n"), F.count_if(share < -clear).alias("quicker"), F.count_if(share > clear).alias("slower")
    )
    style = F.when(2 * F.col("quicker") > F.col("n"), "quick").when(2 * F.col("slower") > F.col("n"), "slow").otherwise("mixed")
    return out.withColumn("style", style)


def goal_outcome(goals: DataFrame, least: float = 0.05) -> DataFrame:
    """Goals(id, before, after), less is better: ``better``, ``worse``, ``unchanged`` or ``unknown``."""
    change = F.col("after") - F.col("before")
    return goals.select("id", F.when(change.isNull(), "unknown").when(change <= -least, "better").when(change >= least, "worse").otherwise("unchanged").alias("outcome"))
