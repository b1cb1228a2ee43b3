"""Across days: visits, corner history, skills, trends, focus areas, merged profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median


def visits(days: DataFrame) -> DataFrame:
    """Days(track_id, day, best_s) in order, against the visit before and the best of all before."""
    w = Window.partitionBy("track_id").orderBy("day")
    before = F.min("best_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return days.select(
        "track_id", "day", "best_s", F.row_number().over(w).cast("long").alias("visit"), (F.col("best_s") - F.lag("best_s").over(w)).alias("change_s"),
        F.coalesce(F.col("best_s") < before, F.lit(True)).alias("personal_best"),
    )


def last_visit(days: DataFrame, day) -> DataFrame:
    """Each track's latest day before ``day``."""
    return days.where(F.col("day") < day).groupBy("track_id").agg(F.max_by(F.struct("day", "best_s"), "day").alias("l")).select("track_id", "l.day", "l.best_s")


def corner_history(stats: DataFrame) -> DataFrame:
    """Stats(track_id, corner, day, laps, value): each day's value weighed by laps."""
    mean = F.sum(F.col("value") * F.col("laps")) / F.nullif(F.sum("laps"), F.lit(0))
    return stats.groupBy("track_id", "corner", "day").agg(F.sum("laps").alias("laps"), mean.alias("value"))


def focus_areas(findings: DataFrame, top: int = 3) -> DataFrame:
    """Findings(group_id, kind, segment, weight): the strongest of each kind in turn, a segment once, ``top`` in all.

    A segment's strongest finding stands for it; kinds take turns by their strongest.
    """
    once = findings.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "segment").orderBy(F.desc("weight"), "kind"))).where("r = 1")
    turn = F.row_number().over(Window.partitionBy("group_id", "kind").orderBy(F.desc("weight"), "segment"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("turn", F.desc("weight"), "kind"))
    out = once.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= top)
    return out.select("group_id", F.col("place").cast("long").alias("place"), "kind", "segment", "weight")


def give_back(laps: DataFrame, least: int = 4) -> DataFrame:
    """Laps(run_id, seconds): the slower half's median less the faster half's; an odd middle lap is in neither."""
    w = Window.partitionBy("run_id")
    place = F.row_number().over(w.orderBy("seconds", "lap_no"))
    half = F.floor(F.count("*").over(w) / 2)
    rows = laps.withColumns({"place": place, "half": half, "n": F.count("*").over(w)})
    fast = median(F.when(F.col("place") <= F.col("half"), F.col("seconds")))
    slow = median(F.when(F.col("place") > F.col("n") - F.col("half"), F.col("seconds")))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), (slow - fast).alias("give_back_s")).where(F.col("n") >= least)


def merged(mine: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """One profile with what only the other has added."""
    return mine.unionByName(theirs.join(mine.select(*keys).distinct(), keys, "left_anti").select(*mine.columns))


def weather(sessions: DataFrame, hours: DataFrame) -> DataFrame:
    """Sessions(run_id, t0, t1) with hours(hour, temperature, rain): extremes and sums over the hours they touch.

    Sessions list their hours, so the join is by hour.
    """
    listed = sessions.select("run_id", F.explode(F.sequence(F.floor(F.col("t0") / 3600), F.floor(F.col("t1") / 3600))).alias("hour"))
    return listed.join(hours, "hour").groupBy("run_id").agg(
        F.count("*").alias("hours"), F.min("temperature").alias("coldest"), F.max("temperature").alias("warmest"), F.sum("rain").alias("rain")
    )
