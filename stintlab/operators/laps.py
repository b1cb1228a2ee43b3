"""Laps(group_id, run_id, lap_no, clock, seconds, excluded): eligibility, ranking, distributions, progression.

A lap is eligible if it has a time and isn't excluded. The total order of laps is by seconds, clock with nulls
last, run and number, so no tie is left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median, quartiles

MIN_LAPS = 3


def _order() -> list:
    return [F.asc("seconds"), F.asc_nulls_last("clock"), F.asc("run_id"), F.asc("lap_no")]


def eligible(laps: DataFrame) -> DataFrame:
    return laps.where("seconds is not null and not isnan(seconds) and not coalesce(excluded, false)")


def rank_group(laps: DataFrame) -> DataFrame:
    """Eligible laps in order, with the gap to the best, the run's best and whether another lap has the same time."""
    group = Window.partitionBy("group_id").orderBy(*_order())
    run = Window.partitionBy("group_id", "run_id").orderBy(*_order())
    same = Window.partitionBy("group_id", "seconds")
    return eligible(laps).select(
        "group_id", "run_id", "lap_no", "seconds", F.row_number().over(group).alias("position"),
        (F.col("seconds") - F.min("seconds").over(Window.partitionBy("group_id"))).alias("gap_s"),
        (F.row_number().over(run) == 1).alias("run_best"), (F.count("*").over(same) > 1).alias("tied"),
    )


def rank_runs(laps: DataFrame) -> DataFrame:
    """Each run's eligible laps with the gap to its fastest; the first of equals is the fastest."""
    run = Window.partitionBy("group_id", "run_id").orderBy(F.asc("seconds"), F.asc("lap_no"))
    best = F.min("seconds").over(Window.partitionBy("group_id", "run_id"))
    return eligible(laps).select(
        "group_id", "run_id", "lap_no", "seconds", (F.col("seconds") - best).alias("gap_s"), (F.row_number().over(run) == 1).alias("fastest")
    )


def distributions(laps: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Five-number summary and interquartile range of ``seconds``; null below ``least`` laps."""
    q = eligible(laps).groupBy(*by).agg(F.count("*").alias("n"), quartiles(F.col("seconds")).alias("q"))
    names = ("least", "q1", "median", "q3", "greatest")
    out = q.select(*by, "n", *(F.when(F.col("n") >= least, F.col("q")[i]).alias(c) for i, c in enumerate(names)))
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def consistency(laps: DataFrame, least: int = MIN_LAPS) -> DataFrame:
    """The summaries of groups (null run_id) and of their runs."""
    both = distributions(laps, ["group_id"], least).withColumn("run_id", F.lit(None).cast("long"))
    return distributions(laps, ["group_id", "run_id"], least).unionByName(both)


def progression(laps: DataFrame) -> DataFrame:
    """Runs of a group in recording order: best lap and the change from the run before."""
    runs = eligible(laps).groupBy("group_id", "run_id").agg(F.min("clock").alias("clock"), F.min("seconds").alias("best"), F.count("*").alias("laps"))
    w = Window.partitionBy("group_id").orderBy(F.asc_nulls_last("clock"), "run_id")
    return runs.select("group_id", "run_id", F.row_number().over(w).alias("session"), "laps", "best", (F.col("best") - F.lag("best").over(w)).alias("change_s"))


def evolution(laps: DataFrame) -> DataFrame:
    """Of each run: laps until one is within its third quartile, and whether a lap after that was its best."""
    w = Window.partitionBy("group_id", "run_id").orderBy(F.asc_nulls_last("clock"), "lap_no")
    every = Window.partitionBy("group_id", "run_id")
    rows = eligible(laps).withColumns({"ord": F.row_number().over(w), "q3": F.percentile(F.col("seconds"), F.lit(0.75)).over(every), "best": F.min("seconds").over(every)})
    pace = rows.groupBy("group_id", "run_id").agg(
        F.min(F.when(F.col("seconds") <= F.col("q3"), F.col("ord"))).alias("laps_to_pace"),
        F.min(F.when(F.col("seconds") == F.col("best"), F.col("ord"))).alias("best_lap"), F.count("*").alias("laps"),
    )
    return pace.withColumn("improved_later", F.col("best_lap") > F.col("laps_to_pace"))


def same_lap_change(laps: DataFrame) -> DataFrame:
    """Each lap against the lap of the same number in the group's run before."""
    w = Window.partitionBy("group_id", "run_id").orderBy(F.asc_nulls_last("clock"), "lap_no")
    rows = eligible(laps).select("group_id", "run_id", "seconds", F.row_number().over(w).alias("ord"))
    rows = rows.join(progression(laps).select("group_id", "run_id", "session"), ["group_id", "run_id"])
    before = rows.select("group_id", (F.col("session") + 1).alias("session"), "ord", F.col("seconds").alias("before"))
    return rows.join(before, ["group_id", "session", "ord"]).select("group_id", "run_id", "ord", (F.col("seconds") - F.col("before")).alias("change_s"))


def improving(laps: DataFrame) -> DataFrame:
    """Laps that end three in a row, each quicker than the one before."""
    w = Window.partitionBy("group_id", "run_id").orderBy(F.asc_nulls_last("clock"), "lap_no")
    rows = eligible(laps).withColumns({"one": F.lag("seconds", 1).over(w), "two": F.lag("seconds", 2).over(w)})
    return rows.where("seconds < one and one < two").select("group_id", "run_id", "lap_no", (F.col("two") - F.col("seconds")).alias("gained_s"))


def running_best(laps: DataFrame) -> DataFrame:
    """Each lap of a group in order of time against the best of all laps before it."""
    w = Window.partitionBy("group_id").orderBy(F.asc_nulls_last("clock"), "run_id", "lap_no")
    before = F.min("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = eligible(laps).select("group_id", "run_id", "lap_no", "seconds", before.alias("best_before"))
    return rows.withColumn("record", F.coalesce(F.col("seconds") < F.col("best_before"), F.lit(True)))


def totals(laps: DataFrame) -> DataFrame:
    """Laps, runs and time of everything, each group and each run, told apart by ``level``."""
    return laps.cube("group_id", "run_id").agg(
        F.count("*").alias("laps"), F.countDistinct("run_id").alias("runs"), F.sum("seconds").alias("seconds"), F.grouping_id().alias("level")
    ).where("level != 2")


def records(laps: DataFrame) -> DataFrame:
    """Each group's best lap and its typical pace, the median of its runs' medians."""
    ok = eligible(laps)
    best = ok.groupBy("group_id").agg(F.min(F.struct("seconds", F.coalesce("clock", F.lit(float("inf"))).alias("clock"), "run_id", "lap_no")).alias("b"))
    pace = ok.groupBy("group_id", "run_id").agg(median(F.col("seconds")).alias("m")).groupBy("group_id").agg(median(F.col("m")).alias("typical_s"))
    return best.join(pace, "group_id").select("group_id", "b.run_id", "b.lap_no", F.col("b.seconds").alias("best_s"), "typical_s")
