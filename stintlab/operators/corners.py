"""A closed axis by its shape: heading and curvature, corners and straights.

An axis is (axis_id, idx, east, north, cum_m) with even spacing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Curvature of a corner in 1/m, least turn in rad, straights that join corners.
CURVED, TURN_RAD, CHAIN_M = 1 / 250, 0.35, 20.0


def features(axis: DataFrame, radius: int = 3) -> DataFrame:
    """Adds heading (rad, circular mean of the steps within ``radius`` points) and curvature (1/m) on the closed loop."""
    size = Window.partitionBy("axis_id")
    rows = axis.withColumns({"n": F.count("*").over(size), "length_m": F.max("cum_m").over(size)})
    first = F.first_value(F.struct("east", "north")).over(Window.partitionBy("axis_id").orderBy("idx"))
    w = Window.partitionBy("axis_id").orderBy("idx")
    ahead = F.coalesce(F.lead(F.struct("east", "north")).over(w), first)
    rows = rows.withColumns({"de": ahead["east"] - F.col("east"), "dn": ahead["north"] - F.col("north")}).withColumn("step_m", F.hypot("de", "dn"))
    # the loop's ends are repeated beyond themselves, so that frames wrap
    wide = rows.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("place", F.col("idx") + F.col("turn") * F.col("n"))
    wide = wide.where((F.col("place") >= -2 * radius - 2) & (F.col("place") < F.col("n") + 2 * radius + 2))
    by_place = Window.partitionBy("axis_id").orderBy("place")
    around = by_place.rowsBetween(-radius, radius)
    unit = {"ce": F.col("de") / F.nullif("step_m", F.lit(0.0)), "cn": F.col("dn") / F.nullif("step_m", F.lit(0.0))}
    wide = wide.withColumns(unit).withColumn("heading", F.atan2(F.sum("cn").over(around), F.sum("ce").over(around)))
    change = F.lead("heading").over(by_place) - F.lag("heading").over(by_place)
    change = F.pmod(change + F.lit(3.141592653589793), F.lit(2 * 3.141592653589793)) - F.lit(3.141592653589793)
    wide = wide.withColumn("curvature", change / (F.col("step_m") + F.lag("step_m").over(by_place)))
    return wide.where("turn = 0").select("axis_id", "idx", "east", "north", "cum_m", "step_m", "heading", "curvature")


def proposals(axis_features: DataFrame, curved: float = CURVED, turn_rad: float = TURN_RAD, chain_m: float = CHAIN_M) -> DataFrame:
    """Corners and the straights between them, in order of progress: runs of one sign of curvature.

    Straights shorter than ``chain_m`` belong to the corner before, corners that turn less than ``turn_rad`` to the
    straight around them.
    """
    w = Window.partitionBy("axis_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def islands(rows: DataFrame, state: str, name: str) -> DataFrame:
        new = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
        return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(so_far)).drop("__new")

    sign = F.when(F.col("curvature") >= curved, 1).when(F.col("curvature") <= -curved, -1).otherwise(0)
    rows = islands(axis_features.withColumn("s", sign), "s", "run")
    run = Window.partitionBy("axis_id", "run")
    rows = rows.withColumns({"run_m": F.sum("step_m").over(run), "run_turn": F.abs(F.sum(F.col("curvature") * F.col("step_m")).over(run))})
    short = (F.col("s") == 0) & (F.col("run_m") < chain_m)
    slight = (F.col("s") != 0) & (F.col("run_turn") < turn_rad)
    rows = rows.withColumn("k", F.when(short, None).when(slight, 0).otherwise(F.col("s")))
    rows = rows.withColumn("k", F.coalesce(F.last("k", True).over(so_far), F.lit(0)))
    rows = islands(rows, "k", "segment")
    out = rows.groupBy("axis_id", "segment", "k").agg(F.min("cum_m").alias("start_m"), F.max(F.col("cum_m") + F.col("step_m")).alias("end_m"), F.sum(F.col("curvature") * F.col("step_m")).alias("turn_rad"))
    kind = F.when(F.col("k") == 0, "straight").otherwise("corner")
    return out.select("axis_id", F.row_number().over(Window.partitionBy("axis_id").orderBy("start_m")).alias("segment_id"), kind.alias("kind"), "start_m", "end_m", "turn_rad")
