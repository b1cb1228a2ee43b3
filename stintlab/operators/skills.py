"""Twelve skills: how each session measures them, and their levels and trends over days.

Every measure is lower for the better. Most are the median over a session's corners; the loss to the next part is a mean, as
most corners give nothing back; commitment is a share of all pick-ups; three measures count from the best ever shown at a
corner in that car. Levels step down by fixed bands and are capped by how many laps stand behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators.season import SKILLS

#: Ranked laps from which a level of 4 and of 5 may show, pick-ups and laps of a commitment, days of a window.
MEDIUM_LAPS, HIGH_LAPS, PICKUPS, PICKUP_LAPS, WINDOW = 5, 15, 3, 3, 3
#: Corner figures that are measured as they are, and km/h of a metre a second.
PLAIN = {
    "brakePointConsistency": "braking_spread_m", "liftTiming": "lift_s", "brakeReleaseTiming": "release_spread_m", "lineConsistency": "line_spread_m", "throttleReapplication": "pickup_spread_m",
}
KMH = 3.6


def session_measures(sessions: DataFrame, corners: DataFrame) -> DataFrame:
    """(session_id, skill, value, ranked_laps): each session's measure of each skill, where it has one.

    ``sessions`` are (session_id, car_id, track_id, ranked_laps, lap_spread_s), ``corners`` a row a session and corner with
    braking_spread_m, lift_s, release_spread_m, entry_spread_mps, line_spread_m, pickup_spread_m, sequence_loss_s,
    throttle_known, released, deceleration_g, minimum_mps, exit_mps and the session's best_ of the last three.
    """
    rows = corners.join(sessions.select("session_id", "car_id", "track_id"), "session_id")
    shown = ("deceleration_g", "minimum_mps", "exit_mps")
    # the best of a corner in a car: one row each, met by key
    best = rows.where("track_id IS NOT NULL").groupBy("car_id", "track_id", "corner_id").agg(*(F.max(f"best_{c}").alias(f"top_{c}") for c in shown))
    rows = rows.join(best, ["car_id", "track_id", "corner_id"], "left")

    def short(c: str, scale: float = 1.0) -> Column:
        return F.when(F.col(f"top_{c}").isNotNull() & F.col(c).isNotNull(), F.greatest(F.col(f"top_{c}") - F.col(c), F.lit(0.0)) * scale)

    values = {k: F.col(c) for k, c in PLAIN.items()} | {
        "turnInConsistency": F.col("entry_spread_mps") * KMH, "brakingEffectiveness": short("deceleration_g"), "minimumSpeedControl": short("minimum_mps", KMH), "exitSpeedExecution": short("exit_mps", KMH),
    }
    each = rows.groupBy("session_id").agg(
        *(F.percentile(v.cast("double"), F.lit(0.5)).alias(k) for k, v in values.items()), F.avg("sequence_loss_s").alias("cornerSequenceManagement"),
        F.sum(F.coalesce("throttle_known", F.lit(0))).alias("known_"), F.sum(F.coalesce("released", F.lit(0))).alias("released_"),
    )
    own = sessions.select("session_id", "ranked_laps", F.col("lap_spread_s").cast("double").alias("paceConsistency")).join(each, "session_id", "left")
    committed = (F.col("known_") >= PICKUPS) & (F.col("ranked_laps") >= PICKUP_LAPS)
    own = own.withColumn("throttleCommitment", F.when(committed, F.col("released_") / F.col("known_") * 100))
    told = F.explode(F.array(*(F.struct(F.lit(n).alias("skill"), F.col(n).cast("double").alias("value")) for n, *_ in SKILLS))).alias("s")
    return own.select("session_id", "ranked_laps", told).select("session_id", "s.skill", "s.value", "ranked_laps").where("value IS NOT NULL")


def exceeded(value: Column, skill: Column) -> Column:
    """How many of its skill's bands a value exceeds."""
    out = F.lit(None).cast("int")
    for name, _, _, bands in SKILLS:
        out = F.when(skill == name, sum((F.when(value > float(b), 1).otherwise(0) for b in bands), F.lit(0))).otherwise(out)
    return out


def level_cap(laps: Column) -> Column:
    """The highest level that so many laps can show."""
    return F.when(laps >= HIGH_LAPS, 5).when(laps >= MEDIUM_LAPS, 4).otherwise(3)


def skill_levels(measures: DataFrame, by: list[str], window: int = WINDOW) -> DataFrame:
    """(by, skill, level, value, ranked_laps, days, confidence, trend, last_day): of measures (by, day, skill, value,
    ranked_laps) over the last ``window`` days that measured the skill, against as many days before.

    Sessions weigh by their laps, one at least. The level is 5 less the bands exceeded, capped by the laps; the trend compares
    the bands alone. Days without a date don't count.
    """
    keys = [*by, "skill"]
    weight = F.greatest("ranked_laps", F.lit(1))
    days = measures.where("day IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "day").agg(F.sum(F.col("value") * weight).alias("sum"), F.sum(weight).alias("weight"), F.sum("ranked_laps").alias("laps"))
    # a row a day by now, so that a skill's window holds days, not sessions
    days = days.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))).where(F.col("nth") <= 2 * window)
    now = F.col("nth") <= window

    def mean(part: Column) -> Column:
        return F.sum(F.when(part, F.col("sum"))) / F.sum(F.when(part, F.col("weight")))

    out = days.groupBy(*keys).agg(
        mean(now).alias("value"), mean(~now).alias("before"), F.sum(F.when(now, F.col("laps"))).alias("ranked_laps"), F.count(F.when(now, F.col("day"))).alias("days"), F.max("day").alias("last_day")
    )
    band, earlier = 5 - exceeded(F.col("value"), F.col("skill")), 5 - exceeded(F.col("before"), F.col("skill"))
    trend = F.when(F.col("before").isNull(), None).when(band > earlier, "improving").when(band < earlier, "declining").otherwise("steady")
    laps = F.col("ranked_laps")
    sure = F.when(laps < MEDIUM_LAPS, "low").when(laps < HIGH_LAPS, "medium").otherwise("high")
    return out.select(*keys, F.least(band, level_cap(laps)).alias("level"), "value", "ranked_laps", "days", sure.alias("confidence"), trend.alias("trend"), "last_day")
