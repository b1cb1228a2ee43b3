"""Longitudinal and lateral acceleration: pairs, peaks, envelope, strong acceleration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.functions.stats import nearest_rank
from stintlab.operators.timeseries import as_of


def pairs(longitudinal: DataFrame, lateral: DataFrame, limit_g: float = 4.0) -> DataFrame:
    """Lateral values at the longitudinal channel's times, linear within gaps, both at most ``limit_g``."""
    asks = longitudinal.select("run_id", "t", F.col("v").alias("lon"))
    both = as_of(asks, lateral.select("run_id", "t", "v"), "linear").withColumnRenamed("value", "lat")
    return both.where((F.abs("lon") <= limit_g) & (F.abs("lat") <= limit_g))


def peaks(points: DataFrame) -> DataFrame:
    """Greatest lateral, braking, accelerating and combined values of each run."""
    total = F.hypot("lon", "lat")
    return points.groupBy("run_id").agg(
        F.count("*").alias("n"), F.max(F.abs("lat")).alias("lateral"), F.max(F.greatest(-F.col("lon"), F.lit(0.0))).alias("braking"),
        F.max(F.greatest(F.col("lon"), F.lit(0.0))).alias("accelerating"), F.max(total).alias("combined"),
    )


def envelope(points: DataFrame, p: float = 0.95, least: int = 25, unused_g: float = 0.1) -> DataFrame:
    """For each run and of eight directions, the nearest-rank percentile of combined values over 0.1 g."""
    size = F.hypot("lon", "lat")
    direction = F.pmod(F.round(F.atan2("lat", "lon") / (math.pi / 4)), F.lit(8)).cast("int")
    rows = points.select("run_id", direction.alias("direction"), size.alias("g")).where(F.col("g") >= unused_g)
    edge = rows.groupBy("run_id", "direction").agg(F.count("*").alias("n"), nearest_rank("g", p).alias("g")).where(F.col("n") >= least)
    best = edge.groupBy("direction").agg(F.max("g").alias("best"))  # eight rows
    return edge.join(F.broadcast(best), "direction").withColumn("unused", F.col("best") - F.col("g")).select("run_id", "direction", "n", "g", "unused")


def strong_acceleration(samples: DataFrame, least: int = 20, limit_g: float = 4.0) -> DataFrame:
    """Each run's 90th percentile, nearest rank, of positive values of at most ``limit_g``."""
    rows = samples.where((F.col("v") > 0) & (F.col("v") <= limit_g))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), nearest_rank("v", 0.9).alias("p90")).where(F.col("n") >= least)
