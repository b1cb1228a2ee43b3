"""Rank correlation of paired measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.units import association_strength


def spearman(pairs: DataFrame, by: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """Pearson's coefficient of averaged ranks; null below ``least`` pairs or where a side has no spread."""

    def ranked(c: str):
        peers = F.count("*").over(Window.partitionBy(*by, c))
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (peers - 1) / 2

    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"rx": ranked(x), "ry": ranked(y)})
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.corr("rx", "ry").alias("r"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy")
    )
    fair = (F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return out.select(*by, "n", F.when(fair, F.col("r")).alias("rho")).withColumn("strength", association_strength(F.round("rho", 9)))
