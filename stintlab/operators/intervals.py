"""Interval algebra on rows (keys, t0, t1); empty intervals are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unite(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching intervals as one."""
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    ahead = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where("t1 > t0").withColumn("new", F.when(ahead.isNull() | (F.col("t0") > ahead), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def _sweep(a: DataFrame, b: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Pieces between neighbouring boundaries, by how many intervals of each side cover them."""
    events = None
    for side, rows in (("a", unite(a, keys)), ("b", unite(b, keys))):
        for at, step in (("t0", 1), ("t1", -1)):
            part = rows.select(*keys, F.col(at).alias("t"), *(F.lit(step if s == side else 0).alias(s) for s in "ab"))
            events = part if events is None else events.unionByName(part)
    events = events.groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("t")
    events = events.select(*keys, F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    return unite(events.where("t1 is not null").where(keep).select(*keys, "t0", "t1"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, "a > 0 and b > 0")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, "a > 0 and b <= 0")


def seconds(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("t1") - F.col("t0")).alias("seconds"))
