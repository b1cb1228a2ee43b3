"""Order statistics. The conventions differ by use and aren't interchangeable, so each has its own function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quartiles(value: Column) -> Column:
    """Least, quartiles and greatest as an array, linear between the two nearest values."""
    return F.percentile(value, F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0))))


def median(value: Column) -> Column:
    """The mean of the middle two of an even number."""
    return F.percentile(value, F.lit(0.5))


def upper_median(name: str) -> Column:
    """Of a column, the element at n div 2 of the sorted values. Counts by value are merged, never a list."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def nearest_rank(name: str, p: float) -> Column:
    """Of a column, the element at ceil(p n), counted from one."""
    return F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY `{name}`)")


def rounded_rank(rows: DataFrame, by: list[str], name: str, p: float) -> DataFrame:
    """(by, name): the element at round(p (n - 1)), counted from zero, by a sort that may spill."""
    part = Window.partitionBy(*by)
    ranked = rows.where(F.col(name).isNotNull()).select(*by, name, F.row_number().over(part.orderBy(name)).alias("k"), F.count("*").over(part).alias("n"))
    return ranked.where(F.col("k") == F.round((F.col("n") - 1) * F.lit(p)) + 1).select(*by, name)
