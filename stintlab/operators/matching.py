"""Finding what belongs together: circuits by place, recordings of one drive, moved files, thinned traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.geo import distance


def find_circuit(points: DataFrame, circuits: DataFrame, cell_deg: float = 0.5) -> DataFrame:
    """(point_id, circuit_id, metres): the nearest circuit whose radius holds the point.

    Circuits are listed in every cell that their radius touches, so that points meet them by cell.
    """
    reach = F.col("radius_m") / 111_000.0
    wide = reach / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))

    def cells(c: str, by):
        return F.sequence(F.floor((F.col(c) - by) / cell_deg), F.floor((F.col(c) + by) / cell_deg))

    spread = circuits.select("circuit_id", "radius_m", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.explode(cells("lat", reach)).alias("y"), cells("lon", wide).alias("xs"))
    spread = spread.select("circuit_id", "radius_m", "clat", "clon", "y", F.explode("xs").alias("x"))
    at = points.withColumns({"y": F.floor(F.col("lat") / cell_deg), "x": F.floor(F.col("lon") / cell_deg)})
    near = at.join(spread, ["x", "y"]).withColumn("metres", distance(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    return near.where("metres <= radius_m").groupBy("point_id").agg(F.min(F.struct("metres", "circuit_id")).alias("b")).select("point_id", "b.circuit_id", "b.metres")


def one_to_one(a: DataFrame, b: DataFrame, start_s: float = 1.0, duration_s: float = 2.0) -> DataFrame:
    """Pairs of recordings (id, start, duration) that begin and last alike and have no other such partner."""
    # starts this close lie in the same or the next bucket
    left = a.select(F.col("id").alias("a_id"), F.col("start").alias("sa"), F.col("duration").alias("da"), F.explode(F.array(*(F.floor(F.col("start") / start_s) + k for k in (-1, 0, 1)))).alias("k"))
    right = b.select(F.col("id").alias("b_id"), F.col("start").alias("sb"), F.col("duration").alias("db"), F.floor(F.col("start") / start_s).alias("k"))
    near = left.join(right, "k").where((F.abs(F.col("sa") - F.col("sb")) <= start_s) & (F.abs(F.col("da") - F.col("db")) <= duration_s))
    alone = {f"{s}_n": F.count("*").over(Window.partitionBy(f"{s}_id")) for s in "ab"}
    return near.withColumns(alone).where("a_n = 1 and b_n = 1").select("a_id", "b_id")


def relinked(missing: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, by): each missing recording's file by content, else fingerprint, else name; the first path."""
    out = missing
    for key in ("sha256", "fingerprint", "name"):
        first = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("path").alias(f"by_{key}"))
        out = out.join(first, key, "left")
    by = F.when(F.col("by_sha256").isNotNull(), "sha256").when(F.col("by_fingerprint").isNotNull(), "fingerprint").when(F.col("by_name").isNotNull(), "name")
    return out.select("id", F.coalesce("by_sha256", "by_fingerprint", "by_name").alias("path"), by.alias("by"))


def every_nth(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most about ``most`` evenly chosen rows of each key, the first among them."""
    w = Window.partitionBy(*keys)
    stride = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / most))
    place = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("__keep", F.pmod(place, stride) == 0).where("__keep").drop("__keep")
