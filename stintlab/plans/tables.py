"""The shared tables as the engine's: events are samples, orders are laps, line items are sector times.

``*_SQL`` say the same as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = 7


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _epoch(column: str):
    # the tables' times carry no zone, and a difference of such times needs none
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} AS timestamp_ntz)) / 1e6D")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("channel"), _epoch("ts").alias("t"), F.col("value").alias("v"))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("group_id"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        "group_id", F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("lap_no"), _epoch("o_orderdate").alias("clock"),
        F.col("o_totalprice").alias("seconds"), (F.col("o_orderstatus") == "P").alias("excluded"),
    )


def sector_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    least = line.groupBy(F.col("l_orderkey").alias("lap_no"), F.col("l_linenumber").alias("segment")).agg(
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("seconds")
    )
    return least.join(laps(spark, sf_dir).select("group_id", "run_id", "lap_no"), "lap_no").select("group_id", "run_id", "lap_no", "segment", "seconds")


def intervals(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Of each supplier, the days from shipping on, as many as the quantity, of line items with a return flag."""
    line = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    day = F.floor(_epoch("l_shipdate") / 86400).cast("long")
    return line.select(F.col("l_suppkey").alias("run_id"), day.alias("t0"), (day + F.floor(F.col("l_quantity") / 10).cast("long")).alias("t1"))


SAMPLES_SQL = "samples AS (SELECT user_id AS run_id, event_type AS channel, epoch_us(ts) / 1e6 AS t, value AS v FROM events)"
LAPS_SQL = (
    "laps AS (SELECT CAST(c_nationkey AS BIGINT) AS group_id, o_custkey AS run_id, o_orderkey AS lap_no, epoch_us(o_orderdate) / 1e6 AS clock, "
    "o_totalprice AS seconds, o_orderstatus = 'P' AS excluded FROM orders JOIN customer ON o_custkey = c_custkey), "
    "ok AS (SELECT * FROM laps WHERE seconds IS NOT NULL AND NOT excluded)"
)
TIMES_SQL = (
    LAPS_SQL + ", times AS (SELECT group_id, run_id, lap_no, segment, s.seconds FROM (SELECT l_orderkey AS lap_no, l_linenumber AS segment, "
    "min(l_extendedprice / l_quantity) AS seconds FROM lineitem GROUP BY ALL) s JOIN laps USING (lap_no))"
)


def intervals_sql(flag: str, name: str) -> str:
    return (
        f"{name} AS (SELECT l_suppkey AS run_id, CAST(floor(epoch_us(l_shipdate) / 86400e6) AS BIGINT) AS t0, "
        f"CAST(floor(epoch_us(l_shipdate) / 86400e6) AS BIGINT) + CAST(floor(l_quantity / 10) AS BIGINT) AS t1 FROM lineitem WHERE l_returnflag = '{flag}')"
    )
