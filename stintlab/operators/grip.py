"""Grip from accelerations: longitudinal g from a speed, peaks by speed band, balance, and figures pooled over laps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.operators.pedals import WINDOW, in_windows
from stintlab.operators.timeseries import as_of

#: Half the span of a derivative in seconds, standard gravity, g beyond which nothing is believed, band
#: edges by unit, least g and speed and samples of a balance, laps of a typical value, pairs of a mean.
HALF_S, GRAVITY, LIMIT_G = 0.25, 9.80665, 4.0
BANDS = {"km/h": (80.0, 120.0), "mph": (50.0, 75.0)}
BALANCE_G, BALANCE_MPS, BALANCE_N, TYPICAL_LAPS, PAIRS = 0.3, 10.0, 10, 3, 5


def from_speed(speed: DataFrame, factor: float = 1 / 3.6, half_s: float = HALF_S, limit: float = LIMIT_G) -> DataFrame:
    """(run_id, t, v): g at each of a speed's samples from its values ``half_s`` before and after, not across gaps."""
    asks = speed.select("run_id", F.col("t").alias("at"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    asks = asks.withColumn("t", F.col("at") + F.col("side") * F.lit(half_s))
    got = as_of(asks, speed, "linear").groupBy("run_id", "at").agg(F.sum(F.when(F.col("side") == 1, F.col("value"))).alias("b"), F.sum(F.when(F.col("side") == -1, F.col("value"))).alias("a"))
    g = (F.col("b") - F.col("a")) * F.lit(factor) / (2 * half_s) / GRAVITY
    return got.select("run_id", F.col("at").alias("t"), g.alias("v")).where(F.abs("v") <= limit)


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """0 below the first edge, one more for each edge reached."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def band_peaks(lateral: DataFrame, speed: DataFrame, windows: DataFrame, edges: tuple[float, ...] = BANDS["km/h"], least: int = 5) -> DataFrame:
    """(run_id, window_id, band, n, peak): the greatest size of the acceleration in each band of speed; null below
    ``least`` samples or where all are zero."""
    rows = in_windows(lateral.select("run_id", "t", "v"), windows)
    rows = as_of(rows.select("run_id", "t", "v", "window_id"), speed, "linear").where("value is not null")
    out = rows.groupBy(*WINDOW, band(F.col("value"), edges).alias("band")).agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("p"))
    return out.select(*WINDOW, "band", "n", F.when((F.col("n") >= least) & (F.col("p") > 0), F.col("p")).alias("peak"))


def balance(samples: DataFrame, least_g: float = BALANCE_G, least_mps: float = BALANCE_MPS, least: int = BALANCE_N) -> DataFrame:
    """(run_id, n, balance) from simultaneous (run_id, yaw in rad/s, lat in g, mps): the median of the yaw rate over what
    the lateral acceleration needs at that speed, of the samples whose signs are related as most are."""
    rows = samples.where((F.abs("lat") >= least_g) & (F.col("mps") >= least_mps) & (F.col("yaw") != 0))
    rows = rows.select("run_id", (F.abs("yaw") / (F.abs("lat") * GRAVITY / F.col("mps"))).alias("ratio"), (F.signum("yaw") == F.signum("lat")).alias("same"))
    w = Window.partitionBy("run_id")
    rows = rows.withColumn("most", F.count_if("same").over(w) * 2 >= F.count("*").over(w)).where("same = most")
    out = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("m"))
    return out.select("run_id", "n", F.when(F.col("n") >= least, F.col("m")).alias("balance"))


def pooled(values: DataFrame, by: list[str], least: int = TYPICAL_LAPS) -> DataFrame:
    """Laps' values(by, run_id, lap_no, source, value) as one figure: only those of the source that most laps have, the
    first by name of equals: peak, its lap, the median of at least ``least``, and how many were left out."""
    known = values.where("value is not null")
    votes = known.groupBy(*by, "source").agg(F.count("*").alias("n"))
    lead = votes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "source")).alias("b"), F.sum("n").alias("measured"))
    rows = known.join(lead, by).where(F.col("source") == F.col("b.source"))
    out = rows.groupBy(*by, "source", "measured").agg(
        F.count("*").alias("laps"), F.min(F.struct((-F.col("value")).alias("v"), "run_id", "lap_no")).alias("p"), F.percentile("value", F.lit(0.5)).alias("m")
    )
    return out.select(*by, "source", "laps", (-F.col("p.v")).alias("peak"), F.col("p.run_id").alias("peak_run"), F.col("p.lap_no").alias("peak_lap"), F.when(F.col("laps") >= least, F.col("m")).alias("typical"), (F.col("measured") - F.col("laps")).alias("left_out"))


def mean_combined(pairs: DataFrame, by: list[str], least: int = PAIRS) -> DataFrame:
    """Mean size of (lon, lat) pairs by group; null below ``least``."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.hypot("lon", "lat")).alias("m")).select(*by, "n", F.when(F.col("n") >= least, F.col("m")).alias("mean_g"))


def thinned_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` of a run's (t, lon, lat) at even places of its order, and its peaks in any case."""
    w = Window.partitionBy("run_id")
    size = F.hypot("lon", "lat")
    rows = pairs.withColumns({"i": F.row_number().over(w.orderBy("t")) - 1, "n": F.count("*").over(w)})
    best = {"a": F.abs("lat"), "b": F.col("lon"), "c": -F.col("lon"), "d": size}
    peaks = pairs.groupBy("run_id").agg(*(F.min(F.struct((-c).alias("x"), "t")).getField("t").alias(k) for k, c in best.items()))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    rows = rows.join(peaks, "run_id")
    kept = F.pmod("i", step) == 0
    for c in best:
        kept |= F.col("t") == F.col(c)
    return rows.where(kept).select("run_id", "t", "lon", "lat")
