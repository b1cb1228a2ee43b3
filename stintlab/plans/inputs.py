"""Queries of pedals and grip: events are samples, and the stretches between a user's sign-ups are windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.operators import grip, pedals
from stintlab.plans import tables as t
from stintlab.plans.registry import _PIECES, query, rounded
from stintlab.plans.tables import SAMPLES_SQL

WINDOWS_SQL = SAMPLES_SQL + (
    ", wn AS (SELECT * FROM (SELECT run_id, row_number() OVER w AS window_id, t AS t0, lead(t) OVER w AS t1 FROM samples WHERE channel = 'signup' WINDOW w AS (PARTITION BY run_id ORDER BY t)) WHERE t1 IS NOT NULL), "
    "iw AS (SELECT s.*, window_id, t0, t1 FROM samples s JOIN wn ON s.run_id = wn.run_id AND s.t >= t0 AND s.t < t1)"
)
_W = "run_id, window_id"


def channel(spark, sf_dir, name):
    return t.samples(spark, sf_dir).where(F.col("channel") == name)


def windows(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("t")
    rows = channel(spark, sf_dir, "signup").select("run_id", F.row_number().over(w).cast("long").alias("window_id"), F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"))
    return rows.where("t1 is not null")


@query(f"WITH {WINDOWS_SQL} SELECT {_W}, channel, count(*) AS n, round(avg(v), 4) AS mean_v, max(v) AS max_v FROM iw WHERE channel <> 'signup' GROUP BY ALL")
def windowed_samples(spark, sf_dir):
    rows = pedals.in_windows(t.samples(spark, sf_dir).where("channel <> 'signup'"), windows(spark, sf_dir))
    return rounded(rows.groupBy("run_id", "window_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean_v"), F.max("v").alias("max_v")))


@query(f"""WITH {SAMPLES_SQL}, {_PIECES}, h AS (SELECT *, sum(CASE WHEN v >= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS island FROM pc),
 r AS (SELECT run_id, channel, min(CASE WHEN v >= 60 THEN t END) AS t0, max(t) AS t1 FROM h WHERE v >= 20 GROUP BY run_id, channel, piece, island)
 SELECT run_id, channel, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM r WHERE t1 - t0 >= 3600""")
def longitudinal_runs(spark, sf_dir):
    return rounded(pedals.longitudinal_runs(t.samples(spark, sf_dir), 1, 60.0, 20.0, 3600.0))


@query(f"""WITH {SAMPLES_SQL} SELECT run_id, channel, count(v) >= 20 AND max(v) / 200 <= 1.5 AND (max(v) - min(v)) / 200 >= 0.2 AS ambiguous FROM samples GROUP BY 1, 2""")
def ambiguous_pedals(spark, sf_dir):
    return pedals.scale_ambiguous(t.samples(spark, sf_dir).withColumn("v", F.col("v") / 200))


@query(f"""WITH {WINDOWS_SQL}, cl AS (SELECT * FROM samples WHERE channel = 'click'),
 pw AS (SELECT * FROM wn WHERE window_id % 2 = 0), rw AS (SELECT * FROM wn WHERE window_id % 2 = 1),
 ph AS (SELECT pw.run_id, pw.window_id, coalesce(max(v) >= 80, false) AS yes FROM pw LEFT JOIN cl ON cl.run_id = pw.run_id AND t >= t0 - 3600 AND t <= t1 GROUP BY 1, 2),
 rh AS (SELECT rw.run_id, rw.window_id, count(v) > 0 AND count_if(v < 80) >= 0.8 * count(v) AS yes FROM rw LEFT JOIN cl ON cl.run_id = rw.run_id AND t >= t0 AND t <= t1 GROUP BY 1, 2),
 p AS (SELECT run_id, count(*) AS n, count_if(yes) AS y FROM ph GROUP BY 1), r AS (SELECT run_id, count(*) AS n, count_if(yes) AS y FROM rh GROUP BY 1)
 SELECT run_id, coalesce(p.n, 0) AS pressed_n, CAST(coalesce(p.y, 0) AS BIGINT) AS pressed_yes, coalesce(r.n, 0) AS released_n, CAST(coalesce(r.y, 0) AS BIGINT) AS released_yes,
 CASE WHEN coalesce(p.n, 0) >= 3 AND coalesce(r.n, 0) >= 3 AND p.y >= 0.5 * p.n AND r.y >= 0.5 * r.n THEN 'fraction' ELSE 'unknown' END AS scale FROM p FULL JOIN r USING (run_id)""")
def judged_pedal_scale(spark, sf_dir):
    w = windows(spark, sf_dir)
    return pedals.judged_scale(channel(spark, sf_dir, "click"), w.where("window_id % 2 = 0"), w.where("window_id % 2 = 1"), 80.0, 3600.0)


@query(f"""WITH {WINDOWS_SQL}, b AS (SELECT *, CASE WHEN v < 40 THEN 1 ELSE 0 END AS below, coalesce(lead(t) OVER w, t1) AS until FROM iw WHERE channel = 'click' WINDOW w AS (PARTITION BY {_W} ORDER BY t)),
 i AS (SELECT *, sum(1 - below) OVER (PARTITION BY {_W} ORDER BY t) AS island FROM b), s AS (SELECT {_W}, min(t) AS a, max(until) AS z FROM i WHERE below = 1 GROUP BY {_W}, island)
 SELECT {_W}, round(a, 6) AS t0, round(z, 6) AS t1, round(z - a, 6) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY z - a DESC, a) AS r FROM s) WHERE r = 1""")
def off_throttle(spark, sf_dir):
    return rounded(pedals.off_throttle(channel(spark, sf_dir, "click"), windows(spark, sf_dir), 40.0))


@query(f"""WITH {WINDOWS_SQL}, l AS (SELECT *, max(CASE WHEN v <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY {_W} ORDER BY t) AS lifted FROM iw WHERE channel = 'click'),
 a AS (SELECT *, coalesce(last_value(CASE WHEN v >= 50 THEN 1 WHEN v < 20 THEN 0 END IGNORE NULLS) OVER w, 0) AS active, lag(t) OVER w AS pt, lag(v) OVER w AS pv, lead(t) OVER w AS nt FROM l WHERE lifted = 1 WINDOW w AS (PARTITION BY {_W} ORDER BY t)),
 b AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY {_W} ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS begins FROM a),
 e AS (SELECT *, sum(begins) OVER (PARTITION BY {_W} ORDER BY t) AS rise FROM b),
 r AS (SELECT {_W}, max(CASE WHEN begins = 1 THEN coalesce(pt + (t - pt) * (50 - pv) / (v - pv), t) END) AS rise_t, max(coalesce(nt, t)) AS fin, bool_or(nt IS NULL) AS open FROM e WHERE active = 1 GROUP BY {_W}, rise)
 SELECT {_W}, round(rise_t, 3) AS t, open AND fin - rise_t < 7200 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY rise_t) AS k FROM r WHERE fin - rise_t >= 7200 OR open) WHERE k = 1""")
def sustained_rises(spark, sf_dir):
    return rounded(pedals.sustained_rise(channel(spark, sf_dir, "click"), windows(spark, sf_dir), 50.0, 20.0, 7200.0), 3)


_LIFTS = f"""d AS (SELECT *, CASE WHEN v <= 40 THEN 1 ELSE 0 END AS down FROM iw WHERE channel = 'click'),
 i AS (SELECT *, sum(chg) OVER (PARTITION BY {_W} ORDER BY t) AS island FROM (SELECT *, CASE WHEN down <> coalesce(lag(down) OVER (PARTITION BY {_W} ORDER BY t), -1) THEN 1 ELSE 0 END AS chg FROM d)),
 s AS (SELECT {_W}, island, down, min(t) AS a, max(t) AS z, max(v) AS top FROM i GROUP BY {_W}, island, down),
 h AS (SELECT *, CASE WHEN down = 1 AND z - a >= 7200 THEN 1 ELSE 0 END AS held FROM s),
 u AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY {_W} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM h),
 y AS (SELECT *, max(CASE WHEN top >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY {_W}, turn ORDER BY a) AS high FROM u)"""


@query(f"WITH {WINDOWS_SQL}, {_LIFTS} SELECT {_W}, round(max(a), 6) AS t FROM y WHERE held = 1 AND high = 1 GROUP BY 1, 2")
def last_lifts(spark, sf_dir):
    return rounded(pedals.last_lift(channel(spark, sf_dir, "click"), windows(spark, sf_dir), 60.0, 40.0, 7200.0))


@query(f"""WITH {WINDOWS_SQL}, o AS (SELECT channel, {_W}, t, v, t - coalesce(lag(t) OVER (PARTITION BY channel, {_W} ORDER BY t), t0) AS step, t1 FROM iw WHERE channel IN ('click', 'view')),
 k AS (SELECT channel, {_W} FROM o GROUP BY ALL HAVING count(*) >= 2 AND bool_and(v <= 60) AND max(step) <= 400000 AND max(t1) - max(t) <= 400000) SELECT {_W} FROM k GROUP BY ALL HAVING count(*) = 2""")
def coasting_windows(spark, sf_dir):
    held = {c: (channel(spark, sf_dir, c), 60.0) for c in ("click", "view")}
    return pedals.coasting_throughout(held, windows(spark, sf_dir), 400_000.0)


@query(f"""WITH {SAMPLES_SQL}, f AS (SELECT run_id, channel, t, floor(v / 20) AS v FROM samples), c AS (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY run_id, channel ORDER BY t), true) AS ch FROM f),
 d AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, channel ORDER BY t) AS step FROM c WHERE ch) SELECT run_id, channel, count(*) AS changes, round(1e6 / quantile_cont(step, 0.5), 3) AS rate_hz FROM d GROUP BY 1, 2""")
def update_rates(spark, sf_dir):
    """In millionths of a hertz, as events are hours apart."""
    rows = pedals.update_rate(t.samples(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20).cast("double")))
    return rounded(rows.withColumn("rate_hz", F.round(F.col("rate_hz") * 1e6, 3)))


_TECHNIQUE = f"""k AS (SELECT *, max(v) OVER (PARTITION BY {_W}) AS peak, min(t) OVER (PARTITION BY {_W}) AS first_t FROM iw WHERE channel = 'view'),
 te AS (SELECT {_W}, max(peak) AS peak, min(CASE WHEN v >= 0.5 * peak THEN t END) - min(first_t) AS hit_s, max(t) - max(CASE WHEN v >= 0.5 * peak THEN t END) AS release_s, count_if(v >= 0.5 * peak) / count(*) AS hold_share FROM k GROUP BY ALL HAVING max(peak) > 0)"""


@query(f"WITH {WINDOWS_SQL}, {_TECHNIQUE} SELECT {_W}, peak, round(hit_s, 6) AS hit_s, round(release_s, 6) AS release_s, round(hold_share, 6) AS hold_share FROM te")
def braking_technique(spark, sf_dir):
    out = pedals.braking_technique(channel(spark, sf_dir, "view"), windows(spark, sf_dir), 0.5)
    return rounded(out)


@query(f"""WITH {WINDOWS_SQL}, {_TECHNIQUE} SELECT run_id, count(*) AS n, {', '.join(f"round(CASE WHEN count(*) >= 3 THEN quantile_cont({c}, 0.5) END, 8) AS {c}" for c in ("peak", "hit_s", "release_s", "hold_share"))} FROM te GROUP BY 1""")
def typical_technique(spark, sf_dir):
    out = pedals.braking_technique(channel(spark, sf_dir, "view"), windows(spark, sf_dir), 0.5)
    return rounded(pedals.typical_technique(out, ["run_id"]), 8)


_SIDES = """, sd AS (SELECT run_id, t AS mid, x.k AS k, t + x.k * 50000.0 AS t FROM samples, (VALUES (-1), (1)) x(k) WHERE channel = 'purchase'),
 sv AS (SELECT run_id, t, v FROM samples WHERE channel = 'purchase'),
 s1 AS (SELECT sd.*, sv.t AS ta, sv.v AS va FROM sd ASOF LEFT JOIN sv ON sd.run_id = sv.run_id AND sd.t >= sv.t),
 s2 AS (SELECT s1.*, sv.t AS tb, sv.v AS vb FROM s1 ASOF LEFT JOIN sv ON s1.run_id = sv.run_id AND s1.t <= sv.t),
 s3 AS (SELECT s2.*, CASE WHEN s2.t = ta THEN va WHEN tb > ta AND tb - ta <= coalesce(interval_s * 3, 1e300) THEN va + (vb - va) * (s2.t - ta) / (tb - ta) END AS value FROM s2 LEFT JOIN (SELECT * FROM lim WHERE channel = 'purchase') l ON s2.run_id = l.run_id),
 gv AS (SELECT run_id, mid AS t, (sum(CASE WHEN k = 1 THEN value END) - sum(CASE WHEN k = -1 THEN value END)) * 3600 / 100000.0 / 9.80665 AS v FROM s3 GROUP BY 1, 2)"""


@query(f"WITH {SAMPLES_SQL}, {_PIECES}{_SIDES} SELECT run_id, round(t, 6) AS t, round(v, 6) + 0.0 AS v FROM gv WHERE abs(v) <= 4")
def longitudinal_from_speed(spark, sf_dir):
    return rounded(grip.from_speed(channel(spark, sf_dir, "purchase"), 3600.0, 50_000.0))


@query(f"""WITH {WINDOWS_SQL}, {_PIECES}, er AS (SELECT run_id, window_id, t, v FROM iw WHERE channel = 'error'), sv AS (SELECT run_id, t, v FROM samples WHERE channel = 'purchase'),
 s1 AS (SELECT er.*, sv.t AS ta, sv.v AS va FROM er ASOF LEFT JOIN sv ON er.run_id = sv.run_id AND er.t >= sv.t), s2 AS (SELECT s1.*, sv.t AS tb, sv.v AS vb FROM s1 ASOF LEFT JOIN sv ON s1.run_id = sv.run_id AND s1.t <= sv.t),
 s3 AS (SELECT s2.*, CASE WHEN s2.t = ta THEN va WHEN tb > ta AND tb - ta <= coalesce(interval_s * 3, 1e300) THEN va + (vb - va) * (s2.t - ta) / (tb - ta) END AS speed FROM s2 LEFT JOIN (SELECT * FROM lim WHERE channel = 'purchase') l ON s2.run_id = l.run_id)
 SELECT {_W}, CAST((speed >= 30) AS INT) + CAST((speed >= 60) AS INT) AS band, count(*) AS n, CASE WHEN count(*) >= 2 AND max(abs(v)) > 0 THEN max(abs(v)) END AS peak FROM s3 WHERE speed IS NOT NULL GROUP BY ALL""")
def grip_band_peaks(spark, sf_dir):
    return rounded(grip.band_peaks(channel(spark, sf_dir, "error"), channel(spark, sf_dir, "purchase"), windows(spark, sf_dir), (30.0, 60.0), 2))


_BALANCE = "bl AS (SELECT l_suppkey AS run_id, (l_discount - 0.05) * 8 AS yaw, (l_tax - 0.04) * 20 AS lat, l_quantity AS mps FROM lineitem)"


@query(f"""WITH {_BALANCE}, b AS (SELECT run_id, abs(yaw) / (abs(lat) * 9.80665 / mps) AS ratio, sign(yaw) = sign(lat) AS same FROM bl WHERE abs(lat) >= 0.3 AND mps >= 10 AND yaw <> 0),
 m AS (SELECT *, count_if(same) OVER w * 2 >= count(*) OVER w AS most FROM b WINDOW w AS (PARTITION BY run_id))
 SELECT run_id, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN quantile_cont(ratio, 0.5) END, 4) AS balance FROM m WHERE same = most GROUP BY 1""")
def grip_balance(spark, sf_dir):
    line = t.read(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("run_id"), ((F.col("l_discount") - 0.05) * 8).alias("yaw"), ((F.col("l_tax") - 0.04) * 20).alias("lat"), F.col("l_quantity").alias("mps"))
    return rounded(grip.balance(rows), 4)


@query("""WITH v AS (SELECT o_custkey AS track_id, o_orderkey % 3 AS run_id, o_orderkey AS lap_no, o_orderstatus AS source, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 1000 END AS value FROM orders),
 k AS (SELECT * FROM v WHERE value IS NOT NULL), c AS (SELECT track_id, source, count(*) AS n FROM k GROUP BY 1, 2), b AS (SELECT track_id, arg_min(source, (-n, source)) AS source, sum(n) AS measured FROM c GROUP BY 1)
 SELECT track_id, source, count(*) AS laps, round(max(value), 2) AS peak, arg_min(run_id, (-value, run_id, lap_no)) AS peak_run, arg_min(lap_no, (-value, run_id, lap_no)) AS peak_lap,
 round(CASE WHEN count(*) >= 3 THEN quantile_cont(value, 0.5) END, 2) AS typical, CAST(max(measured) - count(*) AS BIGINT) AS left_out FROM k JOIN b USING (track_id, source) GROUP BY 1, 2""")
def pooled_grip(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), (k % 3).alias("run_id"), k.alias("lap_no"), F.col("o_orderstatus").alias("source"), F.when(k % 7 > 0, F.col("o_totalprice") / 1000).alias("value"))
    return rounded(grip.pooled(rows, ["track_id"]), 2)


_PAIRS = "pq AS (SELECT l_suppkey AS run_id, l_orderkey * 8.0 + l_linenumber AS t, avg(l_discount - 0.05) * 20 AS lon, avg(l_tax - 0.04) * 20 AS lat FROM lineitem GROUP BY 1, 2)"


def _pairs(spark, sf_dir):
    line = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * F.lit(8.0) + F.col("l_linenumber")).alias("t"))
    return line.agg((F.avg(F.col("l_discount") - 0.05) * 20).alias("lon"), (F.avg(F.col("l_tax") - 0.04) * 20).alias("lat"))


@query(f"WITH {_PAIRS} SELECT run_id, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(sqrt(lon * lon + lat * lat)) END, 4) AS mean_g FROM pq GROUP BY 1")
def mean_combined_g(spark, sf_dir):
    return rounded(grip.mean_combined(_pairs(spark, sf_dir), ["run_id"]), 4)
