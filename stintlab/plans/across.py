"""Queries across days and places; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.operators import driving, laps, matching, profile, quality
from stintlab.plans import tables as t
from stintlab.plans.registry import _PIECES, query, rounded
from stintlab.plans.tables import LAPS_SQL, SAMPLES_SQL, TIMES_SQL


def _channel(spark, sf_dir, name):
    return t.samples(spark, sf_dir).where(F.col("channel") == name)


@query(f"""WITH {SAMPLES_SQL}, {_PIECES},
 l AS (SELECT *, coalesce(last_value(CASE WHEN v >= 30 THEN 1 WHEN v < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active,
 lead(t) OVER w AS nt, lag(t) OVER w AS pt, lag(v) OVER w AS pvv FROM pc WHERE channel = 'click' WINDOW w AS (PARTITION BY run_id, channel, piece ORDER BY t)),
 b AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY run_id, channel, piece ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS begins FROM l),
 e AS (SELECT *, sum(begins) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM b)
 SELECT run_id, channel, CAST(piece AS BIGINT) AS piece, CAST(episode AS BIGINT) AS episode, round(max(CASE WHEN begins = 1 THEN coalesce(pt + (30 - pvv) / (v - pvv) * (t - pt), t) END), 3) AS onset,
 bool_or(begins = 1 AND pt IS NULL) AS cut, round(max(coalesce(nt, t)), 6) AS t1, round(max(v), 6) AS peak FROM e WHERE active = 1 GROUP BY 1, 2, 3, 4""")
def braking_onsets(spark, sf_dir):
    return rounded(driving.onsets(_channel(spark, sf_dir, "click"), 30.0, 15.0)).withColumn("onset", F.round("onset", 3))


_STATES = f"""l AS (SELECT *, CASE channel WHEN 'click' THEN 'braking' WHEN 'view' THEN 'throttle' ELSE 'moving' END AS state, coalesce(last_value(CASE WHEN v >= CASE channel WHEN 'purchase' THEN 20 ELSE 40 END THEN 1 WHEN v < CASE channel WHEN 'purchase' THEN 10 ELSE 20 END THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active,
 lead(t) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS nt FROM pc WHERE channel IN ('click', 'view', 'purchase')),
 b AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY run_id, channel, piece ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS begins FROM l),
 e AS (SELECT *, sum(begins) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM b),
 ep AS (SELECT run_id, state, min(t) AS t0, max(coalesce(nt, t)) AS t1 FROM e WHERE active = 1 GROUP BY run_id, state, piece, episode HAVING max(coalesce(nt, t)) - min(t) >= 0.2),
 cu AS (SELECT DISTINCT run_id, t FROM (SELECT run_id, t0 AS t FROM ep UNION ALL SELECT run_id, t1 FROM ep)),
 sl AS (SELECT run_id, t AS a, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS z FROM cu),
 kp AS (SELECT sl.* FROM sl WHERE z IS NOT NULL AND EXISTS (SELECT 1 FROM ep WHERE ep.run_id = sl.run_id AND state = 'moving' AND t0 <= a AND t1 >= z) AND NOT EXISTS (SELECT 1 FROM ep WHERE ep.run_id = sl.run_id AND state <> 'moving' AND t0 <= a AND t1 >= z)),
 ki AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY a) AS island FROM (SELECT *, CASE WHEN a = lag(z) OVER (PARTITION BY run_id ORDER BY a) THEN 0 ELSE 1 END AS new FROM kp)),
 al AS (SELECT * FROM ep UNION ALL SELECT run_id, 'coasting', min(a), max(z) FROM ki GROUP BY run_id, island HAVING max(z) - min(a) >= 0.2)"""


@query(f"WITH {SAMPLES_SQL}, {_PIECES}, {_STATES} SELECT run_id, state, count(*) AS n, round(sum(t1 - t0), 3) AS seconds, round(max(t1 - t0), 3) AS longest_s FROM al GROUP BY 1, 2")
def driving_states(spark, sf_dir):
    """Clicks as brake, views as throttle, purchases as speed."""
    names = {"braking": "click", "throttle": "view", "moving": "purchase"}
    levels = {"braking": (40.0, 20.0), "throttle": (40.0, 20.0), "moving": (20.0, 10.0)}
    found = driving.states({k: _channel(spark, sf_dir, c) for k, c in names.items()}, levels)
    return rounded(driving.state_shares(found), 3)


@query(f"""WITH {SAMPLES_SQL}, {_PIECES}, m AS (SELECT *, avg(v) OVER (PARTITION BY run_id, channel, piece ORDER BY CAST(round(t * 1000000) AS BIGINT) RANGE BETWEEN 72000000000 PRECEDING AND 72000000000 FOLLOWING) AS mean_v FROM pc WHERE channel = 'view'),
 u AS (SELECT *, CASE WHEN round(mean_v, 6) > round(lag(mean_v) OVER (PARTITION BY run_id, channel, piece ORDER BY t), 6) THEN 1 ELSE 0 END AS up FROM m),
 f AS (SELECT *, sum(up) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS fall FROM u)
 SELECT run_id, channel, CAST(piece AS BIGINT) AS piece, round(min(t), 3) AS t0, round(max(t), 3) AS t1, round(max(mean_v), 3) AS peak, round(min(mean_v), 3) AS trough FROM f GROUP BY run_id, channel, piece, fall HAVING max(mean_v) - min(mean_v) >= 5 AND max(t) - min(t) >= 30""")
def cooling_intervals(spark, sf_dir):
    return rounded(driving.cooling(_channel(spark, sf_dir, "view"), radius_s=72_000.0), 3)


@query(f"""WITH {LAPS_SQL}, o AS (SELECT run_id, seconds AS value, row_number() OVER (PARTITION BY run_id ORDER BY clock NULLS LAST, lap_no) AS ord FROM ok),
 r AS (SELECT *, lag(value, 2) OVER w AS two, max(value) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM o WINDOW w AS (PARTITION BY run_id ORDER BY ord))
 SELECT run_id, ord, round(value, 6) AS value, round(value - two, 6) AS rise FROM r WHERE value - two >= 8 AND value > most""")
def car_watch(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("clock"), "lap_no")
    rows = laps.eligible(t.laps(spark, sf_dir)).select("run_id", F.row_number().over(w).cast("long").alias("ord"), F.col("seconds").alias("value"))
    return rounded(driving.car_watch(rows))


@query("""WITH p AS (SELECT c_custkey AS point_id, (c_custkey % 1700) * 0.1 - 85.0 AS lat, (c_custkey * 7 % 3400) * 0.1 - 170.0 AS lon FROM customer),
 c AS (SELECT CAST(n_nationkey AS BIGINT) AS circuit_id, n_nationkey * 6.5 - 80.0 AS clat, (n_nationkey * 53 % 340) - 170.0 AS clon, 400000.0 AS radius_m FROM nation),
 d AS (SELECT point_id, circuit_id, radius_m, 2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians(clat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(clat)) * sin(radians(clon - lon) / 2) ** 2))) AS metres FROM p, c)
 SELECT point_id, arg_min(circuit_id, (metres, circuit_id)) AS circuit_id, round(min(metres), 2) AS metres FROM d WHERE metres <= radius_m GROUP BY 1""")
def nearest_circuit(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    points = t.read(spark, sf_dir, "customer").select(k.alias("point_id"), (k % 1700 * F.lit(0.1) - 85.0).alias("lat"), (k * 7 % 3400 * F.lit(0.1) - 170.0).alias("lon"))
    circuits = t.read(spark, sf_dir, "nation").select(n.cast("long").alias("circuit_id"), (n * F.lit(6.5) - 80.0).alias("lat"), (n * 53 % 340 - 170.0).alias("lon"), F.lit(400_000.0).alias("radius_m"))
    return rounded(matching.find_circuit(points, circuits, 2.0), 2)


_SAME = "o_orderkey AS id, (o_orderkey * 37 % 90001) / 10.0 AS start, round(o_totalprice / 1000) AS duration FROM orders"


@query(f"""WITH a AS (SELECT {_SAME} WHERE o_orderkey % 2 = 0), b AS (SELECT {_SAME} WHERE o_orderkey % 2 = 1),
 n AS (SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON abs(a.start - b.start) <= 1 AND abs(a.duration - b.duration) <= 2)
 SELECT a_id, b_id FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS x, count(*) OVER (PARTITION BY b_id) AS y FROM n) WHERE x = 1 AND y = 1""")
def paired_recordings(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = t.read(spark, sf_dir, "orders").select(k.alias("id"), (k * 37 % 90001 / 10.0).alias("start"), F.round(F.col("o_totalprice") / 1000).alias("duration"))
    return matching.one_to_one(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query(f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, channel ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY run_id, channel) AS n FROM samples)
 SELECT run_id, channel, round(t, 6) AS t, round(v, 6) AS v FROM r WHERE p % greatest(1, CAST(ceil(n / 5.0) AS BIGINT)) = 0""")
def thinned_traces(spark, sf_dir):
    return rounded(matching.every_nth(t.samples(spark, sf_dir), ["run_id", "channel"], "t", 5))


_DAYS = "dd AS (SELECT group_id AS track_id, CAST(floor(clock / 86400 / 30) AS BIGINT) AS day, min(seconds) AS best_s FROM ok GROUP BY 1, 2)"


def _days(spark, sf_dir):
    day = F.floor(F.col("clock") / 86400 / 30)
    return laps.eligible(t.laps(spark, sf_dir)).groupBy(F.col("group_id").alias("track_id"), day.alias("day")).agg(F.min("seconds").alias("best_s"))


@query(f"""WITH {LAPS_SQL}, {_DAYS} SELECT track_id, day, round(best_s, 6) AS best_s, row_number() OVER w AS visit, round(best_s - lag(best_s) OVER w, 6) AS change_s,
 coalesce(best_s < min(best_s) OVER (PARTITION BY track_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS personal_best FROM dd WINDOW w AS (PARTITION BY track_id ORDER BY day)""")
def track_visits(spark, sf_dir):
    return rounded(profile.visits(_days(spark, sf_dir)))


@query(f"WITH {LAPS_SQL}, {_DAYS} SELECT track_id, max(day) AS day, round(max_by(best_s, day), 6) AS best_s FROM dd WHERE day < 350 GROUP BY 1")
def last_visits(spark, sf_dir):
    return rounded(profile.last_visit(_days(spark, sf_dir), 350))


_CORNERS = "cs AS (SELECT group_id AS track_id, segment AS corner, run_id % 5 AS day, run_id, count(*) AS laps, quantile_cont(seconds, 0.5) AS value FROM times GROUP BY 1, 2, 3, 4)"


def _corners(spark, sf_dir):
    from stintlab.functions.stats import median

    rows = t.sector_times(spark, sf_dir).groupBy(F.col("group_id").alias("track_id"), F.col("segment").alias("corner"), (F.col("run_id") % 5).alias("day"), "run_id")
    return rows.agg(F.count("*").alias("laps"), median(F.col("seconds")).alias("value"))


@query(f"WITH {TIMES_SQL}, {_CORNERS} SELECT track_id, corner, day, CAST(sum(laps) AS BIGINT) AS laps, round(sum(value * laps) / sum(laps), 7) AS value FROM cs GROUP BY 1, 2, 3")
def corner_history(spark, sf_dir):
    return rounded(profile.corner_history(_corners(spark, sf_dir)), 7)


@query(f"""WITH {TIMES_SQL}, q AS (SELECT group_id, segment, quantile_cont(seconds, 0.5) - min(seconds) AS gap, quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) AS spread FROM times GROUP BY 1, 2),
 f AS (SELECT group_id, 'gap' AS kind, segment, round(gap, 8) AS weight FROM q UNION ALL SELECT group_id, 'spread', segment, round(spread / 2, 8) FROM q),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, segment ORDER BY weight DESC, kind) AS r FROM f) WHERE r = 1),
 u AS (SELECT *, row_number() OVER (PARTITION BY group_id, kind ORDER BY weight DESC, segment) AS turn FROM o),
 p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY turn, weight DESC, kind) AS place FROM u)
 SELECT group_id, place, kind, segment, weight FROM p WHERE place <= 3""")
def focus_areas(spark, sf_dir):
    q = t.sector_times(spark, sf_dir).groupBy("group_id", "segment").agg(F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("seconds").alias("least"))
    found = q.select("group_id", "segment", F.explode(F.array(
        F.struct(F.lit("gap").alias("kind"), F.round(F.col("q")[1] - F.col("least"), 8).alias("weight")),
        F.struct(F.lit("spread").alias("kind"), F.round((F.col("q")[2] - F.col("q")[0]) / 2, 8).alias("weight")),
    )).alias("f"))
    return profile.focus_areas(found.select("group_id", "segment", "f.kind", "f.weight"))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seconds, lap_no) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM ok)
 SELECT run_id, count(*) AS n, round(quantile_cont(CASE WHEN p > n - n // 2 THEN seconds END, 0.5) - quantile_cont(CASE WHEN p <= n // 2 THEN seconds END, 0.5), 8) AS give_back_s FROM r GROUP BY 1 HAVING count(*) >= 4""")
def give_back(spark, sf_dir):
    out = profile.give_back(laps.eligible(t.laps(spark, sf_dir)))
    return rounded(out, 8)


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT run_id, min(t) AS t0, min(t) + 20000 AS t1 FROM samples GROUP BY 1),
 h AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, avg(v) AS temperature, CAST(count(*) AS DOUBLE) AS rain FROM samples GROUP BY 1)
 SELECT run_id, count(*) AS hours, round(min(temperature), 4) AS coldest, round(max(temperature), 4) AS warmest, round(sum(rain), 4) AS rain
 FROM s JOIN h ON hour BETWEEN CAST(floor(t0 / 3600) AS BIGINT) AND CAST(floor(t1 / 3600) AS BIGINT) GROUP BY 1""")
def session_weather(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    sessions = rows.groupBy("run_id").agg(F.min("t").alias("t0"), (F.min("t") + 20000).alias("t1"))
    hours = rows.groupBy(F.floor(F.col("t") / 3600).alias("hour")).agg(F.avg("v").alias("temperature"), F.count("*").cast("double").alias("rain"))
    return rounded(profile.weather(sessions, hours), 4)


@query(f"""WITH {LAPS_SQL}, {_DAYS} SELECT track_id, day, round(best_s, 6) AS best_s FROM dd WHERE day < 355
 UNION ALL SELECT track_id, day, round(best_s * 2, 6) FROM dd WHERE day >= 355""")
def merged_profiles(spark, sf_dir):
    """The other profile disagrees on the days that both have; one's own count."""
    days = _days(spark, sf_dir)
    theirs = days.where("day >= 340").withColumn("best_s", F.col("best_s") * 2)
    return rounded(profile.merged(days.where("day < 355"), theirs, ["track_id", "day"]))


@query(f"""WITH {TIMES_SQL}, g AS (SELECT group_id, run_id, lap_no, sum(seconds) AS s, count(*) AS n FROM times GROUP BY 1, 2, 3)
 SELECT group_id, CAST(n AS BIGINT) AS sectors, count(*) AS laps, round(min(s), 4) AS quickest FROM g GROUP BY 1, 2""")
def sector_coverage(spark, sf_dir):
    """How many laps have all sectors, or only some: the incomplete ones count in no theoretical best."""
    lap = t.sector_times(spark, sf_dir).groupBy("group_id", "run_id", "lap_no").agg(F.sum("seconds").alias("s"), F.count("*").alias("sectors"))
    return rounded(lap.groupBy("group_id", "sectors").agg(F.count("*").alias("laps"), F.min("s").alias("quickest")), 4)


@query(f"""WITH {SAMPLES_SQL}, z AS (SELECT run_id, channel, CASE WHEN v < 5 THEN 0.0 ELSE v END AS v FROM samples),
 p AS (SELECT run_id, channel, count(*) AS n, min(v) AS low, max(v) AS high, list_sort(list(v))[count(*) // 2 + 1] AS mid, count(*) FILTER (v = 0) AS zeros FROM z GROUP BY 1, 2)
 SELECT run_id, channel, n, zeros, CASE WHEN n = 0 THEN 'none' WHEN low = high THEN 'constant' WHEN abs(mid) > 20 AND zeros > 0 THEN 'zeros' ELSE 'values' END AS kind FROM p""")
def channel_placeholders(spark, sf_dir):
    return quality.placeholders(t.samples(spark, sf_dir).withColumn("v", F.when(F.col("v") < 5, 0.0).otherwise(F.col("v"))))


@query(f"""WITH {SAMPLES_SQL}, e AS (SELECT run_id, t AS t0, t + 90000 AS t1, row_number() OVER () AS event FROM samples WHERE channel = 'error' AND v > 40),
 h AS (SELECT e.run_id, event, max(v) AS top FROM e LEFT JOIN (SELECT * FROM samples WHERE channel = 'view') s ON e.run_id = s.run_id AND t BETWEEN t0 AND t1 GROUP BY 1, 2),
 c AS (SELECT run_id, count(*) AS n, count(*) FILTER (top >= 30) AS pressed FROM h GROUP BY 1)
 SELECT *, CASE WHEN n < 3 THEN 'unknown' WHEN pressed >= 0.5 * n THEN 'trusted' ELSE 'distrusted' END AS trust FROM c""")
def source_trust(spark, sf_dir):
    events = _channel(spark, sf_dir, "error").where("v > 40").select("run_id", F.col("t").alias("t0"), (F.col("t") + 90000).alias("t1"), F.col("t").alias("event"))
    return quality.source_trust(events, _channel(spark, sf_dir, "view"), 30.0, part_s=90_000.0)


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT run_id, channel, list_sort(list(v)) AS l, count(*) AS n FROM samples WHERE channel IN ('click', 'view') GROUP BY 1, 2),
 w AS (SELECT run_id, channel, l[greatest(1, CAST(ceil(0.95 * n) AS BIGINT))] - l[greatest(1, CAST(ceil(0.05 * n) AS BIGINT))] AS s FROM s),
 r AS (SELECT a.run_id, a.s / b.s AS ratio FROM w a JOIN w b ON a.run_id = b.run_id AND a.channel = 'click' AND b.channel = 'view' WHERE a.s > 0 AND b.s > 0)
 SELECT run_id, round(ratio, 6) AS ratio, ratio > 2 OR ratio < 0.5 AS differ FROM r""")
def scales_differ(spark, sf_dir):
    return rounded(quality.scales_differ(_channel(spark, sf_dir, "click"), _channel(spark, sf_dir, "view")))


@query(f"""WITH {TIMES_SQL}, v AS (SELECT segment, CASE WHEN run_id % 3 = 0 THEN 'measured' ELSE 'inferred' END AS source, seconds FROM times),
 q AS (SELECT segment, source, count(*) AS n, quantile_cont(seconds, 0.5) AS m, quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) AS i FROM v GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, source) AS r FROM q)
 SELECT segment, source, n, round(m, 8) AS median, round(i, 8) AS iqr FROM r WHERE r = 1 AND n >= 3""")
def corner_variability(spark, sf_dir):
    rows = t.sector_times(spark, sf_dir).select("segment", F.when(F.col("run_id") % 3 == 0, "measured").otherwise("inferred").alias("source"), F.col("seconds").alias("value"))
    out = quality.variability(rows)
    return rounded(out, 8)


@query(f"""WITH {TIMES_SQL}, m AS (SELECT group_id, segment, quantile_cont(seconds, 0.5) AS m FROM times GROUP BY 1, 2),
 s AS (SELECT group_id, run_id, lap_no, count(*) AS n, count(*) FILTER ((seconds - m) / m < -0.05) AS quicker, count(*) FILTER ((seconds - m) / m > 0.05) AS slower FROM times JOIN m USING (group_id, segment) GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN 2 * quicker > n THEN 'quick' WHEN 2 * slower > n THEN 'slow' ELSE 'mixed' END AS style FROM s""")
def lap_styles(spark, sf_dir):
    return quality.styles(t.sector_times(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN (o_orderkey % 13) - (o_orderkey % 17) <= -1 THEN 'better' WHEN (o_orderkey % 13) - (o_orderkey % 17) >= 1 THEN 'worse' ELSE 'unchanged' END AS outcome FROM orders""")
def goal_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    goals = t.read(spark, sf_dir, "orders").select(k.alias("id"), (k % 17).alias("before"), F.when(k % 11 != 0, k % 13).alias("after"))
    return quality.goal_outcome(goals, 1)
