"""Queries of days and seasons: orders are laps, nations are tracks, market segments are cars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.functions import units
from stintlab.operators import laps, season, sectors
from stintlab.plans import tables as t
from stintlab.plans.across import _CORNERS, _corners
from stintlab.plans.inputs import _TECHNIQUE, WINDOWS_SQL, channel, windows
from stintlab.plans.laps_along import _EXITS, _L, PROGRESS_SQL, bundle
from stintlab.plans.registry import query, rounded
from stintlab.plans.tables import LAPS_SQL, SAMPLES_SQL, SEGMENTS, TIMES_SQL

_TEMPERATURES = "tl AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY clock NULLS LAST, lap_no) AS ord, seconds AS metric, CASE WHEN lap_no % 9 > 0 THEN (lap_no * 37 % 41) + group_id END AS temperature FROM ok)"


def _rho(x: str, y: str, name: str) -> str:
    return (
        f"{name} AS (SELECT group_id, count(*) AS n, CASE WHEN count(*) >= 8 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM "
        f"(SELECT group_id, rank() OVER (PARTITION BY group_id ORDER BY {x}) + (count(*) OVER (PARTITION BY group_id, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY group_id ORDER BY {y}) + (count(*) OVER (PARTITION BY group_id, {y}) - 1) / 2 AS ry FROM tl WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1)"
    )


@query(f"""WITH {LAPS_SQL}, {_TEMPERATURES}, {_rho("temperature", "metric", "a")}, {_rho("temperature", "ord", "b")}
 SELECT a.group_id, a.n, round(a.rho, 4) AS rho, CASE WHEN a.rho IS NULL THEN NULL WHEN abs(round(a.rho, 9)) >= 0.6 THEN 'strong' WHEN abs(round(a.rho, 9)) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, round(b.rho, 4) AS rho_order, coalesce(abs(round(b.rho, 9)) >= 0.6, false) AS confounded FROM a LEFT JOIN b USING (group_id)""")
def temperature_association(spark, sf_dir):
    w = Window.partitionBy("group_id").orderBy(F.asc_nulls_last("clock"), "lap_no")
    rows = laps.eligible(t.laps(spark, sf_dir)).select("group_id", F.row_number().over(w).alias("ord"), F.col("seconds").alias("metric"), F.when(F.col("lap_no") % 9 > 0, F.col("lap_no") * 37 % 41 + F.col("group_id")).alias("temperature"))
    return rounded(season.temperature_association(rows, ["group_id"]), 4)


@query(f"""WITH {LAPS_SQL} SELECT 'c' || (lap_no % 3) AS channel, run_id, lap_no, ord, seconds AS metric, lap_no % 50 + 0.5 AS temperature FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lap_no) AS ord FROM ok) WHERE (lap_no % 10) / 10.0 * 1.1 >= 0.8""")
def lap_temperatures(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("lap_no")
    own = laps.eligible(t.laps(spark, sf_dir)).select("run_id", "lap_no", "seconds", F.row_number().over(w).cast("long").alias("ord"))
    lap = F.col("lap_no")
    summaries = own.select("run_id", "lap_no", F.concat(F.lit("c"), (lap % 3).cast("string")).alias("channel"), ((lap % 10) / 10.0 * 1.1 * F.col("seconds")).alias("covered_s"), (lap % 50 + 0.5).alias("mean_v"))
    return rounded(season.lap_temperatures(own, summaries))


@query(f"""WITH {SAMPLES_SQL}, b AS (SELECT *, CAST(least(coalesce(floor((t - min(t) OVER w) / nullif(max(t) OVER w - min(t) OVER w, 0.0) * 12), 0), 11) AS BIGINT) AS bin FROM samples WINDOW w AS (PARTITION BY run_id, channel))
 SELECT run_id, channel, bin, count(*) AS n, round(avg(v), 4) AS mean_v, min(v) AS min_v, max(v) AS max_v FROM b GROUP BY 1, 2, 3""")
def channel_trends(spark, sf_dir):
    return rounded(season.trend(t.samples(spark, sf_dir), 12), 4)


_SESSIONS = LAPS_SQL + ", ss AS (SELECT c_mktsegment AS car_id, l.group_id AS track_id, CAST(floor(min(clock) / 86400 / 30) AS BIGINT) AS day, l.run_id, count(*) AS laps, sum(seconds) AS metres FROM ok l JOIN customer ON c_custkey = l.run_id WHERE c_mktsegment <> 'FURNITURE' GROUP BY c_mktsegment, l.group_id, l.run_id)"


def sessions(spark, sf_dir):
    car = t.read(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("car_id"))
    own = laps.eligible(t.laps(spark, sf_dir)).join(car, "run_id")
    return own.groupBy("car_id", F.col("group_id").alias("track_id"), "run_id").agg(F.floor(F.min("clock") / 86400 / 30).alias("day"), F.count("*").alias("laps"), F.sum("seconds").alias("metres"))


@query(f"""WITH {_SESSIONS}, c AS (SELECT DISTINCT c_mktsegment AS car_id FROM customer) SELECT c.car_id, count(day) AS sessions, count(DISTINCT day) AS days, count(DISTINCT track_id) AS tracks, CAST(coalesce(sum(laps), 0) AS BIGINT) AS laps, round(coalesce(sum(metres), 0), 2) AS metres FROM c LEFT JOIN ss USING (car_id) GROUP BY 1""")
def car_totals(spark, sf_dir):
    cars = t.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("car_id")).distinct()
    return rounded(season.car_totals(cars, sessions(spark, sf_dir)), 2)


@query(f"WITH {_SESSIONS} SELECT track_id, count(*) AS sessions, count(DISTINCT day) AS days, count(DISTINCT car_id) AS cars, CAST(sum(laps) AS BIGINT) AS laps FROM ss GROUP BY 1")
def track_totals(spark, sf_dir):
    return season.track_totals(sessions(spark, sf_dir))


@query(f"""WITH {_SESSIONS}, y AS (SELECT *, CAST(floor(day / 12) AS BIGINT) AS year FROM ss) SELECT coalesce(car_id, '-') AS car_id, coalesce(year, -1) AS year, coalesce(track_id, -1) AS track_id, coalesce(day, -1) AS day, 4 - CAST(grouping(car_id) + grouping(year) + grouping(track_id) + grouping(day) AS BIGINT) AS depth, count(*) AS sessions, CAST(sum(laps) AS BIGINT) AS laps
 FROM y GROUP BY ROLLUP (car_id, year, track_id, day)""")
def profile_tree(spark, sf_dir):
    out = season.profile_tree(sessions(spark, sf_dir).withColumn("year", F.floor(F.col("day") / 12)))
    return out.withColumns({"car_id": F.coalesce("car_id", F.lit("-")), **{c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("year", "track_id", "day")}})


_STATS = "sts AS (SELECT group_id, run_id, count(*) AS laps, min(seconds) AS best_s, quantile_cont(seconds, 0.5) AS median_s, CASE WHEN count(*) >= 3 THEN quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) END AS spread_s FROM ok GROUP BY 1, 2)"


def _stats(spark, sf_dir):
    ok = laps.eligible(t.laps(spark, sf_dir))
    return season.session_stats(ok).join(ok.select("run_id", "group_id").distinct(), "run_id")


@query(f"WITH {LAPS_SQL}, {_STATS} SELECT group_id, run_id, laps, round(best_s, 6) AS best_s, round(median_s, 6) AS median_s, round(spread_s, 6) AS spread_s FROM sts")
def session_stats(spark, sf_dir):
    return rounded(_stats(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, {_STATS}, th AS (SELECT group_id, CASE WHEN count(*) = {SEGMENTS} THEN sum(m) END AS total_s FROM (SELECT group_id, segment, min(seconds) AS m FROM times GROUP BY 1, 2) GROUP BY 1)
 SELECT group_id, run_id, laps, round(best_s, 6) AS best_s, round(median_s, 6) AS median_s, round(spread_s, 6) AS spread_s, round(best_s - lag(best_s) OVER (PARTITION BY group_id ORDER BY run_id), 6) AS change_s, round(best_s - total_s, 6) AS gap_s FROM sts LEFT JOIN th USING (group_id)""")
def session_summaries(spark, sf_dir):
    best = sectors.theoretical_best(t.sector_times(spark, sf_dir), SEGMENTS).groupBy("group_id").agg(F.max("total_s").alias("total_s"))
    return rounded(season.session_summary(_stats(spark, sf_dir), best))


_LOSSES = "cd AS (SELECT track_id, day, corner, CASE WHEN count(*) > 0 THEN median(value) END / 10000 AS loss_s FROM cs GROUP BY 1, 2, 3), ck AS (SELECT *, row_number() OVER (PARTITION BY track_id, day ORDER BY loss_s DESC, corner) <= 3 AND loss_s >= 0.1 AS costly FROM cd)"


def _losses(spark, sf_dir):
    from stintlab.functions.stats import median

    return _corners(spark, sf_dir).groupBy("track_id", "day", "corner").agg((median(F.col("value")) / 10000).alias("loss_s"))


@query(f"WITH {TIMES_SQL}, {_CORNERS}, {_LOSSES} SELECT track_id, day, corner, round(loss_s, 5) AS loss_s, costly FROM ck")
def costly_corners(spark, sf_dir):
    return rounded(season.costly(_losses(spark, sf_dir)), 5)


@query(f"""WITH {TIMES_SQL}, {_CORNERS}, {_LOSSES}, w AS (SELECT *, max(CASE WHEN costly THEN day END) OVER (PARTITION BY track_id, corner) AS ll FROM ck WHERE day < 4)
 SELECT track_id, corner, count(*) AS measured, CAST(count_if(costly) AS BIGINT) AS lost, coalesce(max(ll), -1) AS last_lost, count_if(costly) > 0 AND count_if(day > ll) >= 2 AS not_on_last_two FROM w GROUP BY 1, 2""")
def corner_before(spark, sf_dir):
    return season.corner_before(_losses(spark, sf_dir), 4).withColumn("last_lost", F.coalesce("last_lost", F.lit(-1).cast("long")))


@query(f"WITH {TIMES_SQL}, {_CORNERS}, {_LOSSES} SELECT a.track_id, a.corner, round(a.loss_s, 5) AS then_s, round(b.loss_s, 5) AS now_s FROM cd a JOIN cd b USING (track_id, corner) WHERE a.day = 1 AND b.day = 4")
def last_time_corners(spark, sf_dir):
    return rounded(season.then_and_now(_losses(spark, sf_dir), 1, 4), 5)


@query("SELECT o_custkey AS run_id, round(CASE WHEN count(*) >= 3 THEN 100.0 * count_if(o_orderstatus = 'O') / count(*) END, 4) AS value FROM orders GROUP BY 1")
def throttle_commitment(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.lit(1).alias("known"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("released"))
    return rounded(season.commitment(rows), 4)


_FINDINGS = f"""{_EXITS}, bu AS (SELECT {_L}, segment_id, seconds, entry, least, pickup_m FROM tm JOIN sp USING ({_L}, segment_id) LEFT JOIN ex USING ({_L}, segment_id)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY axis_id, segment_id ORDER BY seconds, run_id, lap_no) AS place FROM bu),
 be AS (SELECT axis_id, segment_id, avg(seconds) AS bs, avg(entry) AS b_entry, avg(least) AS bl, avg(pickup_m) AS bp FROM pl WHERE place <= 2 GROUP BY 1, 2),
 fi AS (SELECT axis_id, run_id, lap_no, segment_id, CASE WHEN b_entry - entry >= 2 THEN 'early lift' WHEN bl - least >= 2 THEN 'low least speed' WHEN pickup_m - bp >= 5 THEN 'late throttle' WHEN bp - pickup_m >= 5 THEN 'early throttle' ELSE 'unexplained' END AS kind, seconds - bs AS loss_s FROM pl JOIN be USING (axis_id, segment_id) WHERE place > 2 AND seconds - bs >= 0.005)"""


def _findings(spark, sf_dir):
    return season.findings(bundle(spark, sf_dir).where("entry is not null"), 0.005)


@query(f"WITH {PROGRESS_SQL}, {_FINDINGS} SELECT axis_id, run_id, lap_no, segment_id, kind, round(loss_s, 4) AS loss_s FROM fi")
def coach_findings(spark, sf_dir):
    return rounded(_findings(spark, sf_dir), 4)


_PLAN = """pq AS (SELECT axis_id, segment_id, kind, count(*) AS laps, avg(loss_s) AS loss_s FROM fi GROUP BY 1, 2, 3),
 po AS (SELECT *, row_number() OVER (PARTITION BY axis_id, segment_id ORDER BY laps >= 2 DESC, floor(round(loss_s * 10, 6)) DESC, laps DESC, kind) AS r FROM pq),
 pl2 AS (SELECT axis_id, segment_id, kind, laps, loss_s, row_number() OVER (PARTITION BY axis_id ORDER BY laps >= 2 DESC, floor(round(loss_s * 10, 6)) DESC, laps DESC, segment_id, kind) AS place FROM po WHERE r = 1)"""


@query(f"WITH {PROGRESS_SQL}, {_FINDINGS}, {_PLAN} SELECT axis_id, segment_id, kind, laps, round(loss_s, 4) AS loss_s, place FROM pl2 WHERE place <= 3")
def coach_plan(spark, sf_dir):
    return rounded(season.plan(_findings(spark, sf_dir), ["axis_id"]), 4).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {TIMES_SQL} SELECT group_id, segment, count(*) AS n, round(quantile_cont(seconds, 0.5), 8) AS median, round(quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25), 8) AS spread FROM times GROUP BY 1, 2 HAVING count(*) >= 3 AND round(quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25), 9) >= 1000")
def inconsistent_corners(spark, sf_dir):
    rows = t.sector_times(spark, sf_dir).select("group_id", "segment", F.col("seconds").alias("value"))
    return rounded(season.inconsistent(rows, ["group_id", "segment"], 1000.0), 8)


@query(f"""WITH {TIMES_SQL}, m AS (SELECT run_id, segment AS segment_id, min(seconds) AS value FROM times WHERE lap_no % 3 > 0 GROUP BY 1, 2), g AS (SELECT DISTINCT run_id, segment AS segment_id, CAST(1400 AS DOUBLE) AS before, segment % 2 = 0 AS lower_is_better FROM times)
 SELECT run_id, segment_id, before, lower_is_better, round(value, 8) AS value, CASE WHEN value IS NULL THEN 'not measured' WHEN CASE WHEN lower_is_better THEN before - value ELSE value - before END >= 100 THEN 'better' WHEN CASE WHEN lower_is_better THEN before - value ELSE value - before END <= -100 THEN 'worse' ELSE 'unchanged' END AS outcome FROM g LEFT JOIN m USING (run_id, segment_id)""")
def checked_goals(spark, sf_dir):
    times = t.sector_times(spark, sf_dir).withColumnRenamed("segment", "segment_id")
    goals = times.select("run_id", "segment_id").distinct().withColumns({"before": F.lit(1400.0), "lower_is_better": F.col("segment_id") % 2 == 0})
    return rounded(season.checked_goals(goals, times.where("lap_no % 3 > 0").groupBy("run_id", "segment_id").agg(F.min("seconds").alias("value")), 100.0), 8)


@query(f"""WITH {PROGRESS_SQL}, {_FINDINGS}, {_PLAN}, ev AS (SELECT axis_id, place, kind, segment_id, list(lap_no ORDER BY lap_no) AS laps FROM pl2 JOIN fi USING (axis_id, segment_id, kind) GROUP BY 1, 2, 3, 4)
 SELECT axis_id, count(*) AS n, sha256('{{"schema":"day-report-1","results":[' || string_agg('{{"place":' || place || ',"kind":"' || kind || '","segment_id":' || segment_id || ',"laps":[' || array_to_string(laps, ',') || ']}}', ',' ORDER BY place) || ']}}') AS digest, count(*) <= 64 AND sum(len(laps)) <= 4096 AND min(len(laps)) > 0 AS valid FROM ev GROUP BY 1""")
def day_reports(spark, sf_dir):
    found = _findings(spark, sf_dir)
    plan = season.plan(found, ["axis_id"], 10).withColumn("place", F.col("place").cast("long"))
    evidence = found.join(plan.select("axis_id", "segment_id", "kind", "place"), ["axis_id", "segment_id", "kind"])
    rows = evidence.groupBy("axis_id", "place", "kind", "segment_id").agg(F.array_sort(F.collect_list("lap_no")).alias("laps"))
    return season.report(rows, "axis_id").select("axis_id", "n", F.sha2("document", 256).alias("digest"), "valid")


@query(f"""WITH {LAPS_SQL} SELECT run_id, lap_no, sha256('{{"p0":' || run_id || ',"p1":' || lap_no || ',"p2":' || CASE WHEN excluded THEN '"x"' ELSE 'null' END || '}}') AS lap_key FROM laps""")
def lap_keys(spark, sf_dir):
    r = t.laps(spark, sf_dir)
    return r.select("run_id", "lap_no", season.digest_of(F.col("run_id"), F.col("lap_no"), F.when(F.col("excluded"), "x")).alias("lap_key"))


@query(f"WITH {LAPS_SQL}, r AS (SELECT run_id, min(clock) AS clock FROM laps GROUP BY 1) SELECT group_id, run_id, lap_no FROM laps WHERE run_id IN (SELECT run_id FROM r WHERE clock < (SELECT clock FROM r WHERE run_id = 7))")
def day_before_run(spark, sf_dir):
    r = t.laps(spark, sf_dir)
    return season.before_run(r, r.groupBy("run_id").agg(F.min("clock").alias("clock")), F.lit(7)).select("group_id", "run_id", "lap_no")


@query("""WITH c AS (SELECT c_custkey AS k, (ARRAY['km/h', 'KPH ', 'mph', 'mi/h', 'm/s', 'knots', '', 'furlong'])[c_custkey % 8 + 1] AS unit, (ARRAY['Speed', 'velocity-obd', 'oil_temp', 'heading', 'gps course (deg)', 'course_rate'])[c_custkey % 6 + 1] AS name, c_acctbal AS v FROM customer)
 SELECT k, CASE unit WHEN 'km/h' THEN 'km/h' WHEN 'KPH ' THEN 'km/h' WHEN 'mph' THEN 'mph' WHEN 'mi/h' THEN 'mph' WHEN 'm/s' THEN 'm/s' WHEN 'knots' THEN 'kn' WHEN '' THEN '' END AS canonical, round(v * CASE WHEN unit IN ('km/h', 'KPH ', '') THEN 1 / 3.6 WHEN unit IN ('mph', 'mi/h') THEN 0.44704 WHEN unit = 'm/s' THEN 1 WHEN unit = 'knots' THEN 0.514444 END, 4) AS mps,
 name IN ('Speed', 'velocity-obd') AS is_speed, name = 'oil_temp' AS is_temperature, name IN ('heading', 'gps course (deg)') AND unit = '' AS is_direction,
 CASE WHEN unit = '' THEN false ELSE unit IN ('km/h', 'KPH ') END AS like_kmh,
 CASE WHEN name NOT IN ('Speed', 'velocity-obd') THEN unit WHEN unit IN ('km/h', 'KPH ', '') THEN 'km/h' WHEN unit IN ('mph', 'mi/h') THEN 'mph' ELSE unit END AS effective,
 CASE WHEN unit IN ('km/h', 'KPH ') THEN 2.0 ELSE round(greatest(1e-9, abs(v) * 0.05), 6) END AS tolerance, CAST((v / 10000 > 0.1) AS BIGINT) + CAST((v / 10000 > 0.25) AS BIGINT) + CAST((v / 10000 > 0.5) AS BIGINT) + CAST((v / 10000 > 1) AS BIGINT) AS band FROM c""")
def channel_units(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (k % n + 1).cast("int"))
    r = t.read(spark, sf_dir, "customer").select(k.alias("k"), pick(["km/h", "KPH ", "mph", "mi/h", "m/s", "knots", "", "furlong"], 8).alias("unit"), pick(["Speed", "velocity-obd", "oil_temp", "heading", "gps course (deg)", "course_rate"], 6).alias("name"), F.col("c_acctbal").alias("v"))
    unit, name, v = F.col("unit"), F.col("name"), F.col("v")
    return r.select(
        "k", units.speed_unit(unit).alias("canonical"), F.round(units.speed_in_mps(v, unit), 4).alias("mps"), units.is_speed(name).alias("is_speed"),
        units.is_temperature(name).alias("is_temperature"), units.is_direction(name, unit).alias("is_direction"), units.same_speed_unit(unit, F.lit("km/h")).alias("like_kmh"),
        units.effective_unit(unit, name, F.lit("kmh")).alias("effective"), F.round(units.conflict_tolerance(unit, v), 6).alias("tolerance"),
        units.spread_band(v / 10000).cast("long").alias("band"),
    )
