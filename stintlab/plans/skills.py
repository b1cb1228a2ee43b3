"""Queries of skills: customers are sessions, nations tracks, and a run's sector times stand for its figures in corners."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlab.operators import laps, skills
from stintlab.operators.season import SKILLS
from stintlab.plans import tables as t
from stintlab.plans.registry import query, rounded
from stintlab.plans.tables import TIMES_SQL

#: Each corner figure from the spread q, the median m, the least b and the number n of a run's times in a sector.
_FIGURES = {
    "braking_spread_m": "q / 120", "lift_s": "q / 2000", "release_spread_m": "q / 90", "entry_spread_mps": "q / 700", "line_spread_m": "q / 900", "pickup_spread_m": "q / 110", "sequence_loss_s": "q / 12000",
    "throttle_known": "n", "released": "CASE WHEN m > 1600 THEN n - n // 2 ELSE n // 8 END", "deceleration_g": "1.2 - m / 20000", "best_deceleration_g": "1.2 - b / 20000",
    "minimum_mps": "30 - m / 1500", "best_minimum_mps": "30 - b / 1500", "exit_mps": "45 - m / 1300", "best_exit_mps": "45 - b / 1300",
}
_SESSIONS = f"""{TIMES_SQL}, se AS (SELECT run_id AS session_id, min(run_id % 3) AS car_id, min(group_id) AS track_id, count(*) AS ranked_laps, (quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25)) / 60007 AS lap_spread_s, CAST(floor(min(clock) / 86400 / 90) AS BIGINT) AS day FROM ok GROUP BY 1),
 tq AS (SELECT run_id AS session_id, segment AS corner_id, CASE WHEN count(*) > 1 THEN quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) END AS q, quantile_cont(seconds, 0.5) AS m, min(seconds) AS b, count(*) AS n FROM times GROUP BY 1, 2),
 co AS (SELECT session_id, corner_id, {', '.join(f'{v} AS {k}' for k, v in _FIGURES.items())} FROM tq),
 be AS (SELECT car_id, track_id, corner_id, max(best_deceleration_g) AS td, max(best_minimum_mps) AS tm, max(best_exit_mps) AS te FROM co JOIN se USING (session_id) GROUP BY ALL),
 ea AS (SELECT session_id, median(braking_spread_m) AS brakePointConsistency, median(lift_s) AS liftTiming, median(release_spread_m) AS brakeReleaseTiming, median(line_spread_m) AS lineConsistency, median(pickup_spread_m) AS throttleReapplication, median(entry_spread_mps * 3.6) AS turnInConsistency,
 median(greatest(td - deceleration_g, 0)) AS brakingEffectiveness, median(greatest(tm - minimum_mps, 0) * 3.6) AS minimumSpeedControl, median(greatest(te - exit_mps, 0) * 3.6) AS exitSpeedExecution, avg(sequence_loss_s) AS cornerSequenceManagement, sum(throttle_known) AS known, sum(released) AS rel
 FROM co JOIN se USING (session_id) JOIN be USING (car_id, track_id, corner_id) GROUP BY 1),
 wi AS (SELECT se.*, ea.* EXCLUDE (session_id), lap_spread_s AS paceConsistency, CASE WHEN known >= 3 AND ranked_laps >= 3 THEN rel / known * 100 END AS throttleCommitment FROM se LEFT JOIN ea USING (session_id)),
 me AS (SELECT session_id, track_id, day, ranked_laps, skill, value FROM (SELECT session_id, track_id, day, ranked_laps, unnest([{', '.join(f"'{n}'" for n, *_ in SKILLS)}]) AS skill, unnest([{', '.join(n for n, *_ in SKILLS)}]::DOUBLE[]) AS value FROM wi) WHERE value IS NOT NULL),
 bd AS (SELECT * FROM (VALUES {', '.join(f"('{n}', [{', '.join(str(float(x)) for x in b)}]::DOUBLE[])" for n, _, _, b in SKILLS)}) x(skill, bands))"""


def _measures(spark, sf_dir):
    ok = laps.eligible(t.laps(spark, sf_dir))
    q = F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.75)))
    sessions = ok.groupBy(F.col("run_id").alias("session_id")).agg(
        F.min(F.col("run_id") % 3).alias("car_id"), F.min("group_id").alias("track_id"), F.count("*").alias("ranked_laps"), ((q[1] - q[0]) / 60007).alias("lap_spread_s"), F.floor(F.min("clock") / 86400 / 90).alias("day")
    )
    q = F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = t.sector_times(spark, sf_dir).groupBy(F.col("run_id").alias("session_id"), F.col("segment").alias("corner_id")).agg(q.alias("p"), F.min("seconds").alias("b"), F.count("*").alias("n"))
    rows = rows.select("session_id", "corner_id", F.when(F.col("n") > 1, F.col("p")[2] - F.col("p")[0]).alias("q"), F.col("p")[1].alias("m"), "b", "n")
    corners = rows.select("session_id", "corner_id", *(F.expr(v.replace("n // 2", "n div 2").replace("n // 8", "n div 8").replace("1.2 -", "1.2e0 -")).alias(k) for k, v in _FIGURES.items()))
    return skills.session_measures(sessions, corners), sessions


@query(f"WITH {_SESSIONS} SELECT session_id, skill, round(value, 5) AS value, ranked_laps FROM me")
def skill_measures(spark, sf_dir):
    return rounded(_measures(spark, sf_dir)[0], 5)


@query(f"WITH {_SESSIONS} SELECT session_id, skill, CAST(5 - len(list_filter(bands, lambda x: value > x)) AS BIGINT) AS band FROM me JOIN bd USING (skill)")
def skill_bands(spark, sf_dir):
    rows = _measures(spark, sf_dir)[0]
    return rows.select("session_id", "skill", (5 - skills.exceeded(F.col("value"), F.col("skill"))).cast("long").alias("band"))


@query(f"""WITH {_SESSIONS}, dy AS (SELECT track_id, skill, day, sum(value * greatest(ranked_laps, 1)) AS s, sum(greatest(ranked_laps, 1)) AS w, sum(ranked_laps) AS l FROM me GROUP BY 1, 2, 3),
 nt AS (SELECT *, row_number() OVER (PARTITION BY track_id, skill ORDER BY day DESC) AS nth FROM dy),
 ag AS (SELECT track_id, skill, sum(CASE WHEN nth <= 3 THEN s END) / sum(CASE WHEN nth <= 3 THEN w END) AS value, sum(CASE WHEN nth > 3 THEN s END) / sum(CASE WHEN nth > 3 THEN w END) AS before, sum(CASE WHEN nth <= 3 THEN l END) AS laps, count_if(nth <= 3) AS days, max(day) AS last_day FROM nt WHERE nth <= 6 GROUP BY 1, 2),
 lv AS (SELECT *, 5 - len(list_filter(bands, lambda x: value > x)) AS now, CASE WHEN before IS NOT NULL THEN 5 - len(list_filter(bands, lambda x: before > x)) END AS earlier FROM ag JOIN bd USING (skill))
 SELECT track_id, skill, CAST(least(now, CASE WHEN laps >= 15 THEN 5 WHEN laps >= 5 THEN 4 ELSE 3 END) AS BIGINT) AS level, round(value, 5) AS value, CAST(laps AS BIGINT) AS ranked_laps, CAST(days AS BIGINT) AS days, CASE WHEN laps < 5 THEN 'low' WHEN laps < 15 THEN 'medium' ELSE 'high' END AS confidence,
 CASE WHEN now > earlier THEN 'improving' WHEN now < earlier THEN 'declining' WHEN earlier IS NOT NULL THEN 'steady' END AS trend, last_day FROM lv""")
def skill_levels(spark, sf_dir):
    rows, sessions = _measures(spark, sf_dir)
    found = skills.skill_levels(rows.join(sessions.select("session_id", "track_id", "day"), "session_id"), ["track_id"])
    return rounded(found.withColumns({"level": F.col("level").cast("long")}), 5)


@query(f"WITH {_SESSIONS} SELECT skill, count(*) AS sessions, CAST(count_if(len(list_filter(bands, lambda x: value > x)) = 0) AS BIGINT) AS at_best, any_value(bands[1]) AS first, any_value(bands[4]) AS last FROM me JOIN bd USING (skill) GROUP BY 1")
def skill_catalogue(spark, sf_dir):
    """Every skill's first and last band, how many sessions measured it and how many hold the first."""
    rows = _measures(spark, sf_dir)[0].groupBy("skill").agg(F.count("*").alias("sessions"), F.count_if(skills.exceeded(F.col("value"), F.col("skill")) == 0).alias("at_best"))
    bands = spark.createDataFrame([(n, float(b[0]), float(b[3])) for n, _, _, b in SKILLS], "skill string, first double, last double")
    return rows.join(F.broadcast(bands), "skill")  # a dozen skills
