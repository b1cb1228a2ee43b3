"""Queries of lap rows and segments: purchases are gate passes of a user's run, parts are segments of a brand's axis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.operators import rows, segments
from stintlab.plans import tables as t
from stintlab.plans.registry import _PIECES, query, rounded
from stintlab.plans.tables import LAPS_SQL, SAMPLES_SQL

#: Passes every user but those of an id that 5 divides has; times count from the run's first sample.
_RUNS = SAMPLES_SQL + (
    ", rn AS (SELECT run_id, min(t) AS o, max(t) - min(t) AS duration_s, CASE WHEN run_id % 4 > 0 THEN CAST(floor(min(t)) AS BIGINT) * 1000 END AS origin_ms FROM samples GROUP BY 1), "
    "ps AS (SELECT s.run_id, s.t - o AS t FROM samples s JOIN rn USING (run_id) WHERE channel = 'purchase' AND run_id % 5 > 0), "
    "pn AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS nx FROM ps WINDOW w AS (PARTITION BY run_id ORDER BY t)), "
    "se AS (SELECT x.*, origin_ms + CAST(round(t0 * 1000) AS BIGINT) AS clock_ms FROM (SELECT run_id, 'OUT' AS kind, 0 AS lap_no, 0.0 AS t0, t AS t1 FROM pn WHERE n = 1 UNION ALL SELECT run_id, 'LAP', n, t, nx FROM pn WHERE nx IS NOT NULL "
    "UNION ALL SELECT run_id, 'IN', 0, t, duration_s FROM pn JOIN rn USING (run_id) WHERE nx IS NULL UNION ALL SELECT run_id, 'UNKNOWN', 0, 0.0, duration_s FROM rn WHERE run_id % 5 = 0) x JOIN rn USING (run_id) WHERE t1 > t0)"
)


def runs(spark, sf_dir):
    out = t.samples(spark, sf_dir).groupBy("run_id").agg(F.min("t").alias("o"), (F.max("t") - F.min("t")).alias("duration_s"))
    return out.withColumn("origin_ms", F.when(F.col("run_id") % 4 > 0, F.floor("o").cast("long") * 1000))


def passes(spark, sf_dir):
    p = t.samples(spark, sf_dir).where("channel = 'purchase' and run_id % 5 > 0")
    return p.join(runs(spark, sf_dir).select("run_id", "o"), "run_id").select("run_id", (F.col("t") - F.col("o")).alias("t"))


def sections(spark, sf_dir):
    return rows.sections(runs(spark, sf_dir).drop("o"), passes(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run_id, kind, lap_no, round(t0, 6) AS t0, round(t1, 6) AS t1, coalesce(clock_ms, -1) AS clock_ms FROM se")
def lap_rows(spark, sf_dir):
    return rounded(sections(spark, sf_dir)).withColumn("clock_ms", F.coalesce("clock_ms", F.lit(-1).cast("long")))


@query(f"WITH {_RUNS} SELECT run_id, kind, lap_no, row_number() OVER (PARTITION BY run_id % 3 ORDER BY clock_ms NULLS LAST, run_id, t0) AS ord FROM se")
def lap_rows_in_order(spark, sf_dir):
    out = rows.in_order(sections(spark, sf_dir).withColumn("day", F.col("run_id") % 3), "day")
    return out.select("run_id", "kind", "lap_no", F.col("ord").cast("long").alias("ord"))


_COVER = (
    "fx AS (SELECT s.run_id, s.t - o AS t, CASE WHEN v > 5 THEN v END AS east FROM samples s JOIN rn USING (run_id) WHERE channel <> 'error'), "
    "sx AS (SELECT run_id, t, lead(t) OVER w AS nt, abs(lead(east) OVER w - east) AS m, east IS NULL OR lead(east) OVER w IS NULL AS bad FROM fx WINDOW w AS (PARTITION BY run_id ORDER BY t)), "
    "lp AS (SELECT run_id, lap_no, t0, t1 FROM se WHERE kind = 'LAP'), "
    "cv AS (SELECT l.run_id, l.lap_no, l.t0, l.t1, min(t) AS a, max(nt) AS z, bool_or(bad) AS bad, bool_or(nt - t > 150000) AS gap, sum(m) AS m FROM lp l LEFT JOIN sx ON sx.run_id = l.run_id AND nt IS NOT NULL AND t < t1 AND nt > t0 GROUP BY 1, 2, 3, 4), "
    "ci AS (SELECT run_id, lap_no, t1 - t0 AS seconds, CASE WHEN a IS NULL OR a > t0 OR z < t1 THEN 'gps gap' WHEN bad THEN 'invalid gps' WHEN gap THEN 'gps gap' ELSE 'none' END AS issue, m FROM cv), "
    "cl AS (SELECT run_id, lap_no, seconds, issue, CASE WHEN issue = 'none' THEN m END AS metres FROM ci)"
)


def _covered(spark, sf_dir):
    fixes = t.samples(spark, sf_dir).where("channel <> 'error'").join(runs(spark, sf_dir).select("run_id", "o"), "run_id")
    fixes = fixes.select("run_id", (F.col("t") - F.col("o")).alias("t"), F.when(F.col("v") > 5, F.col("v")).alias("east"), F.lit(0.0).alias("north"))
    laps = sections(spark, sf_dir).where("kind = 'LAP'").select("run_id", "lap_no", "t0", "t1")
    gaps = runs(spark, sf_dir).select("run_id", F.lit(150_000.0).alias("gap_s"))
    return rows.covered_laps(laps, fixes, gaps).join(laps.select("run_id", "lap_no", (F.col("t1") - F.col("t0")).alias("seconds")), ["run_id", "lap_no"])


@query(f"WITH {_RUNS}, {_COVER} SELECT run_id, lap_no, issue, round(metres, 6) AS metres FROM cl")
def lap_coverage(spark, sf_dir):
    return rounded(_covered(spark, sf_dir).drop("seconds"))


_LENGTHS = "ll AS (SELECT group_id, run_id, lap_no, seconds / 1000 AS seconds, CASE WHEN lap_no % 11 > 0 THEN (seconds / 1000) * (10 + lap_no % 40) END AS metres, CASE WHEN excluded THEN 'gps gap' ELSE 'none' END AS issue FROM laps)"
_PLAUSIBLE = (
    "lb AS (SELECT *, seconds NOT BETWEEN 3 AND 3600 OR coalesce(metres < 200 OR metres / seconds > 100, false) AS outside FROM ll), "
    "lm AS (SELECT *, count(CASE WHEN issue = 'none' AND NOT outside THEN metres END) OVER w AS n, quantile_cont(CASE WHEN issue = 'none' AND NOT outside THEN metres END, 0.5) OVER w AS mid FROM lb WINDOW w AS (PARTITION BY run_id)), "
    "lq AS (SELECT group_id, run_id, lap_no, seconds, metres, CASE WHEN issue = 'none' AND (outside OR coalesce(n >= 2 AND metres < 0.8 * mid, false)) THEN 'implausible' ELSE issue END AS issue FROM lm)"
)


def _lengths(spark, sf_dir):
    r = t.laps(spark, sf_dir)
    s = F.col("seconds") / 1000
    return r.select("group_id", "run_id", "lap_no", s.alias("seconds"), F.when(F.col("lap_no") % 11 > 0, s * (10 + F.col("lap_no") % 40)).alias("metres"), F.when(F.col("excluded"), "gps gap").otherwise("none").alias("issue"))


@query(f"WITH {LAPS_SQL}, {_LENGTHS}, {_PLAUSIBLE} SELECT run_id, lap_no, issue FROM lq")
def implausible_laps(spark, sf_dir):
    return rows.plausible(_lengths(spark, sf_dir)).select("run_id", "lap_no", "issue")


@query(f"""WITH {LAPS_SQL}, {_LENGTHS}, {_PLAUSIBLE}, g AS (SELECT group_id, quantile_cont(metres, 0.5) AS mid, count(DISTINCT run_id) AS r FROM lq WHERE issue = 'none' AND metres IS NOT NULL GROUP BY 1)
 SELECT group_id, run_id, lap_no, coalesce(r >= 2 AND metres < 0.8 * mid, false) AS short FROM lq LEFT JOIN g USING (group_id)""")
def short_laps(spark, sf_dir):
    return rows.short_for_group(rows.plausible(_lengths(spark, sf_dir))).select("group_id", "run_id", "lap_no", "short")


_COMPAT = """cc AS (SELECT group_id, run_id, lap_no, seconds, CASE WHEN run_id % 13 > 0 THEN 'l' || (run_id % 2) END AS layout, CASE WHEN run_id % 17 > 0 THEN CASE WHEN lap_no % 29 = 0 THEN 'back' ELSE 'on' END END AS direction,
 CASE run_id % 19 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'none' ELSE 'gates-v2:' || sha256(CAST(run_id % 3 AS VARCHAR)) END AS gates, CASE lap_no % 23 WHEN 0 THEN 'gps gap' WHEN 1 THEN 'invalid gps' WHEN 2 THEN 'implausible' ELSE 'none' END AS issue, excluded FROM laps),
 ci AS (SELECT group_id, run_id, lap_no, seconds, concat_ws(',', CASE WHEN layout IS NULL THEN 'layout unresolved' END, CASE WHEN direction IS NULL THEN 'direction unresolved' END, CASE WHEN gates = 'none' THEN 'gate unresolved' END,
 CASE WHEN layout <> 'l1' THEN 'changed layout' END, CASE WHEN direction <> 'on' THEN 'opposite direction' END, CASE WHEN gates <> 'none' AND gates <> 'gates-v2:' || sha256('1') THEN 'changed gate' END,
 CASE issue WHEN 'gps gap' THEN 'incomplete gps' WHEN 'invalid gps' THEN 'invalid gps' WHEN 'implausible' THEN 'implausible' END, CASE WHEN excluded THEN 'excluded' END) AS issues FROM cc)"""


def _compat(spark, sf_dir):
    run, lap = F.col("run_id"), F.col("lap_no")
    r = t.laps(spark, sf_dir).select(
        "group_id", "run_id", "lap_no", "seconds", "excluded", F.when(run % 13 > 0, F.concat(F.lit("l"), (run % 2).cast("string"))).alias("layout"),
        F.when(run % 17 > 0, F.when(lap % 29 == 0, "back").otherwise("on")).alias("direction"),
        F.when(run % 19 == 0, "none").when(run % 19 == 1, F.concat(F.lit("gates-v3:"), F.sha2(F.lit("1"), 256))).when(run % 19 == 2, "gates-v2:ab12").otherwise(F.concat(F.lit("gates-v2:"), F.sha2((run % 3).cast("string"), 256))).alias("gates"),
        F.when(lap % 23 == 0, "gps gap").when(lap % 23 == 1, "invalid gps").when(lap % 23 == 2, "implausible").otherwise("none").alias("issue"),
        F.lit("l1").alias("ref_layout"), F.lit("on").alias("ref_direction"), F.concat(F.lit("gates-v2:"), F.sha2(F.lit("1"), 256)).alias("ref_gates"),
    )
    return r


@query(f"WITH {LAPS_SQL}, {_COMPAT} SELECT group_id, run_id, lap_no, issues FROM ci")
def lap_compatibility(spark, sf_dir):
    return rows.compatibility(_compat(spark, sf_dir)).select("group_id", "run_id", "lap_no", F.concat_ws(",", "issues").alias("issues"))


@query(f"""WITH {LAPS_SQL}, {_COMPAT}, di AS (SELECT *, concat_ws(',', nullif(issues, ''), CASE WHEN lap_no % 31 = 0 THEN 'different route' END, CASE WHEN lap_no % 37 = 0 AND NOT contains(issues, 'implausible') THEN 'implausible' END, CASE WHEN run_id % 41 = 0 THEN 'stale source' END) AS d FROM ci)
 SELECT group_id, run_id, lap_no, concat_ws(',', nullif(d, ''), CASE WHEN lap_no % 43 = 0 THEN 'not a timed lap' WHEN lap_no % 47 = 0 AND d = '' THEN 'ineligible' END) AS issues FROM di""")
def lap_issues(spark, sf_dir):
    lap, run = F.col("lap_no"), F.col("run_id")
    told = _compat(spark, sf_dir).withColumns({"off_route": lap % 31 == 0, "short": lap % 37 == 0, "stale": run % 41 == 0, "timed": lap % 43 != 0, "eligible": lap % 47 != 0})
    return rows.day_issues(told).select("group_id", "run_id", "lap_no", F.concat_ws(",", "issues").alias("issues"))


@query(f"""WITH {LAPS_SQL}, {_COMPAT}, ok3 AS (SELECT * FROM ci WHERE issues = ''), b AS (SELECT group_id, run_id AS other_run, arg_min(lap_no, (seconds, lap_no)) AS other_lap FROM ok3 GROUP BY 1, 2)
 SELECT group_id, run_id, lap_no, other_run, other_lap FROM ok3 JOIN b USING (group_id) WHERE run_id <> other_run""")
def comparison_candidates(spark, sf_dir):
    return rows.candidates(rows.compatibility(_compat(spark, sf_dir)))


#: Of each brand the first parts by key, one after another; every third axis has a segment that wraps or a flaw.
_SEG = """s0 AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS axis_id, p_partkey AS segment_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord, p_size, p_partkey FROM part),
 sg AS (SELECT axis_id, ord, segment_id, CASE WHEN p_size % 2 = 0 THEN 'corner' ELSE 'straight' END AS kind, ord * 100.0 AS start_m, CASE WHEN ord = 20 AND axis_id % 3 = 0 THEN 50.0 WHEN axis_id % 7 = 1 AND ord = 4 THEN 550.0 ELSE ord * 100.0 + 40 + p_size END AS end_m, p_partkey % 2 = 0 AS approved FROM s0 WHERE ord <= 20),
 s2 AS (SELECT axis_id, ord, segment_id + 100000 AS segment_id, kind, start_m + (segment_id % 90) AS start_m, CASE WHEN end_m < start_m THEN end_m ELSE end_m + (segment_id % 90) END AS end_m FROM sg),
 u1 AS (SELECT axis_id, segment_id, start_m AS a, end_m AS z FROM sg WHERE end_m >= start_m UNION ALL SELECT axis_id, segment_id, start_m, 2200.0 FROM sg WHERE end_m < start_m UNION ALL SELECT axis_id, segment_id, 0.0, end_m FROM sg WHERE end_m < start_m),
 u2 AS (SELECT axis_id, segment_id, start_m AS a, end_m AS z FROM s2 WHERE end_m >= start_m UNION ALL SELECT axis_id, segment_id, start_m, 2200.0 FROM s2 WHERE end_m < start_m UNION ALL SELECT axis_id, segment_id, 0.0, end_m FROM s2 WHERE end_m < start_m),
 ov AS (SELECT u1.axis_id, u1.segment_id AS a_id, u2.segment_id AS b_id, sum(least(u1.z, u2.z) - greatest(u1.a, u2.a)) AS metres FROM u1 JOIN u2 ON u1.axis_id = u2.axis_id AND u1.a < u2.z AND u2.a < u1.z GROUP BY 1, 2, 3),
 os AS (SELECT ov.*, metres / least(la, lb) AS share FROM ov JOIN (SELECT axis_id, segment_id AS a_id, sum(z - a) AS la FROM u1 GROUP BY 1, 2) USING (axis_id, a_id) JOIN (SELECT axis_id, segment_id AS b_id, sum(z - a) AS lb FROM u2 GROUP BY 1, 2) USING (axis_id, b_id))"""


def axis_segments(spark, sf_dir):
    axis = F.regexp_replace("p_brand", "Brand#", "").cast("long")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    r = t.read(spark, sf_dir, "part").select(axis.alias("axis_id"), F.row_number().over(w).cast("long").alias("ord"), F.col("p_partkey").cast("long").alias("segment_id"), "p_size").where("ord <= 20")
    end = F.when((F.col("ord") == 20) & (F.col("axis_id") % 3 == 0), 50.0).when((F.col("axis_id") % 7 == 1) & (F.col("ord") == 4), 550.0).otherwise(F.col("ord") * F.lit(100.0) + 40 + F.col("p_size"))
    kind = F.when(F.col("p_size") % 2 == 0, "corner").otherwise("straight")
    return r.select("axis_id", "ord", "segment_id", kind.alias("kind"), (F.col("ord") * F.lit(100.0)).alias("start_m"), end.alias("end_m"), (F.col("segment_id") % 2 == 0).alias("approved"))


def _other(spark, sf_dir):
    move = F.col("segment_id") % 90
    end = F.when(F.col("end_m") < F.col("start_m"), F.col("end_m")).otherwise(F.col("end_m") + move)
    r = axis_segments(spark, sf_dir).select("axis_id", "ord", "kind", (F.col("segment_id") + 100_000).alias("segment_id"), (F.col("start_m") + move).alias("start_m"), end.alias("end_m"))
    return r


def _lengths_of(segs):
    return segs.select("axis_id").distinct().withColumn("length_m", F.lit(2200.0))


@query(f"""WITH {_SEG}, v AS (SELECT *, lead(ord) OVER w IS NULL AS last, lag(end_m) OVER w AS before, first_value(start_m) OVER w AS f FROM sg WINDOW w AS (PARTITION BY axis_id ORDER BY ord))
 SELECT axis_id, count(*) AS n, count(DISTINCT segment_id) = count(*) AND count(*) <= 64 AND bool_and(start_m >= 0 AND end_m <> start_m AND (before IS NULL OR before <= start_m) AND (end_m >= start_m OR (last AND end_m <= f))) AS valid FROM v GROUP BY 1""")
def valid_segments(spark, sf_dir):
    return segments.valid(axis_segments(spark, sf_dir))


@query(f"WITH {_SEG} SELECT axis_id, a_id, b_id, metres, round(share, 4) AS share FROM os")
def segment_overlaps(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    return rounded(segments.overlaps(a, _other(spark, sf_dir), _lengths_of(a)), 4)


@query(f"WITH {_SEG} SELECT axis_id, a_id, arg_min(b_id, (-metres, b_id)) AS b_id FROM os WHERE share >= 0.5 GROUP BY 1, 2")
def carried_segments(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    return segments.carried(a, _other(spark, sf_dir), _lengths_of(a))


@query(f"""WITH RECURSIVE {_SEG}, rk AS (SELECT axis_id, a_id, b_id, row_number() OVER (PARTITION BY axis_id ORDER BY metres DESC, a_id, b_id) AS k FROM os WHERE share >= 0.5),
 gr AS (SELECT axis_id, 0 AS k, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub FROM (SELECT DISTINCT axis_id FROM rk)
 UNION ALL SELECT g.axis_id, r.k, CASE WHEN list_contains(ua, a_id) OR list_contains(ub, b_id) THEN ua ELSE list_append(ua, a_id) END, CASE WHEN list_contains(ua, a_id) OR list_contains(ub, b_id) THEN ub ELSE list_append(ub, b_id) END FROM gr g JOIN rk r ON r.axis_id = g.axis_id AND r.k = g.k + 1)
 SELECT axis_id, unnest(ua) AS a_id, unnest(ub) AS b_id FROM (SELECT axis_id, arg_max(ua, k) AS ua, arg_max(ub, k) AS ub FROM gr GROUP BY 1)""")
def matched_corners(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    return segments.matched(a, _other(spark, sf_dir), _lengths_of(a))


@query(f"""WITH {_SEG}, m AS (SELECT axis_id, a_id, arg_min(b_id, (-metres, b_id)) AS b_id FROM os GROUP BY 1, 2)
 SELECT sg.axis_id, sg.segment_id, coalesce(b_id, -1) AS approved_id, CASE WHEN b_id IS NULL THEN 'new' WHEN abs(sg.start_m - s2.start_m) <= 10 AND abs(sg.end_m - s2.end_m) <= 10 AND sg.kind = s2.kind THEN 'same' ELSE 'changed' END AS state
 FROM sg LEFT JOIN m ON m.axis_id = sg.axis_id AND a_id = sg.segment_id LEFT JOIN s2 ON s2.axis_id = sg.axis_id AND s2.segment_id = b_id""")
def reviewed_proposals(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    return segments.reviewed(a, _other(spark, sf_dir), _lengths_of(a)).withColumn("approved_id", F.coalesce("approved_id", F.lit(-1).cast("long")))


_S = "axis_id, ord, segment_id, kind, start_m, end_m, approved"


@query(f"WITH {_SEG} SELECT axis_id, ord, segment_id, kind, start_m, end_m, approved OR segment_id % 3 = 0 AS approved FROM sg")
def approved_segments(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    return segments.approved(a, a.where("segment_id % 3 = 0"))


@query(f"""WITH {_SEG}, e AS (SELECT *, CASE WHEN segment_id % 5 = 0 THEN start_m + 10 END AS ns, CASE WHEN segment_id % 5 = 0 THEN CAST(NULL AS DOUBLE) WHEN segment_id % 5 = 1 THEN end_m - 3 END AS ne FROM sg),
 w AS (SELECT *, coalesce(ns, CASE WHEN lag(end_m) OVER v = start_m THEN lag(ne) OVER v END, start_m) AS s1, coalesce(ne, CASE WHEN lead(start_m) OVER v = end_m THEN lead(ns) OVER v END, end_m) AS e1 FROM e WINDOW v AS (PARTITION BY axis_id ORDER BY ord))
 SELECT axis_id, ord, segment_id, kind, s1 AS start_m, e1 AS end_m, approved AND s1 = start_m AND e1 = end_m AS approved FROM w""")
def edited_segments(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    e = a.where("segment_id % 5 < 2").select("axis_id", "segment_id", F.when(F.col("segment_id") % 5 == 0, F.col("start_m") + 10).alias("new_start_m"), F.when(F.col("segment_id") % 5 == 1, F.col("end_m") - 3).alias("new_end_m"))
    return segments.edited(a, e)


@query(f"""WITH {_SEG}, h AS (SELECT sg.*, CASE WHEN segment_id % 4 = 0 AND start_m + 45 < end_m THEN start_m + 45 END AS at_m FROM sg),
 x AS (SELECT *, 0 AS half FROM h WHERE at_m IS NULL UNION ALL SELECT *, 1 FROM h WHERE at_m IS NOT NULL UNION ALL SELECT *, 2 FROM h WHERE at_m IS NOT NULL)
 SELECT axis_id, row_number() OVER (PARTITION BY axis_id ORDER BY ord, half) AS ord, CASE WHEN half = 2 THEN segment_id + 1000000 ELSE segment_id END AS segment_id, kind, CASE WHEN half = 2 THEN at_m ELSE start_m END AS start_m, CASE WHEN half = 1 THEN at_m ELSE end_m END AS end_m, approved AND half = 0 AS approved FROM x""")
def split_segments(spark, sf_dir):
    a = axis_segments(spark, sf_dir)
    cuts = a.where("segment_id % 4 = 0").select("axis_id", "segment_id", (F.col("start_m") + 45).alias("at_m"))
    return segments.split(a, cuts, F.col("segment_id") + 1_000_000)


@query(f"""WITH {_SEG}, h AS (SELECT *, lead(ord) OVER v IS NOT NULL AND ord % 5 = 2 AS head, ord % 5 = 3 AND lag(ord) OVER v IS NOT NULL AS tail, lead(end_m) OVER v AS ne FROM sg WINDOW v AS (PARTITION BY axis_id ORDER BY ord))
 SELECT axis_id, row_number() OVER (PARTITION BY axis_id ORDER BY ord) AS ord, segment_id, kind, start_m, CASE WHEN head THEN ne ELSE end_m END AS end_m, approved AND NOT head AS approved FROM h WHERE NOT tail""")
def merged_segments(spark, sf_dir):
    """The second and third of every five as keys: the third is a next one, so it counts for nothing."""
    a = axis_segments(spark, sf_dir)
    return segments.merged(a, a.where("ord % 5 in (2, 3)"))


_REVISIONS = f"rv AS (SELECT axis_id, sha256(string_agg(concat_ws('|', segment_id, kind, CAST(start_m AS DOUBLE), CAST(end_m AS DOUBLE)), chr(10) ORDER BY ord)) AS revision FROM sg GROUP BY 1)"


@query(f"WITH {_SEG}, {_REVISIONS} SELECT axis_id, revision FROM rv")
def segment_revisions(spark, sf_dir):
    return segments.revision(axis_segments(spark, sf_dir))


@query(f"WITH {_SEG}, {_REVISIONS} SELECT axis_id, axis_id % 2 = 0 AND axis_id % 3 > 0 AS current FROM rv")
def current_results(spark, sf_dir):
    rv = segments.revision(axis_segments(spark, sf_dir))
    made = rv.select("axis_id", F.when(F.col("axis_id") % 2 == 0, F.col("revision")).otherwise("old").alias("made_revision"), F.when(F.col("axis_id") % 3 > 0, 2).otherwise(1).alias("made_by"))
    return segments.current(made, rv, 2).select("axis_id", "current")


@query(f"""WITH {_SEG}, r AS (SELECT c_nationkey AS group_id, c_custkey AS run_id, c_custkey % 40 AS axis_id, c_custkey AS ord FROM customer)
 SELECT CAST(group_id AS BIGINT) AS group_id, arg_min(run_id, ord) AS run_id, arg_min(axis_id, ord) AS axis_id FROM r WHERE axis_id IN (SELECT axis_id FROM sg) GROUP BY 1""")
def canonical_segmentation(spark, sf_dir):
    k = F.col("c_custkey")
    r = t.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("group_id"), k.alias("run_id"), (k % 40).alias("axis_id"), k.alias("ord"))
    return segments.canonical(axis_segments(spark, sf_dir), r)
