"""Queries of laps along an axis: line items are samples at every hundred metres, nations are axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlab.operators import along, measures
from stintlab.operators.written import written
from stintlab.plans import tables as t
from stintlab.plans.registry import query, rounded
from stintlab.plans.tables import LAPS_SQL

PROGRESS_SQL = (
    LAPS_SQL + ", p AS (SELECT group_id AS axis_id, run_id, lap_no, i + s / 10000 AS t, i * 100.0 AS progress_m, v FROM (SELECT l_orderkey AS lap_no, l_linenumber AS i, "
    "min(l_extendedprice / l_quantity) AS s, max(l_quantity) AS v FROM lineitem GROUP BY ALL) x JOIN laps USING (lap_no)), "
    "st AS (SELECT * FROM (SELECT *, lag(progress_m) OVER w AS p0, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY axis_id, run_id, lap_no ORDER BY t)) WHERE progress_m > p0 AND progress_m - p0 <= 150), "
    "g AS (SELECT DISTINCT group_id AS axis_id FROM laps), "
    "sg AS (SELECT axis_id, k AS segment_id, CASE WHEN k % 2 = 0 THEN 'corner' ELSE 'straight' END AS kind, (ARRAY[110.0, 290.0, 440.0, 600.0])[k] + axis_id AS start_m, (ARRAY[290.0, 440.0, 600.0, 700.0])[k] + CASE WHEN k = 4 THEN 0 ELSE axis_id END AS end_m FROM g, range(1, 5) r(k)), "
    "mk AS (SELECT axis_id, start_m AS m FROM sg UNION SELECT axis_id, end_m FROM sg), "
    "cx AS (SELECT axis_id, run_id, lap_no, m, min(t0 + (t - t0) * (m - p0) / (progress_m - p0)) AS t FROM st JOIN mk USING (axis_id) WHERE m BETWEEN p0 AND progress_m GROUP BY 1, 2, 3, 4), "
    "tm AS (SELECT a.axis_id, a.run_id, a.lap_no, segment_id, b.t - a.t AS seconds FROM sg JOIN cx a ON a.axis_id = sg.axis_id AND a.m = start_m JOIN cx b ON b.axis_id = a.axis_id AND b.run_id = a.run_id AND b.lap_no = a.lap_no AND b.m = end_m WHERE b.t > a.t), "
    "sp AS (SELECT axis_id, run_id, lap_no, segment_id, count(*) AS n, arg_min(v, progress_m) AS entry, min(v) AS least, arg_min(progress_m, (v, progress_m)) AS least_m, max(v) AS greatest, arg_max(v, progress_m) AS exit FROM p JOIN sg USING (axis_id) WHERE progress_m BETWEEN start_m AND end_m GROUP BY 1, 2, 3, 4), "
    "pr AS (SELECT axis_id, run_id AS a_run, lap_no AS a_lap, run_id AS b_run, lead(lap_no) OVER (PARTITION BY axis_id, run_id ORDER BY lap_no) AS b_lap FROM (SELECT group_id AS axis_id, run_id, lap_no FROM laps)) "
)
_L = "axis_id, run_id, lap_no"
_PAIR = "axis_id, a_run, a_lap, b_run, b_lap"


def progress(spark, sf_dir):
    line = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("lap_no"), F.col("l_linenumber").alias("i"))
    rows = line.agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("s"), F.max("l_quantity").alias("v"))
    rows = rows.join(t.laps(spark, sf_dir).select(F.col("group_id").alias("axis_id"), "run_id", "lap_no"), "lap_no")
    return rows.select("axis_id", "run_id", "lap_no", (F.col("i") + F.col("s") / 10000).alias("t"), (F.col("i") * F.lit(100.0)).alias("progress_m"), "v")


def segments(spark, sf_dir):
    axes = t.laps(spark, sf_dir).select(F.col("group_id").alias("axis_id")).distinct()
    made = spark.createDataFrame([(1, "straight", 110.0, 290.0), (2, "corner", 290.0, 440.0), (3, "straight", 440.0, 600.0), (4, "corner", 600.0, 700.0)], "segment_id long, kind string, a double, z double")
    last = F.col("segment_id") == 4
    rows = axes.crossJoin(F.broadcast(made))  # four rows
    return rows.select("axis_id", "segment_id", "kind", (F.col("a") + F.col("axis_id")).alias("start_m"), (F.col("z") + F.when(last, 0).otherwise(F.col("axis_id"))).alias("end_m"))


def lap_pairs(spark, sf_dir):
    """Each lap of a run with the next by number."""
    from pyspark.sql import Window

    w = Window.partitionBy("group_id", "run_id").orderBy("lap_no")
    rows = t.laps(spark, sf_dir).withColumn("b_lap", F.lead("lap_no").over(w)).where("b_lap is not null")
    return rows.select(F.col("group_id").alias("axis_id"), F.col("run_id").alias("a_run"), F.col("lap_no").alias("a_lap"), F.col("run_id").alias("b_run"), "b_lap")


@query(f"WITH {PROGRESS_SQL} SELECT {_L}, p0 AS from_m, progress_m AS to_m FROM (SELECT *, lag(progress_m) OVER (PARTITION BY {_L} ORDER BY t) AS p0 FROM p) WHERE progress_m - p0 >= 150")
def projection_gaps(spark, sf_dir):
    return rounded(along.coverage_gaps(progress(spark, sf_dir), 150.0))


@query(f"WITH {PROGRESS_SQL} SELECT {_L}, segment_id, round(sum(least(progress_m, end_m) - greatest(p0, start_m)), 4) AS covered_m, round(max(end_m - start_m), 4) AS length_m FROM st JOIN sg USING (axis_id) WHERE p0 < end_m AND progress_m > start_m GROUP BY ALL")
def projected_coverage(spark, sf_dir):
    return rounded(along.covered(progress(spark, sf_dir), segments(spark, sf_dir)), 4)


@query(f"""WITH {PROGRESS_SQL}, pb AS (SELECT {_L}, k + 0.5 AS t FROM (SELECT DISTINCT {_L} FROM p), range(1, 7) r(k))
 SELECT {_L}, t, round(max(CASE WHEN progress_m - p0 BETWEEN 0 AND 150 THEN p0 + (progress_m - p0) * (t - t0) / (t1 - t0) END), 4) AS progress_m FROM
 (SELECT pb.*, s.t AS t1, s.p0, s.t0, s.progress_m FROM pb LEFT JOIN (SELECT {_L}, t, progress_m, lag(progress_m) OVER w AS p0, lag(t) OVER w AS t0 FROM p WINDOW w AS (PARTITION BY {_L} ORDER BY t)) s
 ON s.axis_id = pb.axis_id AND s.run_id = pb.run_id AND s.lap_no = pb.lap_no AND s.t0 < pb.t AND s.t > pb.t) GROUP BY {_L}, t""")
def progress_at_time(spark, sf_dir):
    rows = progress(spark, sf_dir)
    probes = rows.select(*along.LAP).distinct().select(*along.LAP, F.explode(F.array(*(F.lit(k + 0.5) for k in range(1, 7)))).alias("t"))
    return rounded(along.progress_at_time(probes, rows), 4)


_GRID = f"gr AS (SELECT {_L}, at_m, min(t0 + (t - t0) * s) AS t, arg_min(v0 + (v - v0) * s, t0) AS v FROM (SELECT *, k * 30.0 AS at_m, (k * 30.0 - p0) / (progress_m - p0) AS s FROM st, unnest(range(CAST(ceil(p0 / 30) AS BIGINT), CAST(ceil(progress_m / 30) AS BIGINT))) u(k)) GROUP BY {_L}, at_m)"


@query(f"WITH {PROGRESS_SQL}, {_GRID} SELECT {_L}, at_m, round(t, 4) AS t, round(v, 4) AS v FROM gr")
def channel_along_progress(spark, sf_dir):
    return rounded(along.on_grid(progress(spark, sf_dir), 30.0), 4)


@query(f"""WITH {PROGRESS_SQL}, {_GRID}, d AS (SELECT {_L}, at_m, t - first_value(t) OVER w AS d, first_value(at_m) OVER w AS m FROM gr WINDOW w AS (PARTITION BY {_L} ORDER BY at_m))
 SELECT {_PAIR}, a.at_m, round(a.d - b.d, 4) AS delta_s FROM pr JOIN d a USING (axis_id) JOIN d b USING (axis_id) WHERE a.run_id = a_run AND a.lap_no = a_lap AND b.run_id = b_run AND b.lap_no = b_lap AND a.at_m = b.at_m AND a.m <= 215 AND b.m <= 215""")
def lap_time_delta(spark, sf_dir):
    return rounded(along.timed_delta(progress(spark, sf_dir), lap_pairs(spark, sf_dir), 30.0, anchor_m=215.0), 4)


@query(f"WITH {PROGRESS_SQL} SELECT {_L}, segment_id, round(seconds, 4) AS seconds FROM tm")
def segment_times(spark, sf_dir):
    return rounded(along.segment_times(progress(spark, sf_dir), segments(spark, sf_dir)), 4)


@query(f"WITH {PROGRESS_SQL} SELECT {_L}, segment_id, n, entry, least, least_m, greatest, exit FROM sp")
def segment_speeds(spark, sf_dir):
    return rounded(along.segment_speeds(progress(spark, sf_dir), segments(spark, sf_dir)))


@query(f"""WITH {PROGRESS_SQL}, wd AS (SELECT axis_id, 9 AS segment_id, 90.0 + axis_id AS start_m, 760.0 AS end_m FROM g),
 c AS (SELECT {_L}, segment_id, progress_m, v, min(v) OVER w AS least, max(v) OVER w AS top, min(progress_m) OVER w AS a, max(progress_m) OVER w AS z, arg_min(progress_m, (v, progress_m)) OVER w AS least_m FROM p JOIN wd USING (axis_id) WHERE progress_m BETWEEN start_m AND end_m WINDOW w AS (PARTITION BY {_L}, segment_id)),
 e AS (SELECT {_L}, segment_id, coalesce(max(CASE WHEN v > least + 0.02 * (top - least) AND progress_m < least_m THEN progress_m END), -1) AS lo, coalesce(min(CASE WHEN v > least + 0.02 * (top - least) AND progress_m > least_m THEN progress_m END), 1e9) AS hi FROM c GROUP BY ALL),
 n AS (SELECT {_L}, segment_id, any_value(least) AS least, any_value(top) AS top, any_value(least_m) AS least_m, any_value(a) AS a, any_value(z) AS z, min(progress_m) AS from_m, max(progress_m) AS to_m FROM c JOIN e USING ({_L}, segment_id) WHERE progress_m > lo AND progress_m < hi GROUP BY ALL)
 SELECT {_L}, segment_id, least, CASE WHEN top > least THEN least_m END AS least_m, CASE WHEN top > least THEN from_m END AS from_m, CASE WHEN top > least THEN to_m END AS to_m, CASE WHEN top > least THEN 100 + greatest(least_m - from_m, to_m - least_m) END AS tolerance_m,
 CASE WHEN top = least THEN 'flat speed' WHEN from_m = a OR to_m = z THEN 'at the boundary' ELSE 'resolved' END AS state FROM n""")
def minimum_speeds(spark, sf_dir):
    """Of one long corner, so that a lap has up to seven samples in it."""
    whole = segments(spark, sf_dir).select("axis_id").distinct().select("axis_id", F.lit(9).cast("long").alias("segment_id"), F.lit("corner").alias("kind"), (F.col("axis_id") + 90.0).alias("start_m"), F.lit(760.0).alias("end_m"))
    return rounded(along.minimum_speed(progress(spark, sf_dir), whole, 100.0))


_EXITS = f"""pk AS (SELECT {_L}, segment_id, min(progress_m) AS pickup_m FROM p JOIN sg USING (axis_id) WHERE kind = 'corner' AND progress_m BETWEEN start_m AND end_m AND v >= 25 GROUP BY ALL),
 ex AS (SELECT sp.axis_id, sp.run_id, sp.lap_no, sp.segment_id, pickup_m, exit AS exit_v, tm.seconds AS straight_s FROM sp JOIN sg USING (axis_id, segment_id) LEFT JOIN pk USING ({_L}, segment_id)
 LEFT JOIN tm ON tm.axis_id = sp.axis_id AND tm.run_id = sp.run_id AND tm.lap_no = sp.lap_no AND sp.segment_id = 2 AND tm.segment_id = 3 WHERE kind = 'corner')"""


def _exits(spark, sf_dir):
    rows, segs = progress(spark, sf_dir), segments(spark, sf_dir)
    own = rows.join(segs.where("kind = 'corner'").select("axis_id", "segment_id", "start_m", "end_m"), "axis_id").where("progress_m between start_m and end_m and v >= 25")
    return along.exit_metrics(rows, segs, own.groupBy(*along.LAP, "segment_id").agg(F.min("progress_m").alias("pickup_m")))


@query(f"WITH {PROGRESS_SQL}, {_EXITS} SELECT {_L}, segment_id, pickup_m, exit_v, round(straight_s, 4) AS straight_s FROM ex")
def exit_metrics(spark, sf_dir):
    return rounded(_exits(spark, sf_dir), 4)


_PARTS = "pt AS (SELECT axis_id, segment_id, part, a AS start_m, z AS end_m FROM (SELECT axis_id, segment_id, unnest([1, 2, 3]) AS part, unnest([start_m, start_m + 40, end_m - 30]) AS a, unnest([start_m + 40, end_m - 30, end_m]) AS z FROM sg WHERE kind = 'corner'))"
_PHASES = f""", mp AS (SELECT axis_id, start_m AS m FROM pt UNION SELECT axis_id, end_m FROM pt),
 cp AS (SELECT {_L}, m, min(t0 + (t - t0) * (m - p0) / (progress_m - p0)) AS t FROM st JOIN mp USING (axis_id) WHERE m BETWEEN p0 AND progress_m GROUP BY ALL),
 ph AS (SELECT a.axis_id, a.run_id, a.lap_no, segment_id, part, b.t - a.t AS seconds FROM pt JOIN cp a ON a.axis_id = pt.axis_id AND a.m = start_m JOIN cp b ON b.axis_id = a.axis_id AND b.run_id = a.run_id AND b.lap_no = a.lap_no AND b.m = end_m WHERE b.t > a.t)"""


def _parts(spark, sf_dir):
    rows = segments(spark, sf_dir).where("kind = 'corner'").withColumns({"apex_from_m": F.col("start_m") + 40, "apex_to_m": F.col("end_m") - 30})
    return along.parts_of(rows)


@query(f"WITH {PROGRESS_SQL}, {_PARTS}{_PHASES} SELECT {_L}, segment_id, part, round(seconds, 4) AS seconds FROM ph")
def corner_phase_times(spark, sf_dir):
    return rounded(along.phase_times(progress(spark, sf_dir), _parts(spark, sf_dir)), 4)


@query(f"""WITH {PROGRESS_SQL}, {_PARTS}{_PHASES}, b AS (SELECT axis_id, segment_id, part, min(seconds) AS s, arg_min({{'r': run_id, 'l': lap_no}}, (seconds, run_id, lap_no)) AS w FROM ph GROUP BY 1, 2, 3)
 SELECT axis_id, segment_id, part, round(s, 4) AS best_s, w.r AS run_id, w.l AS lap_no, round(CASE WHEN count(*) OVER c = 3 THEN sum(s) OVER c END, 4) AS total_s FROM b WINDOW c AS (PARTITION BY axis_id, segment_id)""")
def phase_reference(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return rounded(along.phase_reference(along.phase_times(progress(spark, sf_dir), parts), parts), 4)


@query(f"""WITH {PROGRESS_SQL} SELECT {_PAIR}, segment_id, round(a.seconds, 4) AS a_seconds, round(b.seconds, 4) AS b_seconds, round(a.seconds - b.seconds, 4) AS d_seconds
 FROM pr JOIN tm a USING (axis_id) JOIN tm b USING (axis_id, segment_id) WHERE a.run_id = a_run AND a.lap_no = a_lap AND b.run_id = b_run AND b.lap_no = b_lap""")
def compared_sectors(spark, sf_dir):
    times = along.segment_times(progress(spark, sf_dir), segments(spark, sf_dir))
    return rounded(along.compared(times, lap_pairs(spark, sf_dir), ["segment_id"], ["seconds"]), 4)


@query(f"""WITH {PROGRESS_SQL} SELECT {_PAIR}, segment_id, a.least AS a_least, b.least AS b_least, CASE WHEN a.n = b.n THEN a.least - b.least END AS d_least, a.exit AS a_exit, b.exit AS b_exit, CASE WHEN a.n = b.n THEN a.exit - b.exit END AS d_exit
 FROM pr JOIN sp a USING (axis_id) JOIN sp b USING (axis_id, segment_id) WHERE a.run_id = a_run AND a.lap_no = a_lap AND b.run_id = b_run AND b.lap_no = b_lap""")
def compared_speeds(spark, sf_dir):
    """The number of samples stands for a measure's source, so that some pairs differ in it."""
    speeds = along.segment_speeds(progress(spark, sf_dir), segments(spark, sf_dir))
    return rounded(along.compared(speeds, lap_pairs(spark, sf_dir), ["segment_id"], ["least", "exit"], "n"))


def bundle(spark, sf_dir):
    """What is measured of every lap in every segment, written once for the uses of a query."""
    rows = measures.measured(progress(spark, sf_dir), segments(spark, sf_dir), F.col("v") >= 25)
    return written(rows, "measured")


@query(f"""WITH {PROGRESS_SQL}, {_EXITS}, bu AS (SELECT {_L}, segment_id, seconds, entry, least, least_m, exit, pickup_m, straight_s FROM tm FULL JOIN sp USING ({_L}, segment_id) LEFT JOIN ex USING ({_L}, segment_id)),
 lo AS (UNPIVOT (SELECT {_L}, segment_id, seconds, CAST(entry AS DOUBLE) AS entry, CAST(least AS DOUBLE) AS least, CAST(least_m AS DOUBLE) AS least_m, CAST(exit AS DOUBLE) AS exit, CAST(pickup_m AS DOUBLE) AS pickup_m, straight_s FROM bu) ON seconds, entry, least, least_m, exit, pickup_m, straight_s INTO NAME measure VALUE v),
 bs AS (SELECT {_PAIR}, segment_id FROM pr JOIN bu a USING (axis_id) JOIN bu b USING (axis_id, segment_id) WHERE a.run_id = a_run AND a.lap_no = a_lap AND b.run_id = b_run AND b.lap_no = b_lap)
 SELECT bs.axis_id, a_run, a_lap, b_run, b_lap, bs.segment_id, m.measure, round(a.v, 4) AS a, round(b.v, 4) AS b, round(a.v - b.v, 4) AS d FROM bs, (SELECT DISTINCT measure FROM lo) m
 LEFT JOIN lo a ON a.axis_id = bs.axis_id AND a.run_id = a_run AND a.lap_no = a_lap AND a.segment_id = bs.segment_id AND a.measure = m.measure
 LEFT JOIN lo b ON b.axis_id = bs.axis_id AND b.run_id = b_run AND b.lap_no = b_lap AND b.segment_id = bs.segment_id AND b.measure = m.measure WHERE a.v IS NOT NULL OR b.v IS NOT NULL""")
def corner_analyzer(spark, sf_dir):
    return rounded(along.analyzed(bundle(spark, sf_dir), lap_pairs(spark, sf_dir)), 4)


@query(f"""WITH {PROGRESS_SQL}, ok2 AS (SELECT group_id AS axis_id, run_id, lap_no, seconds FROM ok), bl AS (SELECT axis_id, arg_min({{'r': run_id, 'l': lap_no}}, (seconds, run_id, lap_no)) AS w FROM ok2 GROUP BY 1),
 r AS (SELECT tm.* FROM tm SEMI JOIN ok2 USING ({_L})) SELECT {_L}, segment_id, round(seconds, 4) AS seconds, round(of_best, 4) AS of_best_lap_s, round(min(seconds) OVER (PARTITION BY axis_id, segment_id), 4) AS best_s
 FROM r LEFT JOIN (SELECT r.axis_id, segment_id, seconds AS of_best FROM r JOIN bl ON bl.axis_id = r.axis_id AND w.r = run_id AND w.l = lap_no) USING (axis_id, segment_id)""")
def day_corner_figures(spark, sf_dir):
    from stintlab.operators import laps

    ok = laps.eligible(t.laps(spark, sf_dir)).select(F.col("group_id").alias("axis_id"), "run_id", "lap_no", "seconds")
    return rounded(along.day_corners(along.segment_times(progress(spark, sf_dir), segments(spark, sf_dir)), ok), 4)


@query(f"""WITH {PROGRESS_SQL}, r AS (SELECT p.*, row_number() OVER (PARTITION BY {_L} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {_L}) AS n FROM p JOIN (SELECT group_id AS axis_id, run_id, lap_no FROM ok) USING ({_L})),
 k AS (SELECT * FROM r WHERE n <= 4 OR i IN (0, floor((n - 1) / 3), floor(2 * (n - 1) / 3), n - 1)) SELECT {_L}, row_number() OVER (PARTITION BY {_L} ORDER BY t) - 1 AS k, progress_m, v FROM k""")
def comparison_map_layer(spark, sf_dir):
    from stintlab.operators import laps

    ok = laps.eligible(t.laps(spark, sf_dir)).select(F.col("group_id").alias("axis_id"), "run_id", "lap_no")
    return rounded(along.map_layer(progress(spark, sf_dir), ok, most=4)).withColumn("k", F.col("k").cast("long"))


_ONSETS = """os AS (SELECT run_id, l_t + 0.01 AS onset, l_t + 0.5 AS t1, v * 2.0 AS peak FROM (SELECT run_id, t AS l_t, v, lap_no, row_number() OVER (PARTITION BY run_id, t ORDER BY lap_no) AS k FROM p) WHERE lap_no % 3 = 0),
 pb AS (SELECT run_id, t, axis_id, lap_no, progress_m, v FROM p),
 pa AS (SELECT os.*, b.axis_id, b.lap_no, b.progress_m, b.v FROM os ASOF JOIN pb b ON os.run_id = b.run_id AND os.onset >= b.t)"""


def _timed(spark, sf_dir):
    """Laps of a run one after another, since a run's clock goes on."""
    return progress(spark, sf_dir).withColumn("t", F.col("t") + F.col("lap_no") * 10)


_TIMED = PROGRESS_SQL.replace("i + s / 10000 AS t", "lap_no * 10 + i + s / 10000 AS t")


def _onsets(spark, sf_dir):
    rows = _timed(spark, sf_dir).where("lap_no % 3 = 0")
    return rows.select("run_id", (F.col("t") + 0.01).alias("onset"), (F.col("t") + 0.5).alias("t1"), (F.col("v") * 2.0).alias("peak"))


_BRAKES = f"""br AS (SELECT * FROM (SELECT axis_id, run_id, lap_no, segment_id, progress_m AS at_m, t1 - onset AS seconds, peak, v AS v0, row_number() OVER (PARTITION BY axis_id, run_id, lap_no, segment_id ORDER BY onset DESC) AS r
 FROM pa JOIN (SELECT axis_id, segment_id, end_m, greatest(coalesce(lag(end_m) OVER (PARTITION BY axis_id ORDER BY start_m), 0), start_m - 200) AS from_m FROM sg WHERE kind = 'corner') c USING (axis_id) WHERE progress_m BETWEEN from_m AND end_m) WHERE r = 1)"""


@query(f"WITH {_TIMED}, {_ONSETS}, {_BRAKES} SELECT {_L}, segment_id, at_m, round(seconds, 4) AS seconds, peak, v0 FROM br")
def corner_braking(spark, sf_dir):
    return rounded(along.braking(_timed(spark, sf_dir), _onsets(spark, sf_dir), segments(spark, sf_dir)), 4)


@query(f"WITH {_TIMED}, {_ONSETS} SELECT {_L}, segment_id, round(min(onset), 4) AS onset, arg_min(progress_m, onset) AS pickup_m FROM pa JOIN sg USING (axis_id) WHERE kind = 'corner' AND progress_m BETWEEN start_m AND end_m GROUP BY ALL")
def corner_pickups(spark, sf_dir):
    return rounded(along.pickups(_timed(spark, sf_dir), _onsets(spark, sf_dir), segments(spark, sf_dir)), 4)


@query(f"""WITH {_TIMED}, {_ONSETS}, {_BRAKES}, d AS (SELECT sp.axis_id, sp.segment_id, least, CASE WHEN peak >= 60 THEN 'heavy braking' WHEN peak IS NOT NULL THEN 'braking' WHEN sp.lap_no % 3 = 1 THEN 'lift' ELSE 'flat' END AS did FROM sp JOIN sg USING (axis_id, segment_id) LEFT JOIN br USING ({_L}, segment_id) WHERE kind = 'corner'),
 v AS (SELECT axis_id, segment_id, did, count(*) AS n FROM d GROUP BY 1, 2, 3), m AS (SELECT axis_id, segment_id, quantile_cont(least, 0.5) AS v FROM d GROUP BY 1, 2)
 SELECT axis_id, segment_id, arg_min(did, (-n, did)) AS driving, max(n) AS n, any_value(CASE WHEN m.v < 80 / 3.6 THEN 'slow' WHEN m.v < 120 / 3.6 THEN 'medium' ELSE 'fast' END) AS speed FROM v JOIN m USING (axis_id, segment_id) GROUP BY 1, 2""")
def driving_classes(spark, sf_dir):
    segs = segments(spark, sf_dir)
    rows = _timed(spark, sf_dir)
    speeds = along.segment_speeds(rows, segs).join(segs.where("kind = 'corner'").select("axis_id", "segment_id"), ["axis_id", "segment_id"])
    return along.driving_classes(speeds, along.braking(rows, _onsets(spark, sf_dir), segs), speeds.where("lap_no % 3 = 1"))


_MEASURED = f"""{_EXITS}, cv AS (SELECT {_L}, segment_id, sum(least(progress_m, end_m) - greatest(p0, start_m)) AS covered_m FROM st JOIN sg USING (axis_id) WHERE p0 < end_m AND progress_m > start_m GROUP BY ALL),
 me AS (SELECT {_L}, segment_id, kind, seconds, covered_m, coalesce(n, 0) AS n, entry, least, least_m, greatest, exit, pickup_m, straight_s FROM tm FULL JOIN sp USING ({_L}, segment_id) FULL JOIN cv USING ({_L}, segment_id) LEFT JOIN ex USING ({_L}, segment_id) JOIN sg USING (axis_id, segment_id))"""


@query(f"WITH {PROGRESS_SQL}, {_MEASURED} SELECT * REPLACE (round(seconds, 4) AS seconds, round(covered_m, 4) AS covered_m, round(straight_s, 4) AS straight_s) FROM me")
def measured_laps(spark, sf_dir):
    """Times, coverage, speeds, pick-ups and straights of all laps in all segments from one scan of their samples."""
    return rounded(measures.measured(progress(spark, sf_dir), segments(spark, sf_dir), F.col("v") >= 25), 4)


def _eligible(spark, sf_dir):
    from stintlab.operators import laps

    return laps.eligible(t.laps(spark, sf_dir)).select(F.col("group_id").alias("axis_id"), "run_id", "lap_no", "seconds")


_OUTING = f"""ol AS (SELECT group_id AS axis_id, run_id, lap_no, seconds FROM ok), ob AS (SELECT axis_id, min(seconds) AS best_lap_s, arg_min({{'r': run_id, 'l': lap_no}}, (seconds, run_id, lap_no)) AS w FROM ol GROUP BY 1),
 ot AS (SELECT tm.axis_id, tm.run_id, tm.lap_no, tm.segment_id, tm.seconds FROM tm SEMI JOIN ol USING ({_L})),
 os AS (SELECT sg.axis_id, sg.segment_id, sg.kind, count(ot.seconds) AS n, min(ot.seconds) AS best_s, arg_min({{'r': run_id, 'l': lap_no}}, (ot.seconds, run_id, lap_no)) AS b, quantile_cont(ot.seconds, 0.5) AS median_s, quantile_cont(ot.seconds, 0.75) - quantile_cont(ot.seconds, 0.25) AS iqr,
 max(CASE WHEN w.r = run_id AND w.l = lap_no THEN ot.seconds END) AS actual_s, any_value(best_lap_s) AS best_lap_s FROM sg JOIN ob USING (axis_id) LEFT JOIN ot ON ot.axis_id = sg.axis_id AND ot.segment_id = sg.segment_id GROUP BY 1, 2, 3),
 oo AS (SELECT *, CASE WHEN count(best_s) OVER a = count(*) OVER a THEN sum(best_s) OVER a END AS total_s FROM os WINDOW a AS (PARTITION BY axis_id))"""


@query(f"""WITH {PROGRESS_SQL}, {_OUTING} SELECT axis_id, segment_id, kind, round(best_s, 4) AS best_s, coalesce(b.r, 0) AS run_id, coalesce(b.l, 0) AS lap_no, n, round(median_s, 4) AS median_s, round(CASE WHEN n >= 3 THEN iqr END, 4) AS spread_s, round(actual_s, 4) AS actual_s,
 round(actual_s - best_s, 4) AS loss_s, round(total_s, 4) AS total_s, round(best_lap_s, 4) AS best_lap_s, round(best_lap_s - total_s, 4) AS gain_s, CASE WHEN total_s IS NULL THEN 'untimed sector' END AS reason FROM oo""")
def outing_best(spark, sf_dir):
    found = measures.outing_best(bundle(spark, sf_dir), segments(spark, sf_dir), _eligible(spark, sf_dir))
    return rounded(found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("run_id", "lap_no")}), 4)


@query(f"""WITH {PROGRESS_SQL}, {_OUTING}, ev AS (SELECT ol.axis_id, ol.run_id, ol.lap_no, oo.segment_id, oo.best_s FROM ol JOIN oo USING (axis_id)), lo AS (SELECT ev.*, ot.seconds, ot.seconds - best_s AS loss_s FROM ev LEFT JOIN ot USING ({_L}, segment_id))
 SELECT lo.axis_id, lo.run_id, lo.lap_no, segment_id, round(seconds, 4) AS seconds, round(loss_s, 4) AS loss_s, round(CASE WHEN count(loss_s) OVER l = count(*) OVER l THEN sum(loss_s) OVER l END, 4) AS total_loss_s, w.r = lo.run_id AND w.l = lo.lap_no AS best_of_day
 FROM lo JOIN ob ON ob.axis_id = lo.axis_id WINDOW l AS (PARTITION BY lo.axis_id, lo.run_id, lo.lap_no)""")
def sector_table(spark, sf_dir):
    return rounded(measures.sector_table(bundle(spark, sf_dir), segments(spark, sf_dir), _eligible(spark, sf_dir)), 4)


@query(f"""WITH {PROGRESS_SQL}, {_OUTING}, ff AS (SELECT axis_id, run_id, arg_min(lap_no, (seconds, lap_no)) AS lap_no FROM ol GROUP BY 1, 2),
 fi AS (SELECT axis_id, 'gap' AS kind, segment_id, b.r AS run_id, b.l AS lap_no, actual_s - best_s AS value, NULL AS n FROM oo WHERE actual_s IS NOT NULL
 UNION ALL SELECT ot.axis_id, 'loss', ot.segment_id, ot.run_id, ot.lap_no, ot.seconds - actual_s, NULL FROM ot JOIN ff USING ({_L}) JOIN oo ON oo.axis_id = ot.axis_id AND oo.segment_id = ot.segment_id WHERE ot.seconds > actual_s
 UNION ALL SELECT axis_id, 'corner', segment_id, NULL, NULL, CASE WHEN n >= 3 THEN iqr END, n FROM oo WHERE kind = 'corner' AND n > 0)
 SELECT axis_id, kind, segment_id, coalesce(run_id, 0) AS run_id, coalesce(lap_no, 0) AS lap_no, round(value, 4) AS value, coalesce(n, 0) AS n FROM fi WHERE axis_id IN (SELECT axis_id FROM oo WHERE actual_s IS NOT NULL)""")
def focus_inputs(spark, sf_dir):
    found = measures.focus_inputs(bundle(spark, sf_dir), segments(spark, sf_dir), _eligible(spark, sf_dir))
    return rounded(found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("run_id", "lap_no", "n")}), 4)
