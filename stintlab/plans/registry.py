"""Queries by name: a function of (spark, sf_dir) and its DuckDB text, or none where SQL can't say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlab.functions import geo, units
from stintlab.operators import association, forces, fusion, intervals, laps, sectors, timeseries
from stintlab.plans import tables as t
from stintlab.plans.tables import LAPS_SQL, SAMPLES_SQL, SEGMENTS, TIMES_SQL, intervals_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that the order of a sum doesn't show."""
    # adding zero makes a negative zero positive
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# laps


@query(f"""WITH {LAPS_SQL} SELECT group_id, run_id, lap_no, round(seconds, 6) AS seconds,
 row_number() OVER (PARTITION BY group_id ORDER BY seconds, clock NULLS LAST, run_id, lap_no) AS position,
 round(seconds - min(seconds) OVER (PARTITION BY group_id), 6) AS gap_s,
 row_number() OVER (PARTITION BY group_id, run_id ORDER BY seconds, clock NULLS LAST, lap_no) = 1 AS run_best,
 count(*) OVER (PARTITION BY group_id, seconds) > 1 AS tied FROM ok""")
def day_ranking(spark, sf_dir):
    return rounded(laps.rank_group(t.laps(spark, sf_dir))).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {LAPS_SQL} SELECT group_id, run_id, lap_no, round(seconds, 6) AS seconds,
 round(seconds - min(seconds) OVER (PARTITION BY group_id, run_id), 6) AS gap_s,
 row_number() OVER (PARTITION BY group_id, run_id ORDER BY seconds, lap_no) = 1 AS fastest FROM ok""")
def run_ranking(spark, sf_dir):
    return rounded(laps.rank_runs(t.laps(spark, sf_dir)))


_FIVE = "round(quantile_cont(seconds, 0.0), 6) AS least, round(quantile_cont(seconds, 0.25), 6) AS q1, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.75), 6) AS q3, round(quantile_cont(seconds, 1.0), 6) AS greatest, round(quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25), 6) AS iqr"
_FIVE3 = _FIVE.replace("round(", "CASE WHEN count(*) >= 3 THEN round(").replace(", 6) AS", ", 6) END AS")


@query(f"WITH {LAPS_SQL} SELECT group_id, run_id, count(*) AS n, {_FIVE} FROM ok GROUP BY 1, 2")
def run_distribution(spark, sf_dir):
    return rounded(laps.distributions(t.laps(spark, sf_dir), ["group_id", "run_id"]))


@query(f"WITH {LAPS_SQL} SELECT group_id, coalesce(run_id, -1) AS run_id, count(*) AS n, {_FIVE3} FROM ok GROUP BY GROUPING SETS ((group_id), (group_id, run_id))")
def lap_consistency(spark, sf_dir):
    return rounded(laps.consistency(t.laps(spark, sf_dir))).withColumn("run_id", F.coalesce("run_id", F.lit(-1)))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT group_id, run_id, min(clock) AS clock, min(seconds) AS best, count(*) AS laps FROM ok GROUP BY 1, 2)
 SELECT group_id, run_id, row_number() OVER w AS session, laps, round(best, 6) AS best, round(best - lag(best) OVER w, 6) AS change_s FROM r
 WINDOW w AS (PARTITION BY group_id ORDER BY clock NULLS LAST, run_id)""")
def day_progression(spark, sf_dir):
    return rounded(laps.progression(t.laps(spark, sf_dir))).withColumn("session", F.col("session").cast("long"))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, run_id ORDER BY clock NULLS LAST, lap_no) AS ord,
 quantile_cont(seconds, 0.75) OVER e AS q3, min(seconds) OVER e AS best FROM ok WINDOW e AS (PARTITION BY group_id, run_id)),
 p AS (SELECT group_id, run_id, min(CASE WHEN seconds <= q3 THEN ord END) AS laps_to_pace, min(CASE WHEN seconds = best THEN ord END) AS best_lap, count(*) AS laps FROM r GROUP BY 1, 2)
 SELECT *, best_lap > laps_to_pace AS improved_later FROM p""")
def day_evolution(spark, sf_dir):
    return laps.evolution(t.laps(spark, sf_dir)).select(*(F.col(c).cast("long").alias(c) if c != "improved_later" else F.col(c) for c in ("group_id", "run_id", "laps_to_pace", "best_lap", "laps", "improved_later")))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT group_id, run_id, row_number() OVER (PARTITION BY group_id ORDER BY min(clock) NULLS LAST, run_id) AS session FROM ok GROUP BY 1, 2),
 o AS (SELECT ok.group_id, ok.run_id, session, seconds, row_number() OVER (PARTITION BY ok.group_id, ok.run_id ORDER BY clock NULLS LAST, lap_no) AS ord FROM ok JOIN r USING (group_id, run_id))
 SELECT a.group_id, a.run_id, a.ord, round(a.seconds - b.seconds, 6) AS change_s FROM o a JOIN o b ON a.group_id = b.group_id AND a.session = b.session + 1 AND a.ord = b.ord""")
def same_lap_change(spark, sf_dir):
    return rounded(laps.same_lap_change(t.laps(spark, sf_dir))).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT *, lag(seconds, 1) OVER w AS one, lag(seconds, 2) OVER w AS two FROM ok WINDOW w AS (PARTITION BY group_id, run_id ORDER BY clock NULLS LAST, lap_no))
 SELECT group_id, run_id, lap_no, round(two - seconds, 6) AS gained_s FROM r WHERE seconds < one AND one < two""")
def improving_laps(spark, sf_dir):
    return rounded(laps.improving(t.laps(spark, sf_dir)))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT *, min(seconds) OVER (PARTITION BY group_id ORDER BY clock NULLS LAST, run_id, lap_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ok)
 SELECT group_id, run_id, lap_no, round(seconds, 6) AS seconds, round(b, 6) AS best_before, coalesce(seconds < b, true) AS record FROM r""")
def running_best(spark, sf_dir):
    return rounded(laps.running_best(t.laps(spark, sf_dir)))


@query(f"""WITH {LAPS_SQL} SELECT coalesce(group_id, -1) AS group_id, coalesce(run_id, -1) AS run_id, count(*) AS laps, count(DISTINCT run_id) AS runs, round(sum(seconds), 2) AS seconds, CAST(grouping(group_id, run_id) AS BIGINT) AS level
 FROM laps GROUP BY GROUPING SETS ((), (group_id), (group_id, run_id))""")
def lap_totals(spark, sf_dir):
    out = rounded(laps.totals(t.laps(spark, sf_dir)), 2)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("group_id", "run_id")})


@query(f"""WITH {LAPS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seconds, clock NULLS LAST, run_id, lap_no) AS r FROM ok),
 p AS (SELECT group_id, quantile_cont(m, 0.5) AS typical_s FROM (SELECT group_id, run_id, quantile_cont(seconds, 0.5) AS m FROM ok GROUP BY 1, 2) GROUP BY 1)
 SELECT group_id, run_id, lap_no, round(seconds, 6) AS best_s, round(typical_s, 6) AS typical_s FROM b JOIN p USING (group_id) WHERE r = 1""")
def track_records(spark, sf_dir):
    return rounded(laps.records(t.laps(spark, sf_dir)))


# sectors


@query(f"""WITH {TIMES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY group_id, segment ORDER BY seconds, run_id, lap_no) AS r FROM times)
 SELECT group_id, segment, round(seconds, 6) AS best_s, run_id, lap_no,
 round(CASE WHEN count(*) OVER (PARTITION BY group_id) = {SEGMENTS} THEN sum(seconds) OVER (PARTITION BY group_id) END, 6) AS total_s FROM b WHERE r = 1""")
def theoretical_best(spark, sf_dir):
    return rounded(sectors.theoretical_best(t.sector_times(spark, sf_dir), SEGMENTS))


@query(f"""WITH {TIMES_SQL}, b AS (SELECT group_id, segment, min(m) AS m FROM (SELECT group_id, segment, run_id, quantile_cont(seconds, 0.5) AS m FROM times GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT group_id, round(CASE WHEN count(*) = {SEGMENTS} THEN sum(m) END, 6) AS repeatable_s FROM b GROUP BY 1""")
def repeatable_best(spark, sf_dir):
    return rounded(sectors.repeatable_best(t.sector_times(spark, sf_dir), SEGMENTS))


@query(f"WITH {TIMES_SQL} SELECT segment, count(*) AS n, {_FIVE3.rpartition(', CASE')[0]} FROM times GROUP BY 1")
def sector_consistency(spark, sf_dir):
    return rounded(sectors.consistency(t.sector_times(spark, sf_dir)))


@query(f"""WITH {TIMES_SQL}, r AS (SELECT group_id, segment, run_id, count(*) AS n, quantile_cont(seconds, 0.5) AS m, quantile_cont(seconds, 0.75) - quantile_cont(seconds, 0.25) AS i FROM times GROUP BY 1, 2, 3)
 SELECT group_id, segment, run_id, n, round(m, 9) AS median, round(i, 9) AS iqr, row_number() OVER (PARTITION BY group_id, segment ORDER BY m, run_id) = 1 AS fastest FROM r""")
def sector_progression(spark, sf_dir):
    return rounded(sectors.progression(t.sector_times(spark, sf_dir)), 9)


_BEST_LAPS = "l AS (SELECT group_id, run_id, lap_no, sum(seconds) AS s, count(*) AS n FROM times GROUP BY 1, 2, 3), bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, run_id ORDER BY n DESC, s, lap_no) AS r FROM l) WHERE r = 1), d AS (SELECT *, seconds - min(seconds) OVER (PARTITION BY group_id, segment) AS loss_s FROM times)"


@query(f"""WITH {TIMES_SQL}, {_BEST_LAPS} SELECT d.group_id, d.run_id, d.lap_no, segment, round(loss_s, 6) AS loss_s FROM d JOIN bl USING (group_id, run_id, lap_no)
 WHERE loss_s > 0 ORDER BY d.loss_s DESC, group_id, segment, run_id LIMIT 50""")
def time_losses(spark, sf_dir):
    return rounded(sectors.rank_losses(t.sector_times(spark, sf_dir)))


@query(f"""WITH {TIMES_SQL}, {_BEST_LAPS}, c AS (SELECT group_id, run_id, segment, quantile_cont(loss_s, 0.5) AS m FROM d WHERE loss_s > 0 GROUP BY 1, 2, 3 HAVING m >= 0.1),
 w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, run_id ORDER BY m DESC, segment) AS r FROM c) WHERE r <= 3)
 SELECT group_id, segment, count(*) AS visits, round(avg(m), 6) AS mean_loss_s, round(max_by(m, run_id), 6) AS last_loss_s FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_losses(spark, sf_dir):
    return rounded(sectors.repeated_losses(t.sector_times(spark, sf_dir)))


@query()
def realistic_best(spark, sf_dir):
    """Passages with entry and exit speeds made from the segment's time; the chain is by group and closes over the gate."""
    times = t.sector_times(spark, sf_dir)
    return rounded(sectors.realistic_best(times.withColumns({"entry": F.col("seconds") % 7, "exit": F.col("seconds") % 5}), t.SEGMENTS, closes=True))


def _chain_sql() -> str:
    """One least total a passage, segment by segment: passages join within a lap or by speeds within reach."""
    parts = ["pa AS MATERIALIZED (SELECT group_id, run_id, lap_no, segment, seconds, seconds % 7 AS entry, seconds % 5 AS leave FROM times)", "c1 AS MATERIALIZED (SELECT group_id, run_id, lap_no, leave, seconds AS total FROM pa WHERE segment = 1)"]
    for k in range(2, SEGMENTS + 1):
        joins = "((a.run_id = b.run_id AND a.lap_no = b.lap_no) OR abs(a.leave - b.entry) <= 2 / 3.6)"
        parts.append(f"c{k} AS MATERIALIZED (SELECT b.group_id, b.run_id, b.lap_no, b.leave, b.seconds + min(a.total) AS total FROM pa b JOIN c{k - 1} a ON a.group_id = b.group_id AND {joins} WHERE b.segment = {k} GROUP BY b.group_id, b.run_id, b.lap_no, b.leave, b.seconds)")
    return ", ".join(parts)


@query(f"WITH {TIMES_SQL}, {_chain_sql()} SELECT group_id, round(min(total), 6) AS realistic_s FROM c{SEGMENTS} GROUP BY 1")
def realistic_open_best(spark, sf_dir):
    """The same without the join over the gate."""
    times = t.sector_times(spark, sf_dir).withColumns({"entry": F.col("seconds") % 7, "exit": F.col("seconds") % 5})
    return rounded(sectors.realistic_best(times, t.SEGMENTS).select("group_id", "realistic_s"))


# channels

_PIECES = """st AS (SELECT run_id, channel, t - lag(t) OVER (PARTITION BY run_id, channel ORDER BY t) AS dt FROM samples),
 lim AS (SELECT run_id, channel, list_sort(list(dt))[count(*) // 2 + 1] AS interval_s FROM st WHERE dt > 0 GROUP BY 1, 2),
 x AS (SELECT s.*, interval_s * 3 AS gap_s, t - lag(t) OVER w AS step, lag(v) OVER w AS pv FROM samples s LEFT JOIN lim USING (run_id, channel) WINDOW w AS (PARTITION BY s.run_id, s.channel ORDER BY t)),
 pc AS (SELECT *, CASE WHEN step <= coalesce(gap_s, 1e300) THEN step END AS dt, sum(CASE WHEN step IS NULL OR step > coalesce(gap_s, 1e300) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, channel ORDER BY t) - 1 AS piece FROM x)"""


@query(f"WITH {SAMPLES_SQL}, {_PIECES} SELECT run_id, channel, round(interval_s, 6) AS interval_s, round(interval_s * 3, 6) AS gap_s FROM lim")
def gap_thresholds(spark, sf_dir):
    return rounded(timeseries.gap_thresholds(t.samples(spark, sf_dir)))


@query(f"WITH {SAMPLES_SQL}, {_PIECES} SELECT run_id, channel, CAST(piece AS BIGINT) AS piece, count(*) AS n, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM pc GROUP BY 1, 2, 3")
def channel_pieces(spark, sf_dir):
    rows = timeseries.with_pieces(t.samples(spark, sf_dir))
    return rounded(rows.groupBy("run_id", "channel", "piece").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")))


_SUMMARY = "sm AS (SELECT run_id, channel, count(*) AS n, min(v) AS min_v, min_by(t, (v, t)) AS min_t, max(v) AS max_v, min_by(t, (-v, t)) AS max_t, coalesce(sum(dt), 0.0) AS covered_s, coalesce(sum(dt * (v + pv) / 2) / nullif(coalesce(sum(dt), 0.0), 0.0), min(v)) AS mean_v FROM pc GROUP BY 1, 2)"


@query(f"WITH {SAMPLES_SQL}, {_PIECES}, {_SUMMARY} SELECT run_id, channel, n, round(min_v, 6) AS min_v, round(min_t, 6) AS min_t, round(max_v, 6) AS max_v, round(max_t, 6) AS max_t, round(covered_s, 6) AS covered_s, round(mean_v, 2) AS mean_v FROM sm")
def channel_summary(spark, sf_dir):
    out = rounded(timeseries.channel_summary(t.samples(spark, sf_dir)))
    return out.withColumn("mean_v", F.round("mean_v", 2))


@query(f"WITH {SAMPLES_SQL}, {_PIECES}, {_SUMMARY} SELECT channel, CAST(sum(n) AS BIGINT) AS n, round(min(min_v), 4) AS min_v, round(max(max_v), 4) AS max_v, round(sum(covered_s), 1) AS covered_s, round(sum(mean_v * covered_s) / sum(covered_s), 4) AS mean_v FROM sm GROUP BY 1")
def channel_totals(spark, sf_dir):
    out = timeseries.combined_summaries(timeseries.channel_summary(t.samples(spark, sf_dir)), ["channel"])
    return rounded(out, 4).withColumn("covered_s", F.round("covered_s", 1))


def _two(spark, sf_dir, a="click", b="view"):
    rows = t.samples(spark, sf_dir)
    return rows.where(F.col("channel") == a), rows.where(F.col("channel") == b)


_ASOF = f"""{SAMPLES_SQL}, {_PIECES}, probes AS (SELECT run_id, t FROM samples WHERE channel = 'click'), vs AS (SELECT run_id, t, v FROM samples WHERE channel = 'view'),
 a AS (SELECT p.run_id, p.t, vs.t AS ta, vs.v AS va FROM probes p ASOF LEFT JOIN vs ON p.run_id = vs.run_id AND p.t >= vs.t),
 b AS (SELECT a.*, vs.t AS tb, vs.v AS vb FROM a ASOF LEFT JOIN vs ON a.run_id = vs.run_id AND a.t <= vs.t),
 n AS (SELECT b.*, interval_s * 3 AS gap_s FROM b LEFT JOIN (SELECT * FROM lim WHERE channel = 'view') l ON b.run_id = l.run_id)"""


def _as_of(spark, sf_dir, mode, tolerance=None):
    clicks, views = _two(spark, sf_dir)
    return rounded(timeseries.as_of(clicks.select("run_id", "t"), views, mode, tolerance))


@query(f"WITH {_ASOF} SELECT run_id, round(t, 6) AS t, round(CASE WHEN t - ta <= coalesce(gap_s, 1e300) THEN va END, 6) AS value FROM n")
def as_of_previous(spark, sf_dir):
    return _as_of(spark, sf_dir, "previous")


@query(f"""WITH {_ASOF} SELECT run_id, round(t, 6) AS t, round(CASE WHEN coalesce(t - ta <= tb - t, ta IS NOT NULL) THEN CASE WHEN t - ta <= 6000 THEN va END
 ELSE CASE WHEN tb - t <= 6000 THEN vb END END, 6) AS value FROM n""")
def as_of_nearest(spark, sf_dir):
    return _as_of(spark, sf_dir, "nearest", 6000.0)


@query(f"""WITH {_ASOF} SELECT run_id, round(t, 6) AS t, round(CASE WHEN t = ta THEN va WHEN tb > ta AND tb - ta <= coalesce(gap_s, 1e300) THEN va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS value FROM n""")
def as_of_linear(spark, sf_dir):
    return _as_of(spark, sf_dir, "linear")


@query(f"""WITH {SAMPLES_SQL}, {_PIECES},
 l AS (SELECT *, coalesce(last_value(CASE WHEN v >= 30 THEN 1 WHEN v < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active, lead(t) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS nt FROM pc),
 b AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY run_id, channel, piece ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS begins FROM l),
 e AS (SELECT *, sum(begins) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM b)
 SELECT run_id, channel, CAST(piece AS BIGINT) AS piece, CAST(episode AS BIGINT) AS episode, round(min(t), 6) AS t0, round(max(coalesce(nt, t)), 6) AS t1, round(max(v), 6) AS peak
 FROM e WHERE active = 1 GROUP BY 1, 2, 3, 4 HAVING max(coalesce(nt, t)) - min(t) >= 60""")
def episodes(spark, sf_dir):
    return rounded(timeseries.episodes(t.samples(spark, sf_dir), 30.0, 15.0, 60.0))


@query(f"""WITH {SAMPLES_SQL}, b AS (SELECT *, CAST(least(coalesce(floor((t - min(t) OVER w) / nullif(max(t) OVER w - min(t) OVER w, 0.0) * 8), 0), 7) AS BIGINT) AS bucket FROM samples WINDOW w AS (PARTITION BY run_id, channel))
 SELECT run_id, channel, bucket, round(min_by(t, (v, t)), 6) AS low_t, round(min(v), 6) AS low_v, round(min_by(t, (-v, t)), 6) AS high_t, round(max(v), 6) AS high_v FROM b GROUP BY 1, 2, 3""")
def thinned_channels(spark, sf_dir):
    return rounded(timeseries.thinned(t.samples(spark, sf_dir), 8)).withColumn("bucket", F.col("bucket").cast("long"))


@query(f"""WITH {SAMPLES_SQL}, {_PIECES} SELECT run_id, channel, CAST(piece AS BIGINT) AS piece, round(t, 6) AS t, round(v, 6) AS v,
 round(avg(v) OVER (PARTITION BY run_id, channel, piece ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING), 4) AS mean_v FROM pc""")
def moving_average(spark, sf_dir):
    return rounded(timeseries.moving_average(t.samples(spark, sf_dir), 3600.0)).withColumn("mean_v", F.round("mean_v", 4))


@query(f"""WITH {SAMPLES_SQL}, a AS (SELECT run_id, channel, t, (v * 7) % 360 AS v FROM samples), s AS (SELECT *, v - lag(v) OVER (PARTITION BY run_id, channel ORDER BY t) AS step FROM a)
 SELECT run_id, channel, round(t, 6) AS t, round(v, 6) AS v, round(v + 360 * sum(coalesce(-floor(step / 360 + 0.5), 0)) OVER (PARTITION BY run_id, channel ORDER BY t), 6) AS unwrapped FROM s""")
def unwrapped_angles(spark, sf_dir):
    return rounded(timeseries.unwrapped(t.samples(spark, sf_dir), F.col("v") * 7))


@query(f"""WITH {SAMPLES_SQL}, {_PIECES} SELECT run_id, channel, round(coalesce(sum(dt * (v + pv) / 2 / 3.6), 0.0), 2) AS metres, round(coalesce(sum(CASE WHEN v + pv > 0 THEN dt END), 0.0), 3) AS moving_s FROM pc GROUP BY 1, 2""")
def travelled_distance(spark, sf_dir):
    out = timeseries.travelled(t.samples(spark, sf_dir), 1 / 3.6)
    return out.withColumns({"metres": F.round("metres", 2), "moving_s": F.round("moving_s", 3)})


@query(f"""WITH {SAMPLES_SQL}, w AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t) AS window_id, t AS t0, t + 86400 AS t1 FROM samples WHERE channel = 'error')
 SELECT s.run_id, window_id, channel, count(*) AS n, round(avg(v), 4) AS mean_v, round(max(v), 6) AS max_v FROM samples s JOIN w ON s.run_id = w.run_id AND t BETWEEN t0 AND t1 GROUP BY 1, 2, 3""")
def window_summaries(spark, sf_dir):
    from pyspark.sql import Window

    rows = t.samples(spark, sf_dir)
    errors = rows.where("channel = 'error'").withColumn("window_id", F.row_number().over(Window.partitionBy("run_id").orderBy("t")).cast("long"))
    out = timeseries.windowed(rows, errors.select("run_id", "window_id", F.col("t").alias("t0"), (F.col("t") + 86400).alias("t1")))
    return rounded(out).withColumn("mean_v", F.round("mean_v", 4))


# intervals


def _unite_sql(source: str, name: str) -> str:
    return f"""{name}_m AS (SELECT *, max(t1) OVER (PARTITION BY run_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {source} WHERE t1 > t0),
 {name}_i AS (SELECT *, sum(CASE WHEN ahead IS NULL OR t0 > ahead THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM {name}_m),
 {name} AS (SELECT run_id, min(t0) AS t0, max(t1) AS t1 FROM {name}_i GROUP BY run_id, k)"""


_DAYS = f"""{intervals_sql("A", "ia")}, {intervals_sql("R", "ib")}, da AS (SELECT DISTINCT run_id, unnest(range(t0, t1)) AS d FROM ia), db AS (SELECT DISTINCT run_id, unnest(range(t0, t1)) AS d FROM ib)"""


@query(f"WITH {intervals_sql('A', 'ia')}, {_unite_sql('ia', 'u')} SELECT * FROM u")
def interval_union(spark, sf_dir):
    return intervals.unite(t.intervals(spark, sf_dir, "A"), ["run_id"])


def _islands_sql(days: str) -> str:
    return f"SELECT run_id, min(d) AS t0, max(d) + 1 AS t1 FROM (SELECT *, d - row_number() OVER (PARTITION BY run_id ORDER BY d) AS k FROM ({days})) GROUP BY run_id, k"


@query(f"WITH {_DAYS} {_islands_sql('SELECT * FROM da INTERSECT SELECT * FROM db')}")
def interval_intersection(spark, sf_dir):
    return intervals.intersect(t.intervals(spark, sf_dir, "A"), t.intervals(spark, sf_dir, "R"), ["run_id"])


@query(f"WITH {_DAYS} {_islands_sql('SELECT * FROM da EXCEPT SELECT * FROM db')}")
def interval_difference(spark, sf_dir):
    return intervals.subtract(t.intervals(spark, sf_dir, "A"), t.intervals(spark, sf_dir, "R"), ["run_id"])


@query(f"WITH {_DAYS} SELECT run_id, count(*) AS seconds FROM da GROUP BY 1")
def interval_seconds(spark, sf_dir):
    return intervals.seconds(intervals.unite(t.intervals(spark, sf_dir, "A"), ["run_id"]), ["run_id"])


# forces, association, fusion


@query(f"""WITH {SAMPLES_SQL}, p AS (SELECT run_id, count(*) AS n, list_sort(list(v / 20)) AS l FROM samples WHERE channel = 'click' AND v > 0 AND v / 20 <= 4 GROUP BY 1)
 SELECT run_id, n, round(l[greatest(1, CAST(ceil(0.9 * n) AS BIGINT))], 6) AS p90 FROM p WHERE n >= 5""")
def strong_acceleration(spark, sf_dir):
    clicks = t.samples(spark, sf_dir).where("channel = 'click'").withColumn("v", F.col("v") / 20)
    return rounded(forces.strong_acceleration(clicks, least=5))


def _gg(spark, sf_dir):
    """Both channels around zero; gaps count alike, so pairs are by neighbours."""
    clicks, views = _two(spark, sf_dir)
    return forces.pairs(clicks.withColumn("v", F.col("v") / 20 - 1), views.withColumn("v", F.col("v") / 20 - 1))


_GG = f"""{_ASOF}, ck AS (SELECT run_id, t, v / 20 - 1 AS lon FROM samples WHERE channel = 'click'),
 gg AS (SELECT ck.run_id, ck.t, lon, CASE WHEN ck.t = ta THEN va / 20 - 1 WHEN tb > ta AND tb - ta <= coalesce(gap_s, 1e300) THEN (va / 20 - 1) + ((vb / 20 - 1) - (va / 20 - 1)) * (ck.t - ta) / (tb - ta) END AS lat FROM ck JOIN n ON ck.run_id = n.run_id AND ck.t = n.t),
 pt AS (SELECT *, sqrt(lon * lon + lat * lat) AS g FROM gg WHERE abs(lon) <= 4 AND abs(lat) <= 4)"""


@query(f"WITH {_GG} SELECT run_id, count(*) AS n, round(max(abs(lat)), 6) AS lateral, round(max(greatest(-lon, 0.0)), 6) AS braking, round(max(greatest(lon, 0.0)), 6) AS accelerating, round(max(g), 6) AS combined FROM pt GROUP BY 1")
def gg_peaks(spark, sf_dir):
    return rounded(forces.peaks(_gg(spark, sf_dir)))


@query(f"""WITH {_GG}, d AS (SELECT run_id, CAST(((round(atan2(lat, lon) / (pi() / 4)) % 8) + 8) % 8 AS INTEGER) AS direction, g FROM pt WHERE g >= 0.1),
 e AS (SELECT run_id, direction, count(*) AS n, list_sort(list(g))[greatest(1, CAST(ceil(0.95 * count(*)) AS BIGINT))] AS g FROM d GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT run_id, direction, n, round(g, 6) AS g, round(max(g) OVER (PARTITION BY direction) - g, 6) AS unused FROM e""")
def gg_envelope(spark, sf_dir):
    return rounded(forces.envelope(_gg(spark, sf_dir), least=3))


@query(f"""WITH {LAPS_SQL}, r AS (SELECT run_id, seconds, row_number() OVER (PARTITION BY run_id ORDER BY clock, lap_no) AS o FROM ok),
 k AS (SELECT run_id, rank() OVER (PARTITION BY run_id ORDER BY seconds) + (count(*) OVER (PARTITION BY run_id, seconds) - 1) / 2.0 AS rx, o AS ry FROM r),
 c AS (SELECT run_id, count(*) AS n, CASE WHEN count(*) >= 8 AND stddev_pop(rx) > 0 THEN round(corr(rx, ry), 9) END AS rho FROM k GROUP BY 1)
 SELECT run_id, n, round(rho, 6) + 0.0 AS rho, CASE WHEN abs(rho) >= 0.6 THEN 'strong' WHEN abs(rho) >= 0.3 THEN 'moderate' WHEN rho IS NOT NULL THEN 'weak' END AS strength FROM c""")
def order_association(spark, sf_dir):
    from pyspark.sql import Window

    rows = laps.eligible(t.laps(spark, sf_dir))
    rows = rows.withColumn("o", F.row_number().over(Window.partitionBy("run_id").orderBy("clock", "lap_no")).cast("double"))
    return rounded(association.spearman(rows, ["run_id"], "seconds", "o"))


_GRID = f"{SAMPLES_SQL}, ga AS (SELECT run_id, CAST(floor(t / 21600) AS BIGINT) AS k, avg(v) AS v FROM samples WHERE channel = 'click' GROUP BY 1, 2), gb AS (SELECT run_id, CAST(floor(t / 21600) AS BIGINT) AS k, avg(v) AS v FROM samples WHERE channel = 'view' GROUP BY 1, 2)"


def _grids(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return fusion.grid(a, 21600.0), fusion.grid(b, 21600.0)


@query(f"""WITH {_GRID}, o AS (SELECT a.run_id, s.shift, count(*) AS n, corr(a.v, b.v) AS r FROM ga a CROSS JOIN (SELECT unnest(range(-6, 7)) AS shift) s JOIN gb b ON a.run_id = b.run_id AND a.k = b.k - s.shift GROUP BY 1, 2 HAVING count(*) >= 5),
 z AS (SELECT *, round(atanh(greatest(-0.999999, least(0.999999, coalesce(CASE WHEN isnan(r) THEN NULL ELSE r END, -1.0)))) * sqrt(n - 3), 9) AS z FROM o),
 w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY z DESC, abs(shift), shift) AS p FROM z)
 SELECT run_id, CAST(shift AS INTEGER) AS shift, n, round(r, 6) AS r, round(z, 4) AS z FROM w WHERE p = 1""")
def clock_offsets(spark, sf_dir):
    a, b = _grids(spark, sf_dir)
    # once, as a value rounded to six places first may end up on a tie of four
    return rounded(fusion.best_offset(fusion.offsets(a, b, 6, least=5)).withColumn("z", F.round("z", 4)))


@query(f"""WITH {_GRID}, d AS (SELECT a.run_id, abs(a.v - b.v) AS d FROM ga a JOIN gb b USING (run_id, k))
 SELECT run_id, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median_d, round(list_sort(list(d))[CAST(round((count(*) - 1) * 0.95) AS BIGINT) + 1], 6) AS p95_d, round(avg(CASE WHEN d > 15 THEN 1.0 ELSE 0.0 END), 6) AS share_over FROM d GROUP BY 1""")
def fusion_conflict(spark, sf_dir):
    a, b = _grids(spark, sf_dir)
    return rounded(fusion.conflict(a, b, 5.0))


@query(f"""WITH {_GRID} SELECT run_id, k, round(v, 4) AS v, 'primary' AS source FROM ga UNION ALL SELECT run_id, k, round(v, 4), 'other' FROM gb ANTI JOIN ga USING (run_id, k)""")
def fused_channel(spark, sf_dir):
    return rounded(fusion.fuse(*_grids(spark, sf_dir)), 4)


# scalars


@query("""SELECT n_nationkey, round(((n_nationkey * 31.7 + 200) % 360 + 360) % 360 - 180, 6) AS wrapped, round(((n_nationkey * -31.7) % 360 + 360) % 360, 6) AS heading,
 round(2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians((n_nationkey % 7) * 0.5 - 1.0) / 2) ** 2 + cos(radians(1.0)) * cos(radians((n_nationkey % 7) * 0.5)) * sin(radians((n_nationkey % 5) * 0.5 - 1.0) / 2) ** 2))), 3) AS metres,
 round((n_nationkey % 5) * 0.5 * (6371000.0 * pi() / 180) * cos(radians(1.0)), 3) AS east, round(((n_nationkey % 7) * 0.5 - 1.0) * (6371000.0 * pi() / 180), 3) AS north FROM nation""")
def geodesy(spark, sf_dir):
    k = F.col("n_nationkey")
    lat, lon = k % 7 * F.lit(0.5), k % 5 * F.lit(0.5)
    east, north = geo.project(lat, lon, F.lit(1.0), F.lit(0.0))
    return t.read(spark, sf_dir, "nation").select(
        k, F.round(geo.wrap_longitude(k * F.lit(31.7) + 20.0), 6).alias("wrapped"), F.round(geo.normalize_degrees(k * F.lit(-31.7)), 6).alias("heading"),
        F.round(geo.distance(F.lit(1.0), F.lit(1.0), lat, lon), 3).alias("metres"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"),
    )


@query("""WITH m AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS ms FROM orders)
 SELECT o_orderkey, (ms // 60000) || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS lap_time FROM m""")
def lap_time_text(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select("o_orderkey", units.lap_time_text(F.round("o_totalprice") / 1000).alias("lap_time"))
