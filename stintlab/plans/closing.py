"""Queries of documents, stored fusion rules and a whole day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.operators import along, document, fusion, grip, intervals, rows
from stintlab.operators.timeseries import episodes
from stintlab.plans import day_rows, laps_along
from stintlab.plans import tables as t
from stintlab.plans.inputs import _PAIRS, _pairs, channel
from stintlab.plans.registry import _PIECES, query, rounded
from stintlab.plans.tables import SAMPLES_SQL

_DAYS = "dr AS (SELECT CAST(c_nationkey AS BIGINT) AS day, c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_custkey END AS source FROM customer WHERE c_custkey % 40 < 25)"

#: Days that a nation's runs may make.
_PARTS = 1 << 32


def _day_runs(spark, sf_dir):
    k = F.col("c_custkey")
    c = t.read(spark, sf_dir, "customer").where(k % 40 < 25)
    return c.select(F.col("c_nationkey").cast("long").alias("day"), k.alias("id"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("s"), k.cast("string"))).alias("source"), F.array(k % 5, k % 7).alias("excluded"))


_DOCUMENT = """'{"version":3,"day":' || day || ',"runs":[' || string_agg('{"id":' || id || ',"name":"' || name || '","source":' || coalesce('"' || source || '"', 'null') || ',"excluded":[' || id % 5 || ',' || id % 7 || ']}', ',' ORDER BY id) || ']'"""


@query(f"""WITH {_DAYS} SELECT day, sha256({_DOCUMENT} || CASE WHEN day % 2 = 0 THEN ',"app":{{"v":' || day || '}},"note":"x"' ELSE '' END || '}}') AS digest FROM dr GROUP BY 1""")
def day_documents(spark, sf_dir):
    runs = _day_runs(spark, sf_dir)
    days = runs.where("day % 2 = 0").select("day").distinct()
    app = days.select("day", F.lit("app").alias("key"), F.concat(F.lit('{"v":'), F.col("day").cast("string"), F.lit("}")).alias("value"))
    extra = app.unionByName(days.select("day", F.lit("note").alias("key"), F.lit('"x"').alias("value")))
    return document.encoded(runs, extra).select("day", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_DAYS} SELECT day, id, name, source, id % 5 AS first_excluded FROM dr WHERE id % 9 > 0 AND day % 5 <> 1")
def read_day_documents(spark, sf_dir):
    """Written, a ninth of the runs taken out again, one in five spoilt, and read. A nation's runs are as many days as a document's
    bound on runs asks for, each of which names the nation and its own number."""
    by = Window.partitionBy("day").orderBy("id")
    part = F.floor((F.row_number().over(by) - 1) / document.MOST_RUNS)
    runs = _day_runs(spark, sf_dir).withColumn("part", part).withColumn("day", F.col("day") * _PARTS + F.col("part")).drop("part")
    texts = document.without(document.encoded(runs), runs.where("id % 9 = 0").select("day", "id"))
    nation = F.floor(F.col("day") / _PARTS)
    spoilt = F.when(nation % 5 == 1, F.replace("text", F.lit('"version":3'), F.lit('"version":2'))).otherwise(F.col("text"))
    found, _ = document.decoded(texts.withColumn("text", spoilt))
    return found.select(nation.alias("day"), "id", "name", "source", F.col("excluded")[0].alias("first_excluded"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS day, CASE n_nationkey % 5 WHEN 0 THEN 'not a document' WHEN 1 THEN 'another version' WHEN 2 THEN 'another day' ELSE 'repeated runs' END AS problem FROM nation WHERE n_nationkey % 5 < 4""")
def day_document_problems(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    body = lambda version, day, runs: F.format_string('{"version":%d,"day":%d,"runs":[' + runs + "]}", F.lit(version), day)
    text = F.when(k % 5 == 0, F.lit("{nothing")).when(k % 5 == 1, body(2, k, "")).when(k % 5 == 2, body(3, k + 1, "")).when(k % 5 == 3, body(3, k, '{"id":1},{"id":1}')).otherwise(body(3, k, '{"id":1},{"id":2}'))
    return document.decoded(t.read(spark, sf_dir, "nation").select(k.alias("day"), text.alias("text")))[1]


_GRID = f"{SAMPLES_SQL}, pg AS (SELECT run_id, CAST(floor(t / 40000) AS BIGINT) AS k, avg(v) AS v FROM samples WHERE channel = 'click' AND run_id % 11 > 0 GROUP BY 1, 2), og AS (SELECT run_id, CAST(floor(t / 40000) AS BIGINT) AS k, avg(v) AS v FROM samples WHERE channel = 'view' GROUP BY 1, 2)"
_FUSED = """fu AS (SELECT coalesce(pg.run_id, og.run_id) AS run_id, coalesce(pg.k, og.k) AS k, pg.v AS pv, og.v AS ov FROM pg FULL JOIN og ON pg.run_id = og.run_id AND pg.k = og.k),
 fr AS (SELECT *, CASE run_id % 5 WHEN 0 THEN 'fillGaps' WHEN 1 THEN 'preferAlternative' WHEN 2 THEN 'add' WHEN 3 THEN 'primaryOnly' END AS rule FROM fu),
 fv AS (SELECT run_id, k, CASE rule WHEN 'fillGaps' THEN coalesce(pv, ov) WHEN 'preferAlternative' THEN coalesce(ov, pv) WHEN 'add' THEN CASE WHEN run_id % 11 = 0 THEN ov ELSE pv END ELSE pv END AS v,
 CASE rule WHEN 'fillGaps' THEN CASE WHEN pv IS NULL THEN 'other' ELSE 'primary' END WHEN 'preferAlternative' THEN CASE WHEN ov IS NULL THEN 'primary' ELSE 'other' END WHEN 'add' THEN CASE WHEN run_id % 11 = 0 THEN 'other' ELSE 'primary' END ELSE 'primary' END AS source FROM fr)"""


def _ruled(spark, sf_dir):
    p = fusion.grid(channel(spark, sf_dir, "click").where("run_id % 11 > 0"), 40_000.0)
    o = fusion.grid(channel(spark, sf_dir, "view"), 40_000.0)
    run = F.col("run_id")
    rule = F.when(run % 5 == 0, "fillGaps").when(run % 5 == 1, "preferAlternative").when(run % 5 == 2, "add").when(run % 5 == 3, "primaryOnly")
    rules = t.samples(spark, sf_dir).select("run_id").distinct().withColumn("rule", rule).where("rule is not null")
    return p, fusion.fuse_by_rules(p, o, rules)


@query(f"WITH {_GRID}, {_FUSED} SELECT run_id, k, round(v, 6) AS v, source FROM fv WHERE v IS NOT NULL")
def fused_by_rules(spark, sf_dir):
    return rounded(_ruled(spark, sf_dir)[1])


@query(f"WITH {_GRID}, {_FUSED} SELECT fv.run_id, fv.k, round(fv.v, 6) AS v, source FROM fv JOIN (SELECT run_id, min(k) AS a, max(k) AS z FROM pg GROUP BY 1) s ON s.run_id = fv.run_id AND fv.k BETWEEN a AND z WHERE fv.v IS NOT NULL")
def fused_within_primary(spark, sf_dir):
    p, fused = _ruled(spark, sf_dir)
    return rounded(fusion.cut_to_primary(fused, p))


@query(f"WITH {laps_along.PROGRESS_SQL}, lp AS (SELECT axis_id, run_id, lap_no FROM (SELECT *, row_number() OVER (PARTITION BY axis_id ORDER BY c DESC, run_id, lap_no) AS r FROM (SELECT axis_id, run_id, lap_no, count(*) AS c FROM p GROUP BY 1, 2, 3)) WHERE r = 1), c1 AS (SELECT cx.axis_id, m FROM cx JOIN lp USING (axis_id, run_id, lap_no)) SELECT sg.axis_id, segment_id, round(a.m * 1.1 + 5, 4) AS start_m, round(b.m * 1.1 + 5, 4) AS end_m FROM sg LEFT JOIN c1 a ON a.axis_id = sg.axis_id AND a.m = start_m LEFT JOIN c1 b ON b.axis_id = sg.axis_id AND b.m = end_m")
def remeasured_segments(spark, sf_dir):
    """On an axis that is a tenth longer and begins five metres earlier; of each axis the lap with most samples."""
    p = laps_along.progress(spark, sf_dir)
    w = Window.partitionBy("axis_id").orderBy(F.desc("c"), "run_id", "lap_no")
    best = p.groupBy(*along.LAP).agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(w)).where("r = 1").select(*along.LAP)
    old = p.join(best, along.LAP, "left_semi")
    return rounded(along.remeasured(laps_along.segments(spark, sf_dir), old, old.withColumn("progress_m", F.col("progress_m") * 1.1 + 5)), 4)


@query(f"""WITH {SAMPLES_SQL}, {_PIECES}, l AS (SELECT *, coalesce(last_value(CASE WHEN v >= 30 THEN 1 WHEN v < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id, channel, piece ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active, lead(t) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS nt FROM pc WHERE channel IN ('click', 'error')),
 b AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY run_id, channel, piece ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS begins FROM l), e AS (SELECT *, sum(begins) OVER (PARTITION BY run_id, channel, piece ORDER BY t) AS episode FROM b),
 ep AS (SELECT run_id, channel, min(t) AS t0, max(coalesce(nt, t)) AS t1 FROM e WHERE active = 1 GROUP BY run_id, channel, piece, episode)
 SELECT a.run_id, round(sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)), 6) AS seconds FROM ep a JOIN ep b ON a.run_id = b.run_id AND a.channel = 'click' AND b.channel = 'error' AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY 1 HAVING sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)) > 0""")
def trail_braking(spark, sf_dir):
    """Seconds of braking in a corner: clicks as brake, errors as lateral acceleration."""
    both = episodes(t.samples(spark, sf_dir).where("channel in ('click', 'error')"), 30.0, 15.0)
    parts = [both.where(F.col("channel") == c).select("run_id", "t0", "t1") for c in ("click", "error")]
    return rounded(intervals.seconds(intervals.intersect(*parts, ["run_id"]), ["run_id"]))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM pq),
 k AS (SELECT run_id, arg_min(t, (-abs(lat), t)) AS a, arg_min(t, (-lon, t)) AS b, arg_min(t, (lon, t)) AS c, arg_min(t, (-round(sqrt(lon * lon + lat * lat), 9), t)) AS d FROM pq GROUP BY 1)
 SELECT run_id, count(*) AS n, round(max(abs(lat)), 4) AS lateral, round(max(lon), 4) AS accelerating FROM r JOIN k USING (run_id) WHERE i % greatest(1, CAST(ceil(n / 50) AS BIGINT)) = 0 OR t IN (a, b, c, d) GROUP BY 1""")
def gg_scatter(spark, sf_dir):
    out = grip.thinned_pairs(_pairs(spark, sf_dir).withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)}), 50)
    return rounded(out.groupBy("run_id").agg(F.count("*").alias("n"), F.max(F.abs("lat")).alias("lateral"), F.max("lon").alias("accelerating")), 4)


@query(f"""WITH {day_rows._RUNS}, {day_rows._COVER}, pl AS (SELECT run_id % 6 AS group_id, run_id, lap_no, seconds / 1000 AS seconds, metres * 100 AS metres, issue FROM cl),
 pb AS (SELECT *, seconds NOT BETWEEN 3 AND 3600 OR coalesce(metres < 200 OR metres / seconds > 100, false) AS outside FROM pl),
 pm AS (SELECT *, count(CASE WHEN issue = 'none' AND NOT outside THEN metres END) OVER w AS n, quantile_cont(CASE WHEN issue = 'none' AND NOT outside THEN metres END, 0.5) OVER w AS mid FROM pb WINDOW w AS (PARTITION BY run_id)),
 pq AS (SELECT group_id, run_id, lap_no, seconds, metres, CASE WHEN issue = 'none' AND (outside OR coalesce(n >= 2 AND metres < 0.8 * mid, false)) THEN 'implausible' ELSE issue END AS issue FROM pm),
 pg AS (SELECT group_id, quantile_cont(metres, 0.5) AS gm, count(DISTINCT run_id) AS r FROM pq WHERE issue = 'none' AND metres IS NOT NULL GROUP BY 1),
 ps2 AS (SELECT pq.*, coalesce(r >= 2 AND metres < 0.8 * gm, false) AS short FROM pq LEFT JOIN pg USING (group_id))
 SELECT group_id, run_id, lap_no, issue, short, coalesce(CASE WHEN issue = 'none' AND NOT short THEN sum(CASE WHEN issue = 'none' AND NOT short THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY seconds, run_id, lap_no) END, -1)::BIGINT AS position FROM ps2""")
def analyzed_day(spark, sf_dir):
    """A day from passes and positions to ranked laps: sections, coverage, plausibility, short laps, ranks."""
    covered = day_rows._covered(spark, sf_dir)
    laps = covered.select((F.col("run_id") % 6).alias("group_id"), "run_id", "lap_no", (F.col("seconds") / 1000).alias("seconds"), (F.col("metres") * 100).alias("metres"), "issue")
    return rows.ranked_day(laps).select("group_id", "run_id", "lap_no", "issue", "short", F.coalesce(F.col("position").cast("long"), F.lit(-1).cast("long")).alias("position"))


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT DISTINCT run_id, CASE WHEN run_id % 2 = 0 THEN upper(channel) ELSE channel END AS channel FROM samples WHERE (run_id + length(channel)) % 4 > 0) SELECT run_id, channel, row_number() OVER (PARTITION BY run_id ORDER BY lower(channel), channel) AS ord FROM c""")
def channel_names(spark, sf_dir):
    from stintlab.operators import timeseries

    run, name = F.col("run_id"), F.col("channel")
    s = t.samples(spark, sf_dir).where((run + F.length(name)) % 4 > 0).withColumn("channel", F.when(run % 2 == 0, F.upper(name)).otherwise(name))
    return timeseries.channel_names(s).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT DISTINCT run_id, channel FROM samples WHERE (run_id + length(channel)) % 4 > 0) SELECT a.run_id AS a_run, b.run_id AS b_run, a.channel FROM c a JOIN c b ON b.run_id = a.run_id + 1 AND a.channel = b.channel""")
def shared_channels(spark, sf_dir):
    from stintlab.operators import timeseries

    s = t.samples(spark, sf_dir).where((F.col("run_id") + F.length("channel")) % 4 > 0)
    pairs = s.select(F.col("run_id").alias("a_run"), (F.col("run_id") + 1).alias("b_run")).distinct()
    return timeseries.shared_channels(s, pairs)
