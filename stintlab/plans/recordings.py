"""Queries of recordings: pairs of them, values between samples, maps in pieces, directions, and choices of an import."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stintlab.functions import units
from stintlab.operators import alignment, fusion, timeseries, track
from stintlab.plans import tables as t
from stintlab.plans.registry import query, rounded
from stintlab.plans.tables import SAMPLES_SQL
from stintlab.sources import intake


def _paired(spark, sf_dir):
    """(pairs, speeds): runs 2k are the primary recordings, 2k + 1 the others."""
    s, v, c = F.col("s"), F.col("v"), F.col("c")
    rows = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_suppkey") % 10).alias("v"), (3 + F.col("s_suppkey") % 7 * 0.1).alias("off"))
    rows = rows.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(620)), lambda i: i / 2)))

    def speed(x):
        plain = 30 + 9 * F.sin(x / 2.7) + 7 * F.sin(x / 4.3 + s) + 5 * F.sin(x / 1.9 + 2) + 4 * F.sin(x / 6.1)
        lap = 30 + 12 * F.sin(x * (2 * math.pi / 40)) + 5 * F.sin(x * (4 * math.pi / 40))
        return F.when(v.isin(5, 6), lap).otherwise(plain)

    at = c + F.col("off") + F.when((v == 8) & (c > 120) & (c <= 180), 1.5).otherwise(0.0) + F.when(v == 9, 0.0025 * c).otherwise(0.0)
    other = F.when(v == 4, F.pmod(F.xxhash64(s, c), F.lit(1000)) / 50).otherwise(speed(at))
    speeds = rows.select((2 * s).alias("run_id"), c.alias("t"), speed(c).alias("v"))
    speeds = speeds.unionByName(rows.where((v != 2) & (c <= F.when(v == 7, 15).otherwise(300))).select((2 * s + 1).alias("run_id"), c.alias("t"), other.alias("v")))
    declared = F.when(v.isin(1, 6), F.col("off") + 0.5).when(v == 3, F.col("off") + 30)
    pairs = rows.where("c = 0").select(s.alias("pair_id"), (2 * s).alias("primary_id"), (2 * s + 1).alias("candidate_id"), declared.alias("declared_s"), "off")
    return pairs, speeds


@query("""SELECT s_suppkey AS pair_id, ['aligned', 'aligned', 'insufficient', 'conflicting', 'ambiguous', 'ambiguous', 'aligned', 'insufficient', 'ambiguous', 'ambiguous'][s_suppkey % 10 + 1] AS status,
 ['', '', 'no speed', 'declared clock disagrees', 'weak match', 'repeated match', '', 'short overlap', 'windows disagree', 'implausible drift'][s_suppkey % 10 + 1] AS reason,
 s_suppkey % 10 = 6 AS by_clock, s_suppkey % 10 IN (0, 1, 3, 6) AS met FROM supplier""")
def aligned_recordings(spark, sf_dir):
    """All four verdicts; ``met`` is whether the offset is within what a grid of a tenth of a second tells."""
    pairs, speeds = _paired(spark, sf_dir)
    found = alignment.align_recordings(pairs, speeds).join(pairs.select("pair_id", "off"), "pair_id")
    near = F.coalesce(F.abs(F.col("offset_s") - F.col("off")) <= 0.06, F.lit(False)) & F.col("status").isin("aligned", "conflicting")
    return found.select("pair_id", "status", "reason", "by_clock", near.alias("met"))


_NEAR = f"""{SAMPLES_SQL}, gp AS (SELECT run_id, channel, 3 * quantile_disc(dt, 0.5) AS lo, count(*) AS n, list_sort(list(dt))[count(*) // 2 + 1] * 3 AS gap_s FROM (SELECT run_id, channel, t - lag(t) OVER (PARTITION BY run_id, channel ORDER BY t) AS dt FROM samples) WHERE dt > 0 GROUP BY 1, 2),
 sd AS (SELECT run_id, channel, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM samples WINDOW w AS (PARTITION BY run_id, channel ORDER BY t))"""


@query(f"""WITH {_NEAR} SELECT run_id, channel, CAST(round((t + (t1 - t) / 3) * 1e6) AS BIGINT) AS t_us, round(CASE WHEN v BETWEEN 1 AND 60 AND v1 BETWEEN 1 AND 60 AND coalesce(t1 - t <= gap_s, true) THEN v + (v1 - v) / 3 END, 4) AS v FROM sd LEFT JOIN gp USING (run_id, channel) WHERE t1 > t
 UNION ALL SELECT run_id, channel, CAST(round(t * 1e6) AS BIGINT), round(CASE WHEN v BETWEEN 1 AND 60 THEN v END, 4) FROM sd""")
def plausible_values(spark, sf_dir):
    """At every sample and a third of the way to the next one."""
    from pyspark.sql import Window

    samples = t.samples(spark, sf_dir)
    ahead = F.lead("t").over(Window.partitionBy("run_id", "channel").orderBy("t"))
    between = samples.withColumn("t1", ahead).where("t1 > t").select("run_id", "channel", (F.col("t") + (F.col("t1") - F.col("t")) / 3).alias("t"))
    found = timeseries.plausible_at(samples, samples.select("run_id", "channel", "t").unionByName(between), 1.0, 60.0)
    return rounded(found.select("run_id", "channel", F.round(F.col("t") * 1e6).cast("long").alias("t_us"), "v"), 4)


@query(f"""WITH {SAMPLES_SQL}, fx AS (SELECT run_id, lap_no, t, CASE WHEN v < 12 THEN NULL ELSE v END AS east, v * v / 50 AS north FROM (SELECT run_id, t, max(v) AS v, CAST(floor(t / 86400 / 7) AS BIGINT) AS lap_no FROM samples GROUP BY run_id, t)),
 gp AS (SELECT run_id, list_sort(list(dt))[count(*) // 2 + 1] * 3 AS gap_s FROM (SELECT run_id, t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS dt FROM fx) WHERE dt > 0 GROUP BY 1),
 br AS (SELECT fx.*, gap_s, lag(east IS NOT NULL) OVER w AS before, t - lag(t) OVER w AS dt FROM fx LEFT JOIN gp USING (run_id) WINDOW w AS (PARTITION BY run_id, lap_no ORDER BY t)),
 pc AS (SELECT *, sum(CASE WHEN east IS NOT NULL AND (coalesce(NOT before, true) OR coalesce(dt > gap_s, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, lap_no ORDER BY t) - 1 AS piece FROM br),
 ex AS (SELECT run_id, CASE WHEN greatest(max(east) - min(east), max(north) - min(north)) > 0 THEN greatest(max(east) - min(east), max(north) - min(north)) ELSE 1 END AS side, (max(east) + min(east)) / 2 AS ce, (max(north) + min(north)) / 2 AS cn FROM pc WHERE east IS NOT NULL GROUP BY 1)
 SELECT run_id, lap_no, CAST(piece AS BIGINT) AS piece, row_number() OVER (PARTITION BY run_id, lap_no, piece ORDER BY t) - 1 AS k, round(0.5 + (east - ce) / side, 6) + 0.0 AS x, round(0.5 - (north - cn) / side, 6) + 0.0 AS y FROM pc JOIN ex USING (run_id) WHERE east IS NOT NULL""")
def map_pieces(spark, sf_dir):
    rows = t.samples(spark, sf_dir).groupBy("run_id", "t").agg(F.max("v").alias("v")).withColumn("lap_no", F.floor(F.col("t") / 86400 / 7))
    fixes = rows.select("run_id", "lap_no", "t", F.when(F.col("v") >= 12, F.col("v")).alias("east"), (F.col("v") * F.col("v") / 50).alias("north"))
    return rounded(track.map_pieces(fixes)).withColumn("k", F.col("k").cast("long"))


@query("SELECT event_id, round(value * 37 - 900 - 360 * (CASE WHEN value * 37 - 900 - 100 < 0 THEN -1 ELSE 1 END) * floor(abs((value * 37 - 900 - 100) / 360) + 0.5), 6) AS near FROM events")
def directions_near(spark, sf_dir):
    """Directions brought within half a turn of 100 degrees."""
    value = F.col("value") * 37 - 900
    return rounded(t.read(spark, sf_dir, "events").select("event_id", (value + units.turns_near(value, F.lit(100.0))).alias("near")))


_CHOICES = """rd AS (SELECT o_custkey AS batch_id, o_orderkey AS recording_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_id FROM orders),
 ch AS (SELECT *, CASE WHEN batch_id % 9 = 0 OR recording_id % 10 = 0 THEN NULL WHEN recording_id % 5 = 1 AND ord > 1 THEN first_id WHEN recording_id % 7 = 1 THEN -1 - batch_id % 4 ELSE recording_id END AS run_id FROM rd WHERE NOT (batch_id % 23 = 0 AND ord = 1)),
 dr AS (SELECT DISTINCT batch_id, k AS run_id, k = -2 AS grouped FROM rd, (VALUES (-1), (-2), (-3)) x(k)),
 jo AS (SELECT ch.*, dr.grouped, dr.run_id IS NOT NULL AS known, tg.recording_id IS NOT NULL AS reviewed, tg.run_id AS target, ch.run_id IS NOT NULL AND ch.run_id <> ch.recording_id AS other FROM ch LEFT JOIN dr USING (batch_id, run_id) LEFT JOIN ch tg ON tg.batch_id = ch.batch_id AND tg.recording_id = ch.run_id),
 wr AS (SELECT *, CASE WHEN NOT other THEN NULL WHEN known AND grouped THEN 'too many recordings' WHEN NOT known AND NOT reviewed THEN 'changed' WHEN NOT known AND target IS DISTINCT FROM run_id THEN 'target not run'
 WHEN sum(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id, run_id ORDER BY ord) > 1 THEN 'too many recordings' END AS wrong FROM jo)"""


@query(f"""WITH {_CHOICES}, f AS (SELECT batch_id, arg_min(wrong, ord) FILTER (wrong IS NOT NULL) AS first, count(run_id) AS selected FROM wr GROUP BY 1)
 SELECT batch_id, CASE WHEN batch_id % 23 = 0 THEN 'changed' WHEN first IS NOT NULL THEN first WHEN coalesce(selected, 0) = 0 THEN 'nothing selected' END AS problem FROM (SELECT DISTINCT batch_id FROM rd) LEFT JOIN f USING (batch_id)""")
def import_choices(spark, sf_dir):
    from pyspark.sql import Window

    batch, own, ord_ = F.col("batch_id"), F.col("recording_id"), F.col("ord")
    w = Window.partitionBy("batch_id")
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("recording_id"))
    rows = rows.withColumns({"ord": F.row_number().over(w.orderBy("recording_id")), "first_id": F.min("recording_id").over(w)})
    run = F.when((batch % 9 == 0) | (own % 10 == 0), None).when((own % 5 == 1) & (ord_ > 1), F.col("first_id")).when(own % 7 == 1, -1 - batch % 4).otherwise(own)
    choices = rows.where(~((batch % 23 == 0) & (ord_ == 1))).select("batch_id", "recording_id", "ord", run.alias("run_id"))
    runs = rows.select("batch_id").distinct().select("batch_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (-1, -2, -3)))).alias("run_id"))
    return intake.checked_choices(rows, choices, runs.withColumn("grouped", F.col("run_id") == -2))


#: Clicks are one recording of a run, views the other, whose clock is 30 s late and drifts; values under 10 are missing.
_SIDES = f"""{SAMPLES_SQL}, si AS (SELECT run_id, t, CASE WHEN v >= 10 THEN v END AS v, 'primary' AS source FROM samples WHERE channel = 'click' UNION ALL SELECT run_id, t + 30 + 2e-6 * (t - 1.7e9), CASE WHEN v >= 10 THEN v END, 'other' FROM samples WHERE channel = 'view'),
 ga AS (SELECT run_id, source, list_sort(list(dt))[count(*) // 2 + 1] * 3 AS gap_s FROM (SELECT run_id, source, t - lag(t) OVER (PARTITION BY run_id, source ORDER BY t) AS dt FROM si WHERE v IS NOT NULL) WHERE dt > 0 GROUP BY 1, 2),
 st AS (SELECT *, sum(CASE WHEN v IS NOT NULL AND (bv IS NULL OR t - bt > gap_s) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, source ORDER BY t) AS stretch FROM (SELECT si.*, coalesce(gap_s, 'infinity'::DOUBLE) AS gap_s, lag(t) OVER w AS bt, lag(v) OVER w AS bv FROM si LEFT JOIN ga USING (run_id, source) WINDOW w AS (PARTITION BY run_id, source ORDER BY t))),
 co AS (SELECT run_id, stretch, min(t) AS a, max(t) AS z FROM st WHERE source = 'primary' AND v IS NOT NULL GROUP BY 1, 2),
 fu AS (SELECT * FROM st WHERE v IS NOT NULL AND (source = 'primary' OR NOT EXISTS (SELECT 1 FROM co WHERE co.run_id = st.run_id AND st.t BETWEEN a AND z))),
 fp AS (SELECT *, sum(CASE WHEN coalesce(t - pt > greatest(gap_s, pg), true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t, source) - 1 AS piece FROM (SELECT *, lag(t) OVER w AS pt, lag(gap_s) OVER w AS pg FROM fu WINDOW w AS (PARTITION BY run_id ORDER BY t, source)))"""


def _sides(spark, sf_dir):
    rows = t.samples(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 10, F.col("v")))
    own = rows.where("channel = 'click'").select("run_id", "t", "v")
    # the drift is around a day of the recordings, so that times keep their digits
    clocks = rows.select("run_id").distinct().withColumns({"offset_s": F.lit(30.0), "drift_ppm": F.lit(2.0)})
    other = rows.where("channel = 'view'").select("run_id", (F.col("t") - 1.7e9).alias("t"), "v")
    moved = fusion.on_primary_clock(other, clocks).withColumn("t", F.col("t") + 1.7e9)
    return fusion.merged(own, moved)


@query(f"WITH {_SIDES} SELECT run_id, CAST(round(t * 1000) AS BIGINT) AS t_ms, v, source, CAST(piece AS BIGINT) AS piece FROM fp")
def merged_recordings(spark, sf_dir):
    return _sides(spark, sf_dir).select("run_id", F.round(F.col("t") * 1000).cast("long").alias("t_ms"), "v", "source", "piece")


@query(f"""WITH {_SIDES}, sg AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY t, source) - 1 AS segment FROM (SELECT *, CASE WHEN coalesce(source <> lag(source) OVER w OR piece <> lag(piece) OVER w, true) THEN 1 ELSE 0 END AS new FROM fp WINDOW w AS (PARTITION BY run_id ORDER BY t, source)))
 SELECT run_id, CAST(segment AS BIGINT) AS segment, source, CAST(round(min(t) * 1000) AS BIGINT) AS start_ms, CAST(round(max(t) * 1000) AS BIGINT) AS end_ms, count(*) AS n FROM sg GROUP BY 1, 2, 3""")
def merged_segments(spark, sf_dir):
    found = fusion.fused_segments(_sides(spark, sf_dir))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return found.select("run_id", "segment", "source", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "n")
