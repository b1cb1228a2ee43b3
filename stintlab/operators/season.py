"""Days and seasons: temperature and pace, totals of cars and tracks, skills, plans, goals and reports.

Everything here works on results of laps and corners, a few rows a session, never on samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median
from stintlab.operators.association import spearman

#: A correlation with the order that confounds one with temperature, the least covered share of a lap, bins
#: of a day's trend, seconds of a costly corner and how many count, and items of a plan.
CONFOUNDED, COVERED, TREND_BINS, COSTLY_S, COSTLY, PLAN = 0.6, 0.8, 120, 0.1, 3, 3
#: Results and evidence of a report.
RESULTS, EVIDENCE = 64, 4096
#: Skill, its group, unit and bands, the best first.
SKILLS = (
    ("liftTiming", "braking", "s", (0.1, 0.25, 0.5, 0.8)), ("brakePointConsistency", "braking", "m", (2, 4, 7, 12)),
    ("brakeReleaseTiming", "braking", "m", (3, 6, 10, 16)), ("brakingEffectiveness", "braking", "g", (0.02, 0.04, 0.07, 0.12)),
    ("turnInConsistency", "corner", "km/h", (1, 2, 4, 7)), ("minimumSpeedControl", "corner", "km/h", (1, 2, 4, 7)),
    ("lineConsistency", "corner", "m", (0.4, 0.7, 1.1, 1.8)), ("throttleReapplication", "exit", "m", (2, 4, 7, 12)),
    ("throttleCommitment", "exit", "%", (2, 10, 20, 35)), ("exitSpeedExecution", "exit", "km/h", (1, 2, 4, 7)),
    ("cornerSequenceManagement", "lap", "s", (0.01, 0.03, 0.06, 0.1)), ("paceConsistency", "lap", "s", (0.5, 1, 2, 4)),
)


def temperature_association(laps: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """laps(by, ord, metric, temperature): rank correlations of the metric with the temperature and of the temperature
    with the laps' order, and whether the order confounds the first."""
    first = spearman(laps, by, "temperature", "metric", least)
    second = spearman(laps.where("metric is not null"), by, "temperature", "ord", least).select(*by, F.col("rho").alias("rho_order"))
    rows = first.join(second, by, "left")
    return rows.withColumn("confounded", F.coalesce(F.abs(F.round("rho_order", 9)) >= CONFOUNDED, F.lit(False)))


def lap_temperatures(laps: DataFrame, summaries: DataFrame, share: float = COVERED) -> DataFrame:
    """laps(run_id, lap_no, seconds, ord) with the mean of each channel that covers ``share`` of the lap: summaries are
    (run_id, lap_no, channel, covered_s, mean_v)."""
    rows = laps.join(summaries, ["run_id", "lap_no"]).where(F.col("covered_s") >= share * F.col("seconds"))
    return rows.select("channel", "run_id", "lap_no", "ord", F.col("seconds").alias("metric"), F.col("mean_v").alias("temperature"))


def trend(samples: DataFrame, bins: int = TREND_BINS) -> DataFrame:
    """(run_id, channel, bin, n, mean_v, min_v, max_v) in equal parts of a channel's time."""
    w = Window.partitionBy("run_id", "channel")
    span = F.max("t").over(w) - F.min("t").over(w)
    # a channel of one time has no span and lies in the first part; least() would skip its null
    place = F.coalesce(F.floor((F.col("t") - F.min("t").over(w)) / F.nullif(span, F.lit(0.0)) * bins), F.lit(0))
    rows = samples.where("v is not null").withColumn("bin", F.least(place, F.lit(bins - 1)).cast("long"))
    return rows.groupBy("run_id", "channel", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def car_totals(cars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every car with its sessions, days, tracks, laps and metres; zeros for one that was never driven."""
    out = sessions.groupBy("car_id").agg(F.count("*").alias("sessions"), F.countDistinct("day").alias("days"), F.countDistinct("track_id").alias("tracks"), F.sum("laps").alias("laps"), F.sum("metres").alias("metres"))
    return cars.select("car_id").join(out, "car_id", "left").na.fill(0)


def track_totals(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("track_id").agg(F.count("*").alias("sessions"), F.countDistinct("day").alias("days"), F.countDistinct("car_id").alias("cars"), F.sum("laps").alias("laps"))


def profile_tree(sessions: DataFrame) -> DataFrame:
    """Sessions(car_id, year, track_id, day, laps) by car, year, track and day, with subtotals: ``depth`` says how many of
    them a row is about, the others are null."""
    out = sessions.rollup("car_id", "year", "track_id", "day").agg(F.count("*").alias("sessions"), F.sum("laps").alias("laps"), F.grouping_id().alias("g"))
    depth = F.when(F.col("g") == 15, 0).when(F.col("g") == 7, 1).when(F.col("g") == 3, 2).when(F.col("g") == 1, 3).otherwise(4)
    return out.select("car_id", "year", "track_id", "day", depth.cast("long").alias("depth"), "sessions", "laps")


def session_stats(laps: DataFrame) -> DataFrame:
    """Of each run's laps(run_id, seconds): how many, the best, the median and the spread of the middle half."""
    q = F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = laps.groupBy("run_id").agg(F.count("*").alias("laps"), F.min("seconds").alias("best_s"), q.alias("q"))
    return out.select("run_id", "laps", "best_s", F.col("q")[1].alias("median_s"), F.when(F.col("laps") >= 3, F.col("q")[2] - F.col("q")[0]).alias("spread_s"))


def session_summary(stats: DataFrame, theoretical: DataFrame) -> DataFrame:
    """session_stats in order of runs with each run's change of best from the one before and its gap to the group's
    theoretical best (group_id, total_s); stats carry group_id."""
    w = Window.partitionBy("group_id").orderBy("run_id")
    rows = stats.withColumn("change_s", F.col("best_s") - F.lag("best_s").over(w)).join(theoretical, "group_id", "left")
    return rows.withColumn("gap_s", F.col("best_s") - F.col("total_s")).drop("total_s")


def costly(corners: DataFrame, least_s: float = COSTLY_S, top: int = COSTLY) -> DataFrame:
    """Corners(track_id, day, corner, loss_s) with ``costly``: among a day's ``top`` with a loss of ``least_s`` or more."""
    w = Window.partitionBy("track_id", "day").orderBy(F.desc("loss_s"), "corner")
    return corners.withColumn("costly", (F.row_number().over(w) <= top) & (F.col("loss_s") >= least_s))


def corner_before(corners: DataFrame, day: int) -> DataFrame:
    """(track_id, corner, measured, lost, last_lost, not_on_last_two): what the days before ``day`` say of a corner."""
    rows = costly(corners).where(F.col("day") < day)
    lost = F.when(F.col("costly"), F.col("day"))
    w = Window.partitionBy("track_id", "corner")
    rows = rows.withColumn("last_lost", F.max(lost).over(w))
    out = rows.groupBy("track_id", "corner").agg(
        F.count("*").alias("measured"), F.count_if("costly").alias("lost"), F.max("last_lost").alias("last_lost"),
        F.count_if(F.col("day") > F.col("last_lost")).alias("after"),
    )
    return out.select("track_id", "corner", "measured", "lost", "last_lost", ((F.col("lost") > 0) & (F.col("after") >= 2)).alias("not_on_last_two"))


def then_and_now(corners: DataFrame, then: int, now: int) -> DataFrame:
    """(track_id, corner, then_s, now_s): the corners measured on both days."""
    a = corners.where(F.col("day") == then).select("track_id", "corner", F.col("loss_s").alias("then_s"))
    return a.join(corners.where(F.col("day") == now).select("track_id", "corner", F.col("loss_s").alias("now_s")), ["track_id", "corner"])


def commitment(corners: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, value): the share in percent of known pick-ups that were let go again; null below ``least`` of them."""
    out = corners.groupBy("run_id").agg(F.sum("known").alias("k"), F.sum("released").alias("r"))
    return out.select("run_id", F.when(F.col("k") >= least, F.col("r") / F.col("k") * 100).alias("value"))


def findings(bundle: DataFrame, slower_s: float = 0.05, faster: int = 2, speed: float = 2.0, metres: float = 5.0) -> DataFrame:
    """(axis_id, run_id, lap_no, segment_id, kind, loss_s): why a lap lost time in a corner against the quickest laps there,
    at most ``faster`` of them: the first that applies of a lower entry, a lower least speed, a later or earlier
    pick-up, else ``unexplained``."""
    w = Window.partitionBy("axis_id", "segment_id").orderBy("seconds", "run_id", "lap_no")
    rows = bundle.where("seconds is not null").withColumn("place", F.row_number().over(w))
    best = rows.where(F.col("place") <= faster).groupBy("axis_id", "segment_id").agg(*(F.avg(c).alias(f"b_{c}") for c in ("seconds", "entry", "least", "pickup_m")))
    both = rows.join(best, ["axis_id", "segment_id"]).where((F.col("place") > faster) & (F.col("seconds") - F.col("b_seconds") >= slower_s))
    kind = (
        F.when(F.col("b_entry") - F.col("entry") >= speed, "early lift").when(F.col("b_least") - F.col("least") >= speed, "low least speed")
        .when(F.col("pickup_m") - F.col("b_pickup_m") >= metres, "late throttle").when(F.col("b_pickup_m") - F.col("pickup_m") >= metres, "early throttle").otherwise("unexplained")
    )
    return both.select("axis_id", "run_id", "lap_no", "segment_id", kind.alias("kind"), (F.col("seconds") - F.col("b_seconds")).alias("loss_s"))


def inconsistent(values: DataFrame, by: list[str], spread: float, least: int = 3) -> DataFrame:
    """(by, n, median, spread): groups of at least ``least`` values whose middle half is ``spread`` wide or wider."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = values.where("value is not null").groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"))
    out = out.select(*by, "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))
    return out.where((F.col("n") >= least) & (F.round("spread", 9) >= spread))


def plan(found: DataFrame, by: list[str], top: int = PLAN) -> DataFrame:
    """The next session's items of findings (by, segment_id, kind, loss_s): a segment and kind that laps share, those seen
    on several laps first, then by loss in steps of 0.1 s, laps and name; a segment once, ``top`` of a group."""
    rows = found.groupBy(*by, "segment_id", "kind").agg(F.count("*").alias("laps"), F.avg("loss_s").alias("loss_s"))
    step = F.round(F.floor(F.round(F.col("loss_s") * 10, 6)))
    order = [F.desc(F.col("laps") >= 2), F.desc(step), F.desc("laps"), F.asc("segment_id"), F.asc("kind")]
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by, "segment_id").orderBy(*order))).where("r = 1").drop("r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)


def checked_goals(goals: DataFrame, measured: DataFrame, step: float) -> DataFrame:
    """goals(run_id, segment_id, before, lower_is_better) against measured(run_id, segment_id, value) with ``outcome``:
    better, worse or unchanged within ``step``, or not measured."""
    rows = goals.join(measured, ["run_id", "segment_id"], "left")
    gain = F.when(F.col("lower_is_better"), F.col("before") - F.col("value")).otherwise(F.col("value") - F.col("before"))
    gain = F.round(gain, 9)
    return rows.withColumn("outcome", F.when(F.col("value").isNull(), "not measured").when(gain >= step, "better").when(gain <= -step, "worse").otherwise("unchanged"))


def report(results: DataFrame, by: str, most: int = RESULTS, evidence: int = EVIDENCE) -> DataFrame:
    """(by, n, document, valid): a day's results(by, place, kind, segment_id, laps array) as one JSON text; ``valid`` says
    whether it keeps to the bounds on results and evidence and each result has evidence."""
    w = Window.partitionBy(by)
    rows = results.withColumns({"n": F.count("*").over(w), "e": F.sum(F.size("laps")).over(w), "least": F.min(F.size("laps")).over(w)})
    # results beyond the bound don't enter the document, so a row stays small
    kept = rows.where(F.col("place") <= most).groupBy(by, "n", "e", "least").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "segment_id", "laps"))).alias("results"))
    ok = (F.col("n") <= most) & (F.col("e") <= evidence) & (F.col("least") > 0)
    return kept.select(by, "n", F.to_json(F.struct(F.lit("day-report-1").alias("schema"), "results")).alias("document"), ok.alias("valid"))


def digest_of(*parts: Column) -> Column:
    """An id of values in order: the SHA-256 of their JSON, in which nulls count."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def before_run(rows: DataFrame, runs: DataFrame, run: Column) -> DataFrame:
    """A day's rows as they stood before a run began: those of runs(run_id, clock) with an earlier clock."""
    start = runs.where(F.col("run_id") == run).select(F.col("clock").alias("start"))
    earlier = runs.crossJoin(F.broadcast(start)).where("clock < start").select("run_id")  # one row
    return rows.join(earlier, "run_id", "left_semi")
