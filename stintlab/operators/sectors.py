"""Sector times(group_id, run_id, lap_no, segment, seconds): bests, spreads, losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.functions.stats import median, quartiles
from stintlab.operators.written import written

#: Fixed value: how many passages of a segment are tried first for a chain.
FIRST = 500


def theoretical_best(times: DataFrame, segments: int) -> DataFrame:
    """A row for each segment with its best time and lap, and the group's sum where every segment has one."""
    best = times.groupBy("group_id", "segment").agg(F.min(F.struct("seconds", "run_id", "lap_no")).alias("b"))
    total = best.groupBy("group_id").agg(F.when(F.count("*") == segments, F.sum("b.seconds")).alias("total_s"))
    return best.join(total, "group_id").select("group_id", "segment", F.col("b.seconds").alias("best_s"), "b.run_id", "b.lap_no", "total_s")


def repeatable_best(times: DataFrame, segments: int) -> DataFrame:
    """The sum over segments of the best run's median, null unless every segment has one."""
    runs = times.groupBy("group_id", "segment", "run_id").agg(median(F.col("seconds")).alias("m"))
    best = runs.groupBy("group_id", "segment").agg(F.min("m").alias("m"))
    return best.groupBy("group_id").agg(F.when(F.count("*") == segments, F.sum("m")).alias("repeatable_s"))


def consistency(times: DataFrame, least: int = 3) -> DataFrame:
    """Five-number summary of each segment over its laps."""
    q = times.groupBy("segment").agg(F.count("*").alias("n"), quartiles(F.col("seconds")).alias("q"))
    names = ("least", "q1", "median", "q3", "greatest")
    return q.select("segment", "n", *(F.when(F.col("n") >= least, F.col("q")[i]).alias(c) for i, c in enumerate(names)))


def progression(times: DataFrame) -> DataFrame:
    """Each segment and run's median and spread, and which run is typically fastest there."""
    runs = times.groupBy("group_id", "segment", "run_id").agg(F.count("*").alias("n"), quartiles(F.col("seconds")).alias("q"))
    runs = runs.select("group_id", "segment", "run_id", "n", F.col("q")[2].alias("median"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"))
    w = Window.partitionBy("group_id", "segment").orderBy("median", "run_id")
    return runs.withColumn("fastest", F.row_number().over(w) == 1)


def losses(times: DataFrame) -> DataFrame:
    """Each lap's positive loss in each segment against the group's best there."""
    best = times.groupBy("group_id", "segment").agg(F.min("seconds").alias("best_s"))
    return times.join(best, ["group_id", "segment"]).withColumn("loss_s", F.col("seconds") - F.col("best_s")).where("loss_s > 0")


def rank_losses(times: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` greatest losses of the groups' best laps (one a run), ties by place."""
    lap = times.groupBy("group_id", "run_id", "lap_no").agg(F.sum("seconds").alias("lap_s"), F.count("*").alias("n"))
    w = Window.partitionBy("group_id", "run_id").orderBy(F.desc("n"), "lap_s", "lap_no")
    best = lap.withColumn("r", F.row_number().over(w)).where("r = 1").select("group_id", "run_id", "lap_no")
    found = losses(times).join(best, ["group_id", "run_id", "lap_no"])
    return found.orderBy(F.desc("loss_s"), "group_id", "segment", "run_id").limit(top).select("group_id", "run_id", "lap_no", "segment", "loss_s")


def repeated_losses(times: DataFrame, least_s: float = 0.1, top: int = 3, visits: int = 2) -> DataFrame:
    """Segments that are among a run's ``top`` costliest, by median loss of at least ``least_s``, in several runs."""
    cost = losses(times).groupBy("group_id", "run_id", "segment").agg(median(F.col("loss_s")).alias("loss_s")).where(F.col("loss_s") >= least_s)
    w = Window.partitionBy("group_id", "run_id").orderBy(F.desc("loss_s"), "segment")
    worst = cost.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    out = worst.groupBy("group_id", "segment").agg(F.count("*").alias("visits"), F.avg("loss_s").alias("mean_loss_s"), F.max_by("loss_s", "run_id").alias("last_loss_s"))
    return out.where(F.col("visits") >= visits)


class _Join:
    """Which candidates before each candidate it may follow: all, or those of its lap and those whose exit speed is
    within reach of its entry speed, which lie side by side in the order of exit speeds."""

    def __init__(self, exit_: np.ndarray, entry: np.ndarray, before: np.ndarray, after: np.ndarray, meets: bool, reach: float):
        self.meets, self.laps, self.before, self.after = meets, int(max(before.max(), after.max())) + 1, before, after
        self.order = np.argsort(exit_, kind="stable")[: int(np.isfinite(exit_).sum())]
        speed, self.known = exit_[self.order], np.isfinite(entry)
        into = np.where(self.known, entry, 0.0)
        self.low, self.high = np.searchsorted(speed, into - reach, "left"), np.searchsorted(speed, into + reach, "right")
        # the sums above round otherwise than the differences that count
        wide = np.concatenate(([-np.inf], speed, [np.inf]))
        for _ in range(len(speed) + 1):
            step = (wide[self.low + 1] - into < -reach).astype(int) - (wide[self.low] - into >= -reach)
            turn = (wide[self.high + 1] - into <= reach).astype(int) - (wide[self.high] - into > reach)
            if not (step.any() or turn.any()):
                break
            self.low, self.high = self.low + step, self.high + turn
        self.known &= self.low < self.high

    def least(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate, the least total before it and where that is."""
        if not self.meets:
            at = int(total.argmin())
            return np.full(len(self.after), total[at]), np.full(len(self.after), at)
        of_lap = np.full(self.laps, -1)
        down = np.argsort(-total, kind="stable")
        of_lap[self.before[down]] = down
        at = of_lap[self.after]
        best = np.where(at >= 0, total[at], np.inf)
        if self.known.any():
            table = [self.order]  # of the places before the least in each run of 1, 2, 4, ...
            while (half := 1 << (len(table) - 1)) * 2 <= len(self.order):
                x, y = table[-1][:-half], table[-1][half:]
                table.append(np.where(total[y] < total[x], y, x))
            low, high = self.low[self.known], self.high[self.known]
            level = np.frexp(high - low)[1] - 1
            found = np.empty(len(low), int)
            for k in np.unique(level):
                own = level == k
                x, y = table[k][low[own]], table[k][high[own] - (1 << k)]
                found[own] = np.where(total[y] < total[x], y, x)
            near, where = np.full(len(best), np.inf), np.zeros(len(best), int)
            near[self.known], where[self.known] = total[found], found
            best, at = np.minimum(best, near), np.where(near < best, where, at)
        return best, at


def quickest_chain(
    seconds: list[list[float]], entry: list[list[float]], exit_: list[list[float]], reach: float = 2 / 3.6,
    laps: list[list[int]] | None = None, meets: list[bool] | None = None, closes: bool = False,
) -> tuple[float, list[int]] | None:
    """The least sum of one candidate a segment, of which neighbours join wherever their segments meet (everywhere
    unless ``meets`` tells) and, with ``closes``, the last and the first too.

    Two candidates join if they are of one lap or their speeds are known and within ``reach``.
    """
    n = len(seconds)
    if not n or not all(map(len, seconds)):
        return None
    s, en, ex = ([np.asarray(x, float) for x in part] for part in (seconds, entry, exit_))
    if laps is None:
        ends = np.cumsum([0, *map(len, s)])
        laps = [np.arange(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    own = [np.asarray(x, int) for x in laps]
    meets = [True] * (n - 1) if meets is None else meets
    joins = [_Join(ex[i], en[i + 1], own[i], own[i + 1], meets[i], reach) for i in range(n - 1)]

    def chain(total: np.ndarray, ends: np.ndarray | None = None) -> tuple[float, list[int]] | None:
        back = []
        for join, own_s in zip(joins, s[1:], strict=True):
            total, at = join.least(total)
            total = total + own_s
            back.append(at)
        if ends is not None:
            total = np.where(ends, total, np.inf)
        last = int(total.argmin())
        if not np.isfinite(total[last]):
            return None
        way = [last]
        for at in reversed(back):
            way.append(int(at[way[-1]]))
        return float(total[last]), way[::-1]

    if not closes or n < 2:
        return chain(s[0])
    # no closed chain from a first candidate is quicker than the quickest open one
    bound = s[-1]
    for i in range(n - 2, -1, -1):
        bound = s[i] + _Join(en[i + 1], ex[i], own[i + 1], own[i], meets[i], reach).least(bound)[0]
    best = None
    for first in np.argsort(bound, kind="stable"):
        # but for the rounding of sums in another order
        if not np.isfinite(bound[first]) or best is not None and bound[first] > best[0] + 1e-9 * abs(best[0]):
            break
        total = np.full(len(s[0]), np.inf)
        total[first] = s[0][first]
        got = chain(total, (own[-1] == own[0][first]) | (np.abs(ex[-1] - en[0][first]) <= reach))
        if got and (best is None or got[0] < best[0]):
            best = got
    return best


def realistic_best(times: DataFrame, segments: int, reach: float = 2 / 3.6, meets: list[bool] | None = None, closes: bool = False) -> DataFrame:
    """(group_id, realistic_s, laps): the quickest chain of passages (entry and exit speeds known or null) of each group.

    Null and without laps where a segment has no passage, no speed is known or nothing joins. The quickest ``FIRST``
    passages of each segment give a chain, if they join; a passage that with the other segments' quickest takes longer
    than that is in no quicker one and stays out. What is left of a group is one task's, so a group of any size may come
    while speeds join somewhere among its quickest passages.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lap = pdf.groupby(["run_id", "lap_no"], dropna=False).ngroup()
        timed = pdf.assign(lap=lap)[np.isfinite(pdf["seconds"].astype(float))]
        parts = [p.sort_values(["seconds", "run_id", "lap_no"]) for _, p in timed.groupby("segment", sort=True)]
        got = None
        if len(parts) == segments and pdf["spoken"].any():
            got = quickest_chain(*([p[c].tolist() for p in parts] for c in ("seconds", "entry", "exit")), reach, [p["lap"].tolist() for p in parts], meets, closes)
        chain = [int(p["lap_no"].iloc[i]) for p, i in zip(parts, got[1], strict=True)] if got else []
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[:1], "realistic_s": [got[0] if got else None], "laps": [chain]})

    schema = "group_id long, realistic_s double, laps array<long>"
    passages = written(times.select("group_id", "run_id", "lap_no", "segment", "seconds", "entry", "exit"), "passages")
    s = F.col("seconds")
    timed = passages.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col("segment").isNotNull())
    # whether a group knows any speed; NaN is none
    said = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("entry", "exit")]
    groups = passages.groupBy("group_id").agg(F.max(said[0] | said[1]).alias("spoken"))
    order = Window.partitionBy("group_id", "segment").orderBy("seconds", "run_id", "lap_no")
    first = timed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).withColumn("spoken", F.lit(True))
    bound = first.groupBy("group_id").applyInPandas(run, schema).select(F.col("group_id").alias("own"), F.col("realistic_s").alias("bound_s"))
    quickest = first.where("place = 1").withColumn("others_s", F.sum("seconds").over(Window.partitionBy("group_id")) - s)
    # but for the rounding of sums in another order
    most = F.col("bound_s") - F.col("others_s") + 1e-9 * (1 + F.abs("bound_s") + F.abs("others_s"))
    limits = quickest.join(bound, F.col("group_id").eqNullSafe(F.col("own")), "left").select(F.col("group_id").alias("own"), F.col("segment").alias("part"), most.alias("most_s"))
    # a row a group and segment, whose size is known once it is written
    rows = timed.join(written(limits, "limits"), F.col("group_id").eqNullSafe(F.col("own")) & (F.col("segment") == F.col("part"))).drop("own", "part")
    kept = rows.where(F.col("most_s").isNull() | (s <= F.col("most_s"))).join(groups.withColumnRenamed("group_id", "own"), F.col("group_id").eqNullSafe(F.col("own")))
    found = kept.select(*passages.columns, "spoken").groupBy("group_id").applyInPandas(run, schema).withColumnRenamed("group_id", "own")
    told = groups.join(found, F.col("group_id").eqNullSafe(F.col("own")), "left")
    return told.select("group_id", "realistic_s", F.coalesce("laps", F.array().cast("array<long>")).alias("laps"))
