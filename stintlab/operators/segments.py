"""Segments of a lap's axis: validity, edits, review, and the same corner in another segmentation.

Segments are (axis_id, ord, segment_id, kind, start_m, end_m, approved); only the last of an axis may wrap, its end
below its start.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments of an axis, and the share of the shorter that has to overlap.
MOST, SHARE = 64, 0.5


def valid(segments: DataFrame) -> DataFrame:
    """(axis_id, n, valid): at most ``MOST`` segments with ids of their own, in order and without overlap, of which only
    the last wraps, and then not past the first's start."""
    w = Window.partitionBy("axis_id").orderBy("ord")
    last = F.lead("ord").over(w).isNull()
    rows = segments.withColumns({"is_last": last, "before": F.lag("end_m").over(w), "first": F.first("start_m").over(w)})
    wraps = F.col("end_m") < F.col("start_m")
    good = (F.col("start_m") >= 0) & (F.col("end_m") != F.col("start_m")) & (F.col("before").isNull() | (F.col("before") <= F.col("start_m")))
    good &= ~wraps | (F.col("is_last") & (F.col("end_m") <= F.col("first")))
    out = rows.groupBy("axis_id").agg(F.count("*").alias("n"), F.countDistinct("segment_id").alias("ids"), F.min(F.coalesce(good, F.lit(False))).alias("good"))
    return out.select("axis_id", "n", (F.col("good") & (F.col("ids") == F.col("n")) & (F.col("n") <= MOST)).alias("valid"))


def unwrapped(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranges that don't wrap (axis_id, segment_id, a, z): a wrapping one is two. lengths are (axis_id, length_m)."""
    rows = segments.join(lengths, "axis_id")
    whole = F.array(F.struct(F.col("start_m").alias("a"), F.col("end_m").alias("z")))
    parts = F.array(F.struct(F.col("start_m").alias("a"), F.col("length_m").alias("z")), F.struct(F.lit(0.0).alias("a"), F.col("end_m").alias("z")))
    rows = rows.withColumn("r", F.explode(F.when(F.col("end_m") < F.col("start_m"), parts).otherwise(whole)))
    return rows.select("axis_id", "segment_id", "r.a", "r.z").where("z > a")


def overlaps(a: DataFrame, b: DataFrame, lengths: DataFrame) -> DataFrame:
    """(axis_id, a_id, b_id, metres, share): segments of two segmentations that overlap, around the gate too; the share is
    of the shorter."""
    x = unwrapped(a, lengths).select("axis_id", F.col("segment_id").alias("a_id"), F.col("a").alias("a0"), F.col("z").alias("a1"))
    y = unwrapped(b, lengths).select("axis_id", F.col("segment_id").alias("b_id"), F.col("a").alias("b0"), F.col("z").alias("b1"))
    both = x.join(y, "axis_id").where("a0 < b1 and b0 < a1")  # at most 65 of an axis on either side
    met = both.groupBy("axis_id", "a_id", "b_id").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("metres"))
    size_a = x.groupBy("axis_id", "a_id").agg(F.sum(F.col("a1") - F.col("a0")).alias("la"))
    size_b = y.groupBy("axis_id", "b_id").agg(F.sum(F.col("b1") - F.col("b0")).alias("lb"))
    out = met.join(size_a, ["axis_id", "a_id"]).join(size_b, ["axis_id", "b_id"])
    return out.select("axis_id", "a_id", "b_id", "metres", (F.col("metres") / F.least("la", "lb")).alias("share"))


def carried(a: DataFrame, b: DataFrame, lengths: DataFrame, share: float = SHARE) -> DataFrame:
    """(axis_id, a_id, b_id): of each segment of ``a`` the one of ``b`` that overlaps it most, if by ``share`` of the
    shorter; of equals the first by id."""
    rows = overlaps(a, b, lengths).where(F.col("share") >= share)
    return rows.groupBy("axis_id", "a_id").agg(F.min(F.struct((-F.col("metres")).alias("m"), "b_id")).getField("b_id").alias("b_id"))


def matched(a: DataFrame, b: DataFrame, lengths: DataFrame, share: float = SHARE) -> DataFrame:
    """(axis_id, a_id, b_id): one to one, greatest overlaps first; an axis has at most ``MOST`` segments on either side."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used_a, used_b = [], set(), set()
        for r in pdf.sort_values(["metres", "a_id", "b_id"], ascending=[False, True, True]).itertuples():
            if r.a_id not in used_a and r.b_id not in used_b:
                used_a.add(r.a_id)
                used_b.add(r.b_id)
                out.append((r.axis_id, r.a_id, r.b_id))
        return pd.DataFrame(out, columns=["axis_id", "a_id", "b_id"])

    rows = overlaps(a, b, lengths).where(F.col("share") >= share).select("axis_id", "a_id", "b_id", "metres")
    return rows.groupBy("axis_id").applyInPandas(pick, "axis_id long, a_id long, b_id long")


def reviewed(proposals: DataFrame, approved: DataFrame, lengths: DataFrame, same_m: float = 10.0) -> DataFrame:
    """(axis_id, segment_id, approved_id, state): proposals against what was approved: ``new`` without an overlap, ``same``
    if both ends lie within ``same_m`` and the kind agrees, else ``changed``."""
    match = carried(proposals, approved, lengths, 0.0).withColumnsRenamed({"a_id": "segment_id", "b_id": "approved_id"})
    old = approved.select("axis_id", F.col("segment_id").alias("approved_id"), F.col("kind").alias("k"), F.col("start_m").alias("s"), F.col("end_m").alias("e"))
    rows = proposals.join(match, ["axis_id", "segment_id"], "left").join(old, ["axis_id", "approved_id"], "left")
    same = (F.abs(F.col("start_m") - F.col("s")) <= same_m) & (F.abs(F.col("end_m") - F.col("e")) <= same_m) & (F.col("kind") == F.col("k"))
    state = F.when(F.col("approved_id").isNull(), "new").when(same, "same").otherwise("changed")
    return rows.select("axis_id", "segment_id", "approved_id", state.alias("state"))


def _renumbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("axis_id").orderBy("ord", "half")).cast("long")).drop("half")


def approved(segments: DataFrame, keys: DataFrame, yes: bool = True) -> DataFrame:
    """The segments with those of ``keys`` (axis_id, segment_id) approved, or no longer."""
    hit = segments.join(keys.select("axis_id", "segment_id").distinct().withColumn("hit", F.lit(True)), ["axis_id", "segment_id"], "left")
    return hit.withColumn("approved", F.when(F.col("hit"), F.lit(yes)).otherwise(F.col("approved"))).drop("hit").select(*segments.columns)


def edited(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """The segments with new ends from edits (axis_id, segment_id, new_start_m, new_end_m; null keeps); neighbours that
    touched an end follow it, and whatever moved isn't approved any more."""
    w = Window.partitionBy("axis_id").orderBy("ord")
    rows = segments.join(edits, ["axis_id", "segment_id"], "left")
    rows = rows.withColumns({
        "s1": F.coalesce("new_start_m", F.when(F.lag("end_m").over(w) == F.col("start_m"), F.lag("new_end_m").over(w)), "start_m"),
        "e1": F.coalesce("new_end_m", F.when(F.lead("start_m").over(w) == F.col("end_m"), F.lead("new_start_m").over(w)), "end_m"),
    })
    moved = (F.col("s1") != F.col("start_m")) | (F.col("e1") != F.col("end_m"))
    out = rows.withColumns({"approved": F.col("approved") & ~moved, "start_m": F.col("s1"), "end_m": F.col("e1")})
    return out.select(*segments.columns)


def split(segments: DataFrame, cuts: DataFrame, new_id: Column) -> DataFrame:
    """The segments with those of cuts (axis_id, segment_id, at_m) in two where the cut lies inside; the second half has
    ``new_id``, neither is approved, and places in the order are made anew."""
    rows = segments.join(cuts, ["axis_id", "segment_id"], "left")
    inside = (F.col("at_m") > F.col("start_m")) & (F.col("at_m") < F.col("end_m"))
    halves = F.when(F.coalesce(inside, F.lit(False)), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("half", F.explode(halves))
    first, second = F.col("half") == 1, F.col("half") == 2
    rows = rows.withColumns({
        "end_m": F.when(first, F.col("at_m")).otherwise(F.col("end_m")), "start_m": F.when(second, F.col("at_m")).otherwise(F.col("start_m")),
        "segment_id": F.when(second, new_id).otherwise(F.col("segment_id")), "approved": F.col("approved") & (F.col("half") == 0),
    })
    return _renumbered(rows).select(*segments.columns)


def merged(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """The segments with each of ``keys`` (axis_id, segment_id) joined with the next of its axis, under its own id and
    kind; the pair isn't approved. A key that is itself a next one counts for nothing."""
    w = Window.partitionBy("axis_id").orderBy("ord")
    rows = segments.join(keys.select("axis_id", "segment_id").distinct().withColumn("hit", F.lit(1)), ["axis_id", "segment_id"], "left")
    rows = rows.withColumn("hit", F.coalesce("hit", F.lit(0)))
    # of neighbouring keys every second one, from the first on
    rows = rows.withColumn("island", F.sum(1 - F.col("hit")).over(w))
    place = F.row_number().over(Window.partitionBy("axis_id", "island", "hit").orderBy("ord"))
    rows = rows.withColumn("head", (F.col("hit") == 1) & (place % 2 == 1) & F.lead("ord").over(w).isNotNull())
    rows = rows.withColumns({"tail": F.coalesce(F.lag("head").over(w), F.lit(False)), "next_end": F.lead("end_m").over(w), "half": F.lit(0)})
    rows = rows.where("not tail").withColumns({"end_m": F.when(F.col("head"), F.col("next_end")).otherwise(F.col("end_m")), "approved": F.col("approved") & ~F.col("head")})
    return _renumbered(rows).select(*segments.columns)


def revision(segments: DataFrame) -> DataFrame:
    """(axis_id, revision): a digest of an axis's segments in order, equal for equal segmentations."""
    line = F.concat_ws("|", "segment_id", "kind", F.round("start_m", 3).cast("string"), F.round("end_m", 3).cast("string"))
    rows = segments.select("axis_id", F.struct("ord", line.alias("line")).alias("r"))
    # at most MOST rows of an axis
    out = rows.groupBy("axis_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return out.select("axis_id", F.sha2(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), 256).alias("revision"))


def canonical(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each group of runs(group_id, run_id, axis_id, ord) the first run's axis that has segments: (group_id, run_id,
    axis_id)."""
    have = runs.join(segments.select("axis_id").distinct(), "axis_id", "left_semi")
    return have.groupBy("group_id").agg(F.min(F.struct("ord", "run_id", "axis_id")).alias("b")).select("group_id", "b.run_id", "b.axis_id")


def current(results: DataFrame, revisions: DataFrame, algorithm: int) -> DataFrame:
    """results(axis_id, made_revision, made_by) with ``current``: of the segments' revision and this algorithm."""
    same = (F.col("made_revision") == F.col("revision")) & (F.col("made_by") == algorithm)
    return results.join(revisions, "axis_id", "left").withColumn("current", F.coalesce(same, F.lit(False))).drop("revision")
