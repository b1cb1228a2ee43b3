"""Days as documents: one JSON text a day, written, read, checked and changed without losing what a reader doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema version of a day's document, its greatest size in bytes and the runs of a day.
VERSION, MOST_BYTES, MOST_RUNS = 3, 4 << 20, 64

_RUN = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("excluded", T.ArrayType(T.LongType()))])
_DAY = T.StructType([T.StructField("version", T.LongType()), T.StructField("day", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))])


def encoded(runs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(day, text): of runs(day, id, name, source, excluded) a document a day, in order of their ids; extra(day, key, value)
    holds what other writers had added at the top, which stays. A day has at most ``MOST_RUNS`` runs."""
    listed = runs.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("id", "name", "source", "excluded"))).alias("runs"))
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), "day", "runs"), {"ignoreNullFields": "false"})
    if extra is None:
        return listed.select("day", body.alias("text"))
    # a day's few unknown keys, whose values are JSON already
    name = F.concat(F.lit('"'), F.regexp_replace("key", r'(["\\\\])', r"\\\\$1"), F.lit('":'))
    parts = extra.select("day", "key", F.concat(name, "value").alias("part"))
    more = parts.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("key", "part"))).alias("p"))
    more = more.select("day", F.array_join(F.transform("p", lambda x: x["part"]), ",").alias("more"))
    rows = listed.join(more, "day", "left").withColumn("body", body)
    text = F.when(F.col("more").isNull(), F.col("body")).otherwise(F.concat(F.substring("body", F.lit(1), F.length("body") - 1), F.lit(","), F.col("more"), F.lit("}")))
    return rows.select("day", text.alias("text"))


def decoded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, problems) of documents (day, text): runs as :func:`encoded` takes them, and (day, problem) for texts that
    aren't JSON, of another version, too large, of another day, or with too many or repeated runs, which give no runs."""
    rows = documents.withColumn("d", F.from_json("text", _DAY))
    ids = F.transform("d.runs", lambda r: r["id"])
    problem = (
        F.when(F.octet_length("text") > MOST_BYTES, "too large").when(F.col("d").isNull() | F.col("d.version").isNull(), "not a document").when(F.col("d.version") != VERSION, "another version")
        .when(~F.col("d.day").eqNullSafe(F.col("day")), "another day").when(F.size("d.runs") > MOST_RUNS, "too many runs").when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated runs")
    )
    rows = rows.withColumn("problem", problem)
    runs = rows.where("problem is null").select("day", F.explode("d.runs").alias("r")).select("day", "r.*")
    return runs, rows.where("problem is not null").select("day", "problem")


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents without the runs of gone(day, id); everything else in them stays as it was written."""
    listed = gone.groupBy("day").agg(F.collect_set("id").alias("gone"))
    rows = documents.join(listed, "day", "left")
    text = F.col("text")
    kept = F.filter(F.from_json(F.get_json_object(text, "$.runs"), T.ArrayType(_RUN)), lambda r: ~F.array_contains(F.col("gone"), r["id"]))
    old = F.get_json_object(text, "$.runs")
    # the runs' own text is replaced where it stands
    new = F.replace(text, old, F.to_json(kept, {"ignoreNullFields": "false"}))
    return rows.select("day", F.when(F.col("gone").isNull() | old.isNull(), text).otherwise(new).alias("text"))
