"""Days that change by run: lap rows laid out by run, rankings by group, each with versions that a pointer names.

Replacing a run writes its new rows, ranks its groups anew from the groups' stored rows and swaps pointers; no other run and
no other group is read, and no recording again. A change is told by run: the rows that went and the rows that came.

A write names its version by the caller's token, and a pointer is swapped by one rename. A call that was cut off is repeated
with its token: it writes the same folders again, and readers see a run and a group as they were until their pointers move.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS, GROUPS = "runs", "groups"
#: Runs that a call may replace: their pointers are read and swapped by the driver, one at a time.
MOST_RUNS = 10_000


@dataclass
class Change:
    """What a call did: the rows that went and came, (run_id, group_id, change, ...), the groups ranked anew and the files read."""

    feed: DataFrame
    groups: list
    read: list[str]


def _name(value) -> F.Column:
    """A folder's name for an id of any form."""
    return F.sha2(F.coalesce(value.cast("string"), F.lit("")), 256)


def _pointer(spark: SparkSession, folder: str, kind: str, name: str) -> str | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers/{kind}/{name}.json")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _swap(spark: SparkSession, folder: str, kind: str, name: str, row: dict) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, at = (jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers/{kind}/{n}") for n in (f".{name}-{uuid.uuid4().hex}", f"{name}.json"))
    stream = new.getFileSystem(conf).create(new, True)
    stream.write(bytearray(json.dumps(row).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, at, options)


def _write(rows: DataFrame, folder: str, kind: str, by: str, token: str) -> None:
    """Folders by id and version; those of this version are written over, no others."""
    laid = rows.withColumns({"name": _name(F.col(by)), "version": F.lit(token)})
    laid.repartition("name").write.partitionBy("name", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/{kind}")


def _versions(spark: SparkSession, folder: str, kind: str, ids: list) -> dict:
    """Of ids those with a pointer, as (name, pointer)."""
    names = {r["id"]: r["name"] for r in spark.createDataFrame([(str(i),) for i in ids], "id string").select("id", _name(F.col("id")).alias("name")).collect()} if ids else {}
    found = {i: (names[str(i)], _pointer(spark, folder, kind, names[str(i)])) for i in ids}
    return {i: (n, json.loads(p) if p is not None else None) for i, (n, p) in found.items()}


def _stored(spark: SparkSession, folder: str, kind: str, versions: dict, schema) -> tuple[DataFrame, list[str]]:
    paths = [f"{folder}/{kind}/name={n}/version={p['version']}" for n, p in versions.values() if p is not None and p["rows"]]
    if not paths:
        return spark.createDataFrame([], schema), []
    return spark.read.schema(schema).parquet(*paths), paths


def replace_runs(
    rows: DataFrame, folder: str, token: str, rank: Callable[[DataFrame], DataFrame], gone: list | None = None
) -> Change:
    """Puts lap rows (run_id, group_id, lap_no, ...) of whole runs in place of what was stored of these runs and of those in
    ``gone``, and ranks their old and new groups by ``rank``, which adds columns to rows of whole groups."""
    spark, schema = rows.sparkSession, rows.schema
    changed = {r["run_id"]: set(r["groups"]) for r in rows.groupBy("run_id").agg(F.collect_set("group_id").alias("groups")).limit(MOST_RUNS + 1).collect()}
    for run in gone or []:
        changed.setdefault(run, set())
    if len(changed) > MOST_RUNS:
        raise ValueError(f"a call replaces at most {MOST_RUNS} runs")
    before = _versions(spark, folder, RUNS, list(changed))
    old, files = _stored(spark, folder, RUNS, before, schema)
    affected = set().union(*changed.values(), *(p["groups"] for _, p in before.values() if p is not None)) if changed else set()
    groups = _versions(spark, folder, GROUPS, sorted(affected, key=str))
    held, more = _stored(spark, folder, GROUPS, groups, schema)
    runs = spark.createDataFrame([(r,) for r in changed], rows.select("run_id").schema)
    kept = held.join(F.broadcast(runs), "run_id", "left_anti")  # MOST_RUNS rows at most
    _write(rows, folder, RUNS, "run_id", token)
    new, _ = _stored(spark, folder, RUNS, {r: (n, {"version": token, "rows": bool(changed[r])}) for r, (n, _) in before.items()}, schema)
    ranked = rank(kept.select(*schema.names).unionByName(new))
    _write(ranked, folder, GROUPS, "group_id", token)
    written = {r["group_id"] for r in spark.read.parquet(f"{folder}/{GROUPS}").where(F.col("version") == token).select("group_id").distinct().collect()} if affected else set()
    for group, (name, _) in groups.items():
        _swap(spark, folder, GROUPS, name, {"id": group, "version": token, "rows": group in written})
    for run, (name, _) in before.items():
        _swap(spark, folder, RUNS, name, {"id": run, "version": token, "rows": bool(changed[run]), "groups": sorted(changed[run], key=str)})
    feed = old.withColumn("change", F.lit("went")).unionByName(new.withColumn("change", F.lit("came")))
    return Change(feed, sorted(affected, key=str), [*files, *more])


def rerank(spark: SparkSession, folder: str, token: str, groups: list, schema, rank: Callable[[DataFrame], DataFrame]) -> Change:
    """Ranks groups anew by another ``rank``, such as one with other laps left out, from their stored rows alone."""
    held, files = _stored(spark, folder, GROUPS, found := _versions(spark, folder, GROUPS, groups), schema)
    _write(rank(held), folder, GROUPS, "group_id", token)
    for group, (name, pointer) in found.items():
        if pointer is not None:
            _swap(spark, folder, GROUPS, name, {**pointer, "version": token})
    return Change(held.limit(0).withColumn("change", F.lit("")), groups, files)


def rankings(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All groups' current rows. Pointers meet folders by a join that prunes the others."""
    now = spark.read.schema("version string, rows boolean").json(f"{folder}/pointers/{GROUPS}/*.json")
    now = now.where("rows").select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})\.json", 1).alias("name"), "version")
    laid_out = T.StructType([*schema.fields, T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])
    every = spark.read.schema(laid_out).parquet(f"{folder}/{GROUPS}")
    return every.join(now, ["name", "version"]).drop("name", "version")
