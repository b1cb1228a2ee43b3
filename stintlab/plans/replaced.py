"""A query of days that change by run: customers of a nation are dealt to eight runs, three of which are read again from
another recording, and one goes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlab.operators import laps
from stintlab.operators.written import shared_folder
from stintlab.plans import tables as t
from stintlab.plans.registry import query
from stintlab.plans.tables import LAPS_SQL
from stintlab.streaming.replaced import rankings, replace_runs


def _ranked(rows):
    told = laps.rank_group(rows).select("group_id", "run_id", "lap_no", F.col("position").cast("long"))
    return rows.join(told, ["group_id", "run_id", "lap_no"], "left")


@query(f"""WITH {LAPS_SQL}, r AS (SELECT group_id, group_id * 8 + run_id % 8 AS run_id, lap_no, clock, CASE WHEN (group_id * 8 + run_id % 8) % 67 = 5 THEN seconds * 0.5 ELSE seconds END AS seconds, excluded FROM laps),
 k AS (SELECT * FROM r WHERE run_id <> 11), e AS (SELECT group_id, run_id, lap_no, row_number() OVER (PARTITION BY group_id ORDER BY seconds, clock NULLS LAST, run_id, lap_no) AS position FROM k WHERE seconds IS NOT NULL AND NOT excluded)
 SELECT group_id, run_id, lap_no, round(seconds, 4) AS seconds, coalesce(position, 0) AS position FROM k LEFT JOIN e USING (group_id, run_id, lap_no)""")
def replaced_runs(spark, sf_dir):
    run = F.col("group_id") * 8 + F.col("run_id") % 8
    rows = t.laps(spark, sf_dir).withColumn("run_id", run)
    folder = f"{shared_folder(spark)}/day-{uuid.uuid4().hex}"
    replace_runs(rows, folder, "first", _ranked)
    again = rows.where(F.col("run_id") % 67 == 5).withColumn("seconds", F.col("seconds") * 0.5)
    replace_runs(again, folder, "again", _ranked, gone=[11])
    found = rankings(spark, folder, T.StructType([*rows.schema.fields, T.StructField("position", T.LongType())]))
    return found.select("group_id", "run_id", "lap_no", (F.round("seconds", 4) + 0.0).alias("seconds"), F.coalesce("position", F.lit(0)).alias("position"))
