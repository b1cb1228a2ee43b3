"""Structured Streaming forms: appended recordings by batch, and inactivity sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


#: Folders that runs are dealt to.
RUN_PARTS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_new(batch: DataFrame, folder: str) -> None:
    """Appends the samples that the table doesn't have, told by run, channel and time, so a run may come in parts and a
    batch that is delivered again adds nothing. Only the batch's own runs are read, which the table is laid out by."""
    spark = batch.sparkSession
    table = f"{folder}/samples"
    key = ["run_id", "channel", "t"]
    new = batch.dropDuplicates(key).persist()
    # the first batch has no table yet
    if _exists(spark, table):
        runs = new.select(F.pmod(F.xxhash64("run_id"), F.lit(RUN_PARTS)).alias("part"), "run_id").distinct()
        laid_out = T.StructType([*batch.schema.fields, T.StructField("part", T.LongType())])
        own = spark.read.schema(laid_out).parquet(table).join(F.broadcast(runs.select("part").distinct()), "part", "left_semi")  # RUN_PARTS rows at most
        new = new.join(own.select(*key), key, "left_anti")
    laid = new.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(RUN_PARTS)))
    laid.repartition("part").write.partitionBy("part").mode("append").parquet(table)
    new.unpersist()


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts appending a stream of samples (run_id, channel, t, v)."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, folder)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def sessions(stream: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Unbroken stretches of a channel by inactivity: samples have a timestamp ``ts`` besides run_id, channel, v."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("run_id", "channel", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"))
        .select("run_id", "channel", F.col("s.start").alias("t0"), F.col("s.end").alias("t1"), "n", "min_v", "max_v", "mean_v")
    )
