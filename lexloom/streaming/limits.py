"""Quotas and ledgers over streams of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import scratch_folder


def _folder(spark: SparkSession) -> str:
    """A stream's own folder among those that driver and executors share."""
    return f"{scratch_folder(spark, 'stream')}/{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read the result.

    With ``update`` and ``complete`` output each batch's rows are kept with its number, and the
    last of each key counts: a batch that is run again replaces its own files.
    """
    spark, base = stream.sparkSession, _folder(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream. A single file is streamed from its folder by name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    columns = [c for c in table.columns if c not in (*keys, "__batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__batch").alias("x")).select(*keys, "x.*")


def usage_by_day(spark: SparkSession, path: str) -> DataFrame:
    """Additive ledger of each UTC day."""
    per = events(spark, path).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.floor(F.abs("value")).cast("long")).alias("tokens"), F.count("*").alias("calls"))
    return latest(drained(per, "update"), ["day"])


def refused_by_minute(spark: SparkSession, path: str, rpm: int) -> DataFrame:
    """Calls and refused calls of each key and minute, with a watermark that bounds the state."""
    per = events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy("event_type", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("calls"))
    out = latest(drained(per, "update"), ["event_type", "w"])
    return out.select("event_type", F.col("w.start").alias("minute"), "calls", F.greatest(F.col("calls") - rpm, F.lit(0)).alias("refused"))
