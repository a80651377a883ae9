"""Streaming counterparts of the batch increments (SM1, SM3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.incremental import new_rows
from marlstone.sources.jsonl import exists


def append_unseen(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of a stream whose key the target table doesn't have (SM1); a micro-batch that is repeated after a failure adds nothing twice.

    Each batch is written to a folder of its own, which a repetition overwrites; within a batch the first row of a key counts.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, target):
            old = spark.read.option("recursiveFileLookup", "true").parquet(target).where(F.col("_batch") != number)
            fresh = new_rows(fresh, old, key)
        fresh.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part_{number:012d}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(target).drop("_batch")


def live_keys(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark (SM3); state older than the delay is dropped."""
    return stream.where(~F.coalesce("tombstone", F.lit(False)) if "tombstone" in stream.columns else F.lit(True)).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
