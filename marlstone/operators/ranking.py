"""Distributed ranks of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.session import row_parts, shared_table


def average_ranks(df: DataFrame, value: str, by: list[str] = (), partitions: int | None = None) -> DataFrame:
    """(by..., value, share, above): for each distinct value its mean rank as a share of the rows, between 0 and 1, and the rows
    with a greater one; nulls are left out.

    Equal values are counted before anything is sorted, values are sorted by range, and each range is shifted by
    the rows before it: no task sees a whole column, and a value that a third of all rows have is one row. There are as many
    ranges as the number of rows asks for; `df` is counted for that, so it should be a written table.
    """
    keys = list(by)
    if partitions is None:
        partitions = row_parts(df.sparkSession, df.count())
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    # written once: the bounds of ranges are sampled, and every use must see the same ones
    ranged = shared_table(counts.repartitionByRange(partitions, *keys, "_value").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))
    part = W.partitionBy(*keys)
    before = sizes.select(*keys, "_range", F.coalesce(F.sum("_m").over(part.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(part).alias("_total"))
    own = F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    joined = ranged.withColumn("_own", own).join(before, [*keys, "_range"])
    upto = F.col("_before") + F.col("_own")
    share: Column = (upto - F.col("_n") / 2) / F.col("_total")
    return joined.select(*keys, F.col("_value").alias(value), share.alias("share"), (F.col("_total") - upto).alias("above"))
