"""Reports: index-based percentiles, buckets, memberships, gates, counters (AG4-AG10, AG14, PR10-PR13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Edges of the two star histograms, least and greatest value of each bucket.
DOC_BUCKETS = (("0", 0, 0), ("1–9", 1, 9), ("10–49", 10, 49), ("50–99", 50, 99), ("100–499", 100, 499), ("500–999", 500, 999), ("1k–5k", 1000, 4999), ("5k+", 5000, None))
REPORT_BUCKETS = (("0", 0, 0), ("1-9", 1, 9), ("10-49", 10, 49), ("50-499", 50, 499), ("500-4999", 500, 4999), ("5000+", 5000, None))


def bucket(value: Column, edges) -> Column:
    """The label of the bucket that holds a value; null outside all."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(edges):
        inside = value >= low if high is None else value.between(low, high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def index_percentiles(df: DataFrame, by: str, value: str, percents: dict[str, float], median: str = "median") -> DataFrame:
    """(by, median, <name>...): percentile p is the sorted value at index min(int(n * p / 100), n - 1).

    The median of an even number of values is the mean of the two middle ones, rounded down. Equal values are counted first, so a
    group costs as many rows as it has distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(by).orderBy(value)
    cum = counts.withColumn("_c", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(by)))
    at = lambda i: F.min(F.when(F.col("_c") > i, F.col(value)))
    half = F.floor(F.col("_all") / 2)
    low = F.floor((F.col("_all") - 1) / 2)
    aggs = [F.floor((at(low) + at(half)) / 2).cast("bigint").alias(median)]
    for name, p in percents.items():
        aggs.append(at(F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)).alias(name))
    return cum.groupBy(by).agg(*aggs)


def source_stats(df: DataFrame, by: str, stars: str, description: str) -> DataFrame:
    """(by, total, no_description, zero_stars, their percentages, median, p95): null stars count as 0."""
    s = df.select(by, F.coalesce(F.col(stars), F.lit(0)).alias("_s"), (F.trim(F.coalesce(description, F.lit(""))) == "").alias("_d"))
    base = s.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_d").alias("no_description"), F.count_if(F.col("_s") == 0).alias("zero_stars"))
    pct = lambda c: F.round(100 * F.col(c) / F.col("total"), 6)
    return base.join(index_percentiles(s, by, "_s", {"p95": 95}), by).withColumn("pct_no_description", pct("no_description")).withColumn("pct_zero_stars", pct("zero_stars"))


def warnings(stats: DataFrame, max_no_description: float = 5.0, max_zero_stars: float = 15.0) -> DataFrame:
    """The rows of source_stats that exceed a threshold, strictly (PR11)."""
    return stats.where((F.col("pct_no_description") > max_no_description) | (F.col("pct_zero_stars") > max_zero_stars))


def histogram(df: DataFrame, value: Column, edges, by: list[str] = ()) -> DataFrame:
    """(by..., bucket, n) of the buckets that occur."""
    return df.select(*by, bucket(value, edges).alias("bucket")).where("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def memberships(df: DataFrame, items: Column, out: str) -> DataFrame:
    """(out, n): how many rows list each item, once a row; sums may exceed the rows."""
    return df.select(F.explode(F.array_distinct(items)).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def regression_gate(current: int, previous: int | None, threshold: float) -> tuple[bool, float]:
    """(passed, drop): the drop is (previous - current) / max(previous, 1); without a previous count it passes."""
    if previous is None:
        return True, 0.0
    drop = (previous - current) / max(previous, 1)
    return drop <= threshold, drop


def request_class(url: Column, status: Column, raw_host: str, graph_path: str = "/graphql", search_path: str = "/search/") -> Column:
    """conditional, raw, graphql, search or rest, in this order (PR13)."""
    return F.when(status == 304, "conditional").when(url.contains(raw_host), "raw").when(url.contains(graph_path), "graphql").when(url.contains(search_path), "search").otherwise("rest")


def latest_with_prefix(df: DataFrame, tag: str, prefix: str) -> DataFrame:
    """One row: the lexicographically greatest tag with the prefix (AG14)."""
    return df.where(F.col(tag).startswith(prefix)).agg(F.max(tag).alias("latest"))


def needs_update(local: Column, tag: Column, prefix: str = "index-") -> Column:
    """True if the release date in `tag` is after `local` (ISO day), or if either can't be read (PR6)."""
    digits = F.regexp_replace(F.regexp_replace(tag, f"^{prefix}", ""), "-", "")
    released = F.when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date"))
    return F.coalesce(released > local.try_cast("date"), F.lit(True))


def short_stars(n: Column) -> Column:
    """98000 -> 98k, 1500 -> 1.5k, 12 -> 12 (FN15)."""
    return F.when(n >= 10_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).when(n >= 1000, F.concat(F.format_number(F.bround(n / 1000, 1), 1), F.lit("k"))).otherwise(n.cast("string"))


def bar(percent: Column, width: int = 20) -> Column:
    """A bar of `width` blocks: full ones, one at least for what is above 0, rounded half to even, and light ones for the rest (FN14)."""
    full = F.when(percent > 0, F.greatest(F.lit(1), F.bround(percent / 100 * width, 0).cast("int"))).otherwise(0)
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
