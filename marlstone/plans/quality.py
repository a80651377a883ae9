"""Queries of the data quality profile (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.profile import Profile, odd_points
from marlstone.session import table

LARGE = {"skillsmp": "load_no", "skillhub": "load_no", "repo_meta": None, "documents": None, "release_log": None}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The loads and dates that break with the rest."""
    skills = Profile(table(spark, d, "skillsmp"), [("description", F.col("description")), ("stars", F.col("raw_metadata.stars").cast("string"))], F.col("load_no"))
    loads = skills.odd_loads(named=False).select(F.lit("skillsmp").alias("tab"), "col", F.col("load").alias("load_key")).distinct()
    days = odd_points(table(spark, d, "release_log"), "date", "skill_count").select(F.lit("release_log").alias("tab"), F.lit("skill_count").alias("col"), F.col("date").alias("load_key")).distinct()
    return loads.unionByName(days)


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of the large tables and of release_log."""
    out = [Profile(table(spark, d, t)).columns().select(F.lit(t).alias("tab"), "*") for t in LARGE]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every measure by which a load of skillsmp or skillhub breaks with the other loads, over all columns."""
    out = [Profile(table(spark, d, t), load=F.col(c)).odd_loads().select(F.lit(t).alias("tab"), "*") for t, c in LARGE.items() if c]
    return out[0].unionByName(out[1])


QUERIES = {f.__name__: f for f in (p2_found, p2_columns, p2_drift)}
