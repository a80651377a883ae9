"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.urls import record_address
from marlstone.llm import bpe, history, language, neardup, packing, ranking, spam, survivors
from marlstone.llm.oracles import ORACLES  # noqa: F401  read by the entry
from marlstone.session import shared_table, small_rows, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got, _ = survivors.catalog_survivors(table(spark, d, "skillsmp"), table(spark, d, "owner_rename"), table(spark, d, "source_registry"))
    return got.select(F.col("first_id").alias("first_rec_id"), F.col("best_id").alias("best_rec_id"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    skills = table(spark, d, "skillsmp")
    got, _ = survivors.catalog_survivors(skills, table(spark, d, "owner_rename"), table(spark, d, "source_registry"))
    return survivors.surviving_records(skills, got)


def p1_source_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, trust = survivors.catalog_survivors(table(spark, d, "skillsmp"), table(spark, d, "owner_rename"), table(spark, d, "source_registry"))
    return trust.select("source", F.round("reliability", 6).alias("reliability"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(table(spark, d, "skillsmp"), table(spark, d, "lang_samples")).select("rec_id", "seg_no", "lang")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every usable description with the language and confidence of each of its segments."""
    skills, samples = table(spark, d, "skillsmp"), table(spark, d, "lang_samples")
    rows = language.usable_rows(skills, "rec_id", "description", "desc_lang", "name")
    return language.segment_languages(rows, language.fit(samples, rows, "lang", "sample", "declared", "description"), "rec_id", "description").drop("declared")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.skill_ranking(table(spark, d, "skillhub"), table(spark, d, "skillsmp"), table(spark, d, "owner_rename"))[0]
    return got.select("address", "rank", F.round("projection", 6).alias("projection"), "n_scores")


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the ranking puts the skill first that reviewers found better."""
    hub, renames = table(spark, d, "skillhub"), table(spark, d, "owner_rename")
    ranked, _ = ranking.skill_ranking(hub, table(spark, d, "skillsmp"), renames)
    of = record_address(hub, renames).select("hub_id", "address").join(ranked, "address").select("hub_id", "rank")
    better, worse = of.select(F.col("hub_id").alias("better_hub_id"), F.col("rank").alias("b")), of.select(F.col("hub_id").alias("worse_hub_id"), F.col("rank").alias("w"))
    said = table(spark, d, "rank_judgments").join(better, "better_hub_id").join(worse, "worse_hub_id")
    return said.agg(F.count("*").alias("judgments"), F.round(F.avg((F.col("b") < F.col("w")).cast("double")), 6).alias("agreement"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "skillsmp"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "skillsmp"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.nothing_new(history.catalog_records(table(spark, d, "skillsmp"), table(spark, d, "owner_rename")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: a digest of the bytes that each document's ids stand for."""
    return p7_ids(spark, d).select("doc_id", F.md5(bpe.decode(F.col("ids"))).alias("h"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the containers of each spec: (spec_id, items, lost_tokens, overfull, cut_needlessly, broken_parts), all but the items 0.

    Tokens are counted anew. Lost are those in no part, overfull the containers above the capacity, needlessly cut the items that fit one container
    and have more than one part; parts are broken if they don't follow one another.
    """
    boxes, specs = shared_table(p8_containers(spark, d), "boxes"), table(spark, d, "pack_specs")
    rows = small_rows(specs.select("spec_id", "capacity", "tokenizer"), packing.MOST_SPECS) or []
    names = sorted({r.tokenizer for r in rows})
    counts = packing.token_counts(table(spark, d, "documents"), names, "doc_id", "text")
    each = [F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity"), F.col("n")[names.index(r.tokenizer)].alias("total")) for r in rows]
    wanted = counts.select(F.col("id").alias("doc_id"), F.explode(F.array(*each)).alias("s")).select("doc_id", "s.*")
    parts = boxes.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("placed"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("part_no").alias("last"))
    per = wanted.join(parts, ["spec_id", "doc_id"], "left")
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("int")
    items = per.groupBy("spec_id").agg(
        F.count("*").alias("items"),
        F.sum(F.abs(F.col("total") - F.coalesce("placed", F.lit(0)))).cast("int").alias("lost_tokens"),
        bad((F.col("parts") > 1) & (F.col("total") <= F.col("capacity"))).alias("cut_needlessly"),
        bad(F.col("parts").isNull() | (F.col("end") != F.col("total")) | (F.col("last") != F.col("parts"))).alias("broken_parts"),
    )
    full = boxes.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t")).join(specs.select("spec_id", "capacity"), "spec_id").groupBy("spec_id").agg(bad(F.col("t") > F.col("capacity")).alias("overfull"))
    return items.join(full, "spec_id").select("spec_id", "items", "lost_tokens", "overfull", "cut_needlessly", "broken_parts")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each spec are, against the fewest that could hold the tokens."""
    boxes = p8_containers(spark, d).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts"))
    per = boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("parts").alias("parts"))
    return per.join(table(spark, d, "pack_specs"), "spec_id").select("spec_id", "capacity", "containers", "tokens", "fullest", "parts", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents"), table(spark, d, "lang_samples")).where(F.col("stuffed_share") > spam.SHARE).select("doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_segments, p4_ranking, p4_agreement, p7_ids, p7_decoded, p8_containers, p8_checked, p8_fill, p9_found, p1_found, p1_survivors, p1_source_reliability, p5_found, p5_groups, p6_found)}
