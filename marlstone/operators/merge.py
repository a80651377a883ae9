"""Order-aware merging of duplicate records (AG1, AG2), quality filter and drop reasons (PR1, PR2, AG3).

All rules depend on an explicit order column, never on the physical order of rows. Lists are aggregated in two steps, first by
(key, item), so that a key that many rows share never becomes a long list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import canonical_key, stable_id


def dedup_key(repo_url: Column, own_url: Column, renames: list[tuple[str, str]] = ()) -> Column:
    """The canonical key of the record's own document if it has one, else of its repository (PJ3)."""
    return canonical_key(F.coalesce(F.nullif(own_url, F.lit("")), repo_url), renames)


def ordered_items(df: DataFrame, key: str, item: Column, order: str, out: str) -> DataFrame:
    """(key, out): distinct non-empty items by first appearance."""
    first = df.select(key, item.alias("_i"), order).where("_i is not null and _i <> ''").groupBy(key, "_i").agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i"))), lambda x: x["_i"]).alias(out))


def sorted_items(df: DataFrame, key: str, items: Column, out: str) -> DataFrame:
    """(key, out): the sorted set of the non-empty members of array `items`."""
    each = df.select(key, F.explode(items).alias("_i")).where("_i is not null and _i <> ''").distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias(out))


def merge_records(records: DataFrame, order: str = "ord", last_sources: tuple[str, ...] = ()) -> DataFrame:
    """One row a key, merged field by field.

    `records` has key, `order`, repo_url, name, description, source, and optionally stars, pushed_at, categories, triggers, platforms, skill_md_url,
    rank, score, safety_scan, safety_scan_date, official; missing ones count as null. Rules: first known canonical repo_url, first non-empty name and
    skill_md_url, longest description (earliest of equal ones), greatest stars (0 at least) and pushed_at, ordered distinct sources and
    triggers, sorted sets of categories and platforms, last non-null rank, score and scan, date of the first scan; any official.
    `last_sources` limits rank, score and scan to records of these sources (none: all).
    """
    have = set(records.columns)
    kinds = {"stars": "bigint", "pushed_at": "string", "categories": "array<string>", "triggers": "array<string>", "platforms": "array<string>", "skill_md_url": "string", "rank": "string", "score": "double", "safety_scan": "boolean", "safety_scan_date": "string", "official": "boolean"}
    r = records.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in have}).where("key is not null")
    o = F.col(order)
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), o))
    trusted = F.col("source").isin(*last_sources) if last_sources else F.lit(True)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & trusted, o))
    scanned = F.when(F.col("safety_scan").isNotNull() & trusted, F.col("safety_scan_date"))
    one = r.groupBy("key").agg(
        first(canonical_key(F.col("repo_url"))).alias("repo_url"),
        F.coalesce(first(filled("name")), F.lit("")).alias("name"),
        F.coalesce(F.max_by("description", F.struct(F.length(filled("description")), -o)), F.lit("")).alias("description"),
        F.greatest(F.lit(0), F.coalesce(F.max("stars"), F.lit(0))).cast("bigint").alias("stars"),
        F.coalesce(F.max(filled("pushed_at")), F.lit("")).alias("last_updated"),
        F.coalesce(F.bool_or("official"), F.lit(False)).alias("is_official"),
        last("safety_scan").alias("safety_scan"),
        F.coalesce(first(scanned), F.lit(None).cast("string")).alias("safety_scan_date"),
        last("rank").alias("rank"),
        last("score").alias("score"),
        F.coalesce(first(filled("skill_md_url")), F.lit("")).alias("skill_md_url"),
        F.count("*").alias("n_records"),
    )
    none = F.array().cast("array<string>")
    out = one.withColumn("id", stable_id(F.col("key")))
    parts = {"source": ordered_items(r, "key", F.col("source"), order, "source")}
    parts["categories"] = sorted_items(r, "key", F.concat(F.coalesce("categories", none), F.coalesce("topics", none) if "topics" in have else none), "categories")
    parts["platforms"] = sorted_items(r, "key", F.coalesce("platforms", none), "platforms")
    trig = r.select("key", order, F.posexplode(F.coalesce("triggers", none)).alias("_p", "_t")).withColumn("_at", F.struct(order, "_p"))
    parts["triggers"] = ordered_items(trig, "key", F.col("_t"), "_at", "triggers")
    for name, part in parts.items():
        out = out.join(part, "key", "left").withColumn(name, F.coalesce(name, none))
    return out


def drop_reason(description: Column, stars: Column, min_stars: int = 10) -> Column:
    """Why a merged record is dropped: no_description, zero_stars, low_stars, in that order; null if it is kept."""
    n = F.coalesce(stars, F.lit(0))
    return F.when(F.coalesce(description, F.lit("")) == "", "no_description").when(n == 0, F.when(F.lit(min_stars) > 0, F.lit("zero_stars"))).when(n < min_stars, "low_stars")


def drop_counts(merged: DataFrame, min_stars: int = 10) -> DataFrame:
    """(reason, source, n): a dropped record counts for each of its sources; without source as `unknown`."""
    src = F.when(F.size("source") > 0, F.col("source")).otherwise(F.array(F.lit("unknown")))
    return merged.withColumn("reason", drop_reason(F.col("description"), F.col("stars"), min_stars)).where("reason is not null").select("reason", F.explode(src).alias("source")).groupBy("reason", "source").agg(F.count("*").alias("n"))


def command_map(sources: Column, name: Column, platforms: Column, templates: dict[str, tuple[str, str]], extra: dict[str, str] = {}) -> Column:
    """Platform -> command (PJ9): each source sets the command of its platform, later sources win; `extra` adds commands for platforms listed.

    `templates` maps a source to (platform, text with {name}).
    """
    targets = sorted({p for p, _ in templates.values()} | set(extra))
    entries = []
    for t in targets:
        # the last source in the list that serves this platform decides
        mine = {s: text for s, (p, text) in templates.items() if p == t}
        hit = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(sources, lambda s: s.isin(*mine)) if mine else F.array().cast("array<string>")), -1)
        text = F.lit(None).cast("string")
        for s, form in mine.items():
            text = F.when(hit == s, F.replace(F.lit(form), F.lit("{name}"), name)).otherwise(text)
        if t in extra:
            text = F.when(F.array_contains(platforms, t), F.lit(extra[t])).otherwise(text)
        entries += [F.lit(t), text]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def infer_platforms(declared: Column, codex: Column, source: Column, defaults: dict[str, str], fallback: str) -> Column:
    """The declared list if there is one, else codex where marked, else the source's default (PJ10)."""
    by = F.lit(fallback)
    for s, p in defaults.items():
        by = F.when(source == s, F.lit(p)).otherwise(by)
    return F.when(declared.isNotNull(), F.filter(declared, lambda p: p != "")).when(F.coalesce(codex, F.lit(False)), F.array(F.lit("codex"))).otherwise(F.array(by))
