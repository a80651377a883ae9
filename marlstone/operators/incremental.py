"""Deltas against what is there: caches, new rows, backfill, upsert (JN3-JN9, ST5, WN1-WN6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.text import squash
from marlstone.session import row_parts, shared_table


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key isn't there yet; rows without key are kept, repeated ones too (JN4)."""
    return incoming.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str, text: str, value: str) -> DataFrame:
    """Adds `value` and `hit`: true where the cache has the same key with the same text (JN3); of repeated cache keys the last (`ord`) counts."""
    last = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(text).alias("t"), F.col(value).alias("v")), "ord").alias("_c"))
    got = rows.join(last, key, "left")
    hit = F.coalesce(F.col("_c.t") == F.col(text), F.lit(False)) & (F.col(key) != "")
    return got.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn(value, F.when(F.col("hit"), F.col("_c.v"))).drop("_c")


def backfill_stars(rows: DataFrame, meta: DataFrame, repo: str = "repo") -> DataFrame:
    """Rows with stars null or 0 take stars, and where empty pushed_at and default_branch, from `meta` (repo, stargazers_count, pushed_at, default_branch) (JN5)."""
    m = meta.select(F.col("repo").alias("_repo"), F.col("stargazers_count").alias("_stars"), F.col("pushed_at").alias("_pushed"), F.col("default_branch").alias("_branch"))
    needy = F.coalesce("stars", F.lit(0)) == 0
    got = rows.join(m, F.col(repo) == F.col("_repo"), "left")
    found = needy & F.col("_repo").isNotNull()
    return got.withColumns(
        {
            "default_branch": F.when(found, F.coalesce(F.nullif(F.col("default_branch"), F.lit("")), "_branch")).otherwise(F.col("default_branch")),
            "pushed_at": F.when(found, F.coalesce("_pushed", "pushed_at")).otherwise(F.col("pushed_at")),
            "updated": found & F.coalesce(F.col("_stars") > 0, F.lit(False)),
            "stars": F.when(found, F.coalesce("_stars", "stars")).otherwise(F.col("stars")),
        }
    ).drop("_repo", "_stars", "_pushed", "_branch")


def backfill_descriptions(rows: DataFrame, own: Column, repo: Column) -> DataFrame:
    """Empty descriptions take the document's own, else the repository's (JN6); both columns must be in `rows`."""
    full = F.nullif(F.col("description"), F.lit(""))
    return rows.withColumn("description", F.coalesce(full, F.nullif(own, F.lit("")), F.nullif(repo, F.lit("")), "description"))


def exclude_seen(rows: DataFrame, seen: DataFrame, key: str, seen_repos: DataFrame | None = None, repo: str = "repo") -> DataFrame:
    """Rows whose key isn't in `seen`; with `seen_repos`, repositories of one document are left out by their repo as well (JN7, JN8)."""
    out = rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    if seen_repos is None:
        return out
    single = out.groupBy(repo).agg(F.count("*").alias("_n"))
    gone = single.where("_n = 1").join(seen_repos.select(repo).distinct(), repo).select(repo)
    return out.join(gone, repo, "left_anti")


def match_by_name(rows: DataFrame, paths: DataFrame, by: str) -> DataFrame:
    """(rows..., path): the first path of the group whose parent folder equals, holds or is held by the name, squashed; else the first path (JN9).

    `paths` has `by`, pos and path. Names and folders meet by the strings they hold, never as all pairs of a group: one repository may have a
    tenth of all names and a tenth of all paths. A folder without letters and digits is held by every name, and a name without them by every folder.
    """
    folder = squash(F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")))
    named = rows.withColumn("_n", squash(F.coalesce("name", F.lit(""))))
    at = F.when(F.col("pos").isNotNull(), F.struct("pos", "path"))
    # both written once: each is looked up in several ways, and what they are made from would be read again for every one
    f = shared_table(paths.where(F.col(by).isNotNull()).groupBy(by, folder.alias("_f")).agg(F.min(at).alias("_at")), "folders")
    of_paths = f.groupBy(by).agg(F.min("_at").alias("_first"), F.min(F.when(F.col("_f") == "", F.col("_at"))).alias("_any"), F.bit_or(_anchor("_f")).alias("_sizes"))
    n = shared_table(named.where(F.col(by).isNotNull()).select(by, "_n").distinct().join(of_paths, by), "names")
    folders = f.where("_f <> ''").join(n.groupBy(by).agg(F.bit_or(_anchor("_n")).alias("_sizes")), by)
    in_names = _held(n.select(by, "_n", "_sizes"), "_n", f.where("_f <> ''"), "_f", by)
    in_folders = _held(folders, "_f", n.where("_n <> ''").select(by, "_n"), "_n", by)
    like = in_names.unionByName(in_folders).groupBy(by, "_n").agg(F.min("_at").alias("_like"))
    alike = F.when(F.col("_n") == "", F.col("_first")).otherwise(F.least("_any", "_like"))
    best = n.join(like, [by, "_n"], "left").select(by, "_n", F.coalesce(alike["path"], F.col("_first.path")).alias("path"))
    return named.join(best, [by, "_n"]).select(by, *[c for c in rows.columns if c != by], "path")


def _powers(text: str) -> Column:
    """The powers of two that aren't above the length of `text`."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p <= F.length(text))


def _anchor(word: str) -> Column:
    """The greatest power of two that isn't above the length of `word`; null for an empty one."""
    return F.array_max(_powers(word))


def _held(texts: DataFrame, text: str, words: DataFrame, word: str, by: str) -> DataFrame:
    """(by, text, word, _at): every word with a text of the same `by` that holds it; `_at` comes from either side.

    A text is looked up by its runs of as many characters as the anchors of its group have (`_sizes`, as bits), a word by its first ones. Where
    they agree, what follows is cut to the lengths of the words that begin so, all below twice the anchor, and these cuts must equal a word.
    Only that stretch travels with a run, and a hash for its text, so that a very long text isn't copied for each of its characters.
    """
    texts = texts.withColumn("_id", F.xxhash64(by, text))
    size, start = F.col("_p"), F.col("_i")
    runs = texts.withColumn("_p", F.explode(F.filter(_powers(text), lambda p: F.col("_sizes").bitwiseAND(p) != 0)))
    runs = runs.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(text) - size + 1)))
    runs = runs.select(by, "_id", F.xxhash64(by, F.substring(text, start, size)).alias("_k"), F.substring(text, start, size + (size - 1)).alias("_part"))
    begins = words.select(F.xxhash64(by, F.substring(word, F.lit(1), _anchor(word))).alias("_k"), F.length(word).alias("_len")).distinct()
    cuts = runs.join(begins, "_k").where(F.col("_len") <= F.length("_part")).select(by, "_id", F.substring("_part", F.lit(1), F.col("_len")).alias(word))
    found = cuts.join(words, [by, word]).join(texts.drop("_sizes"), [by, "_id"])
    return found.where(F.col(text).contains(F.col(word))).select(by, text, word, "_at")  # equal hashes of differing texts do no harm


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base rows without the keys that changes bring, plus the changes (ST5)."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order; max_by needs no sort of a group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key (WN4, AG11)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def release_deltas(log: DataFrame, date: str = "date", count: str = "skill_count") -> DataFrame:
    """(date, count, delta): the change against the last known count before; null for the first (WN1). Repeated days count once, with the greatest count."""
    days = log.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(F.max(count).alias("skill_count"), F.lit("log").alias("_s"))
    before = F.last("skill_count", ignorenulls=True).over(W.partitionBy("_s").orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    return days.select("date", "skill_count", (F.col("skill_count") - before).alias("delta"))


def carry_forward(df: DataFrame, group: str, order: str, value: Column, out: str) -> DataFrame:
    """Adds the last non-null value up to each row of its group (WN3)."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def numbered(df: DataFrame, order: str, batch: int, parts: int | None = None) -> DataFrame:
    """Adds row_no from 0 and batch_no (WN6). Rows are sorted by range, counted a range and shifted; no task sees them all.

    There are as many ranges as the number of rows asks for; only the counts of the ranges, one row each, meet in one task.
    """
    if parts is None:
        parts = row_parts(df.sparkSession, df.count())
    # written once: the bounds of ranges are sampled, and every use must see the same ones
    ranged = shared_table(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_m"), F.lit(1).alias("_s"))
    shift = sizes.select("_p", F.coalesce(F.sum("_m").over(W.partitionBy("_s").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_r", own).join(shift, "_p").withColumn("row_no", F.col("_r") + F.col("_b")).withColumn("batch_no", F.floor(F.col("row_no") / batch)).drop("_p", "_r", "_b")
