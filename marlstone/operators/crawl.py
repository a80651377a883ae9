"""Records and states of crawls: raw records, tombstones, flags, document candidates, shard states, update status (PJ11, PJ13, PR8, PR9, SC26, SC39, SM4, CT10).

Everything is a projection or a join on a key; nothing here talks to a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import owner_repo
from marlstone.sources.recorded import OVERFLOW, exhausted

#: Layouts in which a repository may keep its document, and the branches that are tried for each.
LAYOUTS = ("{doc}", "skills/{name}/{doc}", "{name}/{doc}", "skill/{doc}", "docs/{doc}")
BRANCHES = ("main", "master")


def raw_record(df: DataFrame, source: str, repo_url: Column, name: Column, description: Column, metadata: dict[str, Column], required: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., repo_url, name, description, source, raw_metadata): a connector's rows in the common form (PJ11); rows whose `required` is null are dropped."""
    meta = F.struct(*[c.alias(k) for k, c in metadata.items()])
    empty = lambda c: F.coalesce(c, F.lit(""))
    return df.where(required.isNotNull()).select(*keep, repo_url.alias("repo_url"), empty(name).alias("name"), empty(description).alias("description"), F.lit(source).alias("source"), meta.alias("raw_metadata"))


def tombstones(df: DataFrame, source: str, deleted_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., repo_url, source, tombstone, deleted_at): rows that mark a record as deleted (PJ13); readers skip them."""
    return df.select(*keep, "repo_url", F.lit(source).alias("source"), F.lit(True).alias("tombstone"), deleted_at.alias("deleted_at"))


def owner_flag(url: Column, host: str, owner: str) -> Column:
    """True if the repository belongs to `owner` (PR8); false for null and foreign addresses."""
    return F.coalesce(F.substring_index(owner_repo(url, host), "/", 1) == owner.lower(), F.lit(False))


def repo_flag(url: Column, host: str, repo: str) -> Column:
    """True if the address leads to the repository `owner/name` (PR9)."""
    return F.coalesce(owner_repo(url, host) == repo.lower(), F.lit(False))


def candidate_paths(name: Column, doc: str = "SKILL.md", layouts: tuple[str, ...] = LAYOUTS, branches: tuple[str, ...] = BRANCHES) -> Column:
    """array<struct<branch, path>>: where a document may be, in the order in which it is looked for (SC39); layouts with a name need one."""
    each = []
    for layout in layouts:
        path = F.replace(F.lit(layout.replace("{doc}", doc)), F.lit("{name}"), name) if "{name}" in layout else F.lit(layout.replace("{doc}", doc))
        each += [F.when(path.isNotNull(), F.struct(F.lit(b).alias("branch"), path.alias("path"))) for b in branches]
    return F.array_compact(F.array(*each))


def first_document(repos: DataFrame, contents: DataFrame, accept: Column | None = None) -> DataFrame:
    """(repo, branch, path, tried): of each repository's candidates the first that has content (SC26, SC39); null, with all that were tried, if none has.

    `repos` has repo and candidates, `contents` repo, path and whatever `accept` looks at. Branches of a recorded content are alike.
    """
    each = repos.select("repo", F.posexplode("candidates").alias("pos", "c")).select("repo", "pos", "c.branch", "c.path")
    there = (contents if accept is None else contents.where(accept)).select("repo", "path").distinct().withColumn("_there", F.lit(True))
    got = each.join(there, ["repo", "path"], "left").groupBy("repo").agg(F.min(F.when(F.col("_there"), F.struct("pos", "branch", "path"))).alias("x"), F.count("*").alias("n"))
    return got.select("repo", "x.branch", "x.path", F.coalesce(F.col("x.pos") + 1, "n").cast("bigint").alias("tried"))


def advance_shards(state: DataFrame | None, counts: DataFrame, overflow: int = OVERFLOW) -> DataFrame:
    """(shard, fetched, runs, exhausted): the state of crawled shards after another run (SM4).

    `counts` has (shard, n) of the run; what a shard gave that the state calls exhausted already is left out, since it isn't asked again. A shard is exhausted
    by a run that gives fewer items than the service could have cut off.
    """
    run = counts.select("shard", F.col("n").alias("_n"))
    if state is None:
        return run.select("shard", F.col("_n").alias("fetched"), F.lit(1).alias("runs"), exhausted(F.col("_n"), overflow).alias("exhausted"))
    both = state.join(run, "shard", "full_outer")
    asked = F.col("_n").isNotNull() & ~F.coalesce("exhausted", F.lit(False))
    return both.select(
        "shard",
        (F.coalesce("fetched", F.lit(0)) + F.when(asked, F.col("_n")).otherwise(0)).alias("fetched"),
        (F.coalesce("runs", F.lit(0)) + asked.cast("int")).alias("runs"),
        F.when(asked, exhausted(F.col("_n"), overflow)).otherwise(F.col("exhausted")).alias("exhausted"),
    )


def update_status(stale: Column, apply: Column, expected: Column, actual: Column, force: Column) -> Column:
    """up_to_date, update_available, updated or error of an installed index (CT10).

    `stale` says whether there is a newer one, `apply` whether it is to be installed; then the hash must be the expected one, without regard to case, and
    a missing expectation is accepted only with `force`.
    """
    fits = F.coalesce(F.lower(expected) == F.lower(actual), force)
    return F.when(~stale & ~force, "up_to_date").when(~apply, "update_available").when(fits, "updated").otherwise("error")
