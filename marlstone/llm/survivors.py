"""Best representative of each duplicate group (problem 1).

Method: iterative truth discovery. Every record claims a value for each field; the support of a value is the
sum of its claimants' source weights, a source's reliability is the mean share of support that its claims have,
and both are recomputed in turn until the reliabilities stay put. The surviving record has the best-supported value of every
field. The record to keep is the group's first in the declared order of preference, which is total and leaves the votes nothing to decide:
they choose values, the order chooses a record.

Groups are never gathered: claims are aggregated by (key, field, value, source) before any further shuffle, so a key that holds
a third of all rows costs as many rows as it has differing claims, spread over all tasks.

Defined cases: records without key belong to no group; null, blank and unusable values are no claims; ties go to the
smallest id, between values to the one claimed by the smallest id; sources compare without case, spaces and punctuation, and a null source is a source of
its own; repeated rows count as further claims of the same source, with falling weight; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.days import utc_day
from marlstone.functions.text import learned_stock_phrases, plain_words, source_key, usable
from marlstone.functions.urls import record_address, spelled_address
from marlstone.session import cut, shared_table, small_rows

#: The reliabilities have settled when none moves by TOLERANCE; a search that hasn't settled after MAX_ROUNDS is an error.
MAX_ROUNDS, TOLERANCE = 60, 0.002
_UNTRUSTED = 2**31 - 1


def trust_of(source: Column, registry: DataFrame, bound: int = 1000) -> Column:
    """The registry's rank of a source (1 is best); sources that aren't in it come after all that are.

    The registry is read to the driver; more than `bound` rows are refused.
    """
    rows = small_rows(registry.groupBy(source_key(F.col("source")).alias("s")).agg(F.min("trust_rank").alias("r")).where("s <> '' and r is not null"), bound)
    if rows is None:
        raise ValueError(f"the source registry has more than {bound} names")
    if not rows:
        return F.lit(_UNTRUSTED)
    ranks = F.create_map(*[F.lit(x) for r in sorted(rows) for x in (r.s, int(r.r))])
    return F.coalesce(F.try_element_at(ranks, source_key(source)), F.lit(_UNTRUSTED))


def discover(claims: DataFrame, prior: DataFrame, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over claims (key, field, value, source, n, first): (supported values, source reliabilities).

    `prior` gives (source, reliability) to begin with; 0.5 where it has none. Values: (key, field, first, support), best ones only.
    Raises RuntimeError if the reliabilities don't settle. A field on which all claims of a key agree supports its sources alike in every round, so such
    claims are summed up a source once; only contested ones are voted on again.
    """
    span = claims.groupBy("key", "field").agg((F.min("value") != F.max("value")).alias("contested"), F.min("first").alias("only"))
    agreed = span.where("not contested")
    disputed = shared_table(claims.join(span.where("contested").select("key", "field"), ["key", "field"], "left_semi"), "claims")
    everything = claims.groupBy("source").agg(F.sum("n").alias("n_all"))
    in_dispute = disputed.groupBy("source").agg(F.sum("n").alias("n_disputed"))
    base = everything.join(in_dispute, "source", "left").select("source", "n_all", (F.col("n_all") - F.coalesce("n_disputed", F.lit(0))).alias("n_agreed"))
    trust = cut(base.join(prior, "source", "left").select("source", "n_all", "n_agreed", F.coalesce("reliability", F.lit(0.5)).alias("reliability")))

    def voted(trust: DataFrame) -> DataFrame:
        w = trust.select("source", (-F.log(1.02 - F.col("reliability"))).alias("w"))
        return disputed.join(w, "source").withColumn("s", F.col("w") * F.log1p("n"))

    moved = None
    for _ in range(max_rounds):
        v = voted(trust)
        value = v.groupBy("key", "field", "value").agg(F.sum("s").alias("support"), F.collect_set(F.struct("source", "n")).alias("by"))
        total = v.groupBy("key", "field").agg(F.sum("s").alias("total"))
        share = value.join(total, ["key", "field"]).select((F.col("support") / F.col("total")).alias("share"), F.explode("by").alias("c"))
        won = share.groupBy("c.source").agg(F.sum(F.col("share") * F.col("c.n")).alias("won"))
        now = F.greatest(F.lit(0.05), F.least(F.lit(0.98), (F.col("n_agreed") + F.coalesce("won", F.lit(0.0))) / F.col("n_all")))
        step = cut(trust.join(won, "source", "left").select("source", "n_all", "n_agreed", now.alias("reliability"), F.abs(now - F.col("reliability")).alias("moved")))
        trust = step.drop("moved")
        moved = step.agg(F.max("moved")).collect()[0][0]
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"the reliabilities still move by {moved} after {max_rounds} rounds")
    values = voted(trust).groupBy("key", "field", "value").agg(F.sum("s").alias("support"), F.min("first").alias("first"))
    best = values.groupBy("key", "field").agg(F.max(F.struct("support", (-F.col("first")).alias("neg"))).alias("m")).select("key", "field", (-F.col("m.neg")).alias("first"), F.col("m.support").alias("support"))
    return best.unionByName(agreed.select("key", "field", F.col("only").alias("first"), F.lit(None).cast("double").alias("support"))), trust.select("source", "reliability")


def resolve_duplicates(records: DataFrame, fields: dict[str, Column], prefer: list[Column], prior: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """One row a key with two or more records: (key, n, first_id, best_id, fused_<field>...), and the source reliabilities.

    `records` has id, key, source and whatever `fields` (value claimed, null for none) and `prefer` (best is largest, nulls
    last) are made of. `fused_<field>` holds the id of the first record that claims the best-supported value, and the support, null where
    all agree.
    """
    names = list(fields)
    r = records.select("id", "key", source_key(F.col("source")).alias("source"), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)]).alias("prefer"), *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"v{i}") for i, c in enumerate(fields.values())])
    r = shared_table(r, "keyed").where("key is not null")
    groups = r.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max(F.struct("prefer", (-F.col("id")).alias("neg"))).alias("top")).where("n > 1")
    groups = shared_table(groups.select("key", "n", "first_id", (-F.col("top.neg")).alias("best_id")), "groups")
    # from here on a group is called by its first id, which is shorter than its key
    claim = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"v{i}").alias("value")) for i in range(len(names))]))
    named = r.drop("prefer").join(groups.select("key", "first_id"), "key").select("id", F.col("first_id").alias("g"), "source", claim.alias("c")).where("c.value is not null")
    claims = shared_table(named.groupBy(F.col("g").alias("key"), F.col("c.field").alias("field"), F.col("c.value").alias("value"), "source").agg(F.count("*").alias("n"), F.min("id").alias("first")), "claims")
    best, trust = discover(claims, prior, **params)
    fused = best.groupBy(F.col("key").alias("first_id")).agg(*[F.max(F.when(F.col("field") == i, F.struct("first", "support"))).alias(f"fused_{k}") for i, k in enumerate(names)])
    return groups.join(fused, "first_id", "left").select("key", "n", "first_id", "best_id", *[f"fused_{k}" for k in names]), trust


def catalog_survivors(skills: DataFrame, renames: DataFrame, registry: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """The operator on crawled skills, grouped by address: (survivors, reliabilities).

    Preferred are, in this order: a usable description, the most trusted source, the latest push day, the longest
    description (code points as stored), the smallest id.
    """
    stock = learned_stock_phrases(skills, "description", "name")
    rank = trust_of(F.col("source"), registry)
    slim = skills.select("rec_id", "repo_url", "source", "description", "raw_metadata")
    keyed = record_address(slim, renames, "key").select(F.col("rec_id").alias("id"), "key", "source", "repo_url", "description", usable(F.col("description"), stock).alias("ok"), rank.alias("rank"), utc_day(F.col("raw_metadata.pushed_at")).alias("day"))
    fields = {
        "repo_url": spelled_address(F.col("repo_url")),
        "source": F.nullif(source_key(F.col("source")), F.lit("")),
        "description": F.when(F.col("ok"), plain_words(F.col("description"))),
    }
    prefer = [F.col("ok"), -F.col("rank"), F.col("day"), F.coalesce(F.length("description"), F.lit(0))]
    prior = registry.groupBy(source_key(F.col("source")).alias("source")).agg((1 - F.min("trust_rank") / 20).alias("reliability"))
    return resolve_duplicates(keyed, fields, prefer, prior, **params)


def surviving_records(skills: DataFrame, survivors: DataFrame) -> DataFrame:
    """The fused record of each group: (address, n_records, best_rec_id, repo_url, source, description) with their supports."""
    fields = ("repo_url", "source", "description")
    # the wanted records are asked for once, each with the fields that are wanted of it
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"fused_{k}.first").alias("rec_id"), F.col(f"fused_{k}.support").alias("support")) for k in fields]))
    wanted = survivors.select("first_id", asked.alias("w")).select("first_id", "w.*").where("rec_id is not null")
    value = F.coalesce(*[F.when(F.col("field") == k, F.col(k)) for k in fields])
    got = wanted.join(skills.select("rec_id", *fields), "rec_id").select("first_id", "field", value.alias("value"), F.round("support", 6).alias("support"))
    flat = got.groupBy("first_id").agg(*[F.max(F.when(F.col("field") == k, F.col(c))).alias(o) for k in fields for c, o in (("value", k), ("support", f"{k}_support"))])
    head = survivors.select("first_id", F.col("key").alias("address"), F.col("n").alias("n_records"), F.col("best_id").alias("best_rec_id"))
    return head.join(flat, "first_id", "left").select("address", "n_records", "best_rec_id", *[c for k in fields for c in (k, f"{k}_support")])
