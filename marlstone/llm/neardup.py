"""Near-duplicate records with small edits (problem 5).

Method: sequential Bayesian verification. Banded minimum hashes give candidates; their sketches are
compared batch by batch, and a pair is dropped as soon as the posterior probability of reaching
the threshold falls below the miss probability; survivors are verified on their exact word sets.

Defined cases: null texts have no words; records with fewer than `least_words` distinct words in the
description take no part; word order, case and repeated words don't matter; records with the same words
form one class; ids are expected to be unique, repeated ids count once; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import fingerprints as fp
from marlstone.session import cut, forget, shared_table

THRESHOLD, LEAST_WORDS, MISS = 0.7, 12, 0.001
#: Rounds after which the search for components gives up with an error.
MAX_ROUNDS = 50
#: Records of a class are paired in chunks of about this many, so that the pairs of a large class are made by many tasks.
CHUNK = 256


def similar_classes(df: DataFrame, id_col: str = "rec_id", name: str = "name", text: str = "description", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) of each record that takes part; (a, b, similarity) of linked classes, a < b."""
    classed = fp.word_classes(df, id_col, name, text, words_in=text, least_words=least_words)
    prints = shared_table(fp.fingerprinted(fp.class_names(classed)), "prints")
    members = shared_table(classed.select("id", "k0", "k1").distinct().join(prints.select("k0", "k1", "cls"), ["k0", "k1"]).select("id", "cls"), "members")
    forget(classed)
    candidates = fp.candidate_pairs(fp.block_rows(prints), fp.posterior_bounds(threshold, miss))
    pairs = fp.pruned_pairs(candidates, prints, threshold, fp.posterior_bounds(threshold, miss, (128, 192)))
    links = shared_table(fp.verified_pairs(pairs, prints, threshold), "links")
    forget(prints)
    forget(candidates)
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame, full_class: int | None = None) -> DataFrame:
    """(rec_id_a, rec_id_b): all pairs of records behind linked classes and within classes, whatever their sizes.

    With `full_class`, a compact form that leaves pairs out: of a class beyond that many records only the representative is paired with others.
    """
    sized = members.join(members.groupBy("cls").agg(F.count("*").alias("m")), "cls")
    star = None
    if full_class is not None:
        beyond = (F.col("m") > full_class) & (F.col("id") != F.col("cls"))
        star = sized.where(beyond).select(F.col("cls").alias("rec_id_a"), F.col("id").alias("rec_id_b"))
        sized = sized.where(~beyond)
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / CHUNK))
    chunks = sized.groupBy("cls", slot.alias("slot")).agg(F.collect_list("id").alias("ids"), F.first("m").alias("m"))
    side = lambda c: chunks.select(F.col("cls").alias(c), F.col("slot").alias(f"s{c}"), F.col("ids").alias(f"i{c}"))
    across = links.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    many = chunks.where("m > 1").select(F.col("cls").alias("a"), F.col("slot").alias("sa"), F.col("ids").alias("ia"))
    within = many.join(many.select("a", F.col("sa").alias("sb"), F.col("ia").alias("ib")), "a").where("sa <= sb").withColumn("b", F.col("a"))
    # a fixed number of partitions, since pairs of chunks are small but what comes out of them is not
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = across.unionByName(within).repartition(n, "a", "sa", "b", "sb")
    first = blocks.select((F.col("a") == F.col("b")) & (F.col("sa") == F.col("sb")), F.explode("ia").alias("x"), "ib").toDF("same", "x", "ib")
    pairs = first.select("same", "x", F.explode("ib").alias("y")).where("not same or x < y").select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))
    return pairs if star is None else pairs.unionByName(star)


def near_duplicate_pairs(df: DataFrame, **params) -> DataFrame:
    """(rec_id_a, rec_id_b), a < b: the pairs of records at or above the threshold."""
    members, links = similar_classes(df, **params)
    return expand_pairs(members, links)


def connected_components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(u, g): every class of the links (a, b) with the least class of its component.

    Each round a class takes the least of its label, its label's label and its neighbours' labels' labels, and writes the neighbours' least to
    the class its label names, so that basins that meet are joined at their roots. Labels only fall; once a round changes none, linked classes have the
    same label. Raises RuntimeError if `max_rounds` rounds don't suffice.
    """
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("g")))
    for _ in range(max_rounds):
        grand = label.join(label.select(F.col("u").alias("g"), F.col("g").alias("gg")), "g")
        near = both.join(grand.select(F.col("u").alias("v"), "gg"), "v").groupBy("u").agg(F.min("gg").alias("near"))
        own = F.struct("u", F.least("gg", "near").alias("g"), F.col("g").alias("was"))
        root = F.struct(F.col("g").alias("u"), F.col("near").alias("g"), F.lit(None).cast(label.schema["g"].dataType).alias("was"))
        told = grand.join(near, "u").select(F.explode(F.array(own, root)).alias("x")).select("x.*")
        nxt = cut(told.groupBy("u").agg(F.min("g").alias("g"), F.max("was").alias("was")))
        label = nxt.select("u", "g")
        if nxt.where("g <> was").limit(1).count() == 0:
            return label
    raise RuntimeError(f"the groups are not settled after {max_rounds} rounds")


def near_duplicate_groups(df: DataFrame, max_rounds: int = MAX_ROUNDS, **params) -> DataFrame:
    """(rec_id, class_id, group_id, n_links): groups are the connected components of the links.

    group_id is the least class of the component; n_links is the number of classes linked to the record's.
    """
    members, links = similar_classes(df, **params)
    label = connected_components(links, max_rounds)
    ends = links.select(F.col("a").alias("u")).unionByName(links.select(F.col("b").alias("u")))
    degree = ends.groupBy("u").agg(F.count("*").alias("n_links"))
    info = label.join(degree, "u").withColumnRenamed("u", "cls")
    return members.join(info, "cls", "left").select(F.col("id").alias("rec_id"), F.col("cls").alias("class_id"), F.coalesce("g", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
