"""Deduplicating each new batch against all history (problem 6).

Method: bit-difference fingerprints in rotated block tables. Each class of equal word sets has a fingerprint, which stands
in the block table once for each of its blocks; an exact block match finds candidates, the bit difference of the sketches (single bits of minimum
hashes, 64 first, then 128 and 192) prunes them, the word sets themselves verify them, and the new fingerprints are appended.
64 plain bits in blocks can't find pairs at similarity 0.7, which differ in some ten bits, so a block consists of six minimum
hashes instead of a run of the sketch's bits.

Addresses are looked up in a table of (address, load), which holds one row however many records an address has.

Defined cases: a record without address matches no address and counts as having another address than any partner; a
missing or unreadable day is earlier than any other; null texts have no words; an empty table gives an empty
result; repeated rows with ids of their own are records of their own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.days import utc_day
from marlstone.functions.urls import record_address
from marlstone.llm import fingerprints as fp
from marlstone.llm.neardup import LEAST_WORDS, THRESHOLD
from marlstone.session import forget, shared_folder, shared_table, write_table

#: Most differing bits among the first 64, 128 and 192; a pair at the threshold exceeds each with probability 0.001 or so.
MOST_DIFFERENT_BITS = (19, 32, 45)
_NEVER = -(2**31)


def catalog_records(df: DataFrame, renames: DataFrame | None) -> DataFrame:
    """(id, load, address, day, name, description) of crawled records; day in days since 1970."""
    day = F.coalesce(F.datediff(utc_day(F.col("raw_metadata.pushed_at")), F.lit("1970-01-01").cast("date")), F.lit(_NEVER))
    return record_address(df, renames).select(F.col("rec_id").alias("id"), F.col("load_no").cast("bigint").alias("load"), "address", day.alias("day"), "name", "description")


def _known_before(rows: DataFrame) -> DataFrame:
    """(address, load, latest, prior): for each address and load what earlier loads hold, from (address, load, day, first); null where they hold nothing."""
    w = W.partitionBy("address").orderBy("load").rangeBetween(W.unboundedPreceding, -1)
    return rows.select("address", "load", F.max("day").over(w).alias("latest"), F.min("first").over(w).alias("prior"))


def _two_least(rows: DataFrame) -> DataFrame:
    """Of (cls, load, tag, first), with one row a tag, the two with the least `first` of each class and load."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("cls", "load").orderBy("first", "tag"))).where("place <= 2").drop("place")


def _partners(mine: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, prior): records of `mine` with a partner at another address in an earlier load; prior is the least such partner.

    `members` has (cls, load, tag, first), a tag being an address or, without one, a record. Of each class and load it has the two least partners with
    differing tags, which are enough to answer for any address, so nothing grows with the square of a class.
    """
    to = links.select(F.col("a").alias("o"), F.col("b").alias("cls")).unionByName(links.select(F.col("b").alias("o"), F.col("a").alias("cls")))
    near = to.join(members.withColumnRenamed("cls", "o"), "o").select("cls", F.col("load").alias("was"), "tag", "first").unionByName(members.withColumnRenamed("load", "was"))
    probe = mine.where("cls is not null").select("cls", "load").distinct()
    found = near.join(probe, "cls").where("was < load").groupBy("cls", "load", "tag").agg(F.min("first").alias("first"))
    answers = _two_least(found).groupBy("cls", "load").agg(F.min(F.struct("first", "tag")).alias("x"), F.max("first").alias("y"))
    other = F.when(~F.col("x.tag").eqNullSafe(F.col("address")), F.col("x.first")).otherwise(F.when(F.col("y") > F.col("x.first"), F.col("y")))
    return mine.join(answers, ["cls", "load"]).select("id", other.alias("prior")).where("prior is not null")


def nothing_new(records: DataFrame, **params) -> DataFrame:
    """(prior_rec_id, rec_id): the records of all loads that bring nothing new against the loads before theirs, by an index made for the purpose."""
    return HistoryIndex(records.sparkSession, shared_folder(records.sparkSession, "history")).check_loads(records, **params)


class HistoryIndex:
    """Everything accepted so far, in a folder that all executors share.

    Tables: `prints` (k0, k1, cls, hashes and the fingerprint of each class of equal word sets, with its rotated blocks), `links` (a, b),
    `addresses` (address, load, day, first), `members` (cls, load, tag, first: the two least of each class and load). Fingerprints are made of new classes only. Of the history a batch scans the
    narrow columns that it looks up (names, blocks, addresses), which a small batch is sent to instead of their being shuffled; everything else is
    first reduced to the classes and addresses that were hit.

    A batch that failed half-way may be checked again: rows are written under the batch's greatest load number, which a second run overwrites.
    """

    TABLES = {
        "addresses": "address binary, load bigint, day int, first bigint, batch bigint",
        "prints": f"k0 bigint, k1 bigint, cls bigint, hashes array<bigint>, {fp.FINGERPRINT}, batch bigint",
        "links": "a bigint, b bigint, batch bigint",
        "members": "cls bigint, load bigint, tag binary, first bigint, batch bigint",
    }

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, batch: int, own: bool = False) -> DataFrame | None:
        """The batch's own rows, or those of all other batches; None if there are none to read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
        mine = f"batch={batch}"
        if not (mine in there if own else any(x.startswith("batch=") and x != mine for x in there)):
            return self.spark.createDataFrame([], self.TABLES[name]).drop("batch") if own else None
        got = self.spark.read.schema(self.TABLES[name]).parquet(f"{self.folder}/{name}")
        return got.where(F.col("batch") == batch if own else F.col("batch") != batch).drop("batch")

    def _write(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        writer = df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option("compression", "zstd")
        write_table(writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch"), self.spark, f"{self.folder}/{name}")
        return self._read(name, batch, own=True)

    def check(self, records: DataFrame, **params) -> DataFrame:
        """(prior_rec_id, rec_id) for one batch (one load number) against what was appended before; then appends the batch."""
        if len(records.select("load").distinct().limit(2).collect()) > 1:
            raise ValueError("one batch has one load number")
        return self.check_loads(records, **params)

    def check_loads(self, records: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, most_bits: tuple[int, int, int] = MOST_DIFFERENT_BITS) -> DataFrame:
        """The same for a batch of any number of loads, each checked against the history and the batch's loads before it."""
        batch = records.agg(F.max("load")).collect()[0][0]
        if batch is None:
            return self.spark.createDataFrame([], "prior_rec_id bigint, rec_id bigint")
        words = fp.word_set(F.col("name"), words_in=F.col("description"), least_words=least_words).alias("w")
        # an address is its 16-byte digest from here on, which is a quarter of its length
        stored = shared_table(records.select("id", "load", F.unhex(F.md5("address")).alias("address"), "day", words), "records")
        given = stored.select("id", "load", "address", "day", "w.*")
        old = {t: self._read(t, batch) for t in self.TABLES}

        names = fp.class_names(given.where("k0 is not null"))
        known = None
        if old["prints"] is not None:
            names = shared_table(names, "names")
            known = shared_table(names.select("k0", "k1").join(old["prints"].select("k0", "k1", "cls"), ["k0", "k1"]), "known")
            names = names.join(known.select("k0", "k1"), ["k0", "k1"], "left_anti")
        prints = self._write("prints", fp.fingerprinted(names), batch)
        of = prints.select("k0", "k1", "cls")
        own = given.drop("hashes")
        with_class = own.where("k0 is not null").join(of if known is None else of.unionByName(known), ["k0", "k1"])
        without = own.where("k0 is null").withColumn("cls", F.lit(None).cast("bigint"))
        mine = shared_table(with_class.unionByName(without).select("id", "load", "address", "day", "cls"), "mine")
        forget(stored)

        links = self._write("links", self._links(prints, old["prints"], threshold, most_bits), batch)
        seen = self._write("addresses", mine.where("address is not null").groupBy("address", "load").agg(F.max("day").alias("day"), F.min("id").alias("first")), batch)
        tag = F.coalesce("address", F.col("id").cast("string").cast("binary"))
        members = self._write("members", _two_least(mine.where("cls is not null").groupBy("cls", "load", tag.alias("tag")).agg(F.min("id").alias("first"))), batch)

        # of the history only what the batch's addresses and classes, and the classes linked to those, lead to
        if old["addresses"] is not None:
            seen = seen.unionByName(old["addresses"].join(seen.select("address").distinct(), "address", "left_semi"))
        if known is not None:
            if old["links"] is not None:
                hit = known.select("cls")
                links = links.unionByName(old["links"].join(hit.withColumnRenamed("cls", "a"), "a", "left_semi")).unionByName(old["links"].join(hit.withColumnRenamed("cls", "b"), "b", "left_semi")).distinct()
            touched = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).unionByName(known.select("cls")).distinct()
            members = members.unionByName(old["members"].join(touched, "cls", "left_semi"))
        before = _known_before(seen).where("latest is not null")
        again = mine.join(before, ["address", "load"]).where("day <= latest").select("id", "prior")
        got = again.unionByName(_partners(mine, members, links)).groupBy("id").agg(F.min("prior").alias("prior"))
        return shared_table(got.select(F.col("prior").alias("prior_rec_id"), F.col("id").alias("rec_id")), "nothing_new")

    @staticmethod
    def _links(prints: DataFrame, old: DataFrame | None, threshold: float, most_bits: tuple[int, int, int]) -> DataFrame:
        """(a, b) of the new classes, among themselves and with the old ones."""
        rows = fp.block_rows(prints)
        if old is not None:
            probe = rows.select("block").distinct()
            rows = rows.unionByName(fp.stale(fp.block_rows(old).join(probe, "block", "left_semi")))
        pairs = fp.candidate_pairs(rows, [(64, 64 - most_bits[0])])
        if old is not None:
            hit = shared_table(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "hit")
            prints = prints.unionByName(old.join(hit, "cls", "left_semi"))
        pruned = fp.pruned_pairs(pairs, prints, threshold, [(128, 128 - most_bits[1]), (192, 192 - most_bits[2])])
        return fp.verified_pairs(pruned, prints, threshold).select("a", "b")
