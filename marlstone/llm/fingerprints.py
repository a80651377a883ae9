"""Word-set classes and their fingerprints, shared by near-duplicate search and history look-up.

A record's text is its set of distinct words, kept as 64-bit hashes. Records with the same set form one class; only one
representative a class is compared further. A fingerprint is made once a class and written: minimum hashes in blocks, of which
equal ones find candidates, and a sketch of 192 single bits of minimum hashes, whose differing bits estimate the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.core import let
from marlstone.functions.text import words
from marlstone.session import shared_table, ship

#: 30 blocks of 6 minimum hashes: a pair at similarity 0.7 shares no block with probability
#: (1 - 0.7^6)^30 = 0.024, one at 0.75 with 0.003, one at 0.8 with 0.0001.
BLOCKS, ROWS = 30, 6
SKETCH_BITS = 192
#: Classes of one block from which it is hot: its classes are paired chunk by chunk, by many tasks.
HOT_BLOCK = 512
#: Pairs that are compared at once.
_AT_ONCE = 1 << 20

#: Columns of a fingerprint beside the names of its class.
FINGERPRINT = "n int, s0 bigint, s1 bigint, s2 bigint, blocks array<bigint>"


def word_set(*texts: Column, words_in: Column, least_words: int) -> Column:
    """struct(k0, k1, hashes) of a row: the sorted hashes of the distinct words of `words_in` and `texts`, and 128 bits that name the set.

    Null for rows with fewer than `least_words` distinct words in `words_in`; null texts have no words.
    """
    hashed = lambda t: F.transform(words(t), lambda x: F.xxhash64(x))
    # sort_array compares numbers in compiled code, array_sort calls a function for each comparison
    enough = let(hashed(words_in), lambda h: F.when(F.size(F.array_distinct(h)) >= least_words, F.sort_array(F.array_distinct(F.concat(h, *map(hashed, texts))))))
    return let(enough, lambda h: F.when(h.isNotNull(), F.struct(F.xxhash64(h).alias("k0"), F.xxhash64(F.lit(1), h).alias("k1"), h.alias("hashes"))))


def word_classes(df: DataFrame, id_col: str, *texts: str, words_in: str, least_words: int) -> DataFrame:
    """(id, k0, k1, hashes): the rows that take part, written once; in Parquet the repeated words are stored as dictionary codes."""
    rest = [F.col(t) for t in texts if t != words_in]
    # exploding a list of none or one keeps the filter from splitting every text a second time
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(word_set(*rest, words_in=F.col(words_in), least_words=least_words)))).alias("w"))
    return shared_table(rows.select("id", "w.*"), "classed")


def class_names(classed: DataFrame) -> DataFrame:
    """(k0, k1, cls, hashes): each class, named by its least id. Copies are summed up before the shuffle."""
    return classed.groupBy("k0", "k1").agg(F.min("id").alias("cls"), F.min_by("hashes", "id").alias("hashes"))


def _mixers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minimum_hashes(values: np.ndarray, starts: np.ndarray, n_hashes: int, seed: int = 11) -> np.ndarray:
    """(n_hashes, sets) minimum hashes of the sets that begin at `starts` in `values` (uint64); no set is empty."""
    mul, add = _mixers(seed, n_hashes)
    v = values ^ (values >> np.uint64(29))
    out = np.empty((n_hashes, len(starts)), np.uint32)
    for i in range(n_hashes):
        out[i] = np.minimum.reduceat(((v * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values (uint64) of a list column and where each list begins and ends."""
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)[off[0] : off[-1]]
    return values, off - off[0]


def fingerprinted(classes: DataFrame, blocks: int = BLOCKS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """The columns of `classes` and FINGERPRINT: number of words, the three parts of the sketch, and the blocks.

    A block holds `rows` minimum hashes and its place among the blocks. The sketch takes one bit of each of 192 minimum hashes, the
    blocks' own ones first, spread evenly; that they are the blocks' makes a pair that shares one look a little more alike, so that
    fewer pairs are dropped. `hashes` must not be empty.
    """
    ship(classes.sparkSession)
    names = classes.columns
    n_hashes = max(blocks * rows, SKETCH_BITS)
    mixed = np.random.default_rng(seed + 2).permutation(n_hashes)[:SKETCH_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _mixers(seed + 1, blocks * rows)
        place = np.arange(64, dtype=np.uint64)[:, None]
        for b in batches:
            if not len(b):
                continue
            values, off = _lists(b.column(names.index("hashes")))
            mins = minimum_hashes(values, off[:-1], n_hashes, seed)
            bits = (mins[mixed] & np.uint32(1)).astype(np.uint64)
            sketch = [(bits[i : i + 64] << place).sum(0, dtype=np.uint64).view(np.int64) for i in (0, 64, 128)]
            keys = np.empty((len(b), blocks), np.uint64)
            for j in range(blocks):
                k = np.full(len(b), (j + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for i in range(j * rows, (j + 1) * rows):
                    k = (k ^ (mins[i].astype(np.uint64) + add[i])) * mul[i]
                    k ^= k >> np.uint64(31)
                # 48 bits are enough: even among 10^9 records chance matches are some 10^5, which the sketches drop at once;
                # the bits left out lie next to other zeros, which compress
                keys[:, j] = k & np.uint64(0xFFFFFFFFFFFF0000)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, blocks, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            own = [pa.array(np.diff(off).astype(np.int32)), *map(pa.array, sketch), lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*names, "n", "s0", "s1", "s2", "blocks"])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{given}, {FINGERPRINT}")


def block_rows(prints: DataFrame) -> DataFrame:
    """(block, sketch, cls): the rotated block table, in which a fingerprint stands once for each block, with that block first."""
    return prints.select(F.explode("blocks").alias("block"), F.col("s0").alias("sketch"), "cls")


def stale(rows: DataFrame) -> DataFrame:
    """Block rows marked as not to be paired with each other: blocks leave their lowest bit free, which is set."""
    return rows.withColumn("block", F.col("block").bitwiseOR(F.lit(1)))


def posterior_bounds(threshold: float, miss: float, batches: tuple[int, ...] = (16, 32, 48, 64)) -> list[tuple[int, int]]:
    """For each number of compared bits the fewest agreeing ones at which a pair stays in.

    Bits of sets with similarity s agree with probability (1 + s) / 2. With a flat prior of s, a
    pair is dropped when its similarity reaches `threshold` with a posterior probability below `miss`.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = (1 + s) / 2
    out = []
    for n in batches:
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        tail = like[:, s >= threshold].sum(1) / like.sum(1)
        out.append((n, int(np.argmax(tail >= miss))))
    return out


def sequential_check(a: Column, b: Column, bounds: list[tuple[int, int]]) -> Column:
    """True for sketches that pass each batch's bound; later batches are looked at only if earlier ones pass."""
    differ = a.bitwiseXOR(b)
    ok = F.lit(True)
    for n, least in bounds:
        part = differ if n == 64 else differ.bitwiseAND(F.lit((1 << n) - 1))
        ok = ok & (F.bit_count(part) <= n - least)
    return ok


def _compared(i: np.ndarray, j: np.ndarray, sketch: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) whose sketches pass each batch's bound, and how many bits differ; a pair that fails a batch isn't looked at again."""
    for n, least in bounds:
        differ = sketch[i] ^ sketch[j]
        count = np.bitwise_count(differ if n == 64 else differ & np.uint64((1 << n) - 1))
        keep = count <= n - least
        i, j = i[keep], j[keep]
    return i, j, np.bitwise_count(sketch[i] ^ sketch[j])


def _pairs_of_runs(first: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of each run, i < j and i fresh, some _AT_ONCE at a time. Fresh rows lead their run."""
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    partners = np.where(fresh[at], np.repeat(first + size, size) - at - 1, 0)
    bounds = np.cumsum(partners)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        n = partners[lo:hi]
        i = np.repeat(at[lo:hi], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def candidate_pairs(rows: DataFrame, bounds: list[tuple[int, int]], hot: int = HOT_BLOCK) -> DataFrame:
    """(a, b, differ), a < b: the pairs of classes, not both stale, that share a block and whose sketches pass; differ counts
    their differing bits. A pair may come more than once.

    One shuffle by block; each task reads its sorted blocks once, and skips those of one class. Blocks of `hot` classes or more aren't
    paired there: their rows are handed on in chunks of `hot`, and every two chunks of a block are compared by a task of their own.
    The result is a written table.
    """
    ship(rows.sparkSession)
    # one sort by one number: a block's fresh rows come before its others
    laid = rows.repartition(F.shiftright("block", 1)).sortWithinPartitions("block")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("differ", pa.int8()), ("block", pa.int64()), ("slot", pa.int64())])

    def handed(block: int, sketch: np.ndarray, cls: np.ndarray, fresh: np.ndarray, before: int) -> pa.RecordBatch:
        """Rows of a hot block: the class as a, its sketch as b, and whether it is fresh as differ."""
        n = len(cls)
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(sketch.view(np.int64)), pa.array(fresh.astype(np.int8)), pa.array(np.full(n, block)), pa.array((before + np.arange(n)) // hot)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        open_, seen = None, 0  # the hot block that is being handed on, and how many of its rows were
        end = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["block", "sketch", "cls"])
        for last, b in _with_end(batches, end):
            raw = b.column(0).to_numpy()
            cols = [raw & ~1, (raw & 1) == 0, b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()]
            block, fresh, sketch, cls = (np.concatenate(x) for x in zip(kept, cols))
            if open_ is not None:
                n = int(np.searchsorted(block, open_, "right"))
                if n:
                    yield handed(open_, sketch[:n], cls[:n], fresh[:n], seen)
                    seen += n
                if n < len(block):
                    open_, seen = None, 0
                block, fresh, sketch, cls = block[n:], fresh[n:], sketch[n:], cls[n:]
            first = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)) if len(block) else np.zeros(0, np.int64)
            size = np.diff(first, append=len(block))
            # the last block may go on in the next batch
            done = len(first) if last else max(0, len(first) - 1)
            cut = len(block) if last or not len(first) else int(first[-1])
            for f, n in zip(first[:done][size[:done] >= hot].tolist(), size[:done][size[:done] >= hot].tolist()):
                yield handed(int(block[f]), sketch[f : f + n], cls[f : f + n], fresh[f : f + n], 0)
            some = (size[:done] > 1) & (size[:done] < hot)
            for i, j in _pairs_of_runs(first[:done][some], size[:done][some], fresh):
                i, j, differ = _compared(i, j, sketch, bounds)
                if len(i):
                    x, y = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
                    # most pairs share several blocks, some of them in this batch
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    none = [pa.nulls(int(new.sum()), pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(differ[order][new].astype(np.int8)), *none], schema=schema)
            if len(block) - cut >= hot:
                open_, seen = int(block[cut]), len(block) - cut
                yield handed(open_, sketch[cut:], cls[cut:], fresh[cut:], 0)
                cut = len(block)
            kept = [block[cut:], fresh[cut:], sketch[cut:], cls[cut:]]

    found = shared_table(laid.mapInArrow(run, "a bigint, b bigint, differ tinyint, block bigint, slot bigint"), "candidates")
    pairs = found.where("block is null").select("a", "b", "differ").unionByName(_hot_pairs(found.where("block is not null"), bounds))
    pairs._marlstone_path = found._marlstone_path
    return pairs


def _with_end(batches: Iterator[pa.RecordBatch], end: pa.RecordBatch) -> Iterator[tuple[bool, pa.RecordBatch]]:
    for b in batches:
        yield False, b
    yield True, end


def _hot_pairs(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs of hot blocks, whose rows have the class as a, its sketch as b, and whether it is fresh as differ: chunk against chunk, spread over the tasks."""
    row = F.struct(F.col("b").alias("sketch"), F.col("a").alias("cls"), (F.col("differ") == 1).alias("fresh"))
    chunks = rows.groupBy("block", "slot").agg(F.collect_list(row).alias("c"), (F.max("differ") == 1).alias("any"))
    side = lambda s: chunks.select("block", *[F.col(k).alias(f"{k}{s}") for k in ("slot", "c", "any")])
    both = side(1).join(side(2), "block").where("slot1 <= slot2 and (any1 or any2)")
    spread = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "slot1", "slot2")
    one = spread.select((F.col("slot1") == F.col("slot2")).alias("same"), F.explode("c1").alias("x"), "c2")
    two = one.select("same", "x", F.explode("c2").alias("y")).where("(not same or x.cls < y.cls) and (x.fresh or y.fresh)")
    close = two.where(sequential_check(F.col("x.sketch"), F.col("y.sketch"), bounds))
    return close.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))).cast("tinyint").alias("differ"))


def pruned_pairs(pairs: DataFrame, prints: DataFrame, threshold: float, bounds: list[tuple[int, int]]) -> DataFrame:
    """(a, b): the distinct candidates whose sizes allow the threshold and that also pass the later batches.

    `bounds` are for 128 and 192 bits in all, the first 64 of which the candidates have been compared on.
    """
    side = lambda c: prints.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("s1").alias(f"{c}1"), F.col("s2").alias(f"{c}2"))
    # equal pairs lie together by a, as the join needs them
    two = pairs.repartition("a").distinct().join(side("a"), "a").join(side("b"), "b")
    second = F.col("differ") + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    third = second + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    least = dict(bounds)
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    return two.where(fits & (second <= 128 - least[128]) & (third <= 192 - least[192])).select("a", "b")


def verified_pairs(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the pairs whose word sets have at least `threshold` of their union in common."""
    one = pairs.join(prints.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(prints.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    got = two.select("a", "b", (F.size("ha") + F.size("hb")).alias("t"), both.alias("i"))
    return got.where(F.col("i") >= threshold * (F.col("t") - F.col("i")) - 1e-9).select("a", "b", (F.col("i") / (F.col("t") - F.col("i"))).alias("similarity"))
