"""Filling containers of fixed capacity with items (problem 8).

Method: non-negative least squares. Shallow combinations of lengths that fill a window below the capacity are
enumerated, the least-squares repeat counts against the histogram of lengths are found under the condition that none is negative,
rounded down, and what they leave is packed greedily.

Only the histogram reaches the driver: at most `capacity` lengths, however many items there are. The plan is a table of runs: of
length n, the items of rank a to b go to the containers from c on, k to each. Items find their run by their rank
among the items of their length, which is counted in hashed parts, so that a length which a third of all items have is no bottleneck.

Defined cases: null, empty and blank-token texts have 0 tokens and go to container 0 without filling it; an item longer
than the capacity is cut into full containers and a rest, which is packed like an item; no other item is cut; ties are in the order of ids; repeated
rows are items of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.bpe import PATTERN, TOKENIZER_DIR, vocabulary
from marlstone.session import shared_table, small_rows

#: Combinations have up to this many lengths and leave at most this share of the capacity unused.
DEPTH, WINDOW = 4, 0.01
#: Combinations that begin with each length, and how many lengths are tried after one.
EACH, BRANCHES = 6, 8
ROUNDS, TOLERANCE = 4_000, 0.01
RANK_PARTS = 64
MOST_SPECS = 1_000


def token_counts(docs: DataFrame, tokenizers: list[str], id_col: str, text: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, n array<int>): the tokens of each text by each tokenizer, without special tokens."""

    def counter(name: str):
        import os

        if os.path.exists(f"{folder}/{name}.tiktoken"):
            import tiktoken

            enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=vocabulary(name, folder), special_tokens={})
            return lambda ts: [len(enc.encode_ordinary(t)) for t in ts]
        if os.path.exists(f"{folder}/{name}.model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
            return lambda ts: [len(x) for x in sp.encode(ts, num_threads=1)]
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{folder}/{name}.json")
        tok.encode_special_tokens = True
        return lambda ts: [len(x.ids) for x in tok.encode_batch(ts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(n) for n in tokenizers]
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ns = [c(texts) for c in count]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(x) for x in zip(*ns)], pa.list_(pa.int32()))], names=["id", "n"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, "id bigint, n array<int>")


def combinations(hist: np.ndarray, capacity: int, depth: int = DEPTH, window: float = WINDOW, each: int = EACH) -> list[tuple[int, ...]]:
    """Distinct multisets of lengths that occur, each filling capacity - window to capacity: the first `each` that begin with each length.

    They are enumerated depth first: after the length that closes the gap come BRANCHES others that fit, evenly spread over the items, each length
    beginning with another one. A multiset has `depth` items; four times as many where a length is so small that `depth` of it don't fill a container.
    """
    lengths = np.flatnonzero(hist)
    known = lengths[lengths > 0].tolist()
    mass = np.cumsum(hist[known]) if known else np.zeros(0)
    slack = int(window * capacity)

    def grow(combo: list[int], room: int, left: int, turn: int) -> Iterator[tuple[int, ...]]:
        if room <= slack:
            yield tuple(sorted(combo, reverse=True))
            return
        i = bisect.bisect_right(known, room) - 1
        if i < 0 or not left:
            return
        if known[i] >= room - slack:
            yield tuple(sorted([*combo, known[i]], reverse=True))
        if left > 1:
            at = np.searchsorted(mass, mass[i] * ((np.arange(BRANCHES) + turn % BRANCHES + 0.5) % BRANCHES) / BRANCHES)
            for j in dict.fromkeys(at.tolist()):
                yield from grow([*combo, known[j]], room - known[j], left - 1, turn + 1)

    out: dict[tuple[int, ...], None] = {}
    for turn, first in enumerate(known):
        some = grow([first], capacity - first, (depth * 4 if first * depth < capacity else depth) - 1, turn)
        out.update(dict.fromkeys(itertools.islice(some, each)))
    return list(out)


def repeat_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Non-negative x with least |A x - hist|^2, by projected gradients with momentum; column j of A counts the lengths of pattern j.

    Ends when the residual falls by less than `tolerance` of itself in 50 steps, or after `rounds` steps: what the counts miss is packed greedily
    afterwards, so an early end costs space and nothing else.
    """
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = hist.astype(float)
    share = np.bincount(rows, minlength=len(h))
    # a step that is safe for every coordinate: row sums bound the curvature
    step = 1.0 / np.maximum(np.bincount(cols, share[rows], len(patterns)), 1.0)
    x = y = np.zeros(len(patterns))
    t, before = 1.0, np.inf
    for k in range(rounds):
        left = np.bincount(rows, y[cols], len(h)) - h
        grad = np.bincount(cols, left[rows], len(patterns))
        new = np.maximum(0.0, y - step * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = np.maximum(0.0, new + (t - 1) / t2 * (new - x)), new, t2
        if k % 50 == 49:
            now = float(((np.bincount(rows, x[cols], len(h)) - h) ** 2).sum())
            if now > (1 - tolerance) * before:
                break
            before = now
    return x


def pack(hist: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, items, first container, items of that length in each container); ranks from 0.

    `hist[n]` counts the items of n tokens, 1 <= n <= capacity.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    box = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal box
        for n in sorted(set(pattern), reverse=True):
            k = pattern.count(n)
            runs.append((n, int(used[n]), k * times, box, k))
            used[n] += k * times
            left[n] -= k * times
        box += times

    patterns = combinations(left, capacity)
    if patterns:
        x = repeat_counts(patterns, left)
        for j in np.argsort(-x, kind="stable"):
            p = patterns[j]
            times = min(int(x[j] + 1e-9), *(int(left[n]) // p.count(n) for n in set(p)))
            if times > 0:
                place(p, times)
    # what rounding leaves: the longest first, each container filled with the longest items that still fit; equal containers in one go
    some = np.flatnonzero(left).tolist()
    while some:
        combo, room, have = [], capacity, {}
        i = len(some) - 1
        while i >= 0 and room > 0:
            n = some[i]
            k = min(room // n, int(left[n]))
            if k:
                combo += [n] * k
                have[n] = k
                room -= n * k
            i = min(i - 1, bisect.bisect_right(some, room) - 1)
        place(tuple(combo), min(int(left[n]) // k for n, k in have.items()))
        some = [n for n in some if left[n]]
    return runs


def ranks_within(items: DataFrame, by: list[str], order: str, parts: int = RANK_PARTS) -> DataFrame:
    """Adds `rank`: the place from 0 of each row among those with equal `by`, without gathering a group: parts are ranked apart and shifted."""
    split = items.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    sizes = split.groupBy(*by, "_part").agg(F.count("*").alias("_m"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    own = split.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_part").orderBy(order)) - 1)
    return own.join(shift, [*by, "_part"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def fill_containers(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(spec_id, id_col, part_no, start_token, n_tokens, container_id): every item, or part of an item beyond the capacity, in its container.

    `specs` has spec_id, capacity and tokenizer; specs without capacity above 0 or tokenizer are left out. They are read to
    the driver; more than MOST_SPECS are refused.
    """
    wanted = small_rows(specs.where("spec_id is not null and capacity > 0 and tokenizer is not null").select("spec_id", "capacity", "tokenizer"), MOST_SPECS)
    if wanted is None:
        raise ValueError(f"more than {MOST_SPECS} pack specs")
    wanted.sort()
    if not wanted:
        return docs.sparkSession.createDataFrame([], f"spec_id int, {id_col} bigint, part_no int, start_token int, n_tokens int, container_id bigint")
    names = sorted({s.tokenizer for s in wanted})
    counts = shared_table(token_counts(docs, names, id_col, text, folder), "counts")
    per_spec = F.array(*[F.struct(F.lit(int(s.spec_id)).alias("spec_id"), F.lit(int(s.capacity)).alias("cap"), F.col("n")[names.index(s.tokenizer)].alias("total")) for s in wanted])
    items = counts.select("id", F.explode(per_spec).alias("s")).select("id", "s.*")
    whole = F.floor(F.col("total") / F.col("cap"))
    rest = items.select("spec_id", "id", "cap", "total", (F.col("total") - whole * F.col("cap")).cast("int").alias("len"), whole.cast("int").alias("full"))
    hist: dict[int, np.ndarray] = {int(s.spec_id): np.zeros(int(s.capacity) + 1, np.int64) for s in wanted}
    full = dict.fromkeys(hist, 0)
    for r in rest.groupBy("spec_id", "len").agg(F.count("*").alias("m"), F.sum("full").alias("f")).collect():  # at most capacity lengths a spec
        hist[r.spec_id][r.len] = r.m
        full[r.spec_id] += r.f
    runs = [(k, *x) for k, h in hist.items() for x in pack(h, len(h) - 1)]
    spark = docs.sparkSession
    plan = spark.createDataFrame(runs, "spec_id int, len int, first bigint, items bigint, box bigint, each int") if runs else spark.createDataFrame([], "spec_id int, len int, first bigint, items bigint, box bigint, each int")
    # one row a length: its runs in the order of ranks
    table = plan.groupBy("spec_id", "len").agg(F.array_sort(F.collect_list(F.struct("first", "items", "box", "each"))).alias("runs"))
    boxes = {k: max([x[4] + -(-x[3] // x[5]) for x in runs if x[0] == k], default=0) for k in hist}
    ranked = ranks_within(rest.where("len > 0").select("spec_id", "id", "len", "full", "cap"), ["spec_id", "len"], "id")
    hit = F.filter("runs", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") < x["first"] + x["items"]))[0]
    tails = ranked.join(table, ["spec_id", "len"]).withColumn("h", hit).select("spec_id", F.col("id").alias(id_col), (F.col("full") + 1).alias("part_no"), (F.col("full") * F.col("cap")).alias("start_token"), F.col("len").alias("n_tokens"), (F.col("h.box") + F.floor((F.col("rank") - F.col("h.first")) / F.col("h.each"))).alias("container_id"))
    base = F.create_map(*[F.lit(x) for k in sorted(boxes) for x in (k, int(boxes[k]))])
    nothing = rest.where("total = 0").select("spec_id", F.col("id").alias(id_col), F.lit(1).alias("part_no"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"), F.lit(0).cast("bigint").alias("container_id"))
    # full containers of cut items follow the packed ones, numbered by hashed parts too
    cut = rest.where("full > 0").select("spec_id", "id", "full", "cap")
    share = cut.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)))
    sizes = share.groupBy("spec_id", "_part").agg(F.sum("full").alias("_m"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(W.partitionBy("spec_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    own = F.coalesce(F.sum("full").over(W.partitionBy("spec_id", "_part").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = share.withColumn("_own", own).join(shift, ["spec_id", "_part"]).select("spec_id", "id", "cap", (F.try_element_at(base, F.col("spec_id")) + F.col("_before") + F.col("_own")).alias("from"), F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("p", "part_no"))
    heads = placed.select("spec_id", F.col("id").alias(id_col), "part_no", (F.col("p") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"), (F.col("from") + F.col("p")).alias("container_id"))
    return tails.unionByName(heads).unionByName(nothing)
