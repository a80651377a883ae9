"""Vector search: exact, 8-bit scalar-quantized and inverted-list top k with post-filters (TK1-TK5, TK8, TK9, AG12, AG13, PR4, PJ15).

Queries are taken in blocks of at most QUERY_BLOCK vectors, which bounds what is broadcast; each task scores its Arrow batches with one matrix
product and keeps its best k a query, and the few kept rows are merged by a window. Scores are summed up in doubles and rounded to six places, ties go to the
smaller id, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.session import hash_sample, shared_folder, ship, write_table

QUERY_BLOCK = 2_048
#: Rows from which an index is built with inverted lists, and how many there are.
IVF_ROWS, IVF_LISTS = 30_000, 256
TRAIN_ROWS = 20_000
#: The lists that are probed are as many as keep this share of the nearest PROBE_K rows (what a catalog search fetches) of PROBE_QUERIES sampled rows.
PROBE_RECALL, PROBE_K, PROBE_QUERIES = 0.95, 60, 500


def l2_norm(v: Column) -> Column:
    """The Euclidean length, summed up in doubles."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def clamp_score(s: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best columns of each row; equal scores by the smaller id."""
    k = min(k, scores.shape[1])
    if not k or not len(scores):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # only what can be among the k best after rounding is sorted
    least = np.partition(scores, -k, axis=1)[:, -k]
    row, col = np.nonzero(scores >= (least - 2e-6)[:, None])
    score, hit = np.round(scores[row, col], 6), ids[col]
    order = np.lexsort((hit, -score, row))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = order[place < k]
    return row[best], hit[best], score[best]


def _blocks(queries: DataFrame, id_col: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in blocks, in the order of their ids; one block at a time is on the driver."""
    last = None
    while True:
        rest = queries if last is None else queries.where(F.col(id_col) > last)
        got = rest.select(id_col, vector).where(F.col(vector).isNotNull()).orderBy(id_col).limit(QUERY_BLOCK).collect()
        if not got:
            return
        yield np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
        last = got[-1][0]
        if len(got) < QUERY_BLOCK:
            return


_HITS = "query_id bigint, id bigint, score double"


def _merge(parts: Iterable[DataFrame], k: int, spark) -> DataFrame:
    """The k best hits of each query. A block's hits are written before the next block is read, so that plans and broadcasts don't add up."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    path, last = None, None
    for hits in parts:
        if last is not None:
            path = path or shared_folder(spark, "hits")
            write_table(last.write.mode("append"), spark, path)
        last = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    if last is None:
        return spark.createDataFrame([], _HITS + ", rank int")
    if path is None:
        return last
    write_table(last.write.mode("append"), spark, path)
    return spark.read.schema(last.schema).parquet(path)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k rows with the greatest inner product of each query. Null vectors take no part."""
    ship(vectors.sparkSession)
    rows = vectors.select(id_col, vector).where(F.col(vector).isNotNull())

    def parts() -> Iterator[DataFrame]:
        for ids, q in _blocks(queries, id_col, vector):
            shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

            def run(batches, shared=shared):
                ids, q = shared.value
                for b in batches:
                    if len(b):
                        i, hit, s = _best(q @ _matrix(b.column(1)).astype(np.float64).T, b.column(0).to_numpy(), k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(hit), pa.array(s)], names=["query_id", "id", "score"])

            yield rows.mapInArrow(run, _HITS)

    return _merge(parts(), k, vectors.sparkSession)


def ranges(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, lo, hi): least and greatest value of each dimension (AG13)."""
    return vectors.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))


class ScalarQuantizer:
    """Codes of 8 bits a dimension: floor(255 * (x - lo) / (hi - lo)), read back at the middle of their step."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.span = lo, hi - lo

    @classmethod
    def train(cls, vectors: DataFrame, vector: str = "embedding") -> ScalarQuantizer:
        rows = sorted(ranges(vectors, vector).collect())  # one row a dimension
        return cls(np.array([r.lo for r in rows]), np.array([r.hi for r in rows]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        safe = np.where(self.span > 0, self.span, 1.0)
        return np.clip(np.floor(255 * (x - self.lo) / safe), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.lo + (codes + 0.5) / 255 * self.span


def _sample(vectors: DataFrame, vector: str, id_col: str, n: int) -> np.ndarray:
    """At most n vectors, those with the smallest id hashes."""
    rows = hash_sample(vectors.where(F.col(vector).isNotNull()).select(id_col, vector), n, id_col)
    return np.array([r[0] for r in rows.select(vector).collect()], np.float64)


def train_centroids(vectors: DataFrame, lists: int, vector: str = "embedding", id_col: str = "vec_id", sample: int = TRAIN_ROWS, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means over a bounded sample: the `sample` rows with the smallest id hashes."""
    x = _sample(vectors, vector, id_col, sample)
    lists = max(1, min(lists, len(x)))
    if not len(x):
        return np.zeros((1, 0))
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin(((c * c).sum(1)[None] - 2 * x @ c.T), 1)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order][first]] = np.add.reduceat(x[order], first, axis=0) / np.diff(first, append=len(x))[:, None]
    return c


def probes_needed(vectors: DataFrame, c: np.ndarray, vector: str = "embedding", id_col: str = "vec_id", recall: float = PROBE_RECALL, k: int = PROBE_K) -> int:
    """The fewest lists whose probing keeps `recall` of the k nearest rows, a query's own row left out, within the sample that centroids are trained on.

    In the whole table the nearest rows lie nearer, so that no fewer of them stand in the lists that are probed.
    """
    x = _sample(vectors, vector, id_col, TRAIN_ROWS)
    if len(x) < 2:
        return len(c)
    own = np.linspace(0, len(x) - 1, min(PROBE_QUERIES, len(x))).astype(int)
    norm = 0.5 * (c * c).sum(1)[None]
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[own] @ c.T - norm), axis=1, kind="stable"), axis=1)
    need = place[np.arange(len(own))[:, None], np.argmax(x @ c.T - norm, 1)[top]]
    kept = np.cumsum(np.bincount(need.reshape(-1), minlength=len(c))) / need.size
    return int(np.searchsorted(kept, recall - 1e-9)) + 1


class VectorIndex:
    """An index over all rows: quantized codes, in inverted lists from IVF_ROWS rows on.

    `table` has (id, list_id, codes). Partitioned by list_id when written, so that probing reads the probed lists only.
    """

    def __init__(self, table: DataFrame, quantizer: ScalarQuantizer, centroids: np.ndarray, nprobe: int | None = None) -> None:
        self.table, self.quantizer, self.centroids = table, quantizer, centroids
        self.nprobe = len(centroids) if nprobe is None else nprobe

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
        if lists is None:
            lists = 1 if vectors.limit(IVF_ROWS).count() < IVF_ROWS else IVF_LISTS
        q = ScalarQuantizer.train(vectors, vector)
        c = np.zeros((1, len(q.lo))) if lists <= 1 else train_centroids(vectors, lists, vector, id_col)
        return cls(cls._coded(vectors, id_col, vector, q, c), q, c, 1 if lists <= 1 else probes_needed(vectors, c, vector, id_col))

    @staticmethod
    def _coded(vectors: DataFrame, id_col: str, vector: str, q: ScalarQuantizer, c: np.ndarray) -> DataFrame:
        ship(vectors.sparkSession)

        def run(batches):
            for b in batches:
                if len(b):
                    x = _matrix(b.column(1)).astype(np.float64)
                    at = np.argmax(x @ c.T - 0.5 * (c * c).sum(1)[None], 1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in q.encode(x)], pa.binary())], names=["id", "list_id", "codes"])

        return vectors.select(F.col(id_col).alias("id"), vector).where(F.col(vector).isNotNull()).mapInArrow(run, "id bigint, list_id int, codes binary")

    def append(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """The index with further rows, coded with the ranges it has (TK8); values beyond a range get its end."""
        return VectorIndex(self.table.unionByName(self._coded(vectors, id_col, vector, self.quantizer, self.centroids)), self.quantizer, self.centroids, self.nprobe)

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank) from the `nprobe` lists nearest to each query, by default as many as the index was found to need."""
        nprobe = self.nprobe if nprobe is None else nprobe
        return _merge(self._parts(queries, k, nprobe, id_col, vector), k, self.table.sparkSession)

    def _parts(self, queries: DataFrame, k: int, nprobe: int, id_col: str, vector: str) -> Iterator[DataFrame]:
        quant, c = self.quantizer, self.centroids
        for ids, q in _blocks(queries, id_col, vector):
            near = np.argsort(-(q @ c.T - 0.5 * (c * c).sum(1)[None]), axis=1, kind="stable")[:, :nprobe]
            probe = np.zeros((len(q), len(c)), bool)
            np.put_along_axis(probe, near, True, 1)
            shared = self.table.sparkSession.sparkContext.broadcast((ids, q, probe))

            def run(batches, shared=shared):
                ids, q, probe = shared.value
                for b in batches:
                    if not len(b):
                        continue
                    x = quant.decode(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(b), -1))
                    hits, at = b.column(0).to_numpy(), b.column(1).to_numpy()
                    # a list is scored for the queries that probe it only
                    order = np.argsort(at, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                        mine = np.flatnonzero(probe[:, at[rows[0]]])
                        if len(mine):
                            i, hit, s = _best(q[mine] @ x[rows].T, hits[rows], k)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[mine[i]]), pa.array(hit), pa.array(s)], names=["query_id", "id", "score"])

            probed = sorted({int(x) for x in near.reshape(-1)})
            rows = self.table if len(probed) == len(c) else self.table.where(F.col("list_id").isin(probed))
            yield rows.mapInArrow(run, _HITS)


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of true hits among the first k that were found (AG12)."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id")
    f = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("ok"))
    return t.join(f, ["query_id", "id"], "left").agg(F.round(F.avg(F.coalesce("ok", F.lit(0)).cast("double")), 6).alias("recall"))


def attribute_filter(platforms: list[str] = (), sources: list[str] = (), min_stars: int = 0, safety_only: bool = False) -> Column:
    """AND across filters, OR inside lists; an empty list, 0 or False filters nothing; only a scan that is true is safe (PR4)."""
    ok = F.lit(True)
    for name, want in (("platforms", platforms), ("source", sources)):
        if want:
            # arrays_overlap is null when a list without a hit holds a null
            ok = ok & F.coalesce(F.arrays_overlap(F.col(name), F.array(*[F.lit(x) for x in want])), F.lit(False))
    if min_stars:
        ok = ok & (F.coalesce("stars", F.lit(0)) >= min_stars)
    if safety_only:
        ok = ok & F.coalesce(F.col("safety_scan"), F.lit(False))
    return ok


def search(hits: DataFrame, rows: DataFrame, keep: Column, propose: int, key: str = "id") -> DataFrame:
    """Post-filtered search (TK5): of the first 6 * propose hits of each query those that pass, at most 3 * propose; scores are clamped to 0..1.

    Columns of `rows` named query_id, sim_score or place give way to the search's own; score and rank may be the rows'.
    The filter comes after the cut on purpose: a selective one may leave fewer rows than there are matches.
    """
    near = hits.where(F.col("rank") <= 6 * propose).select(key, F.col("query_id").alias("_query_id"), F.col("score").alias("_score"), F.col("rank").alias("_rank"))
    top = near.join(rows, key).where(keep)
    place = F.row_number().over(W.partitionBy("_query_id").orderBy("_rank"))
    got = top.withColumns({"query_id": F.col("_query_id"), "sim_score": clamp_score(F.col("_score")), "place": place})
    return got.where(F.col("place") <= 3 * propose).drop("_query_id", "_score", "_rank")
