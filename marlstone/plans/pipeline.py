"""The catalog from raw files to search: normalize, embed, build, update, search (CT5-CT7, CT11, SK2, SK3, SK5-SK7, SK9, SC12, SC38, SC40, SM2, TK8-TK10, FN23, CT12, CT17).

Rows are matched by keys, never by position; each stage is a table that the next one reads.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import embedding_text
from marlstone.operators import merge
from marlstone.operators import vectors as vec
from marlstone.operators.incremental import new_rows, numbered, split_by_cache
from marlstone.session import shared_table, ship
from marlstone.sinks import writers
from marlstone.sources.jsonl import QualityGateError, exists, read_progress, scan_records

BATCH = 128


class IncrementalError(Exception):
    """An index can't be extended: another model, or too large for appending."""


class NoIndexError(Exception):
    """There is no index to search."""


# --- normalize ---------------------------------------------------------------------------------------


def normalize(spark: SparkSession, paths: list[str], renames: list[tuple[str, str]] = (), min_stars: int = 10, last_sources: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(unified records, drop counts) of raw files in the given order."""
    raw = scan_records(spark, paths)
    m = F.col("raw_metadata")
    wide = raw.select(
        merge.dedup_key(F.col("repo_url"), m["skill_md_url"], renames).alias("key"), "ord", "repo_url", "name", "description", "source", m["stars"].alias("stars"), m["pushed_at"].alias("pushed_at"), m["categories"].alias("categories"), m["topics"].alias("topics"),
        m["triggers"].alias("triggers"), m["platforms"].alias("platforms"), m["skill_md_url"].alias("skill_md_url"), m["rank"].alias("rank"), m["overall_score"].alias("score"), m["safety_scan"].alias("safety_scan"), m["safety_scan_date"].alias("safety_scan_date"), m["official"].alias("official"),
    )
    # the order within files is a struct; merging needs one number
    one = shared_table(merge.merge_records(numbered(wide, "ord", BATCH).drop("ord", "batch_no").withColumnRenamed("row_no", "ord"), last_sources=last_sources), "merged")
    reason = merge.drop_reason(F.col("description"), F.col("stars"), min_stars)
    text = embedding_text(F.col("name"), F.col("description"), F.col("categories"), F.col("platforms"), F.col("triggers"))
    return one.where(reason.isNull()).withColumn("embedding_text", text), merge.drop_counts(one, min_stars)


def write_catalog(unified: DataFrame, path: str, min_rows: int = 0) -> int:
    """Writes the unified records if there are at least `min_rows` (SK2), atomically; returns their number."""
    n = unified.count()
    if n < min_rows:
        raise QualityGateError(f"{n} records, {min_rows} demanded")
    writers.replace_atomically(unified, path)
    return n


# --- embed -------------------------------------------------------------------------------------------


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashes of words and their beginnings, at length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                for piece in (w, w[:4]):
                    h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], key: str = "id", text: str = "embedding_text", cache: DataFrame | None = None) -> DataFrame:
    """(id, embedding_text, embedding): rows whose key and text the cache has take its vector (JN3), the others go to the embedder in batches."""
    ship(rows.sparkSession)
    need = rows.select(F.col(key).alias("id"), F.col(text).alias("embedding_text"))
    hits = None
    if cache is not None:
        split = split_by_cache(need, cache.withColumn("ord", F.lit(0)) if "ord" not in cache.columns else cache, "id", "embedding_text", "embedding")
        hits, need = split.where("hit").select("id", "embedding_text", "embedding"), split.where("not hit").select("id", "embedding_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.slice(at, BATCH)
                v = embedder([t or "" for t in part.column(1).to_pylist()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "embedding_text", "embedding"])

    made = need.mapInArrow(run, "id string, embedding_text string, embedding array<float>")
    return made if hits is None else hits.unionByName(made)


def embed_resumable(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], progress: str, key: str = "id", text: str = "embedding_text", batch: int = BATCH) -> DataFrame:
    """(id, batch_idx, embedding) by way of a progress log (SK5, SM2): batches that the log has are read, only the others are embedded and appended.

    Batches are numbered in the order of the key, so a run that broke off goes on where it was, as long as the rows are the same; `finish` deletes the log.
    """
    spark = rows.sparkSession
    ship(spark)
    need = numbered(rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")), "id", batch).select("id", "t", "row_no", F.col("batch_no").cast("int").alias("batch_idx"))
    todo = need.join(read_progress(spark, progress).select("batch_idx"), "batch_idx", "left_anti")

    def run(_, part):
        part = part.sort_values("row_no")
        v = embedder([t or "" for t in part["t"]]).astype("<f4")
        ids = list(part["id"])
        return pd.DataFrame({"batch_idx": [int(part["batch_idx"].iloc[0])], "record_ids": [ids], "vectors_b64": [base64.b64encode(v.tobytes()).decode()]})

    made = todo.groupBy("batch_idx").applyInPandas(run, "batch_idx int, record_ids array<string>, vectors_b64 string")
    made.write.mode("append").json(progress)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                v = np.frombuffer(raw, "<f4").reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([n] * len(ids), pa.int32()), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "batch_idx", "embedding"])

    return read_progress(spark, progress).mapInArrow(unpack, "id string, batch_idx int, embedding array<float>")


def finish(spark: SparkSession, progress: str) -> None:
    """Deletes a progress log whose batches are all stored elsewhere (SK5)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(progress)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def import_npy(spark: SparkSession, data: bytes, ids: list[str]) -> DataFrame:
    """(id, embedding) of a small matrix file and its keys in order (SC12); their numbers must agree."""
    m = np.load(io.BytesIO(data), allow_pickle=False)
    if len(m) != len(ids):
        from marlstone.sources.jsonl import AlignmentError

        raise AlignmentError(f"{len(m)} vectors, {len(ids)} keys")
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id string, embedding array<float>")


# --- index -------------------------------------------------------------------------------------------


@dataclass
class CatalogIndex:
    """An index folder: `vectors` (id, list_id, codes) by list, `metadata` by key, `state` with ranges, centroids and the manifest."""

    spark: SparkSession
    folder: str

    def _state(self) -> dict:
        if not exists(self.spark, f"{self.folder}/state"):
            raise NoIndexError(self.folder)
        return json.loads(self.spark.read.text(f"{self.folder}/state").limit(1).collect()[0][0])

    def _save(self, state: dict) -> None:
        writers.replace_atomically(self.spark.createDataFrame([(json.dumps(state),)], "value string"), f"{self.folder}/state", "text")

    def build(self, metadata: DataFrame, vectors: DataFrame, model: str, lists: int | None = None) -> None:
        """Checks that both have the same keys, then writes vectors, metadata and manifest."""
        writers.check_alignment(vectors, metadata)
        keyed = vectors.select(F.xxhash64("id").alias("vec_id"), "id", "embedding")
        index = vec.VectorIndex.build(keyed, lists=lists)
        writers.replace_atomically(metadata.withColumn("vec_id", F.xxhash64("id")), f"{self.folder}/metadata")
        index.table.withColumn("_batch", F.lit(0)).write.mode("overwrite").partitionBy("list_id").parquet(f"{self.folder}/vectors")
        n = metadata.count()
        self._save({"model": model, "lo": index.quantizer.lo.tolist(), "span": index.quantizer.span.tolist(), "centroids": index.centroids.tolist(), "nprobe": index.nprobe, "count": n, "date": datetime.date.today().isoformat(), "hash": writers.table_hash(self._table())})

    def _table(self) -> DataFrame:
        return self.spark.read.schema("id bigint, codes binary, _batch int, list_id int").parquet(f"{self.folder}/vectors").select("id", "list_id", "codes")

    def _index(self, state: dict) -> vec.VectorIndex:
        lo, span = np.array(state["lo"]), np.array(state["span"])
        return vec.VectorIndex(self._table(), vec.ScalarQuantizer(lo, lo + span), np.array(state["centroids"]), state.get("nprobe"))

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/metadata")

    def update(self, incoming: DataFrame, embedder: Callable[[list[str]], np.ndarray], model: str) -> int:
        """Embeds and appends the rows whose id is new (CT7); returns their number. Another model (TK9) or an index with lists (TK8) raises."""
        fresh = shared_table(new_rows(incoming.where("id is not null").dropDuplicates(["id"]), self.metadata(), "id"), "fresh")
        n = fresh.count()
        if not n:
            return 0
        state = self._state()
        if state["model"] and state["model"] != model:
            raise IncrementalError(f"the index was made with {state['model']}, not {model}")
        if len(state["centroids"]) > 1:
            raise IncrementalError("an index with lists is rebuilt, not extended")
        vectors = shared_table(embed(fresh, embedder).select(F.xxhash64("id").alias("vec_id"), "embedding"), "vectors")
        old = self._index(state)
        coded = vec.VectorIndex._coded(vectors, "vec_id", "embedding", old.quantizer, old.centroids)
        coded.withColumn("_batch", F.lit(state["count"])).write.mode("append").partitionBy("list_id").parquet(f"{self.folder}/vectors")
        have = self.metadata()
        writers.replace_atomically(have.unionByName(fresh.withColumn("vec_id", F.xxhash64("id")), allowMissingColumns=True), f"{self.folder}/metadata")
        self._save(state | {"count": state["count"] + n, "date": datetime.date.today().isoformat(), "hash": writers.table_hash(self._table())})
        return n

    def search(self, text: str, embedder: Callable[[list[str]], np.ndarray], keep: Column = None, propose: int = 10, nprobe: int | None = None, prefix: str = "") -> DataFrame:
        """Hits for a query text with sim_score and place: the first 6 * propose, filtered, at most 3 * propose; nprobe=1 searches the nearest list only."""
        state = self._state()
        q = [float(x) for x in embedder([prefix + text])[0]]
        query = self.spark.createDataFrame([(0, q)], "vec_id bigint, embedding array<float>")
        hits = self._index(state).search(query, 6 * propose, nprobe)
        rows = self.metadata().withColumnRenamed("id", "skill_id").withColumnRenamed("vec_id", "id")
        return vec.search(hits, rows, F.lit(True) if keep is None else keep, propose)

    def search_in_tiers(self, text: str, embedder, tiers: list[Column], enough: int = 3, good: float = 0.4, **params) -> DataFrame:
        """The first tier of filters with `enough` hits of at least `good`, else the last (TK10)."""
        got = None
        for keep in tiers:
            got = self.search(text, embedder, keep, **params)
            if got.where(F.col("sim_score") >= good).limit(enough).count() >= enough:
                return got
        return got


# --- small parts -------------------------------------------------------------------------------------


def add_filtered(spark: SparkSession, path: str, urls: DataFrame, reason: str) -> None:
    """Appends addresses that a connector rejected, with the UTC time (SK9)."""
    urls.select("url", F.lit(reason).alias("reason"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("filtered_at")).write.mode("append").json(path)


def wait_seconds(retry_after: Column, reset_epoch: Column, now_epoch: Column, cap: int = 120) -> Column:
    """How long to wait after a refused request (CT12): what was asked for, else until the reset, else a minute; `cap` at most."""
    asked = retry_after.try_cast("bigint")
    return F.least(F.lit(cap), F.greatest(F.lit(0), F.coalesce(asked, reset_epoch - now_epoch, F.lit(60)))).cast("bigint")


def parse_count(text: Column) -> Column:
    """The number in `N skills` or `skill_count: N`, with thousands separators; null without (FN23)."""
    n = F.regexp_extract(F.lower(text), r"(?:skill_count:?\s*([\d,]+)|([\d,]+)\s+skills)", 0)
    return F.regexp_replace(n, r"\D", "").try_cast("bigint")


def parse_sha256(text: Column) -> Column:
    """The first 64 hex digits of a text, lower case; null without (FN23)."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b([0-9a-f]{64})\b", 1)), F.lit(""))
