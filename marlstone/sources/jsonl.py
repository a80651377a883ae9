"""Readers for record files, caches and manifests (SC1-SC11, SC14-SC17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import small_rows

RAW_SCHEMA = """repo_url string, name string, description string, source string,
 raw_metadata struct<stars:bigint, pushed_at:string, default_branch:string, skill_md_url:string, platforms:array<string>, categories:array<string>,
 topics:array<string>, triggers:array<string>, safety_scan:boolean, safety_scan_date:string, rank:string, overall_score:double,
 dimension_scores:map<string,double>, skillhub_url:string, official:boolean, path:string, parent_repo:string>,
 skill_md_url string, tombstone boolean, deleted_at string"""

#: A file is corrupt with more malformed lines than both.
MAX_BAD_LINES, MAX_BAD_SHARE = 5, 0.10
MANIFEST_LINES = 10_000


class CorruptFileError(ValueError):
    """A record file has too many malformed lines."""


class QualityGateError(Exception):
    """Fewer records than demanded."""


class AlignmentError(Exception):
    """Two parts of an index don't have the same rows."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, file, ord, value): non-blank lines; ord rises with the place of the file in `paths`, then with the place in the file.

    Within a file the order is that of byte offsets of its splits, so long files are read by many tasks.
    """
    out = None
    for i, p in enumerate(paths):
        raw = spark.read.text(p).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
        one = raw.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
        # rows of one split are consecutive and keep their order under the id; splits are ordered by their start
        one = one.select(F.lit(i).alias("file_no"), "file", F.struct(F.lit(i).alias("f"), F.col("file").alias("p"), F.col("_start").alias("s"), F.col("_id").alias("i")).alias("ord"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def scan_records(spark: SparkSession, paths: list[str], schema: str = RAW_SCHEMA) -> DataFrame:
    """Records of several files, tolerantly (SC1): `schema` and ord.

    Missing files, blank and malformed lines are skipped; a file with more than MAX_BAD_LINES malformed ones that are more than MAX_BAD_SHARE of
    its lines raises CorruptFileError; tombstones and records without repo_url are left out.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema).withColumn("ord", F.struct(F.lit(0).alias("f"), F.lit("").alias("p"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("i")))
    lines = _lines(spark, there).select("file_no", "ord", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    gate = lines.groupBy("file_no").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).where((F.col("bad") > MAX_BAD_LINES) & (F.col("bad") > MAX_BAD_SHARE * F.col("n")))
    broken = gate.orderBy("file_no").limit(5).collect()
    if broken:
        raise CorruptFileError("; ".join(f"{there[r.file_no]}: {r.bad} of {r.n} lines are corrupt" for r in broken))
    good = lines.where(~bad & ~F.coalesce(F.col("r.tombstone"), F.lit(False)) & (F.length("r.repo_url") > 0))
    return good.select("r.*", "ord").drop("_corrupt_record")


def scan_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file, failing at the first malformed line (SC2, SC15)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_folder(spark: SparkSession, folder: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """All *.jsonl of a folder (SC3): malformed lines and tombstones skipped; an absent source is the file's stem."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return df.where(~F.coalesce("tombstone", F.lit(False))).withColumn("source", F.coalesce(F.nullif("source", F.lit("")), stem))


def known_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of a column (SC4, SC6, SC8, SC11)."""
    return df.select(F.col(column).alias(column.split(".")[-1])).where(f"`{column.split('.')[-1]}` <> ''").distinct()


def resume_keys(df: DataFrame) -> DataFrame:
    """(key, record): the last record of each document address, else repository address (SC5, SC7)."""
    key = F.coalesce(F.nullif(F.col("raw_metadata.skill_md_url"), F.lit("")), F.col("repo_url"))
    rest = F.struct(*[c for c in df.columns if c != "ord"])
    return df.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.max_by(rest, "ord").alias("record"))


def read_object_cache(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of one JSON object (SC9, SC10); a missing file or anything but an object gives no rows."""
    empty = spark.createDataFrame([], f"key string, value {value_schema}")
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """`key: value` lines, split at the first colon (SC14); a required key that is missing raises KeyError, more than MANIFEST_LINES entries CorruptFileError."""
    rows = spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(F.substring_index("value", ":", 1)).alias("k"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("v"))
    got = small_rows(rows, MANIFEST_LINES)
    if got is None:
        raise CorruptFileError(f"{path} has more than {MANIFEST_LINES} entries")
    out = {r.k: r.v for r in got}
    for k in required:
        if k not in out:
            raise KeyError(f"{path} has no {k}")
    return out


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch_idx, record_ids, vectors binary): the last entry of each batch of a progress log (SC16); malformed lines are skipped."""
    schema = "batch_idx int, record_ids array<string>, vectors_b64 string"
    if not exists(spark, path):
        return spark.createDataFrame([], "batch_idx int, record_ids array<string>, vectors binary")
    lines = _lines(spark, [path]).select("ord", F.from_json("value", schema).alias("r")).where("r.batch_idx is not null and r.vectors_b64 is not null")
    return lines.groupBy("r.batch_idx").agg(F.max_by(F.struct("r.record_ids", F.unbase64("r.vectors_b64").alias("vectors")), "ord").alias("x")).select("batch_idx", "x.record_ids", "x.vectors")
