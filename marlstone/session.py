"""Session helpers: tables, shared folder for lineage cuts, bounded collects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a classic query go when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    home = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"  # served from the driver, not read by executors
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(file))
    sc._marlstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder: one Parquet file, or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint that outlives lost executors.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a local
    session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    ship(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "marlstone-checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder; what is written there goes when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if base is None and given.isDefined():
        base = given.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "marlstone-checkpoints")
    path = f"{base.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """`df` written as a table below the shared checkpoint folder and read again: a compressed, columnar cut of the lineage.

    The shuffle files of the write go as soon as it is done, since nothing can ask for them again; `forget` deletes the table itself.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_folder(spark, label)
    write_table(df.write.option("compression", "zstd"), spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def write_table(writer, spark: SparkSession, path: str) -> None:
    """Writes Parquet to `path` and frees the shuffle files that the write made."""
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)


def forget(df: DataFrame) -> None:
    """Deletes a table of `shared_table`; only for tables that nothing still to be computed reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._marlstone_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_parts(spark: SparkSession, rows: int, each: int = 2_000_000) -> int:
    """How many tasks `rows` rows need at `each` a task, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hash_sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most `n` rows that differ in the columns `by`: those with the smallest hashes, one a hash; repeated rows count once.

    Rows are cut by a threshold of their hash before they are compared, so that tasks send some 1.5 n rows in all, however many tasks there are.
    """
    hashed = df.withColumn("_h", F.xxhash64(*by))
    total = hashed.agg(F.approx_count_distinct("_h")).collect()[0][0]
    if total > 2 * n:
        hashed = hashed.where(F.col("_h") < F.lit(int(-(2**63) + 2**64 * (1.5 * n / total))))
    rest = F.struct(*df.columns)
    return hashed.groupBy("_h").agg(F.min(rest).alias("_r")).orderBy("_h").limit(n).select("_r.*")


def small_rows(df: DataFrame, bound: int) -> list | None:
    """The rows of `df` if there are at most `bound`, else None. At most bound + 1 rows reach the driver."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None
