"""Writers: records with a gate, manifests, atomic replacement, index files, rendered reports (SK1, SK2, SK8, SK10-SK12, SK16, SK17, SC13, AG15)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.operators import stats
from marlstone.session import small_rows
from marlstone.sources.jsonl import AlignmentError, QualityGateError


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line (SK1); null fields are left out by the writer."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_gated(df: DataFrame, path: str, min_rows: int) -> None:
    """Writes only if there are enough rows (SK2); raises QualityGateError before anything is written. Counting stops at the bound."""
    n = df.limit(min_rows).count() if min_rows > 0 else 0
    if n < min_rows:
        raise QualityGateError(f"{n} records, {min_rows} demanded")
    write_records(df, path)


def replace_atomically(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes next to `path` and renames (SK8, SK17): readers see the old or the new table. `df` may read from `path`."""
    spark = df.sparkSession
    tmp, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).save(tmp)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    fs.rename(P(tmp), P(path))
    fs.delete(P(old), True)


def check_alignment(vectors: DataFrame, metadata: DataFrame, key: str = "id") -> None:
    """Raises AlignmentError unless both have the same keys (SC13, CT19, JN2)."""
    a, b = vectors.select(key).withColumn("_a", F.lit(1)), metadata.select(key).withColumn("_b", F.lit(1))
    odd = a.join(b, key, "full_outer").where("_a is null or _b is null").limit(1).count()
    if odd:
        raise AlignmentError("vectors and metadata differ in their keys")


def manifest_line(date: str, count: int, model: str, index_sha256: str, metadata_sha256: str) -> str:
    """The manifest text (SK16)."""
    return f"date: {date}\nskill_count: {count}\nembed_model: {model}\nindex_sha256: {index_sha256}\nmetadata_sha256: {metadata_sha256}\n"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files (AG15)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> Column | str:
    """A hash of a table's rows that doesn't depend on their order: one aggregate, no sort."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    r = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(2**31))).alias("s")).collect()[0]
    return f"{r.n}-{(r.x or 0) & (2**64 - 1):016x}-{r.s or 0}"


def result_json(df: DataFrame, fields: list[str]) -> Column:
    """One hit as JSON, with null fields kept (SK10)."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def hit_text(place: Column, name: Column, stars: Column, score: Column, description: Column, url: Column) -> Column:
    """The text block of a hit (SK10)."""
    head = F.concat(place.cast("string"), F.lit(". "), name, F.when(stars > 0, F.concat(F.lit(" ⭐ "), F.format_number(stars, 0))).otherwise(""), F.lit(" ("), F.format_string("%.2f", score), F.lit(")"))
    return F.concat_ws("\n", head, F.concat(F.lit("   "), description), F.concat(F.lit("   "), url))


def rewrite_blocks(text: str, blocks: dict[str, str], mark: str = "<!-- stats:{name}:{end} -->") -> tuple[str, list[str]]:
    """A text with what stands between the marks of each named block replaced (SK12), and the names found, in the order of the text.

    `mark` is the form of both marks, `end` being start and end. Names that aren't given, and marks without their partner, stay as they are. A
    block that has or had several lines gets lines of its own.
    """
    spans: list[tuple[int, int, str]] = []
    for name in blocks:
        begin, close = (mark.format(name=name, end=e) for e in ("start", "end"))
        at = text.find(begin)
        while at >= 0:
            inside = at + len(begin)
            stop = text.find(close, inside)
            if stop < 0:
                break
            spans.append((inside, stop, name))
            at = text.find(begin, stop + len(close))
    pieces, names, last = [], [], 0
    for inside, stop, name in sorted(spans):
        if inside < last:
            continue
        several = "\n" in blocks[name] or "\n" in text[inside:stop]
        pieces += [text[last:inside], f"\n{blocks[name]}\n" if several else blocks[name]]
        names.append(name)
        last = stop
    return "".join([*pieces, text[last:]]), names


def distribution_lines(histogram: DataFrame, edges) -> DataFrame:
    """(place, line): a histogram (bucket, n) as the lines of a table with bars, buckets in the order of `edges`, and its total last (CT14)."""
    order = F.create_map(*[F.lit(x) for i, (label, _, _) in enumerate(edges) for x in (label, i)])
    sums = histogram.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 0").withColumn("all", F.sum("n").over(W.partitionBy(F.lit(0))))  # one row a bucket
    share = 100.0 * F.col("n") / F.col("all")
    count = lambda c: F.format_number(c, 0)
    line = F.concat(F.lit("| "), "bucket", F.lit(" | "), count("n"), F.lit(" | "), stats.bar(share), F.lit(" "), F.bround(share, 0).cast("int").cast("string"), F.lit("% |"))
    rows = sums.select(F.try_element_at(order, F.col("bucket")).alias("place"), line.alias("line"))
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(len(edges)).alias("place"), F.concat(F.lit("| **Total** | **"), count("n"), F.lit("** | |")).alias("line"))
    return rows.unionByName(total)


def rounded_count(n: Column, step: int = 500) -> Column:
    """A number to be quoted: rounded down to a multiple of `step`, with a plus (CT14)."""
    return F.concat(F.format_number(F.floor(n / step) * step, 0), F.lit("+"))


def source_report(per_source: DataFrame, most: int = 1_000) -> str:
    """The rows of `source_stats` as a text table with a row of totals (SK13); one row a source is read to the driver, and more than `most` are refused."""
    rows = small_rows(per_source, most)
    if rows is None:
        raise ValueError(f"more than {most} sources")
    rows.sort(key=lambda r: r[0])
    wide = max([6, *(len(r[0]) for r in rows)])
    stars = lambda n: f"{n // 1000}k" if n >= 10_000 else f"{n / 1000:.1f}k" if n >= 1000 else str(n)
    lines = [f"{'Source':<{wide}}  {'Records':>9}  {'No description':>20}  {'No stars':>20}  {'Median':>7}  {'P95':>7}"]

    def part(n: int, of: int, most_percent: float | None) -> str:
        share = 100 * n / of if of else 0.0
        return f"{n:,} ({share:.1f}%){' !' if most_percent is not None and share > most_percent else '  '}"

    for r in rows:
        lines.append(f"{r[0]:<{wide}}  {r.total:>9,}  {part(r.no_description, r.total, 5):>20}  {part(r.zero_stars, r.total, 15):>20}  {stars(r.median):>7}  {stars(r.p95):>7}")
    total, empty, zero = (sum(r[c] for r in rows) for c in ("total", "no_description", "zero_stars"))
    return "\n".join([*lines, f"{'TOTAL':<{wide}}  {total:>9,}  {part(empty, total, None):>20}  {part(zero, total, None):>20}"])


def release_markdown(deltas: DataFrame, most: int = 10_000) -> str:
    """The release log as a table, newest first (SK11); one row a release is read to the driver, and more than `most` are refused."""
    rows = small_rows(deltas, most)
    if rows is None:
        raise ValueError(f"more than {most} releases")
    rows.sort(key=lambda r: (r.date is not None, r.date), reverse=True)
    sign = lambda d: "—" if d is None else f"{d:+,}"
    return "\n".join(["| Date | Skills | Change |", "|---|---|---|", *(f"| {r.date} | {'—' if r.skill_count is None else f'{r.skill_count:,}'} | {sign(r.delta)} |" for r in rows)])
