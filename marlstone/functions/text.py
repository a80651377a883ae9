"""Text functions: words, stock phrases, embedding text, normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.urls import is_blank

# Phrases that feeds put where a description is missing, in words.
STOCK_PHRASES = (
    "a skill",
    "add a description",
    "coming soon",
    "description goes here",
    "keine beschreibung",
    "n a",
    "no description",
    "no description provided",
    "no description website or topics provided",
    "none",
    "null",
    "placeholder",
    "sin descripción",
    "tbd",
    "todo",
    "暂无描述",
)

#: ASCII stands first since it is tested fastest; a run is never given back.
WORD = r"[a-z0-9\p{L}\p{N}]++"


def words(c: Column) -> Column:
    """The longest runs of letters or digits of the lower-cased text, in order; empty for null."""
    return F.regexp_extract_all(F.coalesce(F.lower(c), F.lit("")), F.lit(WORD), F.lit(0))


def distinct_words(*cols: Column) -> Column:
    """The distinct words of several texts together; a null text has none."""
    return F.array_distinct(words(F.concat_ws("\n", *cols)))


def plain_words(c: Column) -> Column:
    """The words joined by one space: equal for texts that differ in case, marks and spacing only."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def learned_stock_phrases(df: DataFrame, text: str, name: str, min_share: float = 0.0005, min_rows: int = 3) -> list[str]:
    """Short texts that unrelated records share so often that they can't describe any of them.

    A phrase of at most eight words counts if it stands in `min_share` of all rows, in
    `min_rows` rows at least (fewer can't be told from chance), and in most of them under another name. At most 1 / min_share phrases can
    fulfil that, which bounds what reaches the driver. Empty tables give none.
    """
    n = df.count()
    least = max(min_rows, int(min_share * n))
    if n < least:
        return []
    p = plain_words(F.col(text))
    # a phrase of many rows is nearly always under new names: one name a row is enough to see it, so names are hashed to 64 bits
    got = (
        df.where(F.length(text) <= 200)
        .select(p.alias("p"), F.xxhash64(F.lower(name)).alias("h"))
        .where("p <> ''")
        .groupBy("p")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d"))
        .where((F.col("n") >= least) & (F.col("d") > 0.5 * F.col("n")) & (F.size(F.split("p", " ")) <= 8))
    )
    return sorted(r.p for r in got.select("p").collect())


def usable(c: Column, learned: list[str] = ()) -> Column:
    """False for null, blank, texts without letter or digit, and stock phrases."""
    p = plain_words(c)
    bad = sorted({*STOCK_PHRASES, *learned})
    return ~is_blank(c) & (p != "") & ~p.isin(bad)


def source_key(c: Column) -> Column:
    """A source name without regard to case, spaces and punctuation; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def squash(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def embedding_text(name: Column, description: Column, categories: Column, platforms: Column, triggers: Column) -> Column:
    """`name. description` and sentences for the lists that aren't empty; of the triggers the first five."""

    def sentence(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, ", "), F.lit(".")))

    return F.concat_ws(
        " ",
        F.concat(name, F.lit(". "), description),
        sentence("Categories", categories),
        sentence("Platforms", platforms),
        sentence("Triggers", F.slice(triggers, 1, 5)),
    )
