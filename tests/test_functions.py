"""Addresses, days and texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions.days import utc_day
from marlstone.functions.text import embedding_text, learned_stock_phrases, source_key, usable, words
from marlstone.functions.urls import canonical_key, close_renames, owner_repo, spelled_address, stable_id, subtree_hint, with_address


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


SAME = [
    "https://forge.example/o/r",
    "HTTP://www.Forge.Example:443/O/R/",
    "git@forge.example:o/r.git",
    "https://forge.example/o/r.git/?tab=readme#usage",
    "ssh://git@forge.example/o/r.git",
    " \thttps://forge.example//o/r//\n",
    "https://forge.example/o/r\n",
    "https://forge.example/o/r.git\n",
    "https://forge.example/%6F/r",
    "​https://forge.example/o/./r ",
]


def test_spellings_of_one_place(spark):
    assert set(out(col(spark, SAME), spelled_address(F.col("v")))) == {"forge.example/o/r"}


def test_places_that_differ(spark):
    got = out(col(spark, ["https://forge.example/o/r", "https://forge.example/o/r/blob/main/SKILL.md", "https://forge.example/o/r/blob/dev/SKILL.md", "https://other.example/o/r", "https://forge.example:8443/o/r"]), spelled_address(F.col("v")))
    assert len(set(got)) == 5


def test_no_address(spark):
    assert out(col(spark, [None, "", " ​\n", "https://"]), spelled_address(F.col("v"))) == [None] * 4


def test_bad_percent_codes_are_kept(spark):
    assert out(col(spark, ["https://forge.example/o/100%"]), spelled_address(F.col("v"))) == ["forge.example/o/100%"]


def test_renames_follow_chains_and_survive_circles():
    assert close_renames({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c", "y": "x"}


@pytest.mark.parametrize("many", [False, True])
def test_renamed_owner(spark, many):
    rows = [("Old", "mid"), ("mid", "new"), (None, "z"), ("", "q")] + [(f"o{i}", f"n{i}") for i in range(400 if many else 0)]
    ren = spark.createDataFrame(rows, "old_owner string, new_owner string")
    df = col(spark, ["https://forge.example/OLD/r", "https://forge.example/mid", "https://forge.example/r/old", None])
    got = with_address(df, F.col("v"), ren)
    assert [r.address for r in got.orderBy("i").collect()] == ["forge.example/new/r", "forge.example/new", "forge.example/r/old", None]


def test_canonical_key(spark):
    v = ["HTTPS://A/B.git//", "https://a/b/.git", "", None, "x/old/r", "x/older/old/"]
    got = out(col(spark, v), canonical_key(F.col("v"), [("/old/", "/new/"), ("older", "oldest")]))
    assert got == ["https://a/b", "https://a/b/", None, None, "x/new/r", "x/oldest/old"]
    assert out(col(spark, ["a"]), stable_id(F.col("v")))[0] == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_address_parts(spark):
    v = ["https://www.forge.example/O/R.git", "https://notforge.example/o/r", "https://forge.example/o", "https://forge.example/o/r/tree/main/a/b"]
    assert out(col(spark, v), owner_repo(F.col("v"), "forge.example")) == ["o/r", None, None, "o/r"]
    assert out(col(spark, v), subtree_hint(F.col("v")))[3] == "a/b"


DAYS = {
    "2024-03-01T00:30:00+01:00": (2024, 2, 29),
    "2023-12-31T23:30:00-0500": (2024, 1, 1),
    "2024-05-06T07:08:09Z": (2024, 5, 6),
    "2024-05-06 07:08:09.123": (2024, 5, 6),
    "2024/05/06": (2024, 5, 6),
    "20240506": (2024, 5, 6),
    "06 May 2024": (2024, 5, 6),
    "May 6, 2024": (2024, 5, 6),
    "1714979289": (2024, 5, 6),
    "1714979289000": (2024, 5, 6),
    "2024-02-30": None,
    "0000-00-00": None,
    "2024-05-06T25:00:00Z": None,
    "06 Xyz 2024": None,
    "unknown": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland"])
def test_days(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = out(col(spark, list(DAYS)), utc_day(F.col("v")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [d and datetime.date(*d) for d in DAYS.values()]


def test_usable_texts(spark):
    v = [None, "", " \n", "...", "N/A", "TODO", "<add a description>", "暂无描述", "Sorts files.", "A skill for sorting"]
    assert out(col(spark, v), usable(F.col("v"))) == [False] * 8 + [True] * 2


def test_learned_phrases(spark):
    rows = [(f"n{i}", "Work in progress!") for i in range(40)] + [("same", "Copied text here")] * 40 + [(f"m{i}", f"text number {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "name string, description string")
    assert learned_stock_phrases(df, "description", "name") == ["work in progress"]
    assert learned_stock_phrases(df.limit(0), "description", "name") == []


def test_words_and_sources(spark):
    assert out(col(spark, ["Größe: x_1, 中文。ok", None]), words(F.col("v"))) == [["größe", "x", "1", "中文", "ok"], []]
    assert out(col(spark, ["Skill-SMP deep ", None]), source_key(F.col("v"))) == ["skillsmpdeep", ""]


def test_embedding_text(spark):
    df = spark.createDataFrame([(0, "n", "d", ["a", "b"], [], [str(i) for i in range(9)])], "i int, n string, d string, c array<string>, p array<string>, t array<string>")
    got = out(df, embedding_text(*[F.col(x) for x in "ndcpt"]))
    assert got == ["n. d Categories: a, b. Triggers: 0, 1, 2, 3, 4."]
