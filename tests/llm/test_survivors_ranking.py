"""Problems 1 and 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ranking, survivors

META = "struct<stars:bigint,pushed_at:string,default_branch:string,skill_md_url:string,platforms:array<string>,topics:array<string>>"
SCHEMA = f"rec_id bigint, repo_url string, name string, description string, source string, raw_metadata {META}"


def rec(i, url, text, source, pushed=None, own=None):
    return (i, url, "n", text, source, (1, pushed, None, own, None, None))


@pytest.fixture(scope="module")
def tables(spark):
    ren = spark.createDataFrame([("old", "new")], "old_owner string, new_owner string")
    reg = spark.createDataFrame([("marketplace", 1), ("topic", 2)], "source string, trust_rank int")
    return ren, reg


def found(spark, tables, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    got, trust = survivors.catalog_survivors(df, *tables)
    return got, trust, df


A, B = "https://forge.example/new/r", "git@forge.example:OLD/r.git"


@pytest.mark.parametrize(
    "rows,best",
    [
        ([rec(1, A, None, "marketplace", "2025-01-01"), rec(2, B, "Sorts.", None)], 2),
        ([rec(1, A, "TODO", "marketplace"), rec(2, B, "Sorts.", "unknown")], 2),
        ([rec(1, A, "A long description", "topic", "2025-01-01"), rec(2, B, "Sorts.", "Market-Place ")], 2),
        ([rec(1, A, "Sorts.", "nowhere"), rec(2, B, "Sorts.", "topic")], 2),
        ([rec(1, A, "A long description", "topic", "2024-12-31"), rec(2, B, "Sorts.", "topic", "01 Jan 2025")], 2),
        ([rec(1, A, "A long description", "topic", "unreadable"), rec(2, B, "Sorts.", "topic", "1999-01-01")], 2),
        ([rec(1, A, "Sorts.", "topic"), rec(2, B, "Sorts more.", "topic")], 2),
        ([rec(2, A, "Sorts.", "topic"), rec(1, B, "Other.", "topic")], 1),
        ([rec(2, A, None, None), rec(1, B, "", None)], 1),
    ],
)
def test_record_to_keep(spark, tables, rows, best):
    got, _, _ = found(spark, tables, rows)
    assert [(r.first_id, r.best_id, r.n) for r in got.collect()] == [(1, best, 2)]


def test_groups(spark, tables):
    rows = [rec(1, A, "x", "topic"), rec(2, A, "x", "topic", own=A + "/blob/main/SKILL.md"), rec(3, None, "x", None), rec(4, " ", "y", None), rec(5, B, "x", "topic", own=" "), rec(6, "https://forge.example/new/R#a", "x", "topic")]
    got, _, _ = found(spark, tables, rows, extra=("id", "key", "value", "n"))
    assert [(r.first_id, r.n) for r in got.collect()] == [(1, 3)]


def test_no_rows(spark, tables):
    got, trust, _ = found(spark, tables, [])
    assert got.count() == 0 and trust.count() == 0


def test_truth_discovery_trusts_the_agreeing_source(spark, tables):
    rows, i = [], 0
    for g in range(12):
        url = f"https://forge.example/o/r{g}"
        for source, text in (("good", f"Right text {g}"), ("fair", f"Right text {g}"), ("bad", f"Wrong thing {g} {g * 7}")):
            i += 1
            rows.append(rec(i, url, text, source))
    # here good and bad meet alone: the source that agrees elsewhere wins
    rows += [rec(100, "https://forge.example/o/last", "From bad", "bad"), rec(101, "https://forge.example/o/last", "From good", "good")]
    got, trust, df = found(spark, tables, rows)
    r = {x.source: x.reliability for x in trust.collect()}
    assert r["good"] > r["bad"] and r["fair"] > r["bad"]
    fused = {x.address: x.description for x in survivors.surviving_records(df, got).collect()}
    assert fused["forge.example/o/last"] == "From good" and fused["forge.example/o/r3"] == "Right text 3"


def test_hot_key(spark, tables):
    rows = [rec(i, A, f"text {i}", "topic", "2025-01-01") for i in range(2, 3000)] + [rec(1, B, "the longest text of all of them", "marketplace")]
    got, _, _ = found(spark, tables, rows)
    assert [(r.first_id, r.best_id, r.n) for r in got.collect()] == [(1, 1, 2999)]


def test_grades(spark):
    v = ["S", "[b]", "Grade C", "f ", "?", "N/A", "", None, "class"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(ranking.grade_value(F.col("v"))).collect()] == [6.0, 4.0, 3.0, 1.0, None, None, None, None, None]


def test_ranking_follows_the_common_factor(spark):
    r = np.random.default_rng(1)
    t = r.normal(size=300)
    rows = [(f"k{i}", float(t[i] * 1e6 + r.normal() * 1e5), float(np.exp(t[i] + 0.3 * r.normal())), float(-(t[i] + 0.3 * r.normal()))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double")
    got, load = ranking.combine(df, "k", {"a": 1, "b": 1, "c": -1})
    assert load["a"] > 0 and load["b"] > 0 and load["c"] < 0
    place = {x.k: x.rank for x in got.collect()}
    assert sorted(place.values()) == list(range(1, 301))
    order = np.argsort(np.argsort([-x for x in t]))
    mine = np.array([place[f"k{i}"] - 1 for i in range(300)])
    assert np.corrcoef(order, mine)[0, 1] > 0.95


def test_ranking_agrees_with_plain_computation(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "k bigint, a double, b double, c double")
    got, load = ranking.combine(df, "k", {"a": 1, "b": 1, "c": 1})
    ranks = (np.argsort(np.argsort(x, 0), 0) + 0.5) / 80 - 0.5
    vec = np.linalg.eigh(np.corrcoef(ranks.T))[1][:, -1]
    vec = vec * np.sign(vec.sum())
    want = ranks @ vec / np.sqrt((vec**2).sum())
    proj = {q.k: q.projection for q in got.collect()}
    assert np.allclose([proj[i] for i in range(80)], want, atol=1e-6)


def test_ranking_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, None), ("b", 2.0, None), ("c", None, None), (None, 5.0, 5.0), ("d", 1.0, 1.0)], "k string, a double, b double")
    got, load = ranking.combine(df, "k", {"a": 1, "b": 1})
    p = {r.k: (r.rank, r.n_scores) for r in got.collect()}
    assert load["b"] == 0.0
    assert p == {"b": (1, 1), "a": (2, 2), "d": (2, 2), "c": (4, 0)}
    empty, _ = ranking.combine(df.limit(0), "k", {"a": 1, "b": 1})
    assert empty.count() == 0


def test_no_scale_rules(spark):
    rows = [(i, float(i), float((i * 37) % 50)) for i in range(50)]
    a, _ = ranking.combine(spark.createDataFrame(rows, "k int, a double, b double"), "k", {"a": 1, "b": 1})
    b, _ = ranking.combine(spark.createDataFrame([(k, x * 1e9, y) for k, x, y in rows], "k int, a double, b double"), "k", {"a": 1, "b": 1})
    assert {tuple(r) for r in a.select("k", "rank").collect()} == {tuple(r) for r in b.select("k", "rank").collect()}
