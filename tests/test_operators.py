"""Merging, reports, increments, ranks."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import incremental as inc
from marlstone.operators import merge, stats
from marlstone.operators.ranking import average_ranks

RAW = "key string, ord bigint, repo_url string, name string, description string, source string, stars bigint, pushed_at string, categories array<string>, rank string, safety_scan boolean, safety_scan_date string"


def test_merge_rules(spark):
    rows = [
        ("k", 3, "C/", "third", "long text", "b", 5, "2024-02", ["z", ""], "", None, "d3"),
        ("k", 1, "A.git", "", "same size", "a", None, "", None, "A", True, "d1"),
        ("k", 2, "B", "second", "short", "a", 9, "2023-12", ["a", "z"], None, False, "d2"),
        ("none", 4, None, None, None, None, None, None, None, None, None, None),
        (None, 5, "x", "x", "x", "x", 1, "x", None, None, None, None),
    ]
    got = {r.key: r for r in merge.merge_records(spark.createDataFrame(rows, RAW)).collect()}
    assert set(got) == {"k", "none"}
    k = got["k"]
    assert (k.repo_url, k.name, k.description, k.stars, k.last_updated) == ("a", "second", "same size", 9, "2024-02")
    assert (k.source, k.categories, k.rank, k.safety_scan, k.safety_scan_date, k.n_records) == (["a", "b"], ["a", "z"], "", False, "d1", 3)
    e = got["none"]
    assert (e.name, e.description, e.stars, e.source, e.platforms, e.skill_md_url) == ("", "", 0, [], [], "")


def test_merge_of_nothing(spark):
    assert merge.merge_records(spark.createDataFrame([], RAW)).count() == 0


def test_merge_with_extra_columns(spark):
    df = spark.createDataFrame([("k", 1, "a", "n", "d", "s", "keep out")], "key string, ord bigint, repo_url string, name string, description string, source string, id string")
    assert merge.merge_records(df).select("id").collect()[0][0] != "keep out"


@pytest.mark.parametrize("description,star,want", [("", 50, "no_description"), (None, 0, "no_description"), ("x", 0, "zero_stars"), ("x", None, "zero_stars"), ("x", 9, "low_stars"), ("x", 10, None)])
def test_drop_reasons(spark, description, star, want):
    df = spark.createDataFrame([(description, star)], "d string, s bigint")
    assert df.select(merge.drop_reason(F.col("d"), F.col("s"))).collect()[0][0] == want


def test_drop_counts_count_each_source(spark):
    df = spark.createDataFrame([("", 0, ["a", "b"]), ("x", 0, [])], "description string, stars bigint, source array<string>")
    assert {tuple(r) for r in merge.drop_counts(df).collect()} == {("no_description", "a", 1), ("no_description", "b", 1), ("zero_stars", "unknown", 1)}


def test_command_map_last_source_wins(spark):
    df = spark.createDataFrame([(["a", "b"], "n", ["codex"]), (["b", "a"], "n", []), ([], "n", [])], "s array<string>, n string, p array<string>")
    m = merge.command_map(F.col("s"), F.col("n"), F.col("p"), {"a": ("x", "one {name}"), "b": ("x", "two {name}")}, {"codex": "copy"})
    assert [r[0] for r in df.select(m).collect()] == [{"x": "two n", "codex": "copy"}, {"x": "one n"}, {}]


def test_index_percentiles(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 21)] + [("b", 7), ("c", None)], "g string, v bigint")
    got = {r.g: (r.median, r.p95) for r in stats.index_percentiles(df, "g", "v", {"p95": 95}).collect()}
    assert got == {"a": (10, 20), "b": (7, 7)}


def test_source_stats(spark):
    df = spark.createDataFrame([("a", None, " "), ("a", 4, "x"), ("b", 0, None)], "s string, v bigint, d string")
    got = {r.s: (r.total, r.no_description, r.zero_stars, r.median, r.pct_zero_stars) for r in stats.source_stats(df, "s", "v", "d").collect()}
    assert got == {"a": (2, 1, 1, 2, 50.0), "b": (1, 1, 1, 0, 100.0)}
    assert stats.source_stats(df.limit(0), "s", "v", "d").count() == 0


def test_buckets_and_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0, 9, 10, 4999, 5000, -1, None, 98_000, 1_500)], "v bigint")
    assert [r[0] for r in df.select(stats.bucket(F.col("v"), stats.DOC_BUCKETS)).collect()] == ["0", "1–9", "10–49", "1k–5k", "5k+", None, None, "5k+", "1k–5k"]
    assert [r[0] for r in df.select(stats.short_stars(F.col("v"))).collect()][-2:] == ["98k", "1.5k"]


def test_star_labels_of_every_record(spark, tmp_path):
    from marlstone.plans.catalogue import QUERIES

    rows = [(0, 999), (1, 1000), (2, 1250), (3, 1350), (4, 9940), (5, 9999), (6, 10_000), (7, None)]
    meta = "struct<stars bigint, pushed_at string, default_branch string, skill_md_url string, platforms array<string>, topics array<string>>"
    schema = f"rec_id bigint, repo_url string, name string, description string, source string, raw_metadata {meta}, desc_lang string, load_no int, crawled_at timestamp"
    df = spark.createDataFrame([(i, None, None, None, None, (v, None, None, None, None, None), None, 1, None) for i, v in rows], schema)
    df.write.parquet(str(tmp_path / "skillsmp.parquet"))
    got = {r.rec_id: r.label for r in QUERIES["star_labels"](spark, str(tmp_path)).collect()}
    assert got == {0: "999", 1: "1.0k", 2: "1.2k", 3: "1.4k", 4: "9.9k", 5: "10.0k", 6: "10k", 7: None}


def test_bar_rounds_half_to_even(spark):
    df = spark.createDataFrame([(12.5,), (0.1,), (0.0,), (100.0,)], "p double")
    got = [r[0] for r in df.select(stats.bar(F.col("p"))).collect()]
    assert [len(b.rstrip("░")) for b in got] == [2, 1, 0, 20] and {len(b) for b in got} == {20}


@pytest.mark.parametrize("now,before,ok", [(90, 100, True), (89, 100, False), (5, 0, True), (5, None, True)])
def test_regression_gate(now, before, ok):
    assert stats.regression_gate(now, before, 0.1)[0] is ok


def test_update_and_tags(spark):
    df = spark.createDataFrame([("2025-01-01", "index-2025-01-02"), ("2025-01-02", "index-2025-01-02"), (None, "index-2025-01-02"), ("2025-01-01", "index-x")], "l string, t string")
    assert [r[0] for r in df.select(stats.needs_update(F.col("l"), F.col("t"))).collect()] == [True, False, True, True]
    tags = spark.createDataFrame([("v9",), ("index-1",), ("index-2",)], "t string")
    assert stats.latest_with_prefix(tags, "t", "index-").collect()[0][0] == "index-2"


def test_request_classes(spark):
    df = spark.createDataFrame([("https://raw.x/a", 304), ("https://raw.x/a", 200), ("https://x/graphql", 200), ("https://x/search/code", 200), ("https://x/repos", 200)], "u string, s int")
    assert [r[0] for r in df.select(stats.request_class(F.col("u"), F.col("s"), "raw.x")).collect()] == ["conditional", "raw", "graphql", "search", "rest"]


def test_new_rows_keep_null_and_repeated(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "id string")
    assert sorted(str(r.id) for r in inc.new_rows(a, spark.createDataFrame([("x",), (None,)], "id string"), "id").collect()) == ["None", "y", "y"]


def test_cache_needs_the_same_text(spark):
    rows = spark.createDataFrame([("a", "t"), ("b", "new"), ("", "t"), (None, "t")], "id string, text string")
    cache = spark.createDataFrame([("a", "old", 1, 1), ("a", "t", 2, 2), ("b", "t", 3, 3), ("", "t", 4, 4)], "id string, text string, v int, ord int")
    got = {r.id: (r.hit, r.v) for r in inc.split_by_cache(rows, cache, "id", "text", "v").collect()}
    assert got == {"a": (True, 2), "b": (False, None), "": (False, None), None: (False, None)}


def test_backfill(spark):
    rows = spark.createDataFrame([("a", 0, None, ""), ("b", 5, "p", "main"), ("c", None, "p", None)], "repo string, stars bigint, pushed_at string, default_branch string")
    meta = spark.createDataFrame([("a", 7, "q", "dev"), ("b", 9, "q", "dev")], "repo string, stargazers_count bigint, pushed_at string, default_branch string")
    got = {r.repo: (r.stars, r.pushed_at, r.default_branch, r.updated) for r in inc.backfill_stars(rows, meta).collect()}
    assert got == {"a": (7, "q", "dev", True), "b": (5, "p", "main", False), "c": (None, "p", None, False)}


def test_exclusion_by_key_and_single_repo(spark):
    rows = spark.createDataFrame([("k1", "r1"), ("k2", "r2"), ("k3", "r3"), ("k4", "r3")], "key string, repo string")
    seen = spark.createDataFrame([("k1", "r9"), (None, "r2"), ("k9", "r3")], "key string, repo string")
    assert {r.key for r in inc.exclude_seen(rows, seen, "key", seen).collect()} == {"k3", "k4"}


def test_names_match_folders(spark):
    rows = spark.createDataFrame([("r", "My Tool"), ("r", "zzz"), ("q", "gone")], "repo string, name string")
    paths = spark.createDataFrame([("r", 0, "a/other/SKILL.md"), ("r", 1, "a/my-tool/SKILL.md")], "repo string, pos int, path string")
    assert {(r.name, r.path) for r in inc.match_by_name(rows, paths, "repo").collect()} == {("My Tool", "a/my-tool/SKILL.md"), ("zzz", "a/other/SKILL.md")}


def test_names_and_folders_as_by_brute_force(spark):
    rng = random.Random(7)
    word = lambda most: "".join(rng.choice("aAb-B") for _ in range(rng.randint(0, most)))
    groups = [None, "p", "q", "r", "only names"]
    names = [(rng.choice(groups), rng.choice([None, "", "-", word(4), word(9), word(24)]), k) for k in range(150)]
    names += names[:9] + [("r", "a" * 300 + "b", 150), ("r", "b" * 70, 151), ("none alike", "a", 152), ("long", "ab " * 20_000 + "Ba b", 153)]
    paths = [(rng.choice([*groups[:4], "only paths"]), 200 - k, rng.choice([f"{word(9)}/SKILL.md", f"x/{word(3)}b{word(20)}/SKILL.md", f"y/{word(5)}b/z"])) for k in range(60)]
    paths += [("r", 0, "a/" + "b" * 65 + "/SKILL.md"), ("r", 1, "c/" + "a" * 260 + "B/SKILL.md"), ("none alike", 5, "zz/SKILL.md"), ("none alike", 4, "yy/SKILL.md"), ("none alike", None, "a/SKILL.md"), ("q", 250, "SKILL.md"), ("long", 1, "bbb/SKILL.md"), ("long", 2, "ab-abb-ab/SKILL.md")]
    plain = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    want = []
    for group, name, k in names:
        own = sorted((pos, path) for by, pos, path in paths if by == group and group and pos is not None)
        like = [path for _, path in own if (f := plain(["", *path.split("/")][-2])) in plain(name) or plain(name) in f]
        want += [(group, name, k, (like or [path for _, path in own])[0])] if own else []
    rows = spark.createDataFrame(names, "repo string, name string, k int")
    got = inc.match_by_name(rows, spark.createDataFrame(paths, "repo string, pos int, path string"), "repo")
    assert got.columns == ["repo", "name", "k", "path"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) and len({r[3] for r in want}) > 10


def test_names_of_one_repository_do_not_meet_all_its_paths(spark):
    """A repository with a tenth of all names and paths must not be joined as all their pairs."""
    code = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:14]
    rows = spark.createDataFrame([("r", f"{code(i)} x") for i in range(1200)], "repo string, name string")
    paths = spark.createDataFrame([("r", i, f"a/{code(i)}/SKILL.md") for i in range(600, 1800)], "repo string, pos int, path string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r.name: r.path for r in inc.match_by_name(rows, paths, "repo").collect()}
    assert got == {f"{code(i)} x": f"a/{code(max(i, 600))}/SKILL.md" for i in range(1200)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, ran = 0, store.executionsList()
    for k in range(before, ran.size()):
        x = ran.apply(k).executionId()
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(v.get().replace(",", "")))
    assert 1200 <= most < 40_000


def test_release_deltas(spark):
    log = spark.createDataFrame([("d2", 5), ("d1", 3), ("d3", None), ("d4", 4), ("d2", 5)], "date string, skill_count bigint")
    assert [(r.date, r.delta) for r in inc.release_deltas(log).orderBy("date").collect()] == [("d1", None), ("d2", 2), ("d3", None), ("d4", -1)]


def test_upsert_and_firsts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert {tuple(r) for r in inc.upsert(a, spark.createDataFrame([("y", 3)], "k string, v int"), "k").collect()} == {("x", 1), ("y", 3)}
    b = spark.createDataFrame([("x", 2), ("x", 1)], "k string, v int")
    assert inc.first_per_key(b, "k", ["v"]).collect()[0].v == 1 and inc.latest_per_key(b, "k", ["v"]).collect()[0].v == 2


def test_numbering_is_gapless(spark):
    got = inc.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("o")), "o", 128).orderBy("o").collect()
    assert [r.row_no for r in got] == list(range(1000)) and got[-1].batch_no == 7


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 9.0, None)], "v double")
    got = {r.v: (r.share, r.above) for r in average_ranks(df, "v", partitions=3).collect()}
    assert got == {1.0: (0.125, 3), 2.0: (0.5, 1), 9.0: (0.875, 0)}
    assert average_ranks(df.limit(0), "v").count() == 0
