"""Crawl records and states, samples, and the bounds that raise."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import urls
from marlstone.operators import crawl, merge
from marlstone.operators.incremental import numbered
from marlstone.plans import pipeline
from marlstone.session import forget, hash_sample, shared_table
from marlstone.sinks import writers
from marlstone.sources import jsonl


def test_long_rename_lists_settle_circles(spark):
    pairs = {"a": "b", "b": "c", "c": "a", "x": "y", "y": "z", "in": "b", "self": "self"}
    df = spark.createDataFrame(list(pairs.items()), "old string, new string")
    got = {r.old: r.new for r in urls._closed_table(df).collect()}
    want = urls.close_renames(pairs)
    assert {k: v for k, v in got.items() if k != v} == want == {"b": "a", "c": "a", "x": "z", "y": "z", "in": "a"}


def test_triggers_keep_the_order_of_records(spark):
    rows = [("k", 1, [f"t{i}" for i in range(2000)]), ("k", 2, ["late", "t5"])]
    df = spark.createDataFrame(rows, "key string, ord bigint, triggers array<string>").withColumns({c: F.lit("x") for c in ("repo_url", "name", "description", "source")})
    assert merge.merge_records(df).collect()[0].triggers == [*rows[0][2], "late"]


def test_numbered_counts_through(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("x"))
    for parts in (None, 9):
        got = sorted((r.x, r.row_no, r.batch_no) for r in numbered(df, "x", 64, parts).collect())
        assert [g[1] for g in got] == list(range(5000)) and all(g[2] == g[1] // 64 for g in got)


def test_hash_sample_is_bounded_and_ignores_copies(spark):
    df = spark.range(40_000).select(F.when(F.col("id") < 20_000, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("t"))
    got = [r.t for r in hash_sample(df, 3000, "t").collect()]
    assert len(got) == len(set(got)) == 3000
    assert got == [r.t for r in hash_sample(df.repartition(5), 3000, "t").collect()]
    assert hash_sample(df.where("t = 'copy'"), 10, "t").count() == 1 and hash_sample(df.limit(0), 10, "t").count() == 0


def test_forgotten_tables_are_gone(spark):
    t = shared_table(spark.range(3).toDF("a"), "gone")
    assert jsonl.exists(spark, t._marlstone_path)
    forget(t)
    assert not jsonl.exists(spark, t._marlstone_path)


def test_bounds_raise(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame([(f"d{i}", i, 1) for i in range(5)], "date string, skill_count bigint, delta bigint")
    assert writers.release_markdown(log, 5).splitlines()[2].startswith("| d4 |")
    with pytest.raises(ValueError):
        writers.release_markdown(log, 4)
    monkeypatch.setattr(jsonl, "MANIFEST_LINES", 2)
    (tmp_path / "m").write_text("a: 1\nb: 2\nc: 3\n")
    with pytest.raises(jsonl.CorruptFileError):
        jsonl.read_manifest(spark, str(tmp_path / "m"))


def test_blocks_between_marks():
    text = "x <!-- stats:a:start -->1<!-- stats:a:end --> y <!-- stats:b:start -->\n2\n<!-- stats:b:end --> <!-- stats:c:start -->3"
    got, names = writers.rewrite_blocks(text, {"b": "8", "a": "9", "c": "7", "d": "6"})
    assert got == "x <!-- stats:a:start -->9<!-- stats:a:end --> y <!-- stats:b:start -->\n8\n<!-- stats:b:end --> <!-- stats:c:start -->3" and names == ["a", "b"]
    assert writers.rewrite_blocks("no marks", {"a": "1"}) == ("no marks", [])
    assert writers.rewrite_blocks("[a start]1[a end]", {"a": "2\n3"}, "[{name} {end}]")[0] == "[a start]\n2\n3\n[a end]"


def test_shard_states(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "shard string, n bigint")
    one = crawl.advance_shards(None, run(("a", 949), ("b", 1000)))
    two = crawl.advance_shards(one, run(("a", 5), ("b", 10), ("c", 950)))
    assert {r.shard: r[1:] for r in two.collect()} == {"a": (949, 1, True), "b": (1010, 2, True), "c": (950, 1, False)}
    assert crawl.advance_shards(one, run()).count() == 2


def test_update_status(spark):
    rows = [(False, True, "a", "a", False), (True, False, "a", "a", False), (True, True, "aB", "Ab", False), (True, True, "a", "b", False), (True, True, None, "b", False), (True, True, None, "b", True), (False, True, None, "b", True)]
    df = spark.createDataFrame(rows, "stale boolean, apply boolean, expected string, actual string, force boolean")
    got = [r[0] for r in df.select(crawl.update_status(*map(F.col, df.columns))).collect()]
    assert got == ["up_to_date", "update_available", "updated", "error", "error", "updated", "updated"]


def test_candidates_and_first_documents(spark):
    repos = spark.createDataFrame([("r1", "n"), ("r2", None), ("r3", "m")], "repo string, name string")
    repos = repos.select("repo", crawl.candidate_paths(F.col("name")).alias("candidates"))
    assert {r.repo: len(r.candidates) for r in repos.collect()} == {"r1": 10, "r2": 6, "r3": 10}
    contents = spark.createDataFrame([("r1", "skill/SKILL.md", "---"), ("r1", "skills/n/SKILL.md", "x"), ("r3", "SKILL.md", "---")], "repo string, path string, text string")
    got = {r.repo: (r.branch, r.path, r.tried) for r in crawl.first_document(repos, contents, F.col("text") == "---").collect()}
    assert got == {"r1": ("main", "skill/SKILL.md", 7), "r2": (None, None, 6), "r3": ("main", "SKILL.md", 1)}


def test_flags_and_raw_records(spark):
    df = spark.createDataFrame([("https://forge.example/Own/r.git", "n", None), ("https://else.example/own/r", "n", "d"), (None, None, None)], "repo_url string, name string, description string")
    url = F.col("repo_url")
    flags = [tuple(r) for r in df.select(crawl.owner_flag(url, "forge.example", "own"), crawl.repo_flag(url, "forge.example", "own/r")).collect()]
    assert flags == [(True, True), (False, False), (False, False)]
    raw = crawl.raw_record(df, "s", url, F.col("name"), F.col("description"), {"stars": F.lit(1)}, url).collect()
    assert len(raw) == 2 and raw[0].description == "" and raw[0].raw_metadata.stars == 1
    dead = crawl.tombstones(df, "s", F.lit("2025-01-01")).collect()
    assert all(r.tombstone for r in dead) and len(dead) == 3


def test_embedding_goes_on_where_it_broke_off(spark, tmp_path):
    rows = spark.createDataFrame([(f"id{i:03d}", f"text {i}") for i in range(300)] + [("id999", None)], "id string, embedding_text string")
    made = spark.sparkContext.accumulator(0)
    inner = pipeline.hash_embedder(8)

    def counting(texts):
        made.add(len(texts))
        return inner(texts)

    log = str(tmp_path / "log")
    whole = {r.id: tuple(r.embedding) for r in pipeline.embed_resumable(rows, counting, log, batch=64).collect()}
    assert len(whole) == 301 and made.value == 301
    again = {r.id: tuple(r.embedding) for r in pipeline.embed_resumable(rows, counting, log, batch=64).collect()}
    assert again == whole and made.value == 301  # every batch was in the log
    pipeline.finish(spark, log)
    assert not jsonl.exists(spark, log)


def test_rendered_reports(spark):
    from marlstone.operators import stats

    hist = spark.createDataFrame([("1–9", 7), ("0", 1)], "bucket string, n bigint")
    got = [r.line for r in writers.distribution_lines(hist, stats.DOC_BUCKETS).orderBy("place").collect()]
    assert got == ["| 0 | 1 | ██" + "░" * 18 + " 12% |", "| 1–9 | 7 | " + "█" * 18 + "░░ 88% |", "| **Total** | **8** | |"]
    df = spark.createDataFrame([("b", 2000 if i else 0, "x" if i % 2 else " ") for i in range(4)] + [("a", 12, "x")], "source string, stars bigint, description string")
    lines = writers.source_report(stats.source_stats(df, "source", "stars", "description")).splitlines()
    assert lines[1].split() == ["a", "1", "0", "(0.0%)", "0", "(0.0%)", "12", "12"]
    assert lines[2].split() == ["b", "4", "2", "(50.0%)", "!", "1", "(25.0%)", "!", "2.0k", "2.0k"] and lines[3].split()[:3] == ["TOTAL", "5", "2"]
    with pytest.raises(ValueError):
        writers.source_report(stats.source_stats(df, "source", "stars", "description"), 1)
