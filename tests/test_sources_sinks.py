"""Readers, writers, streams, recorded services."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from marlstone.sinks import writers
from marlstone.sources import documents as docs
from marlstone.sources import jsonl, recorded
from marlstone.streaming.append import append_unseen, read_appended


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_tolerant_scan_keeps_order(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", [{"repo_url": f"u{i}", "name": "n"} for i in range(30)] + ['{"repo_url": "cut'])
    b = lines(tmp_path / "b.jsonl", [{"repo_url": "v", "raw_metadata": {"stars": 3, "topics": ["t"]}}, "", "   ", {"repo_url": "t", "tombstone": True}, {"name": "no url"}])
    got = jsonl.scan_records(spark, [a, str(tmp_path / "missing"), b]).orderBy("ord").collect()
    assert [r.repo_url for r in got] == [f"u{i}" for i in range(30)] + ["v"]
    assert got[-1].raw_metadata.stars == 3


def test_scan_of_missing_files(spark, tmp_path):
    assert jsonl.scan_records(spark, [str(tmp_path / "none")]).count() == 0


@pytest.mark.parametrize("good,bad,fails", [(1, 20, True), (5, 1, False), (100, 6, False), (50, 6, True), (40, 5, False)])
def test_corrupt_gate(spark, tmp_path, good, bad, fails):
    p = lines(tmp_path / "x.jsonl", [{"repo_url": "u"}] * good + ["{broken"] * bad)
    if fails:
        with pytest.raises(jsonl.CorruptFileError):
            jsonl.scan_records(spark, [p])
    else:
        assert jsonl.scan_records(spark, [p]).count() == good


def test_folder_scan_uses_the_stem(spark, tmp_path):
    lines(tmp_path / "feed.jsonl", [{"repo_url": "a"}, {"repo_url": "b", "source": "own"}, "{bad", {"repo_url": "c", "tombstone": True}])
    assert {(r.repo_url, r.source) for r in jsonl.scan_folder(spark, str(tmp_path)).where("repo_url is not null").collect()} == {("a", "feed"), ("b", "own")}


def test_caches_manifest_progress(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": "1", "b": "2"}')
    assert {tuple(r) for r in jsonl.read_object_cache(spark, str(tmp_path / "c.json"), "string").collect()} == {("a", "1"), ("b", "2")}
    (tmp_path / "bad.json").write_text("[1")
    assert jsonl.read_object_cache(spark, str(tmp_path / "bad.json"), "string").count() == 0
    assert jsonl.read_object_cache(spark, str(tmp_path / "no.json"), "string").count() == 0
    (tmp_path / "v.txt").write_text(writers.manifest_line("2025-01-01", 3, "m:1", "x", "y"))
    assert jsonl.read_manifest(spark, str(tmp_path / "v.txt"), ("date",))["embed_model"] == "m:1"
    with pytest.raises(KeyError):
        jsonl.read_manifest(spark, str(tmp_path / "v.txt"), ("nope",))
    b64 = lambda b: base64.b64encode(b).decode()
    p = lines(tmp_path / "p.jsonl", [{"batch_idx": 0, "record_ids": ["a"], "vectors_b64": b64(b"1")}, "{x", {"batch_idx": 0, "record_ids": ["a"], "vectors_b64": b64(b"2")}])
    assert [bytes(r.vectors) for r in jsonl.read_progress(spark, p).collect()] == [b"2"]


def test_gate_and_atomic_replace(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(jsonl.QualityGateError):
        writers.write_gated(df, str(tmp_path / "g"), 4)
    assert not (tmp_path / "g").exists()
    writers.write_gated(df, str(tmp_path / "g"), 3)
    t = str(tmp_path / "t")
    writers.replace_atomically(df, t)
    writers.replace_atomically(spark.read.parquet(t).where("id < 2"), t)
    assert spark.read.parquet(t).count() == 2 and len(list(tmp_path.iterdir())) == 2


def test_alignment(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",)], "id string")
    writers.check_alignment(a, a)
    with pytest.raises(jsonl.AlignmentError):
        writers.check_alignment(a, b)


def test_block_rewrite():
    text = "a <!-- stats:n:start -->1<!-- stats:n:end --> b <!-- stats:other:start -->2<!-- stats:other:end -->"
    got, names = writers.rewrite_blocks(text, {"n": "9"})
    assert got == text.replace("-->1<", "-->9<") and names == ["n"]
    assert writers.rewrite_blocks(got, {"n": "9"})[0] == got


def test_hashes_and_rendering(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert writers.file_hashes(spark, str(tmp_path / "f")).collect()[0].sha256.startswith("ba7816bf")
    df = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    assert writers.table_hash(df) == writers.table_hash(df.orderBy("y").repartition(3)) != writers.table_hash(df.limit(1))
    md = writers.release_markdown(spark.createDataFrame([("d1", 1000, None), ("d2", 1500, 500)], "date string, skill_count bigint, delta bigint"))
    assert "| d2 | 1,500 | +500 |" in md and md.index("d2") < md.index("d1")


def test_front_matter(spark):
    df = spark.createDataFrame([("<!-- c -->\n---\nname: a\ntriggers: [x, y]\n---\nbody",), ("no",), ("---\n: [\n---\n",), (None,), ("---\n- 1\n---\n",)], "t string")
    assert [json.loads(r[0]) for r in df.select(docs.frontmatter_json("t")).collect()] == [{"name": "a", "triggers": ["x", "y"]}, {}, {}, {}, {}]


def test_html_and_links(spark):
    page = '<html><title> T </title><meta name="d" content="m"><a href="https://x/1">one <b>two</b></a><script>no</script>text</html>'
    r = spark.createDataFrame([(page,), (None,)], "t string").select(docs.html_parts("t").alias("h")).collect()
    assert (r[0].h.title, r[0].h.meta, r[0].h.links[0].text) == ("T", {"d": "m"}, "one two") and "no" not in r[0].h.text
    assert r[1].h.links == []
    doc = "## A\n- [n](https://x/1) — first\ntext\n## B\r\n* [m](https://x/2)\n- [bad](nolink)"
    got = docs.link_list(spark.createDataFrame([(1, doc), (2, "- [q](https://x/3) - d"), (3, None)], "i int, t string"), "i", "t")
    assert {(r.i, r.category, r.name, r.description) for r in got.collect()} == {(1, "A", "n", "first"), (1, "B", "m", ""), (2, "", "q", "d")}


def test_html_of_every_page(spark, tmp_path):
    from marlstone.plans.catalogue import QUERIES

    spark.createDataFrame([(1, '<A HREF="x">one</A>'), (2, "<p>two</p>"), (3, None), (4, '<a href="y">z</a>')], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_links, r.n_text) for r in QUERIES["html_pages"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 3), 2: (0, 3), 3: (0, 0), 4: (1, 1)}


def test_paths_and_candidates(spark):
    df = spark.createDataFrame([("a/b/SKILL.md", "../c/X.md")], "b string, t string")
    assert df.select(docs.join_path("b", "t")).collect()[0][0] == "a/c/X.md"
    c = spark.createDataFrame([("k", ["u1", "u2", "u3"])], "k string, urls array<string>")
    have = spark.createDataFrame([("u3", "three"), ("u2", "two"), ("u1", None)], "url string, content string")
    assert docs.first_found(c, have, "k").collect()[0].content == "two"
    rules = spark.createDataFrame([("x.example", "/", True), ("x.example", "/private", False)], "host string, prefix string, allow boolean")
    urls = spark.createDataFrame([("https://x.example/private/a",), ("https://x.example/b",), ("https://y.example/",)], "url string")
    assert {r.url[-2:]: r.allowed for r in docs.allowed(rules, urls).collect()} == {"/a": False, "/b": True, "e/": True}


def test_recorded_search(spark, tmp_path):
    item = lambda i: {"id": i, "repo": f"r{i}"}
    (tmp_path / "s1.json").write_text(json.dumps({"pages": [{"total_count": 5, "items": [item(1), item(2)]}, {"total_count": 5, "items": [item(2), item(3)]}, {"total_count": 5, "items": []}, {"total_count": 5, "items": [item(9)]}]}))
    (tmp_path / "s2.json").write_text(json.dumps({"pages": [{"total_count": 2, "items": [item(3), item(4)]}, {"total_count": 2, "items": [item(8)]}]}))
    spark.dataSource.register(recorded.RecordedSearch)
    df = spark.read.format("recorded_search").option("path", str(tmp_path)).option("per_page", 2).load()
    assert {(r.shard, r.item_id) for r in df.collect()} == {("s1", 1), ("s1", 2), ("s1", 3), ("s2", 3), ("s2", 4)}
    assert [r.repo for r in recorded.discover([df.where("shard = 's2'"), df], "repo").collect()] == ["r3", "r4", "r1", "r2"]
    assert df.sparkSession.read.format("recorded_search").option("path", str(tmp_path)).option("limit", 1).load().count() == 2
    assert recorded.shard_grid({"size": ["a", "b"], "stars": ["0"]}) == ["size:a|stars:0", "size:b|stars:0"]


def test_stream_appends_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "id string, v int").write.parquet(src)
    schema = spark.read.parquet(src).schema
    append_unseen(spark.readStream.schema(schema).parquet(src), out, "id", ck).awaitTermination()
    spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int").write.mode("append").parquet(src)
    append_unseen(spark.readStream.schema(schema).parquet(src), out, "id", ck).awaitTermination()
    assert {tuple(r) for r in read_appended(spark, out).select("id", "v").collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_base64_and_documents(spark):
    df = spark.createDataFrame([("aGVs\nbG8=", "x" * 201), (None, None)], "b string, t string")
    r = df.select(docs.decode_base64(F.col("b")).alias("b"), docs.looks_like_document(F.col("t")).alias("l")).collect()
    assert (r[0].b, r[0].l, r[1].b, r[1].l) == ("hello", True, None, False)
