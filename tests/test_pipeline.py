"""From raw files to search hits."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.plans import pipeline as p
from marlstone.sources.jsonl import AlignmentError, QualityGateError


def raw(tmp_path):
    a = [{"repo_url": f"https://forge.example/o/r{i}", "name": f"tool {i}", "description": f"Sorts files of kind {i} by {w}", "source": "one", "raw_metadata": {"stars": 5 + i, "topics": ["x"], "platforms": ["codex"]}} for i, w in enumerate("alpha beta gamma delta omega sigma theta kappa lambda".split())]
    b = [{"repo_url": "https://forge.example/O/r7.git/", "name": "later", "description": "A much longer description of kappa sorting", "source": "two", "raw_metadata": {"stars": 40}}, {"repo_url": "https://forge.example/o/none", "source": "two"}, {"repo_url": "https://forge.example/o/gone", "tombstone": True}]
    for name, rows in (("a", a), ("b", b)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"), str(tmp_path / "missing.jsonl")]


def test_from_files_to_hits(spark, tmp_path):
    unified, drops = p.normalize(spark, raw(tmp_path))
    got = {r.repo_url[-2:]: r for r in unified.collect()}
    assert set(got) == {"r5", "r6", "r7", "r8"}
    assert (got["r7"].name, got["r7"].source, got["r7"].stars) == ("tool 7", ["one", "two"], 40)
    assert got["r5"].embedding_text == "tool 5. Sorts files of kind 5 by sigma Categories: x. Platforms: codex."
    assert {tuple(r) for r in drops.collect()} == {("low_stars", "one", 5), ("no_description", "two", 1)}
    out = str(tmp_path / "catalog")
    with pytest.raises(QualityGateError):
        p.write_catalog(unified, out, 5)
    assert p.write_catalog(unified, out, 4) == 4

    meta, e = spark.read.parquet(out), p.hash_embedder(32)
    index = p.CatalogIndex(spark, str(tmp_path / "index"))
    with pytest.raises(p.NoIndexError):
        index.search("x", e)
    first = meta.where("stars < 13")
    vectors = p.embed(first, e)
    with pytest.raises(AlignmentError):
        index.build(meta, vectors, "m1")
    index.build(first, vectors, "m1")
    with pytest.raises(p.IncrementalError):
        index.update(meta, e, "m2")
    assert index.update(meta, e, "m1") == 2 and index.update(meta, e, "m1") == 0
    assert index._state()["count"] == 4 and index.metadata().count() == 4
    # appended rows are coded with the ranges of the first ones; an index over all rows finds each of them first
    whole = p.CatalogIndex(spark, str(tmp_path / "whole"))
    whole.build(meta, p.embed(meta, e), "m1")
    for r in meta.collect():
        assert r.id in {x.skill_id for x in index.search(r.embedding_text, e, propose=2).collect()}
        top = whole.search(r.embedding_text, e, propose=2).orderBy("place").collect()
        assert top[0].skill_id == r.id and top[0].sim_score > 0.95 and len(top) <= 6
    assert index.search("kappa", e, F.col("stars") > 30).count() == 1
    tiers = index.search_in_tiers("sorts files of kind", e, [F.col("stars") > 1000, F.lit(True)], enough=1, good=0.0)
    assert tiers.count() == 4


def test_cached_vectors_are_kept(spark):
    rows = spark.createDataFrame([("a", "t1"), ("b", "changed"), ("c", "new")], "id string, embedding_text string")
    cache = spark.createDataFrame([("a", "t1", [9.0]), ("b", "t2", [9.0])], "id string, embedding_text string, embedding array<float>")
    got = {r.id: r.embedding for r in p.embed(rows, lambda ts: np.full((len(ts), 1), 1.0), cache=cache).collect()}
    assert got == {"a": [9.0], "b": [1.0], "c": [1.0]}


def test_small_parts(spark, tmp_path):
    buf = io.BytesIO()
    np.save(buf, np.eye(2, dtype=np.float32))
    assert p.import_npy(spark, buf.getvalue(), ["a", "b"]).count() == 2
    with pytest.raises(AlignmentError):
        p.import_npy(spark, buf.getvalue(), ["a"])
    p.add_filtered(spark, str(tmp_path / "f"), spark.createDataFrame([("u",)], "url string"), "no_document")
    assert spark.read.json(str(tmp_path / "f")).collect()[0].reason == "no_document"
    w = spark.createDataFrame([("7", 100, 50), (None, 100, 50), (None, None, 50), ("999", None, 50), (None, 10, 50)], "r string, e bigint, n bigint")
    assert [r[0] for r in w.select(p.wait_seconds(F.col("r"), F.col("e"), F.col("n"))).collect()] == [7, 50, 60, 120, 0]
    t = spark.createDataFrame([("index of 42,068 skills, sha256 " + "aB" * 32,), ("nothing",)], "t string")
    assert [tuple(r) for r in t.select(p.parse_count(F.col("t")), p.parse_sha256(F.col("t"))).collect()] == [(42068, "ab" * 32), (None, None)]
