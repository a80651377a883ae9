"""Vector search and the column profile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import vectors as vec
from marlstone.operators.profile import Profile, flat_columns, odd_points


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>, label int").repartition(3)
    return x.astype(np.float32).astype(float), df


def test_exact_top_k(data):
    x, df = data
    got = vec.exact_top_k(df, df.where("vec_id < 5"), 7)
    s = np.round(x[:5] @ x.T, 6)
    for q in range(5):
        want = sorted(range(400), key=lambda i: (-s[q, i], i))[:7]
        assert [r.id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_queries_in_blocks(data, monkeypatch):
    _, df = data
    want = {tuple(r) for r in vec.exact_top_k(df, df.where("vec_id < 9"), 3).collect()}
    monkeypatch.setattr(vec, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in vec.exact_top_k(df, df.where("vec_id < 9"), 3).collect()} == want


def test_quantized_and_inverted_lists(data):
    _, df = data
    q = df.where("vec_id % 50 = 0")
    truth = vec.exact_top_k(df, q, 10)
    recall = lambda found: vec.recall_at_k(found, truth, 10).collect()[0][0]
    assert recall(vec.VectorIndex.build(df).search(q, 10)) > 0.9
    index = vec.VectorIndex.build(df, lists=8)
    few, more = recall(index.search(q, 10)), recall(index.search(q, 10, nprobe=8))
    assert few <= more and more > 0.9


def test_recall_of_the_production_index(spark):
    from marlstone.plans.catalogue import QUERIES

    for size in ("sf0.001", "sf0.1"):
        assert QUERIES["recall_ivf"](spark, f"/root/testdata/{size}").collect()[0].recall >= 0.9


def test_append_uses_stored_ranges(data):
    _, df = data
    half = vec.VectorIndex.build(df.where("vec_id < 200"), lists=1).append(df.where("vec_id >= 200"))
    assert half.table.count() == 400
    q = df.where("vec_id = 300")
    assert half.search(q, 1).collect()[0].id == 300


def test_post_filter_may_leave_few(data):
    _, df = data
    hits = vec.exact_top_k(df, df.where("vec_id = 0"), 12)
    rows = df.select(F.col("vec_id").alias("id"), "label")
    got = vec.search(hits, rows, F.col("label") == 1, 2)
    assert got.count() <= 6 and {r.label for r in got.collect()} <= {1}
    assert vec.search(hits, rows, F.col("label") == 99, 2).count() == 0


def test_attribute_filters(spark):
    df = spark.createDataFrame([(1, ["a", None], ["s"], 10, True), (2, ["b"], ["t"], 9, None), (3, None, ["s"], 11, False)], "i int, platforms array<string>, source array<string>, stars bigint, safety_scan boolean")
    ids = lambda **k: [r.i for r in df.where(vec.attribute_filter(**k)).orderBy("i").collect()]
    assert ids() == [1, 2, 3] and ids(platforms=["a", "b"]) == [1, 2] and ids(platforms=["b"], sources=["s"]) == []
    assert ids(min_stars=10) == [1, 3] and ids(safety_only=True) == [1]


def test_zero_vector_and_no_queries(spark, data):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert df.select(vec.l2_normalize(F.col("embedding"))).collect()[0][0] == [0.0, 0.0]
    assert vec.exact_top_k(data[1], data[1].limit(0), 3).count() == 0


def loads(spark, change=None, n=8, per=60):
    rows = []
    for k in range(1, n + 1):
        for i in range(per):
            text, stars = f"Helps with item {i % 37} of list {(i * 7) % 23}.", (i * i) % 90 + 1
            if k == 3 and change:
                text, stars = change(text, stars, i)
            rows.append((k, text, stars))
    return spark.createDataFrame(rows, "load int, t string, s bigint")


CHANGES = {
    "nulls": (lambda t, s, i: (None if i % 3 else t, s), "t"),
    "blank": (lambda t, s, i: (" " if i % 3 else t, s), "t"),
    "constant": (lambda t, s, i: ("..." if i % 3 else t, s), "t"),
    "cut": (lambda t, s, i: (t[:9], s), "t"),
    "upper": (lambda t, s, i: (t.upper(), s), "t"),
    "markup": (lambda t, s, i: (f"<p>{t}</p>", s), "t"),
    "thousands": (lambda t, s, i: (t, s * 1000), "s"),
    "negative": (lambda t, s, i: (t, -1 if i % 3 else s), "s"),
    "zero": (lambda t, s, i: (t, 0 if i % 4 else s), "s"),
}


@pytest.mark.parametrize("name", CHANGES)
def test_odd_load_is_named(spark, name):
    change, column = CHANGES[name]
    df = loads(spark, change)
    got = Profile(df, [("t", F.col("t")), ("s", F.col("s").cast("string"))], F.col("load")).odd_loads()
    assert {(r["col"], r.load) for r in got.collect()} == {(column, "3")}


def test_even_loads_give_no_finding(spark):
    assert Profile(loads(spark), load=F.col("load")).odd_loads().where("col <> 'load'").count() == 0


def test_few_loads_and_empty_table(spark):
    assert Profile(loads(spark, n=3), load=F.col("load")).odd_loads().count() == 0
    p = Profile(loads(spark).limit(0), load=F.col("load"))
    assert p.columns().count() == 0 and p.odd_loads().count() == 0


def test_column_profile(spark):
    df = spark.createDataFrame([("AB-12", 1, ["x"]), ("CD-34", 2, None), (None, 2, ["x"]), (" ", None, ["x"]), ("EF-56", 7, ["y"])] + [(f"GH-{i}", 3, ["z"]) for i in range(10, 60)], "code string, value int, n array<string>")
    got = {r["col"]: r for r in Profile(df).columns().collect()}
    c = got["code"]
    assert (c.n_rows, c.n_null, c.n_blank, c.n_nonconforming) == (55, 1, 1, 0)
    assert got["value"].max_number == 7 and got["n"].n_distinct == 3
    assert {r.expression for r in Profile(df).expressions().where("col = 'code'").collect()} == {"AA-99"}


def test_odd_value_conforms_to_nothing(spark):
    df = spark.createDataFrame([(f"AB-{i}",) for i in range(100, 400)] + [("§",)], "code string")
    assert Profile(df).columns().collect()[0].n_nonconforming == 1


def test_nested_names(spark):
    df = spark.createDataFrame([((1, {"a": 2.0}),)], "r struct<`x y`:int, m:map<string,double>>")
    assert [n for n, _ in flat_columns(df.schema)] == ["r.x y", "r.m"]


def test_odd_points(spark):
    rows = [(f"2025-01-{i:02d}", 1000 + 10 * i) for i in range(1, 29)]
    bad = {5: 0, 10: 10_100, 15: -1150, 20: 600, 25: 999_999_999}
    rows = [(d, bad.get(i, v)) for i, (d, v) in enumerate(rows, 1)] + [("2025-01-29", None), (None, 5), rows[2]]
    got = odd_points(spark.createDataFrame(rows, "date string, n bigint"), "date", "n")
    assert {r.date for r in got.collect()} == {f"2025-01-{i:02d}" for i in bad}


def test_long_values_get_real_expressions(spark):
    garbage = [("".join(chr(0x4E00 + (i * 7919 + k * 104729) % 20000) for k in range(90)),) for i in range(5)]
    prose = [(" ".join(["plain words follow one another here"] * 3) + f" case {i}.",) for i in range(40)]
    got = {r.expression: r.n for r in Profile(spark.createDataFrame(prose + garbage, "v string")).expressions().collect()}
    assert "…" not in got and got.get(None) == 5 and sum(got.values()) == 45


def test_expressions_are_applicable(spark, sf):
    from marlstone.operators.profile import PATH, _cells, expression_regex, induced_expressions, level_label

    texts = ["Sorts lists, quickly. Then it's done!", "Packs 20 files. Reads them again; stops.", "v1.2.3", "2024-01-05", "a+b (c) [d]", "日本語のテキスト。", "UPPER", "x", "tab\tand\nline", "naïve l'été", "[Ab]+.", "(w )+", "50% off"]
    df = spark.createDataFrame([(t,) for t in texts] + [(f"{2000 + i}-01-{10 + i % 9}",) for i in range(40)], "t string").unionByName(spark.read.parquet(f"{sf}/skillsmp.parquet").select(F.col("description").alias("t")))
    cells = _cells(df, flat_columns(df.schema), F.lit("all")).where("h3 is not null").cache()
    for level in range(4):
        regex = expression_regex(F.lit(level), level_label(F.lit(level), F.col("value")))
        odd = [r.value for r in cells.select("value", regex.alias("r")).where("not value rlike r").collect()]
        assert len(odd) <= (1 if level else 0), (level, odd)
    got = cells.join(induced_expressions(cells), PATH).where("level is not null")
    fits = got.select(F.rlike(F.col("value"), expression_regex(F.col("level"), level_label(F.col("level"), F.col("value")))).alias("ok"))
    assert fits.count() > 100 and fits.where("not ok").count() == 0
    shown = Profile(df).expressions()
    assert set(shown.columns) == {"col", "expression", "regex", "load", "n"} and shown.where("expression is not null").count() > 10


def test_many_blocks_of_queries_are_one_result(data, monkeypatch):
    _, df = data
    whole = {tuple(r) for r in vec.exact_top_k(df, df, 3).collect()}
    index = vec.VectorIndex.build(df, lists=8)
    coded = {tuple(r) for r in index.search(df, 3, nprobe=3).collect()}
    monkeypatch.setattr(vec, "QUERY_BLOCK", 150)
    assert {tuple(r) for r in vec.exact_top_k(df, df, 3).collect()} == whole
    assert {tuple(r) for r in index.search(df, 3, nprobe=3).collect()} == coded
