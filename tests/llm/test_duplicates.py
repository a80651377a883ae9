"""Problems 5 and 6, against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import fingerprints as fp
from marlstone.llm import history, neardup

SCHEMA = "rec_id bigint, name string, description string"


def word_set(name, text):
    return {w for t in (name, text) if t for w in re.findall(r"[^\W_]+", t.lower())}


def brute(rows, threshold=0.7, least=12):
    part = [(i, word_set(n, t)) for i, n, t in rows if t and len(word_set(None, t)) >= least]
    return {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(part, 2) if len(a & b) >= threshold * len(a | b) - 1e-9}


def corpus(n=500, seed=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2500)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.4:
            name, text = r.choice(rows)[1:]
            ws = (text or "x").split()
            for _ in range(r.randrange(5)):
                k = r.randrange(len(ws))
                ws[k : k + 1] = r.choice([[], [r.choice(vocab)], [ws[k], r.choice(vocab)]])
                ws = ws or ["x"]
            if r.random() < 0.3:
                r.shuffle(ws)
            rows.append((i, r.choice([name, None]), " ".join(ws)))
        else:
            rows.append((i, r.choice(vocab), " ".join(r.choices(vocab, k=r.randrange(8, 50)))))
    return rows + [(n, None, None), (n + 1, "a", ""), (n + 2, "b", " !? ")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_pairs_against_brute_force(spark, rows):
    want = brute(rows)
    got = [tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(set(got)) >= 0.98 * len(want) > 100


def test_groups_are_the_components(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.rec_id: r.group_id for r in neardup.near_duplicate_groups(df).collect()}
    assert len({(find(i), g) for i, g in got.items()}) == len(set(got.values())) == len({find(i) for i in got})


@pytest.mark.parametrize("chain", [[1, *range(200, 1, -1)], random.Random(7).sample(range(1, 10_000), 1000)], ids=["falling", "random"])
def test_long_chains_are_one_group(spark, chain):
    links = spark.createDataFrame([(min(x), max(x)) for x in itertools.pairwise(chain)], "a bigint, b bigint")
    got = {r.u: r.g for r in neardup.connected_components(links).collect()}
    assert got == dict.fromkeys(chain, min(chain))
    with pytest.raises(RuntimeError):
        neardup.connected_components(links, max_rounds=2)


def test_copies_case_order_and_marks(spark):
    text = " ".join(f"Word{i}," for i in range(15))
    rows = [(1, "n", text), (2, "N", text.upper()), (3, "n!", " ".join(reversed(text.split()))), (4, None, text), (5, "other", " ".join(text.split()[:11]))]
    assert {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}


def test_large_class_stays_linear(spark):
    rows = [(i, "n", " ".join(f"w{k}" for k in range(20))) for i in range(60)]
    members, links = neardup.similar_classes(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in neardup.expand_pairs(members, links, full_class=50).collect()}
    assert got == {(0, i) for i in range(1, 60)}


def test_every_pair_of_large_classes(spark):
    a, b = " ".join(f"w{k}" for k in range(20)), " ".join(f"w{k}" for k in range(1, 21))
    rows = [(i, None, " ".join([*a.split()[i % 20 :], *a.split()[: i % 20]])) for i in range(1100)] + [(i, None, b) for i in range(1100, 1120)]
    got = neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == got.distinct().where("rec_id_a < rec_id_b").count() == 1120 * 1119 // 2


def variants(n, seed=3):
    """A template with one word that differs, among other texts."""
    r = random.Random(seed)
    same = [f"s{k}" for k in range(24)]
    return [(i, None, " ".join([*same, f"v{i}"])) for i in range(n)] + [(n + i, None, " ".join(f"x{r.randrange(4000)}" for _ in range(25))) for i in range(60)]


def test_hot_blocks_are_paired_in_chunks(spark):
    classed = fp.word_classes(spark.createDataFrame(variants(150), SCHEMA), "rec_id", "name", "description", words_in="description", least_words=12)
    rows = fp.block_rows(fp.fingerprinted(fp.class_names(classed)).select("blocks", "s0", "cls").checkpoint())
    bounds = fp.posterior_bounds(0.7, 0.001)
    plain = {tuple(r) for r in fp.candidate_pairs(rows, bounds).collect()}
    for hot in (7, 150):
        assert {tuple(r) for r in fp.candidate_pairs(rows, bounds, hot=hot).collect()} == plain
    assert len([p for p in plain if p[1] < 150]) == 150 * 149 // 2
    old = rows.where("cls < 100")
    mixed = rows.where("cls >= 100").unionByName(fp.stale(old))
    for hot in (7, 512):
        got = {tuple(r) for r in fp.candidate_pairs(mixed, bounds, hot=hot).collect()}
        assert got == {p for p in plain if p[1] >= 100}


def test_blocks_that_span_arrow_batches(spark):
    classed = fp.word_classes(spark.createDataFrame(variants(90), SCHEMA), "rec_id", "name", "description", words_in="description", least_words=12)
    rows = fp.block_rows(fp.fingerprinted(fp.class_names(classed)).select("blocks", "s0", "cls").checkpoint())
    bounds = fp.posterior_bounds(0.7, 0.001)
    plain = {tuple(r) for r in fp.candidate_pairs(rows, bounds).collect()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for hot in (30, 512):
            assert {tuple(r) for r in fp.candidate_pairs(rows, bounds, hot=hot).collect()} == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_no_rows_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicate_pairs(df).count() == 0 and neardup.near_duplicate_groups(df).count() == 0
    rows = [(1, "n", " ".join(f"w{k}" for k in range(20))), (2, "n", " ".join(f"w{k}" for k in range(20)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(9) for c in ("id", "cls", "key", "hashes", "a", "b")})
    assert neardup.near_duplicate_pairs(df).count() == 1


def test_very_long_text(spark):
    words = [f"v{i}" for i in range(30_000)]
    rows = [(1, None, " ".join(words)), (2, None, " ".join(words[:28_000])), (3, None, " ".join(words[:15_000]))]
    assert {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 2)}


def test_posterior_bounds_rarely_drop_a_pair():
    import numpy as np

    r = np.random.default_rng(0)
    bounds = fp.posterior_bounds(0.7, 0.001)
    agree = r.random((20_000, 64)) < 0.85
    kept = np.ones(20_000, bool)
    for n, least in bounds:
        kept &= agree[:, :n].sum(1) >= least
    assert kept.mean() > 0.985
    unlike = r.random((20_000, 64)) < 0.6
    assert np.mean(np.all([unlike[:, :n].sum(1) >= least for n, least in bounds], axis=0)) < 0.1


REC = "id bigint, load bigint, address string, day int, name string, description string"


def brute_history(rows):
    at = {i: (load, address, day) for i, load, address, day, _, _ in rows}
    pairs = brute([(i, n, t) for i, _, _, _, n, t in rows])
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = set()
    for i, (load, address, day) in at.items():
        old = [j for j, (l, a, _) in at.items() if l < load and a is not None and a == address]
        prior = old if old and day <= max(at[j][2] for j in old) else []
        prior = prior + [j for j in near.get(i, ()) if at[j][0] < load and (at[j][1] is None or at[j][1] != address)]
        if prior:
            out.add((min(prior), i))
    return out


def batches(seed=6, n=400):
    r = random.Random(seed)
    texts = corpus(n, seed)
    out = []
    for k, (_, name, text) in enumerate(texts):
        out.append((k * 3 % 1009, k * 6 // len(texts) + 1, r.choice([None, "", *[f"a{i}" for i in range(60)]]) or None, r.choice([-(2**31), 5, 6, 7]), name, text))
    return out


def test_history_against_brute_force(spark):
    rows = batches()
    want = brute_history(rows)
    got = {tuple(r) for r in history.nothing_new(spark.createDataFrame(rows, REC)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want) and len(want) > 50


def test_batch_by_batch_is_the_same(spark, tmp_path):
    rows = batches(seed=8, n=250)
    df = spark.createDataFrame(rows, REC)
    index, got = history.HistoryIndex(spark, str(tmp_path / "index")), set()
    for load in range(1, 7):
        part = df.where(F.col("load") == load)
        got |= {tuple(r) for r in index.check(part).collect()}
        if load == 3:  # a batch that is checked again gives the same and adds nothing
            again = {tuple(r) for r in index.check(part).collect()}
            assert again == {x for x in got if x[1] in {r.id for r in part.collect()}}
    assert got == {tuple(r) for r in history.nothing_new(df).collect()}


def test_a_batch_is_all_that_is_fingerprinted(spark, tmp_path, monkeypatch):
    rows = batches(seed=9, n=240)
    df = spark.createDataFrame(rows, REC)
    seen, made, compared = [], fp.fingerprinted, []
    monkeypatch.setattr(fp, "fingerprinted", lambda classes: made(classes.cache()) if seen.append(classes.count()) is None else None)
    rest = fp.pruned_pairs
    monkeypatch.setattr(fp, "pruned_pairs", lambda pairs, prints, *a: rest(pairs, prints, *a) if compared.append(prints.count()) is None else None)
    index = history.HistoryIndex(spark, str(tmp_path / "index"))
    known = set()
    for load in range(1, 7):
        index.check(df.where(F.col("load") == load)).collect()
        sets = {frozenset(word_set(n, t)) for _, l, _, _, n, t in rows if l == load and t and len(word_set(None, t)) >= 12}
        assert seen[-1] == len(sets - known)  # classes of the history aren't made again
        known |= sets
    # and of the history only what shares a block is compared: most texts have no relative
    assert compared[-1] < 0.7 * len(known)


def test_history_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], REC)
    assert history.nothing_new(empty).count() == 0
    assert history.HistoryIndex(spark, str(tmp_path / "i")).check(empty).count() == 0
    copies = [(i, 1 + i % 3, "hot", 5, None, None) for i in range(300)]
    got = {r.rec_id: r.prior_rec_id for r in history.nothing_new(spark.createDataFrame(copies, REC)).collect()}
    assert got == {i: 0 for i in range(300) if i % 3}
    with pytest.raises(ValueError):
        history.HistoryIndex(spark, str(tmp_path / "i")).check(spark.createDataFrame(copies, REC))
