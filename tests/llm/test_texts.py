"""Problems 3, 7, 8 and 9."""

import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import bpe, language, packing, spam
from marlstone.session import table

# --- tokens ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(), special_tokens={})


TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world", "don't  we'll I'M", "a\r\n\tb\x0b\x0cc\x1cd\x85e f", "<|endoftext|>", "中文字符。日本語のテキスト、カタカナ", "한국어 텍스트", "Привет, мир", "naïve café ́e",
    "😀👍🏽 e‍", "﻿BOM �", "x²½Ⅷ٣", "a" * 5000, "ab" * 3000, "-" * 4000, "word " * 2000, "  x", "'s't're", "1234567 89", "tab\tend ", "龍喚士 裏覚醒 ーン",
]


def test_ids_of_hard_texts(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "chunk", "word", "ids")})
    got = {r.doc_id: r.ids for r in bpe.encode(df, chunk_chars=300).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_ids_of_documents_and_back(spark, sf, reference):
    d = table(spark, sf, "documents")
    got = bpe.encode(d).join(d.select("doc_id", "text"), "doc_id").withColumn("back", bpe.decode(F.col("ids")))
    for r in got.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.back).decode() == (r.text or "")


def test_no_documents_and_equal_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "a b")], "doc_id bigint, text string")
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.encode(df).count() == 3


def test_decoding_unknown_and_no_ids(spark):
    df = spark.createDataFrame([([],), ([999_999],), ([15496, 995],)], "ids array<int>")
    assert bytes(df.select(bpe.decode(F.col("ids"))).collect()[0][0]) == b""


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_join_to_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert b"".join(bpe.splitter()(text)) == text.encode()


def test_words_of_parts_give_the_ids_of_the_text(reference):
    merge, cuts, r = bpe._heap_merger("byte_bpe_50k", bpe.TOKENIZER_DIR), bpe._cuts("byte_bpe_50k", bpe.TOKENIZER_DIR), random.Random(3)
    for _ in range(1000):
        texts = ["".join(r.choices("abst'relvdm  \n\t\x1c\x85\xa0\u3000é中文。、12²٣😀-_\x00", k=r.randrange(30))) for _ in range(r.randrange(1, 4))]
        parts = [(i, p) for i, t in enumerate(texts) for p in bpe._parts(t, r.randrange(1, 9))]
        words, counts = bpe._split([p for _, p in parts], cuts)
        got: list[list[int]] = [[] for _ in texts]
        for i, w in zip(np.repeat([i for i, _ in parts], counts), words.to_pylist()):
            got[i] += merge(w)
        assert got == [reference.encode_ordinary(t) for t in texts]


def test_ids_of_texts_that_are_split_in_parts(spark, reference):
    texts = ["it's  a line\n中文 é " * 40_000, "", "x" * 300 + " 'tis", None, "naïve, 'll\n\n" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert len(texts[0]) > 2 * bpe.SPLIT_CHARS and got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_words_of_any_script_cost_about_the_same():
    r = random.Random(1)

    def cost(chars: str) -> float:
        text = " ".join("".join(r.choices(chars, k=r.randrange(2, 30))) for _ in range(10_000))
        seconds = []
        for _ in range(3):
            split, began = bpe.splitter(), time.thread_time()
            words = split(text)
            seconds.append(time.thread_time() - began)
        return min(seconds) / len(words)

    cost("aé中")
    assert cost("".join(map(chr, range(0x4E00, 0x5E00)))) < 10 * cost("abcdefghij")


def test_heap_merges_like_the_fold(reference):
    merge = bpe._heap_merger("byte_bpe_50k", bpe.TOKENIZER_DIR)
    r = random.Random(1)
    for _ in range(200):
        w = "".join(r.choices("abetnio", k=r.randrange(1, 60)))
        assert merge(w.encode()) == reference.encode_ordinary(w)


# --- containers -------------------------------------------------------------------------------------


def filled(hist, capacity):
    runs = packing.pack(hist, capacity)
    count, room = Counter(), defaultdict(int)
    for n, first, items, box, each in runs:
        assert items % each == 0
        assert first == count[n]
        count[n] += items
        for b in range(items // each):
            room[box + b] += n * each
    return count, room


@pytest.mark.parametrize("seed,capacity,top", [(1, 512, 400), (2, 100, 100), (3, 2048, 300), (4, 64, 63)])
def test_packing_is_whole_and_tight(seed, capacity, top):
    r = np.random.default_rng(seed)
    hist = np.bincount(np.clip(r.lognormal(np.log(top / 4), 0.8, 6000).astype(int), 1, capacity), minlength=capacity + 1)
    count, room = filled(hist, capacity)
    assert count == {n: int(k) for n, k in enumerate(hist) if k and n}
    assert max(room.values()) <= capacity
    total = sum(n * k for n, k in count.items())
    assert len(room) <= 1.03 * -(-total // capacity) + 1


def test_packing_edge_cases():
    assert packing.pack(np.zeros(11, np.int64), 10) == []
    h = np.zeros(11, np.int64)
    h[10] = 3
    assert len(filled(h, 10)[1]) == 3
    h = np.zeros(11, np.int64)
    h[1] = 1_000_000
    assert len(filled(h, 10)[1]) == 100_000


def test_least_squares_is_not_negative_and_close():
    r = np.random.default_rng(0)
    patterns = [(3, 7), (5, 5), (10,), (2, 8), (4, 6)]
    want = r.integers(0, 50, 5)
    hist = np.zeros(11)
    for p, x in zip(patterns, want):
        for n in p:
            hist[n] += x
    got = packing.repeat_counts(patterns, hist, rounds=3000)
    assert (got >= 0).all() and np.allclose(got, want, atol=0.2)


def test_documents_in_containers(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["the"] * r.randrange(1, 30))) for i in range(300)] + [(300, None), (301, ""), (302, " ".join(["the"] * 130)), (303, " ".join(["the"] * 64))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("id", "n", "len", "rank", "spec_id")})
    specs = spark.createDataFrame([(1, 32, "byte_bpe_50k"), (2, 50, "piece_bpe_32k"), (None, 5, "byte_bpe_50k"), (4, 0, "byte_bpe_50k"), (5, 9, None)], "spec_id int, capacity int, tokenizer string")
    got = packing.fill_containers(df, specs).collect()
    for spec, capacity in ((1, 32), (2, 50)):
        mine = [x for x in got if x.spec_id == spec]
        assert {x.doc_id for x in mine} == set(range(304))
        room, parts = defaultdict(int), defaultdict(list)
        for x in mine:
            room[x.container_id] += x.n_tokens
            parts[x.doc_id].append((x.part_no, x.start_token, x.n_tokens))
        assert max(room.values()) <= capacity
        for p in parts.values():
            p.sort()
            total = sum(n for _, _, n in p)
            assert [s for _, s, _ in p] == list(range(0, max(total, 1), capacity))[: len(p)]
            assert len(p) == max(1, -(-total // capacity))
        assert len([k for k, v in room.items() if v]) <= 1.1 * sum(room.values()) / capacity + 2
    assert {x.spec_id for x in got} == {1, 2}


def test_no_items_or_specs(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, 32, "byte_bpe_50k")], "spec_id int, capacity int, tokenizer string")
    assert packing.fill_containers(df, specs).count() == 0
    assert packing.fill_containers(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), specs.limit(0)).count() == 0


def test_ranks_within_a_hot_group(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("g"))
    got = packing.ranks_within(df, ["g"], "id").where("g = 1").collect()
    assert sorted(r["rank"] for r in got) == list(range(len(got)))


# --- languages --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judge(spark, sf):
    return language.fit(table(spark, sf, "lang_samples"), None, "lang", "sample", "", "")


def test_held_out_sentences(spark, sf):
    s = table(spark, sf, "lang_samples")
    half = language.fit(s.where("sample_id % 2 = 0"), None, "lang", "sample", "", "")
    rest = s.where("sample_id % 2 = 1").collect()
    right = sum([x[0] for x in half.segments(r["sample"])] == [r.lang] for r in rest)
    assert right / len(rest) > 0.97


EN, DE, ZH = "Use this skill when you need to archive calendars and split the fixtures.", "Bitte zuerst Bilder sortieren, damit niemand seltene Vorlagen überschreibt.", "适合每天都要加密索引、同时维护草稿的团队使用。"


@pytest.mark.parametrize(
    "text,want",
    [
        (EN, ["en"]),
        (f"{EN} {EN}", ["en"]),
        (f"{EN} {DE}", ["en", "de"]),
        (f"{EN} — {DE} / {ZH}", ["en", "de", "zh"]),
        (f"{DE}\n{EN}{ZH}{DE}", ["de", "en", "zh", "de"]),
        (f"{EN} [Bilder sortieren und Vorlagen überschreiben] {EN}", ["en"]),
        (f"`{DE}` {EN}", ["en"]),
        (f"<p>{EN.replace(' ', '&nbsp;')}</p> Kitobuel.", ["en"]),
        ("中文工具", ["zh"]),
        ("12345 !!", []),
        ("", []),
    ],
)
def test_segments(judge, text, want):
    got = judge.segments(text)
    assert [x[0] for x in got] == want and all(0 <= x[1] <= 1 for x in got)


def test_labels(spark):
    v = ["en-US", "ENG", " German", "zh_Hans", "日本語", "und", "xx", "??", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(language.label_language(F.col("v"))).collect()] == ["en", "en", "de", "zh", "ja", None, None, None, None, None]


def test_relabelled_rows(spark, sf):
    rows = [(1, EN, "English"), (2, EN, "de"), (3, EN, None), (4, f"{EN} {DE}", "en"), (5, "TODO", None), (6, None, "fr"), (7, " ", "xx"), (8, DE, "deu"), (9, EN, "xx"), (9, EN, "xx")]
    df = spark.createDataFrame([(i, t, k, "n", "extra") for i, t, k in rows], "rec_id bigint, description string, desc_lang string, name string, declared string")
    got = sorted((r.rec_id, r.seg_no, r.lang) for r in language.relabelled(df, table(spark, sf, "lang_samples")).collect())
    assert got == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de"), (9, 1, "en"), (9, 1, "en")]
    assert language.relabelled(df.limit(0), table(spark, sf, "lang_samples")).count() == 0


def test_very_long_text(judge):
    got = judge.segments(f"{EN} " * 3000 + f"{DE} " * 2000)
    assert [x[0] for x in got] == ["en", "de"]


def test_texts_are_judged_together_and_alike(judge):
    texts = [EN, DE, "", f"{EN} {DE}", ZH, EN, "中文工具", "a b", f"{DE}\n{EN}{ZH}{DE}", f"{EN} " * 50, "Привет, мир, мы сортируем карты", "Use it. Use it now"] * 400
    calls, compress = [], dict(judge.compress)
    try:
        for k, f in compress.items():
            judge.compress[k] = lambda b, k=k, f=f: (calls.append(k), f(b))[1]
        got = list(judge.segments_of(texts))
    finally:
        judge.compress.update(compress)
    # sentences that come again in a chunk are compressed once, and a language has its turn once a chunk and group
    assert sum(a != b for a, b in zip(calls, calls[1:])) < 200 and len(calls) < 1000
    assert got == [judge.segments(t) for t in texts[:12]] * 400


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Sort maps", ".", "!", " ", "  ", "\n", "\r", "\x1c", "\x85", "\xa0", "|", "/", "—", "•", "é", "Überschrift", "-x", "--y", "²", "µ", "…"]), max_size=40).map("".join))
def test_quick_breaks_are_the_same(text):
    whole = r"(?<=[.!?])\s+|\s+[{}]\s+|\s{{2,}}|[\r\n]+"
    if text.isascii():
        assert language._ASCII_BREAK.split(text) == re.split(whole.format("/|"), text)
    if not language._OTHER.search(text):
        assert language._LATIN_BREAK.split(text) == language._BREAK.split(text)
    assert language._PHRASE.sub("", text) == re.sub(language._PHRASE.pattern.replace(r"-(?<!\S-)-?[a-z]", r"(?<!\S)--?[a-z]"), "", text)
    assert bool(language._FOURTEEN.search(text)) == (len(language._LETTERS.findall(text)) >= 14)


# --- stuffed pages ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, sf):
    pages = [r.text for r in table(spark, sf, "documents").where("text is not null").collect()]
    return spam.fit(table(spark, sf, "lang_samples"), pages=pages)


PROSE = " ".join(["When outliers look versioned, the workflow stops and offers to replay the personas.", "Good results need incremental patches, a short list of histograms and one pass to replay the rest.", "It can split thumbnails from XLSX files lazily and export them into stale thumbnails."])
LINKS = "\n".join(f"https://site{i}.example/page/{i * 37}" for i in range(30))
SPAM = {
    "keywords": ", ".join(["cheap maps", "best maps", "maps free", "buy maps"] * 20),
    "links": LINKS,
    "markdown links": "\n".join(f"- [maps sort](https://site{i}.example/{i})" for i in range(30)),
    "tags": "tags: " + " ".join(f"#maps{i} @sort{i}" for i in range(30)),
    "products": "\n".join(f"foo-{i}.{i + 1}.2 download" for i in range(30)),
    "sentences": "Looking for best maps? best maps is the best maps tool for best maps. Get best maps now, best maps today, best maps free. " * 8,
}
FAIR = {
    "prose": PROSE,
    "code": "Shows the code.\n\n```python\n" + "\n".join(f"x{i} = f{i}(y, z)" for i in range(40)) + "\n```\n",
    "table": f"{PROSE}\n\n| a | b |\n|---|---|\n" + "\n".join(f"| maps{i} | sort{i} |" for i in range(30)),
    "links with sentences": "\n".join(f"- [maps](https://site{i}.example/{i}) — {PROSE}" for i in range(4)),
    "glossary": "\n".join(f"**maps{i}**: {s}." for i, s in enumerate(PROSE.split(". "))),
    "short tail": f"{PROSE} {PROSE} {PROSE}\n\n{LINKS[:300]}",
    "front matter": f"---\nname: x\ntriggers:\n  - sort maps\n  - split maps\n---\n\n{PROSE}",
    "chinese": ZH * 5,
}


@pytest.mark.parametrize("name", SPAM)
def test_stuffing_is_found(model, name):
    assert model.stuffed_share(SPAM[name]) > 0.5
    assert model.stuffed_share(f"{PROSE}\n\n{SPAM[name]}\n\n{SPAM[name]}") > 0.5


@pytest.mark.parametrize("name", FAIR)
def test_fair_pages_are_not(model, name):
    assert model.stuffed_share(FAIR[name]) <= 0.5


def test_pages_as_a_table(spark, sf):
    pages = [(1, PROSE), (2, LINKS), (3, None), (4, ""), (5, " \n "), (6, LINKS), (7, LINKS * 200), (8, f"<!-- {SPAM['keywords']} -->")]
    df = spark.createDataFrame(pages, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "stuffed_share", "t")})
    s = table(spark, sf, "lang_samples")
    got = {r.doc_id: r.stuffed_share for r in spam.stuffed_pages(df, s).collect()}
    assert {i for i, x in got.items() if x > spam.SHARE} == {2, 6, 7, 8} and len(got) == 8
    assert spam.stuffed_pages(df.limit(0), s).count() == 0


def test_all_pages_set_the_thresholds_and_copies_count_once(spark, sf, monkeypatch):
    made = []
    settle = spam.ProseModel.settle
    monkeypatch.setattr(spam.ProseModel, "settle", lambda m, levels: (settle(m, levels), made.append((int(levels.sum()), m.middle, m.dev))))
    s = table(spark, sf, "lang_samples")

    def last(n, copies):
        rows = [(i, f"Sort maps number{i} and split the list of files for it, then replay every step of pass{i}.") for i in range(n)] + [(n + i, PROSE * 4) for i in range(copies)]
        spam.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string"), s).count()
        return made[-1]

    one, more, hot = last(10, 1), last(2000, 1), last(10, 500)
    assert more[0] - one[0] == 1990  # every page has one block
    assert hot == one


def test_all_clean_samples_train(spark):
    many, rare = 40_000, ["qa", "qb", "qc", "qd", "qe", "qf"]
    rows = [("xx", f"the number{i} is here") for i in range(many)] + [(k, f"{k}word row{i}") for k in rare for i in range(3)]
    df = spark.createDataFrame(rows + rows[-50:] + [("xx", None), (None, "the")], "lang string, sample string").repartition(7)
    m = spam.fit(df)
    # of 40,018 samples each counts, and copies once: three make a function word of a small language
    assert m.function == {"the", "number", "is", "here", "row"} | {f"{k}word" for k in rare}
    at = lambda *c: int(m.clean.reshape((len(spam.CLASSES),) * 3)[c])
    assert at(spam._B, spam._B, spam._F) == sum(-(-many // n) + len(rare) * -(-3 // n) for _, n in spam.SHAPES)
    with pytest.raises(ValueError):
        spam.fit(df.limit(0))


def test_queries_are_registered():
    from marlstone.llm.queries import QUERIES

    assert {"p1_found", "p3_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found", "p4_ranking"} <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))
