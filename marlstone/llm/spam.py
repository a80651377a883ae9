"""Keyword-stuffed and link-list pages (problem 9).

Method: an n-gram model of word classes, trained on prose. Every block of a page (paragraph or list) is turned into a sequence of
function words and word classes and scored by the model; blocks whose perplexity is abnormally high or low are
stuffing, and a page is flagged when they hold more than half of its characters.

The classes are: function word, content word, content word used again shortly after, number or version, link, tag, mark
between items, end of sentence, long and short runs of a script without spaces. Function words are those that stand in many
of the clean samples of a language. All clean samples of differing texts count, however many there are. Code, tables, front matter and headings are set aside; they count as characters but are never flagged.

Defined cases: null, empty and blank texts are not flagged; whole texts are scored, block by block; repeated pages are judged
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.session import forget, shared_table, ship

#: A word is a function word of a language if it stands in this share of its samples, and in three at least.
FUNCTION_SHARE = 0.06
#: A content word counts as used again within this many tokens.
AGAIN = 24
#: A block is abnormal when its bits a token leave the range that prose keeps by this many standard deviations of prose blocks.
DEVIATIONS = 7.0
#: Tokens of average prose that are added to a block before its bits are averaged, so that a few tokens decide nothing.
PRIOR_TOKENS = 8
#: Blocks of the pages are prose, which refines the trigrams, if they cost less than this many times the bits of the clean samples.
PROSE_FACTOR = 2.5
#: And if at least this share of their trigrams stands in the clean samples at all: what the samples never show, a row of links say, they don't explain.
KNOWN_SHARE = 0.5
#: Bits a token are counted in steps of 1 / STEPS, from which the middle and the deviation of all prose blocks are read.
STEPS = 1_000
#: Only blocks of more tokens than this, begin marks included, count for the middle and the deviation.
LEAST_TOKENS = 8
SHARE = 0.5

#: Prose comes as single sentences, running paragraphs and lists of sentences: what stands between samples, and how many are joined. RUN is a multiple of each number.
SHAPES, RUN = ((" ", 1), (" ", 2), (" ", 4), ("\n", 3), ("\n", 6)), 12

CLASSES = "BFCRNUTSPJj"
_B, _F, _C, _R, _N, _U, _T, _S, _P, _J, _j = range(len(CLASSES))
_TOKEN = re.compile(r"<a\s[^<>]*>|https?://[^\s<>()\]]+|[#@]\w+|\d[\w.\-]*|[^\W\d_]+(?:['’_\-][^\W_]+)*|\n|[·|,;•→»]|[.!?。！？…:]+")
_FENCE = re.compile(r"^(?:```|~~~)[\s\S]*?(?:^(?:```|~~~)[^\n]*$|\Z)", re.M)
_FRONT = re.compile(r"\A\s*---[ \t]*\n[\s\S]*?\n---[ \t]*(?:\n|\Z)", re.M)
_TABLE = re.compile(r"^[ \t]*\|.*\|[ \t]*$", re.M)
_HEAD = re.compile(r"^[ \t]*#{1,6}[ \t][^\n]*$", re.M)
_MARKER = re.compile(r"^[ \t]*(?:[-*+>]|\d+[.)])[ \t]+(?:\[[ xX]?\][ \t]+)?", re.M)
_WIDE = re.compile(r"[ぁ-ヿ一-鿿]")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")


class _Classes(dict):
    """Class of each token; tokens that were not given are classed by their form."""

    def __init__(self, given: dict[str, int], most: int = 400_000) -> None:
        super().__init__(given)
        self.given, self.most = given, most

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c == "\n":
            k = _S
        elif c.isdigit():
            k = _N
        elif t.startswith(("http", "<a")) and len(t) > 6:
            k = _U
        elif c in "#@":
            k = _T
        elif c in "·|,;•→»":
            k = _S
        elif c in ".!?。！？…:":
            k = _P
        elif _WIDE.match(t):
            k = _J if len(t) > 4 else _j
        else:
            k = _C
        # addresses, numbers and tags hardly ever come again, so they aren't kept; what is kept is dropped all at once when it has become too much
        if k in (_C, _J, _j, _S, _P):
            if len(self) > self.most:
                self.clear()
                self.update(self.given)
            self[t] = k
        return k


def blocks(text: str) -> list[str]:
    """The blocks of a page that could be prose or stuffing."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.lstrip("\ufeff").replace("\xa0", " ")
    if "<!--" in text:
        # what is hidden in a comment is part of the page
        text = text.replace("<!--", "\n\n").replace("-->", "\n\n")
    if "---" in text:
        text = _FRONT.sub("\n\n", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "|" in text:
        text = _TABLE.sub("\n\n", text)
    if "#" in text:
        text = _HEAD.sub("\n\n", text)
    return [b for b in _PARAGRAPH.split(text) if b and not b.isspace()]


#: Trigrams, and steps of bits: a block of more than 32 bits a token counts in the last.
_CELLS, _LEVELS = len(CLASSES) ** 3, 32 * STEPS


def _packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one, and their sizes."""
    return (np.concatenate(seqs) if seqs else np.zeros(0, np.int8)), np.array([len(s) for s in seqs], np.int64)


def _codes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a trigram of one block begins, and the trigrams as numbers."""
    inside = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    at, x, n = np.flatnonzero(inside), flat.astype(np.int64), len(CLASSES)
    return inside, (x[at] * n + x[at + 1]) * n + x[at + 2]


def _median(at: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(at, kind="stable")
    below = np.cumsum(weight[order])
    return float(at[order][np.searchsorted(below, below[-1] / 2)])


class ProseModel:
    """Trigrams of word classes."""

    def __init__(self, function: set[str]) -> None:
        self.function = function
        self.classes = _Classes(dict.fromkeys(function, _F))

    def train(self, seen: np.ndarray) -> None:
        """Takes how often each trigram stands in the clean samples."""
        self.clean = seen
        self.base_seen = seen > 0
        self._weigh(seen)

    def settle_base(self, levels: np.ndarray) -> None:
        """Settles on the clean samples alone, and keeps that as what tells prose."""
        self.settle(levels)
        self.base_bits, self.base_mean, self.base_middle = self.bits, self.mean, self.middle

    def _weigh(self, seen: np.ndarray) -> None:
        """Bits of the trigrams from how often each was seen."""
        counts = 0.02 + seen.reshape((len(CLASSES),) * 3)
        two = counts.sum(0) + 0.2
        two /= two.sum(1, keepdims=True)
        # the less a history was seen, the more the shorter one counts
        self.bits = -np.log2((counts + 2 * two[None]) / (counts.sum(2, keepdims=True) + 2))
        self.mean = float((self.bits.reshape(-1) * seen).sum() / max(1, seen.sum()))

    def refine(self, counts: np.ndarray) -> None:
        """Trains on the clean samples and the trigrams counted in the prose blocks of pages."""
        self._weigh(self.clean + counts)

    def settle(self, levels: np.ndarray) -> None:
        """Takes the middle and the deviation of prose blocks from a histogram of their bits."""
        if not levels.any():
            raise ValueError(f"the clean samples have no block of more than {LEAST_TOKENS} tokens")
        at = (np.arange(len(levels)) + 0.5) / STEPS
        self.middle = _median(at, levels)
        self.dev = max(0.05, _median(np.abs(at - self.middle), levels) * 1.4826)

    def is_prose(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which blocks the clean samples explain."""
        inside, codes = _codes(flat, sizes)
        known = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[inside], self.base_seen[codes], minlength=len(sizes))
        return (self._each(flat, sizes, self.base_bits, self.base_mean) < PROSE_FACTOR * self.base_middle) & (known >= KNOWN_SHARE * (sizes - 2))

    def prose_counts(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How often each trigram stands in the prose blocks."""
        inside, codes = _codes(flat, sizes)
        return np.bincount(codes[np.repeat(self.is_prose(flat, sizes), sizes)[inside]], minlength=_CELLS)

    def prose_levels(self, flat: np.ndarray, sizes: np.ndarray, clean: bool = False) -> np.ndarray:
        """The histogram of the bits of the prose blocks; all blocks of the clean samples are."""
        keep = (sizes > LEAST_TOKENS) & (True if clean else self.is_prose(flat, sizes))
        return np.bincount(np.minimum((self._each(flat, sizes)[keep] * STEPS).astype(int), _LEVELS - 1), minlength=_LEVELS)

    def _each(self, flat: np.ndarray, sizes: np.ndarray, bits: np.ndarray | None = None, mean: float | None = None) -> np.ndarray:
        """Bits a token of each block, drawn a little to the mean."""
        inside, codes = _codes(flat, sizes)
        block = np.repeat(np.arange(len(sizes)), sizes)[inside]
        total = np.bincount(block, (self.bits if bits is None else bits).reshape(-1)[codes], minlength=len(sizes))
        return (total + PRIOR_TOKENS * (self.mean if mean is None else mean)) / (sizes - 2 + PRIOR_TOKENS)

    def _bits(self, s: np.ndarray) -> float:
        return float(self._each(s, np.array([len(s)]))[0])

    def sequence(self, block: str) -> np.ndarray:
        """The classes of a block's tokens, after two begin marks."""
        toks = _TOKEN.findall(_MARKER.sub("", block.lower()))
        cls = self.classes
        out = [_B, _B]
        last: dict[str, int] = {}
        for i, t in enumerate(toks):
            k = cls[t]
            if k == _C:
                if i - last.get(t, -1000) <= AGAIN:
                    k = _R
                last[t] = i
            elif k == _J:
                # a run without spaces weighs as the words it holds
                out.extend([_J] * (len(t) // 5))
            out.append(k)
        return np.array(out, np.int8)

    def deviation(self, block: str) -> float:
        """By how many standard deviations a block's bits a token (the logarithm of its perplexity) differ from those of prose."""
        return (self._bits(self.sequence(block)) - self.middle) / self.dev

    def stuffed_share(self, text: str, deviations: float = DEVIATIONS) -> float:
        """The share of a text's characters that stand in abnormal blocks."""
        bad = sum(len(b) for b in blocks(text) if abs(self.deviation(b)) > deviations)
        return bad / max(1, len(text.strip()))


def _summed(rows: DataFrame, count, size: int) -> np.ndarray:
    """The sum of the counters that `count` makes of each batch of (seq, sizes); a task gives one row a counter, so at most `size` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            sizes = np.asarray(b.column(1).flatten(), np.int64)
            if len(sizes):
                total += count(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8), sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("seq", "sizes").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _function_words(clean: DataFrame) -> set[str]:
    """The words that stand in FUNCTION_SHARE of the samples of a language; for each language, at most 1 / FUNCTION_SHARE times the words of a sample reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter((k, w) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(_TOKEN.findall(t.lower())) if w[0].isalpha() and not _WIDE.match(w))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "w", "n"])

    counts = clean.select("k", "t").mapInArrow(words, "k string, w string, n bigint").groupBy("k", "w").agg(F.sum("n").alias("n")).where("n >= 3")
    totals = clean.groupBy("k").agg(F.count("*").alias("total"))
    return {r.w for r in counts.join(F.broadcast(totals), "k").where(F.col("n") >= FUNCTION_SHARE * F.col("total")).select("w").distinct().collect()}


def _in_runs(clean: DataFrame) -> DataFrame:
    """(ts): the samples of a language in the order of their hashes, RUN to a row; no language is gathered, as each 256th of the hashes is ranked apart."""
    # neighbours in the alphabet begin alike, and paragraphs made of them would repeat words as no prose does
    split = clean.withColumn("part", F.shiftright("h", 56))
    sizes = split.groupBy("k", "part").agg(F.count("*").alias("m"))
    before = sizes.select("k", "part", (F.sum("m").over(W.partitionBy("k").orderBy("part")) - F.col("m")).alias("before"))
    own = split.withColumn("own", F.row_number().over(W.partitionBy("k", "part").orderBy("h", "t")) - 1)
    at = own.join(before, ["k", "part"]).select("k", "t", (F.col("own") + F.col("before")).alias("at"))
    runs = at.groupBy("k", F.floor(F.col("at") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("x"))
    return runs.select(F.col("x.t").alias("ts"))


def _trained(samples: DataFrame, lang: str, sample: str) -> tuple[ProseModel, DataFrame]:
    """A model from all clean samples of differing texts, and (seq, sizes), a table of the blocks that were made of them. Counted on the executors."""
    spark = samples.sparkSession
    given = samples.select(F.col(lang).cast("string").alias("k"), F.col(sample).alias("t")).where("k is not null and t is not null")
    clean = shared_table(given.distinct().withColumn("h", F.xxhash64("k", "t")), "samples")
    model = ProseModel(_function_words(clean))
    base = spark.sparkContext.broadcast(model)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = base.value
        for b in batches:
            runs = [[own.sequence(sep.join(ts[i : i + n])) for sep, n in SHAPES for i in range(0, len(ts), n)] for ts in b.column(0).to_pylist()]
            cols = [pa.array([b"".join(s.tobytes() for s in seqs) for seqs in runs], pa.binary()), pa.array([[len(s) for s in seqs] for seqs in runs], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["seq", "sizes"])

    made = shared_table(_in_runs(clean).mapInArrow(classed, "seq binary, sizes array<int>"), "clean")
    forget(clean)
    model.train(_summed(made, lambda flat, sizes: np.bincount(_codes(flat, sizes)[1], minlength=_CELLS), _CELLS))
    model.settle_base(_clean_levels(model, made))
    return model, made


def _clean_levels(model: ProseModel, made: DataFrame) -> np.ndarray:
    """The histogram of the bits of all blocks made of clean samples."""
    own = made.sparkSession.sparkContext.broadcast(model)
    return _summed(made, lambda flat, sizes: own.value.prose_levels(flat, sizes, clean=True), _LEVELS)


def fit(samples: DataFrame, lang: str = "lang", sample: str = "sample", pages: list[str] = ()) -> ProseModel:
    """A model from all clean samples of differing texts, and pages."""
    model, made = _trained(samples, lang, sample)
    if pages:
        # blocks that the clean samples already explain well show how prose is set on pages; what they don't explain teaches nothing
        packed = _packed([model.sequence(b) for t in dict.fromkeys(pages) for b in blocks(t)])
        model.refine(model.prose_counts(*packed))
        model.settle(model.prose_levels(*packed) + _clean_levels(model, made))
    forget(made)
    return model


def stuffed_pages(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text: str = "text", deviations: float = DEVIATIONS) -> DataFrame:
    """(id_col, stuffed_share): each page with the share of its characters in abnormal blocks; 0 for null, empty and blank texts.

    Texts are split and classed once. Trigrams, middle and deviation come from the prose blocks of all distinct texts.
    """
    ship(docs.sparkSession)
    model, made = _trained(samples, "lang", "sample")
    sc = docs.sparkSession.sparkContext
    base = sc.broadcast(model)  # a table of class trigrams and some hundred words
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("total", pa.int64()), ("seq", pa.binary()), ("sizes", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32()))])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = base.value
        for b in batches:
            rows = []
            for t in b.column(2):
                t = t.as_py() or ""
                parts = blocks(t)
                seqs = [own.sequence(x) for x in parts]
                rows.append((len(t.strip()), b"".join(s.tobytes() for s in seqs), [len(s) for s in seqs], [len(x) for x in parts]))
            cols = [pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=schema)

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    pages = shared_table(given.mapInArrow(classed, "id bigint, h bigint, total bigint, seq binary, sizes array<int>, chars array<int>"), "blocks")
    distinct = pages.where(F.size("sizes") > 0).groupBy("h").agg(F.first(F.struct("seq", "sizes")).alias("x")).select("x.*")
    model.refine(_summed(distinct, lambda flat, sizes: base.value.prose_counts(flat, sizes), _CELLS))
    refined = sc.broadcast(model)
    model.settle(_summed(distinct, lambda flat, sizes: refined.value.prose_levels(flat, sizes), _LEVELS) + _clean_levels(model, made))
    forget(made)
    settled = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = settled.value
        for b in batches:
            sizes, chars = np.asarray(b.column(3).flatten(), np.int64), np.asarray(b.column(4).flatten(), np.int64)
            far = np.abs(own._each(np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8), sizes) - own.middle) > deviations * own.dev
            page = np.repeat(np.arange(len(b)), np.asarray(pa.compute.list_value_length(b.column(3))))
            shares = np.bincount(page, chars * far, minlength=len(b)) / np.maximum(1, b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares, pa.float64())], names=["id", "stuffed_share"])

    return pages.select("id", "total", "seq", "sizes", "chars").mapInArrow(run, "id bigint, stuffed_share double").withColumnRenamed("id", id_col)
