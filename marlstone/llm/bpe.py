"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

Method: higher-order functions fold ranked merges over the byte arrays of distinct words, with a literal rank map;
decoding concatenates binary pieces.

One pass over the texts splits them into words and writes, chunk by chunk, each document as numbers of the chunk's
own word list. The distinct words of all chunks are merged once each, wherever they occur; the ids return to the chunks that asked for them, and
documents become ids by look-up. A chunk has a bounded number of characters (a longer document is a chunk of its own), so no task
holds more than that, and a word that stands in every document is shuffled once a chunk.

A "word" is a piece of the splitting pattern, cut further where no token of the vocabulary
spans the two bytes at the cut (between most CJK characters), which cannot change the result.

Defined cases: null and empty texts give an empty list; special tokens in a text are ordinary text; white space and control characters are
encoded as they are; equal ids keep their rows; the result has one row for each row of the table; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.core import let
from marlstone.session import shared_table

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# The splitting pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a chunk; words longer than LONG_WORD bytes are merged with a heap instead of the fold, whose cost is quadratic in the length.
CHUNK_CHARS, LONG_WORD = 16 << 20, 2048
#: Characters that are split at once; a longer text is split in parts.
SPLIT_CHARS = 1 << 18
#: Larger than any rank.
_NONE = 1 << 17


@lru_cache(4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Classes of characters: letters, numbers, white space, everything else, and the place between two texts.
_OTHER, _LETTER, _NUMBER, _WHITE, _BETWEEN = range(5)


@lru_cache(4)
def _cuts(name: str, folder: str) -> np.ndarray:
    """For a byte and the byte after it, in UTF-8: whether the latter begins a character and no token spans the two."""
    cut = np.zeros((256, 256), bool)
    cut[:, 0xC2:0xF5] = True
    for t in vocabulary(name, folder):
        b = np.frombuffer(t, np.uint8)
        cut[b[:-1], b[1:]] = False
    return cut


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its class and, in UTF-8, its first byte, last byte and length."""
    import regex

    points = np.arange(0x110000)
    chars = "".join(map(chr, points))
    kind = np.full(len(points), _OTHER, np.uint8)
    for pattern, k in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _WHITE)):
        for m in regex.finditer(pattern, chars):
            kind[m.start() : m.end()] = k
    wide = [points >= x for x in (0x80, 0x800, 0x10000)]
    first = np.select(wide[::-1], [0xF0 | points >> 18, 0xE0 | points >> 12, 0xC0 | points >> 6], points)
    last = np.where(wide[0], 0x80 | points & 0x3F, points)
    return kind, first.astype(np.uint8), last.astype(np.uint8), 1 + sum(w.astype(np.uint8) for w in wide)


def _split(texts: list[str], cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another (binary), and how many each text has.

    PATTERN, applied to all characters at once: a word begins where the class changes, with three exceptions. Of white space before something else
    the last character is apart; it belongs to what follows if it is a blank. An apostrophe that begins a word takes the ending after it along.
    """
    kinds, first, last, length = _characters()
    joined = "\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    between = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = kinds[points]
    kind[between] = _BETWEEN
    begins = np.empty(len(points), bool)
    begins[0], begins[1:] = False, kind[1:] != kind[:-1]

    end = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] < _WHITE))
    begins[end] = True
    begins[end[points[end] == ord(" ")] + 1] = False

    at = np.flatnonzero((points == ord("'")) & begins)
    one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long_ = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    begins[at[short | long_] + 1] = False
    begins[at[short] + 2] = True
    begins[at[long_] + 3] = True

    if joined.isascii():
        begins[between] = False
        starts = np.flatnonzero(begins)
        offsets = starts - np.searchsorted(between, starts)
    else:
        at = np.flatnonzero(points >= 0x80)
        begins[at] |= cuts[last[points[at - 1]], first[points[at]]]
        begins[between] = False
        starts = np.flatnonzero(begins)
        each = length[points]
        each[between] = 0
        offsets = np.cumsum(each, dtype=np.int64)[starts] - each[starts]
    data = "".join(texts).encode()
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(offsets, len(data)).astype(np.int32)), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(starts, between))


# a cut before white space that follows something else, or before punctuation that follows a letter or number, falls between two words in any case
_PART_END = re.compile(r"\S(?=[ \n])|[^\W_](?=[!-/:-@\[-`{-~。、，])")


def _parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, or more where it has no place to be cut."""
    at = 0
    while len(text) - at > size and (m := _PART_END.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def splitter(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """A function from a text to its words, as bytes."""
    return lambda text: _split([text], _cuts(name, folder))[0].to_pylist()


@lru_cache(4)
def _merge_tables(name: str, folder: str) -> tuple[list[int], str, str, str]:
    """The rank map, as number lists: ids of the 256 bytes; ranks of byte pairs; a displacement for each left id; slots.

    Every way to halve a token into two tokens is a pair. The slot of a pair is the displacement of its left id
    plus its right id, and holds left * 2^17 + rank; displacements are chosen so that no two pairs share a slot.
    """
    ranks = vocabulary(name, folder)
    rows: dict[int, dict[int, int]] = {}
    for t, r in ranks.items():
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i]), ranks.get(t[i:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = r
    n_ids = max(ranks.values()) + 1
    size = 16 * n_ids
    slots, free = np.full(size + n_ids, -1, np.int64), np.ones(size + n_ids, bool)
    place = np.zeros(n_ids, np.int64)
    first_free = 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array(sorted(row))
        while not free[first_free]:
            first_free += 1
        at, wide = max(0, first_free - int(rights[-1])), 256 if len(rights) < 16 else 8192
        while True:
            span = np.arange(at, min(at + wide, size))
            if not len(span):
                raise ValueError("the rank map needs more slots")
            for x in rights:
                span = span[free[span + x]]
                if not len(span):
                    break
            if len(span):
                hit = int(span[0])
                break
            at, wide = at + wide, min(wide * 2, 1 << 16)
        place[a] = hit
        free[hit + rights] = False
        slots[hit + rights] = [a << 17 | row[int(b)] for b in rights]
    last = (int(np.flatnonzero(~free).max()) if rows else 0) + n_ids + 1
    bytes_ = [ranks[bytes([i])] for i in range(256)]
    pairs = [ranks.get(bytes([i, j]), _NONE) for i in range(256) for j in range(256)]
    text = lambda xs: ",".join(map(str, xs))
    return bytes_, text(pairs), text(place), text(np.pad(slots, (0, n_ids))[:last])


def merge_fold(word: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """The ids (array<int>) of one word (binary, not empty): its bytes, then the lowest-ranked pair merged again and again."""
    byte_ids, byte_pairs, place, slots = _merge_tables(name, folder)
    numbers = lambda text, kind: F.split(F.lit(text), ",").cast(f"array<{kind}>")

    low = F.lit((1 << 17) - 1)
    ident = lambda x: x.bitwiseAND(low)

    def entry(t: Column, left: Column, at: Column, right: Column) -> Column:
        """A token at byte `at`, with the rank of the pair it forms with the token after it in front; _NONE if that doesn't merge."""
        held = F.get(t["slots"], F.get(t["place"], left.cast("int")) + right.cast("int"))
        rank = F.coalesce(F.least((held - F.shiftleft(left, 17)).bitwiseAND(F.lit(2**63 - 1)), F.lit(_NONE)), F.lit(_NONE))
        return F.shiftleft(rank, 34) + at + left

    def fold(t: Column) -> Column:
        codes = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.ascii(c))

        def start(codes: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                rank = F.coalesce(F.get(t["pairs"], c * 256 + F.get(codes, i + 1)), F.lit(_NONE).cast("bigint"))
                return F.shiftleft(rank, 34) + F.shiftleft(i.cast("bigint"), 17) + F.get(t["bytes"], c)

            return F.transform(codes, one)

        def merged(s: Column, m: Column, p: Column) -> Column:
            # the least entry is the leftmost pair of the lowest rank, and that rank is the id of what it merges to
            token = F.shiftright(m, 34)
            before = F.get(s, p - 2)
            left = F.when(p > 1, F.array(entry(t, ident(before), before.bitwiseAND(F.lit(((1 << 17) - 1) << 17)), token))).otherwise(F.array().cast("array<bigint>"))
            here = F.array(entry(t, token, m.bitwiseAND(F.lit(((1 << 17) - 1) << 17)), ident(F.get(s, p + 1))))
            return F.concat(F.slice(s, F.lit(1), F.greatest(p - 2, F.lit(0))), left, here, F.slice(s, p + 2, F.lit(1 << 30)))

        def step(s: Column, _: Column) -> Column:
            # without a pair that merges nothing changes any more
            return let(F.array_min(s), lambda m: F.when(m >= _NONE << 34, s).otherwise(let(F.array_position(s, m).cast("int"), lambda p: merged(s, m, p))))

        return let(codes, lambda codes: F.aggregate(F.slice(codes, 2, 1 << 30), start(codes), step, lambda s: F.transform(s, lambda x: ident(x).cast("int"))))

    tables = F.struct(F.array(*[F.lit(i) for i in byte_ids]).alias("bytes"), numbers(byte_pairs, "bigint").alias("pairs"), numbers(place, "int").alias("place"), numbers(slots, "bigint").alias("slots"))
    return let(tables, fold)


def _chunked(docs: DataFrame, name: str, folder: str, chunk_chars: int) -> DataFrame:
    """(chunk, id, refs, word, local): document rows have id and refs (uint32 numbers), word rows have word and its number."""
    schema = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("refs", pa.binary()), ("word", pa.binary()), ("local", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(name, folder)
        chunk, size, waiting = TaskContext.get().partitionId() << 32, 0, 0
        ids: list[int | None] = []
        # the parts of texts that are to be split next, and of all parts of the chunk the document and the number of words
        parts: list[str] = []
        owners: list[int] = []
        counts: list[np.ndarray] = []
        words: list[pa.Array] = []

        def split() -> None:
            nonlocal parts, waiting
            found, count = _split(parts, cuts)
            words.append(found)
            counts.append(count)
            parts, waiting = [], 0

        def flush() -> pa.RecordBatch:
            if parts:
                split()
            numbered = pa.chunked_array(words, pa.binary()).dictionary_encode()
            local = numbered.chunk(0).dictionary
            flat = np.concatenate([c.indices.to_numpy() for c in numbered.chunks]).astype(np.uint32)
            n, m = len(ids), len(local)
            each = np.zeros(n + 1, np.int64)
            np.add.at(each, np.array(owners) + 1, np.concatenate(counts))
            refs = pa.Array.from_buffers(pa.binary(), n, [None, pa.array(4 * np.cumsum(each)).cast(pa.int32()).buffers()[1], pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, chunk)),
                    pa.array(ids + [None] * m, pa.int64()),
                    pa.concat_arrays([refs, pa.nulls(m, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), local]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                ],
                schema=schema,
            )

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                for part in _parts(text, SPLIT_CHARS):
                    parts.append(part)
                    owners.append(len(ids))
                    waiting += len(part)
                    if waiting >= SPLIT_CHARS:
                        split()
                ids.append(i)
                size += len(text)
                if size >= chunk_chars:
                    yield flush()
                    chunk, size, ids, owners, counts, words = chunk + 1, 0, [], [], [], []
        if ids:
            yield flush()

    return docs.mapInArrow(run, "chunk bigint, id bigint, refs binary, word binary, local int")


def _long_words(words: DataFrame, name: str, folder: str) -> DataFrame:
    """Words too long for the fold, by the same merges in a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _heap_merger(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word binary, ids array<int>")


def _heap_merger(name: str, folder: str):
    import heapq

    ranks = vocabulary(name, folder)

    def encode(word: bytes) -> list[int]:
        n = len(word)
        end, prev, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not alive[i] or end[i] != j or end[j] != e:
                continue
            alive[j], end[i] = False, e
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    return encode


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id_col, ids): the token ids of each text; no special tokens."""
    parts = shared_table(_chunked(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), tokenizer, folder, chunk_chars), "bpe")
    asked = parts.where("word is not null").select(F.col("chunk").alias("of"), "local", "word")
    # distinct words are partitioned as the asking rows are, so the join back to them moves nothing
    asked = asked.repartition("word")
    words = asked.groupBy("word").agg(F.lit(1).alias("_")).select("word")
    short = words.where(F.length("word") <= LONG_WORD).select("word", merge_fold(F.col("word"), tokenizer, folder).alias("ids"))
    long_ = _long_words(words.where(F.length("word") > LONG_WORD), tokenizer, folder)
    known = asked.where(F.length("word") <= LONG_WORD).join(short, "word").unionByName(asked.where(F.length("word") > LONG_WORD).join(long_, "word")).select("of", "local", "ids")

    def look_up(doc: pa.Table, dic: pa.Table) -> pa.Table:
        n = len(dic)
        ids = dic.column("ids").combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
        off = ids.offsets.to_numpy().astype(np.int64) if n else np.zeros(1, np.int64)
        values = ids.values.to_numpy() if n else np.zeros(0, np.int32)
        start, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        local = dic.column("local").to_numpy()
        start[local], count[local] = off[:-1], np.diff(off)
        raw = doc.column("refs").combine_chunks()
        refs = [np.frombuffer(r, np.uint32) for r in raw.to_pylist()]
        flat = np.concatenate(refs) if refs else np.zeros(0, np.uint32)
        each = count[flat]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = values[np.repeat(start[flat] - (ends - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in refs])]).astype(np.int64)
        tokens = np.concatenate([[0], ends])[bounds]
        lists = pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(out.astype(np.int32)))
        return pa.table({id_col: doc.column("id"), "ids": lists})

    rows = parts.where("refs is not null").select("chunk", "id", "refs")
    return rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(look_up, f"{id_col} bigint, ids array<int>")


def decode(ids: Column, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """The bytes of a list of ids: the tokens' binary pieces joined. Unknown ids give null, an empty list empty bytes."""
    ranks = vocabulary(tokenizer, folder)
    names = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        names[r] = t
    pieces = F.transform(F.split(F.lit(",".join(base64.b64encode(t).decode() for t in names)), ","), lambda s: F.unbase64(s))
    return let(pieces, lambda t: F.aggregate(ids, F.lit(b"").cast("binary"), lambda a, i: F.concat(a, F.get(t, i))))
