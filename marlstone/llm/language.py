"""Missing or wrong language labels, and segments of mixed texts (problem 3).

Method: compression classification. Each language has a zstandard raw-content dictionary; a sentence belongs to the language whose
dictionary makes it smallest, and is rejected when the margin to the second is narrow. Rejected sentences follow
their neighbours if those are among the close candidates; a text of rejected sentences only is compressed as a whole.

The dictionaries hold given clean samples and sentences of a bounded sample of labelled rows (`LABELLED_ROWS`), kept where
the clean samples don't contradict the label. A script that only some languages use leaves only those as candidates; a single candidate is
compared with compression without any dictionary, and a sentence in a script of none of the languages has the language `none`.

Defined cases: null, blank and unusable texts have no segment; repeated rows are judged alike; very long texts
are judged sentence by sentence; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import learned_stock_phrases, usable
from marlstone.session import hash_sample, ship

#: Bounds of what is read to the driver and of each dictionary's bytes.
SAMPLE_ROWS, LABELLED_ROWS, DICTIONARY_BYTES = 20_000, 4_000, 24_000
LEVEL, PER_BEGINNING = 3, 6
#: A margin below this many bytes, or below this share of the smaller size, is narrow.
NARROW_BYTES, NARROW_SHARE = 5, 0.06
#: What stands for the language of a sentence that no dictionary makes smaller than no dictionary does.
NONE = "none"
#: How many sentences are compressed by one language before the next: a few MB of texts and sizes.
CHUNK_UNITS = 4_000
_SIZE = itemgetter(0)

# Usual names and three-letter codes of the languages.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "ko": "ko kor korean 한국어",
    "zh": "zh zho chi chinese cmn mandarin 中文 汉语",
    "ja": "ja jpn japanese 日本語",
}
_SPELLING = {s: k for k, v in LABELS.items() for s in v.split()}


def label_language(c: Column) -> Column:
    """The code of a declared language in any usual spelling; null if it names none."""
    first = F.regexp_extract(F.lower(F.trim(c)), r"^(\p{L}+)", 1)
    m = F.create_map(*[F.lit(x) for kv in sorted(_SPELLING.items()) for x in kv])
    return F.try_element_at(m, first)


_TAG = re.compile(r"<[^<>]{0,400}>")
# every branch begins with a literal, so that the search passes over what can't begin a phrase; likewise with _ASCII_BREAK and blanks
_PHRASE = re.compile(r"`[^`\n]*`|\[[^\[\]\n]{0,200}\]|\([^()\n]{0,200}\)|\{[^{}\n]{0,200}\}|“[^”\n]{0,200}”|„[^“”\n]{0,200}[“”]|«[^»\n]{0,200}»|「[^」\n]{0,200}」|『[^』\n]{0,200}』|\"[^\"\n]{0,200}\"|https?://\S+|-(?<!\S-)-?[a-z][\w-]*")
_NOISE = re.compile("\u00e2\u20ac[\u2122\u201c\u201d\u0153\u00a6\u02dc]?s?|[\u00c2\u00c3\ufffd](?=\\s|$)|\u00c2(?=\u00a0)|[\u200b-\u200f\u2060\ufeff\u00ad*_#>]")
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[.!?。！？])(?=[ぁ-ヿ一-鿿가-힣])|(?<=[。！？])\s*|\s+[—–/|•·]\s+|\s{2,}|[\r\n]+|\s*[\U0001F000-\U0001FAFF\u2600-\u27BF\u2026]\uFE0F?\s*")
_ASCII_BREAK = re.compile(r"\s(?:(?<=[.!?]\s)\s*|\s*[/|]\s+|\s+|(?<=[\r\n]))")
_LATIN_BREAK = re.compile(r"\s(?:(?<=[.!?]\s)\s*|\s*[—–/|•·]\s+|\s+|(?<=[\r\n]))")
#: What isn't Latin, a blank or a usual mark: texts without it break at blanks only, and with a Latin letter they are Latin.
_OTHER = re.compile("[^\x00-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ‐-‥‧‰-⁞]")
_FOURTEEN = re.compile(r"[^\W\d_](?:[\W\d_]*[^\W\d_]){13}")
#: Texts without these characters hold no phrase or noise to take out.
_MARKS = re.compile(r"[`\[({\"\-*_#>]|http")
_LETTERS = re.compile(r"[^\W\d_]")
_HANGUL, _KANA, _HAN, _CYRILLIC = (re.compile(p) for p in ("[\uac00-\ud7a3\u1100-\u11ff]", "[\u3041-\u30ff]", "[\u4e00-\u9fff]", "[\u0400-\u04ff]"))
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")


def units(text: str) -> list[str]:
    """The sentences of a text, without markup, commands, quoted and bracketed phrases, and without what is too short to have a language."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    plain = text.isascii()
    if not plain:
        text = _PHRASE.sub(" ", _NOISE.sub("", text))
    elif _MARKS.search(text):
        for c in "*_#>":  # the noise that ASCII has
            text = text.replace(c, "")
        text = _PHRASE.sub(" ", text)
    out = []
    for u in (_ASCII_BREAK if plain else _BREAK if _OTHER.search(text) else _LATIN_BREAK).split(text):
        u = " ".join(u.split())
        if plain or u.isascii():
            if len(u) >= 17 and " " in u:
                out.append(u)
            continue
        if " " in u and _FOURTEEN.search(u) or (_HAN.search(u) or _KANA.search(u) or _HANGUL.search(u)) and len(_LETTERS.findall(u)) >= 5:
            out.append(u)
    return out


def candidates(unit: str, languages: list[str]) -> list[str]:
    """The languages whose script a unit is mostly written in; none for a script that none of the known ones is written in."""
    if unit.isascii() or _LATIN.search(unit) and not _OTHER.search(unit):
        return [x for x in languages if x not in ("ja", "zh", "ko", "ru")] or languages
    han, kana, hangul, cyrillic = (len(p.findall(unit)) for p in (_HAN, _KANA, _HANGUL, _CYRILLIC))
    latin = len(_LATIN.findall(unit))
    other = len(_LETTERS.findall(unit)) - han - kana - hangul - cyrillic - latin
    latin /= 6  # names among CJK characters are Latin, and a letter says less than a character
    most = max(han + kana, hangul, cyrillic, latin)
    if other > max(most, 6 * latin):
        return []
    # Chinese has no kana
    some = ({"ja": 1} if kana else {"ja": 1, "zh": 1}) if most == han + kana else {"ko": 1} if most == hangul else {"ru": 1} if most == cyrillic else None
    got = [x for x in languages if (x in some if some else x not in ("ja", "zh", "ko", "ru"))]
    return got or languages


def _within(texts: list[str], bound: int) -> list[str]:
    out, size = [], 0
    for t in texts:
        if size > bound:
            break
        out.append(t)
        size += len(t.encode()) + 1
    return out


class Judge:
    """Compressors with one dictionary a language."""

    def __init__(self, texts: dict[str, list[str]], level: int = LEVEL, bound: int = DICTIONARY_BYTES) -> None:
        import zstandard as zs

        # only what the dictionaries hold is kept, which bounds what is sent to the executors
        self.texts = {k: _within(v, bound) for k, v in texts.items() if v}
        self.languages = sorted(self.texts)
        self.latin = tuple(candidates("", self.languages))
        self.compress = {}
        self.plain = zs.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        for k in self.languages:
            # what comes last is the cheapest to refer to: the clean samples, which are given first
            raw = b"\n".join(t.encode() for t in reversed(self.texts[k]))[-bound:]
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress[k] = zs.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, units: Iterable[str]) -> dict[str, list[tuple[int, str]]]:
        """(size, language), smallest first, of each unit. A language compresses all units before the next does: its dictionary stays in the processor's cache."""
        groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for u in dict.fromkeys(units):
            groups[self.latin if u.isascii() else tuple(candidates(u, self.languages))].append(u)
        got: dict[str, list[tuple[int, str]]] = {}
        for some, us in groups.items():
            bs = [u.lower().encode() for u in us]
            columns = {k: [len(self.compress[k](b)) for b in bs] for k in some}
            if len(some) < 2:
                # against a language of the same script that isn't known: no dictionary at all, which has to win clearly
                columns[NONE] = [len(self.plain(b)) + NARROW_BYTES * len(some) for b in bs]
            # of equal sizes Han characters alone are rather Chinese
            names = sorted(columns, key=lambda k: (k == "ja" and len(some) > 1, k))
            for u, *ns in zip(us, *[columns[k] for k in names]):
                got[u] = sorted(zip(ns, names), key=_SIZE)
        return got

    def segments(self, text: str) -> list[tuple[str, float, str]]:
        """(language, confidence, words) of each segment, in reading order."""
        return next(self.segments_of([text]))

    def segments_of(self, texts: Iterable[str]) -> Iterator[list[tuple[str, float, str]]]:
        """The segments of each text, in the order of the texts; they are judged together until they have CHUNK_UNITS sentences."""
        chunk: list[list[str]] = []
        n = 0
        for t in texts:
            chunk.append(us := _judged_units(t))
            n += len(us) + 1
            if n >= CHUNK_UNITS:
                yield from self._chunk(chunk)
                chunk, n = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, chunk: list[list[str]]) -> Iterator[list[tuple[str, float, str]]]:
        sizes = self.sizes(u for us in chunk for u in us)
        judged = [[sizes[u] for u in us] for us in chunk]
        lone = [[_clear(z) for z in zs] for zs in judged]
        whole = [" ".join(us) if us and not any(lang) else None for us, lang in zip(chunk, lone)]
        sizes.update(self.sizes(w for w in whole if w is not None and w not in sizes))
        for us, zs, lang, w in zip(chunk, judged, lone, whole):
            yield _joined(us, zs, lang, None if w is None else sizes[w])


def _judged_units(text: str) -> list[str]:
    """The sentences of a text; all its words if it has none, nothing if they have no letters."""
    us = units(text)
    if not us:
        us = [" ".join(_PHRASE.sub(" ", _NOISE.sub("", _TAG.sub(" ", html.unescape(text)))).split())]
        if not _LETTERS.search(us[0]):
            return []
    return us


def _clear(z: list[tuple[int, str]]) -> str | None:
    """The language of the smallest size if no other is close."""
    return z[0][1] if len(z) == 1 or z[1][0] >= _bound(z) else None


def _bound(z: list[tuple[int, str]]) -> float:
    return max(z[0][0] + NARROW_BYTES, z[0][0] * (1 + NARROW_SHARE))


def _joined(us: list[str], judged: list[list[tuple[int, str]]], lang: list[str | None], whole: list[tuple[int, str]] | None) -> list[tuple[str, float, str]]:
    """Segments of a text's units; `lang` has their clear languages. whole: the sizes of the text, if none is clear."""
    if None in lang:
        close = [{k for n, k in z if n < _bound(z)} for z in judged]
        if whole is not None:
            lang = [whole[0][1] if whole[0][1] in c else None for c in close]
            if not any(lang):
                lang[0] = judged[0][0][1]
        for order in (range(1, len(us)), range(len(us) - 2, -1, -1)):
            step = 1 if order.step > 0 else -1
            for i in order:
                near = lang[i - step]
                if lang[i] is None and near is not None and near in close[i]:
                    lang[i] = near
    out: list[tuple[str, float, str]] = []
    for u, z, k in zip(us, judged, lang):
        k = k or z[0][1]
        mine = next(n for n, x in z if x == k)
        other = next((n for n, x in z if x != k), None)
        sure = 1.0 if other is None else max(0.0, min(1.0, 0.5 + (other - mine) / max(other, 1)))
        if out and out[-1][0] == k:
            out[-1] = (k, max(out[-1][1], sure), f"{out[-1][2]} {u}")
        else:
            out.append((k, sure, u))
    return out


def fit(samples: DataFrame, labelled: DataFrame | None, lang: str, sample: str, label: str, text: str) -> Judge:
    """A judge from clean samples (at most SAMPLE_ROWS) and, if given, from LABELLED_ROWS labelled rows of differing texts; those with the smallest hashes, so that each language has its share."""
    texts: dict[str, list[str]] = defaultdict(list)
    clean = samples.select(F.col(lang).alias("k"), F.col(sample).alias("t")).where("k is not null and t is not null")
    for r in sorted(hash_sample(clean, SAMPLE_ROWS, "k", "t").collect()):
        texts[r.k].append(r.t.lower())
    judge = Judge(texts)
    if labelled is None:
        return judge
    known = labelled.select(F.col(label).alias("k"), F.col(text).alias("t")).where(F.col("k").isin(judge.languages) & (F.length("t").between(20, 4000)))
    seen: dict[tuple[str, ...], list[tuple[str, str, bool]]] = defaultdict(list)
    rows = [(r.k, units(r.t)) for r in hash_sample(known, LABELLED_ROWS, "t").collect()]
    sized = judge.sizes(u for _, us in rows for u in us)
    for said, us in rows:
        for u in us:
            sizes = {k: n for n, k in sized[u]}
            best = min(sizes.values())
            if sizes.get(said, 1 << 30) < best + 2 * NARROW_BYTES:
                second = min((n for k, n in sizes.items() if k != said), default=1 << 30)
                seen[tuple(u.lower().split()[:2])].append((said, u.lower(), sizes[said] + NARROW_BYTES <= second))
    # sentences that the clean samples can't tell apart follow the label that most sentences with their first two words bear
    sure: dict[str, list[str]] = defaultdict(list)
    for votes in seen.values():
        k, n = Counter(k for k, _, _ in votes).most_common(1)[0]
        won = n >= 3 and n >= 0.7 * len(votes)
        mine: Counter[str] = Counter()
        for x, u, clear in votes:
            # a few sentences of each beginning, so that a dictionary holds all of them
            if (clear or won and x == k) and mine[x] < PER_BEGINNING:
                mine[x] += 1
                sure[x].append(u)
    for k, us in sure.items():
        texts[k] += _without_names(us, texts[k])
    return Judge(texts)


def _without_names(sentences: list[str], clean: list[str]) -> list[str]:
    """The sentences without words that are rare among them and in no clean sample: names say nothing about the language."""
    common = Counter(w for u in sentences for w in set(u.split()))
    given = {w for u in clean for w in u.split()}
    return [" ".join(w for w in u.split() if common[w] >= 4 or w in given or not w.isascii()) for u in sentences]


def segment_languages(df: DataFrame, judge: Judge, id_col: str, text: str, declared: str | None = None) -> DataFrame:
    """(id_col, seg_no, lang, confidence, declared, n_segments): one row a segment. Texts are judged in Arrow batches on the executors.

    With `declared`, texts of one language that equals that column are left out.
    """
    ship(df.sparkSession)
    # compressors can't be sent, texts can: at most DICTIONARY_BYTES a language
    shared = df.sparkSession.sparkContext.broadcast(judge.texts)
    seg = pa.struct([("lang", pa.string()), ("confidence", pa.float64())])
    keep_all = declared is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(shared.value)
        for b in batches:
            ids, said, out = [], [], []
            for i, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own.segments_of(t.as_py() for t in b.column(2))):
                if len(s) > 1 or s and (keep_all or s[0][0] != k):
                    ids.append(i)
                    said.append(k)
                    out.append([{"lang": x[0], "confidence": round(x[1], 6)} for x in s])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string()), pa.array(out, pa.list_(seg))], names=["id", "declared", "segs"])

    label = F.lit(None).cast("string") if keep_all else F.col(declared)
    got = df.select(F.col(id_col).alias("id"), label.alias("declared"), F.col(text).alias("t")).where("t is not null").mapInArrow(run, "id bigint, declared string, segs array<struct<lang:string,confidence:double>>")
    return got.select(F.col("id").alias(id_col), "declared", F.size("segs").alias("n_segments"), F.posexplode("segs").alias("p", "s")).select(id_col, (F.col("p") + 1).alias("seg_no"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"), "declared", "n_segments")


def usable_rows(df: DataFrame, id_col: str, text: str, label: str, name: str) -> DataFrame:
    """(id_col, text, declared): the rows whose text says something; declared is the language their label names."""
    stock = learned_stock_phrases(df, text, name)
    return df.where(usable(F.col(text), stock)).select(id_col, text, label_language(F.col(label)).alias("declared"))


def relabelled(df: DataFrame, samples: DataFrame, id_col: str = "rec_id", text: str = "description", label: str = "desc_lang", name: str = "name") -> DataFrame:
    """Segments of the texts that need a label: those whose label is missing or wrong, and all of several languages.

    Columns: id_col, seg_no, lang, confidence, declared (the label's language), n_segments.
    """
    rows = usable_rows(df, id_col, text, label, name)
    judge = fit(samples, df.select(text, label_language(F.col(label)).alias("declared")), "lang", "sample", "declared", text)
    return segment_languages(rows, judge, id_col, text, "declared")
