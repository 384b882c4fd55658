"""Language of each sentence of a text, by bit-sliced n-gram filters.

One Bloom filter per language, sliced so that the bits of all languages stand in one byte: a single look-up
of an n-gram (the AND of the bytes at its probes) gives the set of all languages that contain it. Per sentence
and language the hits are counted, less the false hits that the filter's load lets expect; the language with the most wins,
with its lead over the second as the confidence.

N-grams are of three and four letters; of characters U+4E00-U+9FFF single ones and pairs. Digits and signs are spaces.
Wrongly decoded texts are repaired first. A sentence counts if it is terminated and has at least
``LEAST_WORDS`` words; cells of tables, headings, greetings and code aren't sentences. A long text without any
full stop is judged by windows of ``WINDOW`` words.

Defined results: null and empty texts have no segment; texts without a full sentence have segments, but aren't among the
mislabelled; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunk_config, codes, slices
from .encoding import Repairer

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "it", "ru")
SAMPLE_ROWS, WIDEN_ROWS = 20_000, 4000
LEAST_WORDS, WINDOW, TEXT_WORDS = 4, 14, 20
LEAST_GRAMS, LEAST_SHARE = 16, 0.45
#: Confidence that a sentence of a language beside the main one must have.
SURE = 0.12
SLICE_CHARS = 400_000
_BITS = 18

#: Names of the languages in themselves and in each other (fixed values), lower-cased; codes with a region are cut.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese английский 英文 英语 英語",
    "zh": "zh zho chi cn chinese mandarin chinesisch chinois chino chinês cinese китайский 中文 汉语 漢語 简体中文 繁體中文 普通话",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco немецкий 德文 德语 德語",
    "fr": "fr fra fre french français francais französisch francés frances francês francese французский 法文 法语 法語",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spagnolo испанский 西班牙文 西班牙语",
    "it": "it ita italian italiano italienisch italien итальянский 意大利文 意大利语",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese португальский 葡萄牙文 葡萄牙语",
    "ru": "ru rus russian русский russisch russe ruso russo 俄文 俄语 俄語",
}


def declared_language(value: Column) -> Column:
    """The code of a declared language, null if the value names none (placeholders, blanks) or several."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"[\s\x{a0}]+", " "))), r"^([a-z]{2,3})[-_][a-z]{2,4}$", "$1")
    words = F.split(plain, r"[\s,;/()\[\]]+")
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(n) for n in names.split()])), code) for code, names in NAMES.items()]))
    return F.when(F.size(named) == 1, F.element_at(named, 1))


_CLASS = np.zeros(65536, np.uint8)  # 1: letter, 2: digit, 3: a character that is a word of its own
for _i in range(65536):
    _c = chr(_i)
    _CLASS[_i] = 3 if 0x4E00 <= _i <= 0x9FFF else 1 if _c.isalpha() else 2 if _c.isnumeric() else 0
_BOUND = re.compile(r"[.!?;]+[\"'”’»“)]*(?=\s|$)|[。！？；]+[”’」』)）]*|\t|\n\s*\n|\n(?=\s*(?:[-–•*]|\d+[.)])\s)")
_CELL = re.compile(r"[:：]\s*[^\s:：]+\s*[;；]?\s*$")
_CODE = re.compile(r"[={}\[\]]|\w\(\w*\)|[a-z]_[a-z]|//")


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes for each place of a text, and whether they count; the three places after it must exist."""
    kind = _CLASS[np.minimum(c, 65535)]
    x = np.where((kind & 1) == 1, c, 32).astype(np.uint32)
    own = kind == 3
    n = len(x) - 3
    with np.errstate(over="ignore"):
        two = x[:n] * np.uint32(0x9E3779B1) + x[1 : n + 1] * np.uint32(0x85EBCA77)
        three = two + x[2 : n + 2] * np.uint32(0xC2B2AE3D)
        a = np.where(own[:n], x[:n] * np.uint32(0x27D4EB2F), three)
        b = np.where(own[:n], two ^ np.uint32(0x5BD1E995), three + x[3:] * np.uint32(0x165667B1))
        for h in (a, b):
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
    counts = own[:n] | ((x[1 : n + 1] != 32) & (x[:n] + x[2 : n + 2] != 64) & ~own[1 : n + 1])
    return a, b, counts


@dataclass
class LanguageFilter:
    table: np.ndarray
    false: np.ndarray

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> LanguageFilter:
        """A filter from (language, text); n-grams that a language has only once don't enter."""
        table = np.zeros(1 << _BITS, np.uint8)
        false = np.zeros(len(LANGUAGES))
        for k, lang in enumerate(LANGUAGES):
            own = [t for code, t in texts if code == lang and t]
            if not own:
                continue
            a, b, counts = _grams(codes(f" {'   '.join(own).lower()}    "))
            for h in (a, b):
                grams, n = np.unique(h[counts], return_counts=True)
                for at in cls._probes(grams[n > 1]):
                    table[at] |= np.uint8(1 << k)
            false[k] = ((table >> k) & 1).mean() ** 2
        return cls(table, false)

    @staticmethod
    def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> np.uint32(32 - _BITS), (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)

    def shares(self, c: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the corrected share of its n-grams that each language contains, and their number."""
        a, b, counts = _grams(np.concatenate([c, np.full(3, 32, np.uint32)]))
        sums = np.zeros((len(begins), len(LANGUAGES)), np.int64)
        for h in (a, b):
            p, q = self._probes(h)
            mask = np.where(counts, self.table[p] & self.table[q], 0).astype(np.uint8)
            for half in (0, 1):
                lanes = np.add.reduceat(_SPREAD[half][mask], begins)
                for k in range(4):
                    sums[:, 4 * half + k] += ((lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
        n = 2 * np.add.reduceat(counts.astype(np.int64), begins)
        return np.maximum(0, (sums - n[:, None] * self.false) / (1 - self.false) / np.maximum(1, n)[:, None]), n


_SPREAD = [np.array([sum(((m >> (4 * half + k)) & 1) << (16 * k) for k in range(4)) for m in range(256)], np.uint64) for half in (0, 1)]


def _segments(text: str) -> list[tuple[int, int, int]]:
    """Begin, end and kind (1: ended, 0: not, -1: no sentence) of all segments, which cover the text."""
    out, begin = [], 0
    for m in _BOUND.finditer(text):
        end = m.end()
        if end == begin:
            continue
        while end - begin > 60_000:  # lanes of 16 bits
            out.append((begin, begin + 60_000, 0))
            begin += 60_000
        ended = text[m.start()] in ".!?;。！？；"
        out.append((begin, end, (-1 if _CELL.search(text, max(begin, end - 60), end) or _CODE.search(text, begin, end) else 1) if ended else 0))
        begin = end
    while begin < len(text):
        end = min(len(text), begin + 60_000)
        out.append((begin, end, 0))
        begin = end
    return out


def _windows(text: str) -> list[tuple[int, int, int]]:
    ends = [m.end() for m in re.finditer(r"[一-鿿]|[^\s一-鿿]+", text)][WINDOW - 1 :: WINDOW]
    ends = [*ends[:-1], len(text)] if ends else [len(text)]
    return [(b, e, 2) for b, e in zip([0, *ends[:-1]], ends, strict=True) if e > b]


def label_batch(texts: list[str | None], f: LanguageFilter, repairer: Repairer, every: bool = False) -> Iterator[tuple[int, int, int, int, str | None, float, bool]]:
    """Segments with a language: row, number, begin, end, language, confidence, and whether it is a full sentence (of at least
    ``LEAST_WORDS`` words and ``LEAST_GRAMS`` n-grams, of which the language has ``LEAST_SHARE``, in a text of ``TEXT_WORDS`` words).
    Places are those of the repaired, lower-cased text.

    ``every``: also of short segments and texts, with a confidence that is lower the less there is to go by; what has no
    n-gram of any language gets no language, with a confidence of 0. Else only what may be a full sentence."""
    rows = [(i, (repairer.repair(t)[0] if not t.isascii() else t).lower()) for i, t in enumerate(texts) if t and (every or len(t) > TEXT_WORDS)]
    for x, y in slices([len(t) for _, t in rows], SLICE_CHARS):
        part = rows[x:y]
        c = codes("   " + "".join(t + "   " for _, t in part))  # no n-gram has letters of two texts
        starts = np.cumsum([3] + [len(t) + 3 for _, t in part])
        kind = _CLASS[np.minimum(c, 65535)]
        word = (kind == 1) | (kind == 2)
        first = (kind == 3) | (word & ~np.concatenate([[False], word[:-1]]))
        first[starts[:-1]] |= word[starts[:-1]]
        words = np.concatenate([[0], np.cumsum(first)])
        segments = []
        for k, (_, t) in enumerate(part):
            short = words[starts[k + 1]] - words[starts[k]] < TEXT_WORDS
            if short and not every:
                segments.append((k, starts[k], starts[k + 1] - 3, -2))
                continue
            own = _segments(t)
            if not short and len(own) < 4 and not any(s[2] > 0 and words[starts[k] + s[1]] - words[starts[k] + s[0]] >= LEAST_WORDS for s in own) and not re.search(r"[=(){}|]|[:：]\s*\S+\s*(?:;|\n|$)", t):
                own = _windows(t)
            segments += [(k, starts[k] + b, starts[k] + e, -1 if short else kind_) for b, e, kind_ in own]
        if not segments:
            continue
        begins = np.array([s[1] for s in segments], np.int64)
        shares, n = f.shares(c, begins - 1)  # the n-gram that begins with the space before a word is the word's
        best = shares.argmax(axis=1)
        top = shares[np.arange(len(best)), best]
        shares[np.arange(len(best)), best] = -1
        confidence = np.clip((top - np.maximum(0, shares.max(axis=1))) / np.maximum(top, 1e-9), 0, 1)
        clear = (n >= LEAST_GRAMS) & (top >= LEAST_SHARE) & (words[[s[2] for s in segments]] - words[begins] >= LEAST_WORDS)
        confidence = np.where(clear, confidence, confidence * np.minimum(1, n / LEAST_GRAMS) * np.minimum(1, top / LEAST_SHARE))
        number: Counter = Counter()
        for j, (k, b, e, kind_) in enumerate(segments):
            if kind_ == -2:
                continue
            number[k] += 1
            if every or clear[j]:
                lang = LANGUAGES[best[j]] if top[j] > 0 else None
                yield part[k][0], number[k], int(b - starts[k]), int(e - starts[k]), lang, float(confidence[j]), bool(kind_ > 0 and clear[j])


def widen(f: LanguageFilter, labelled: list[tuple[str, str]], corpus: list[tuple[str, str]]) -> LanguageFilter:
    """A filter from the labelled texts, and the sentences of those corpus texts whose label the first filter confirms."""
    found: dict[int, list] = {}
    texts = [t for _, t in corpus]
    for i, _, b, e, lang, _, full in label_batch(texts, f, Repairer()):
        if full:
            found.setdefault(i, []).append((lang, b, e))
    more = []
    for i, own in found.items():
        lang = corpus[i][0]
        if texts[i].isascii() or len(texts[i].lower()) == len(texts[i]):
            if sum(x == lang for x, _, _ in own) >= 0.8 * len(own):
                more += [(lang, texts[i][b:e]) for x, b, e in own if x == lang]
    return LanguageFilter.fit(labelled + more)


def train(samples: DataFrame, items: DataFrame, docs: DataFrame | None = None) -> LanguageFilter:
    """A filter from at most ``SAMPLE_ROWS`` labelled rows of each table, widened by at most ``WIDEN_ROWS`` labelled documents
    (those of the least hashed texts), whose labels may be wrong."""
    a = bounded_sample(samples.where("text is not null and lang is not null").select("lang", "text"), SAMPLE_ROWS, "text", "lang").toPandas()
    b = bounded_sample(items.where("passage is not null and lang is not null").select("lang", F.col("passage").alias("text")), SAMPLE_ROWS, "text", "lang").toPandas()
    labelled = [*a.itertuples(index=False, name=None), *b.itertuples(index=False, name=None)]
    f = LanguageFilter.fit(labelled)
    if docs is None:
        return f
    c = bounded_sample(docs.where(F.col("text").isNotNull() & F.col("lang").isin(*LANGUAGES)).select("lang", "text"), WIDEN_ROWS, "text", "lang", by="lang").toPandas()
    return widen(f, labelled, [*c.itertuples(index=False, name=None)])


def label_segments(rows: DataFrame, f: LanguageFilter, id_col: str = "id", text_col: str = "content_with_weight") -> DataFrame:
    """``id``, ``segment``, ``begin``, ``end``, ``lang`` (null if nothing tells), ``confidence`` and ``full`` of every segment of
    every text that isn't empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer()
        for pdf in batches:
            ids = pdf["_id"].tolist()
            out = [(ids[i], *x) for i, *x in label_batch(pdf["_text"].tolist(), f, repairer, True)]
            yield pd.DataFrame(out, columns=["id", "segment", "begin", "end", "lang", "confidence", "full"])

    some = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return some.mapInPandas(run, "id string, segment int, begin int, end int, lang string, confidence double, full boolean")


def main_languages(rows: DataFrame, f: LanguageFilter, id_col: str = "id", text_col: str = "content_with_weight") -> DataFrame:
    """``id``, ``lang`` and ``confidence`` of every text that isn't empty: the language of most of its characters (full sentences
    count ten times), with the mean confidence of its segments times their part of the text; null if nothing tells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer()
        for pdf in batches:
            found: dict[int, dict[str | None, list[float]]] = {}
            for i, _, b, e, lang, confidence, full in label_batch(pdf["_text"].tolist(), f, repairer, True):
                own = found.setdefault(i, {}).setdefault(lang, [0.0, 0.0])
                size = (e - b) * (10 if full else 1)
                own[0] += size * (lang is not None)
                own[1] += size * confidence
            out = []
            for i, by in found.items():
                lang = max(by, key=lambda x: (by[x][0], x or ""))
                out.append((pdf["_id"].iloc[i], lang, by[lang][1] / max(1e-9, sum(n for n, _ in by.values()))))
            yield pd.DataFrame(out, columns=["id", "lang", "confidence"])

    some = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return some.mapInPandas(run, "id string, lang string, confidence double")


def text_languages(rows: DataFrame, f: LanguageFilter, id_col: str = "id", text_col: str = "content_with_weight", *keep: str) -> DataFrame:
    """``id``, the columns ``keep`` and ``langs``, the sorted languages of the full sentences, of every text with such.

    A language beside the main one counts if a sentence of it has a confidence of ``SURE``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer()
        for pdf in batches:
            found: dict[int, dict[str, list[float]]] = {}
            for i, _, _, _, lang, confidence, full in label_batch(pdf["_text"].tolist(), f, repairer):
                if full:
                    found.setdefault(i, {}).setdefault(lang, []).append(confidence)
            langs = {}
            for i, own in found.items():
                main = max(own, key=lambda x: sum(own[x]))
                langs[i] = sorted(x for x, c in own.items() if x == main or max(c) >= SURE)
            at = sorted(langs)
            out = pdf.iloc[at][["id", *keep]].reset_index(drop=True)
            yield out.assign(langs=pd.Series([langs[i] for i in at], dtype=object))

    some = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("_text"), *keep)
    kinds = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return some.mapInPandas(run, f"id string{kinds}, langs array<string>")


def mislabelled(chunk: DataFrame, source_file: DataFrame, chunking_config: DataFrame, f: LanguageFilter) -> DataFrame:
    """``id`` and ``lang`` of the chunks whose languages aren't exactly the declared one, or without a declared one."""
    config = chunk_config(source_file, chunking_config, "language").select("doc_id", declared_language(F.col("language")).alias("declared"))
    own = text_languages(chunk, f, "id", "content_with_weight", "doc_id")
    both = own.join(config, "doc_id", "left")
    return both.where(F.col("declared").isNull() | (F.size("langs") != 1) | (F.element_at("langs", 1) != F.col("declared"))).select("id", F.explode("langs").alias("lang")).distinct()
