"""Segmentation with a dictionary, for texts without spaces, and a light stemmer for Latin words.

The dictionary is a small table (word, frequency, tag) that the caller gives; with an empty one every Chinese
character is a token. Agreement of the two greedy passes is taken; where they differ the best path by dynamic
programming decides."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: The score of an unknown piece, and of a path per piece (fixed values).
UNKNOWN, PER_PIECE = -12.0, 30.0
_RUN = re.compile(r"[一-龥]+|[a-z0-9ß-öø-ÿœ]+|[а-яё]+")


@dataclass
class Dictionary:
    words: dict[str, tuple[float, str]] = field(default_factory=dict)
    longest: int = 1

    @classmethod
    def of(cls, rows: list[tuple[str, float, str]]) -> Dictionary:
        words = {w.lower(): (float(int(math.log(max(f, 1e-9) / 1e6) + 0.5)), t) for w, f, t in rows if w}
        return cls(words, max(map(len, words), default=1))

    @classmethod
    def from_table(cls, table: DataFrame, most: int = 1_000_000) -> Dictionary:
        """Columns ``word``, ``freq``, ``pos``. A dictionary goes to all workers, so one of more than ``most`` words is refused."""
        rows = table.where("word is not null").groupBy("word").agg(F.max("freq").alias("freq"), F.max_by("pos", "freq").alias("pos")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a dictionary has {most} words at most")
        return cls.of([(r["word"], r["freq"] or 1.0, r["pos"] or "") for r in rows])

    def frequency(self, word: str) -> int:
        return int(math.exp(self.words[word][0]) * 1e6 + 0.5) if word in self.words else 0

    def tag(self, word: str) -> str:
        return self.words.get(word, (0, ""))[1]

    def forward(self, s: str) -> list[str]:
        out, i = [], 0
        while i < len(s):
            n = next((k for k in range(min(self.longest, len(s) - i), 1, -1) if s[i : i + k] in self.words), 1)
            out.append(s[i : i + n])
            i += n
        return out

    def backward(self, s: str) -> list[str]:
        out, j = [], len(s)
        while j > 0:
            n = next((k for k in range(min(self.longest, j), 1, -1) if s[j - k : j] in self.words), 1)
            out.append(s[j - n : j])
            j -= n
        return out[::-1]

    def score(self, pieces: list[str]) -> float:
        """Fewer pieces, longer words and more frequent words score higher."""
        if not pieces:
            return 0.0
        return PER_PIECE / len(pieces) + sum(len(p) > 1 for p in pieces) / len(pieces) + sum(self.words[p][0] if p in self.words else UNKNOWN for p in pieces)

    def paths(self, s: str, best: int = 2) -> list[list[str]]:
        """The best segmentations; states are kept per number of pieces, as the score depends on it."""
        states: list[dict[int, list[tuple[float, list[str]]]]] = [{} for _ in range(len(s) + 1)]
        states[0] = {0: [(0.0, [])]}
        for i in range(len(s)):
            for n, kept in states[i].items():
                for k in range(1, min(self.longest, len(s) - i) + 1):
                    p = s[i : i + k]
                    if k > 1 and p not in self.words:
                        continue
                    gain = self.words[p][0] if p in self.words else UNKNOWN
                    to = states[i + k].setdefault(n + 1, [])
                    to += [(v + gain, [*path, p]) for v, path in kept]
                    to.sort(key=lambda x: (-x[0], x[1]))
                    del to[best:]
        found = [path for kept in states[len(s)].values() for _, path in kept]
        return sorted(found, key=lambda p: (-self.score(p), p))[:best]

    def segment(self, s: str) -> list[str]:
        f, b = self.forward(s), self.backward(s)
        if f == b:
            return f
        out: list[str] = []
        i = x = y = 0
        while i < len(s):
            a, z, xa, yz = i, i, x, y
            a += len(f[xa])
            z += len(b[yz])
            while a != z:
                if a < z:
                    xa += 1
                    a += len(f[xa])
                else:
                    yz += 1
                    z += len(b[yz])
            span = s[i:a]
            out += [span] if xa == x and yz == y else self.paths(span, 1)[0]
            i, x, y = a, xa + 1, yz + 1
        return out

    def fine(self, s: str) -> list[str]:
        """The second best segmentation of a word of three or more characters: its parts."""
        if len(s) < 3:
            return [s]
        inner = [p for p in self.paths(s, 2) if p != [s]]
        return inner[0] if inner and any(len(x) > 1 for x in inner[0]) else [s]


def stem(word: str) -> str:
    """A light stemmer: plural, -ing, -ed, -ly, if a stem of three letters with a vowel is left."""
    for suffix, by in (("sses", "ss"), ("ies", "y"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")):
        if word.endswith(suffix) and not (suffix == "s" and word[-2:] in ("ss", "us", "is")):
            base = word[: -len(suffix)] + by
            if len(base) >= 3 and re.search("[aeiouy]", base):
                return base[:-1] if suffix in ("ing", "ed") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return word


def tokenize(c: Column, dictionary: Dictionary | None = None, fine: bool = False, stems: bool = True) -> Column:
    """Tokens of a text, joined by spaces: Latin words stemmed, Chinese by the dictionary."""
    d = dictionary or Dictionary()

    def one(text):
        if text is None:
            return None
        out: list[str] = []
        for run in _RUN.findall(text.translate(_HALF).lower()):
            if "一" <= run[0] <= "龥":
                words = d.segment(run)
                out += [p for w in words for p in d.fine(w)] if fine else words
            else:
                out.append(stem(run) if stems and run.isascii() and run.isalpha() else run)
        return " ".join(out)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(one)

    return run(c)


_HALF = {0x3000: " ", **{x: chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)}}


def glue_latin(tokens: Column) -> Column:
    """Neighbouring Latin words as one term ("machine learning")."""
    start = F.array().cast("array<string>")

    def step(acc, t):
        last = F.try_element_at(acc, F.lit(-1))
        both = F.coalesce(last.rlike("[a-zA-Z]$"), F.lit(False)) & t.rlike("^[a-zA-Z]+$")
        return F.when(both, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), t)))).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(tokens, start, step)


def merge_short(tokens: Column, stop_words: list[str] = T.STOP_WORDS) -> Column:
    """Runs of short tokens (one character, or one or two Latin letters or digits; no stop words) as one term each.

    From a run of five or more two are taken off at a time, until fewer are left, which stay together. A short first token
    goes together with a longer second one that doesn't begin with a Latin letter or a digit. Empty tokens are dropped."""
    empty = F.array().cast("array<string>")
    short = lambda t: ((F.length(t) == 1) | t.rlike("^[0-9a-z]{1,2}$")) & ~t.isin(*stop_words)
    own = F.filter(tokens, lambda t: t != "")
    first, second = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    alone = (F.length(first) == 1) | first.rlike("^[0-9a-z]{1,2}$")
    head = (F.size(own) > 1) & alone & (F.length(second) > 1) & ~second.rlike("^[0-9a-zA-Z]")
    rest = F.when(F.coalesce(head, F.lit(False)), F.slice(own, 3, F.size(own))).otherwise(own)
    start = F.struct(F.when(F.coalesce(head, F.lit(False)), F.array(F.concat_ws(" ", first, second))).otherwise(empty).alias("out"), empty.alias("run"))

    def close(a):
        n = F.size(a["run"])
        pairs = F.when(n < 5, 0).otherwise(F.floor((n - 3) / 2)).cast("int")  # taken off while five or more are left
        two = F.transform(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), lambda k: F.array_join(F.slice(a["run"], 2 * k - 1, F.lit(2)), " "))
        left = F.slice(a["run"], 2 * pairs + 1, F.greatest(n - 2 * pairs, F.lit(0)))
        return F.concat(a["out"], F.when(pairs > 0, two).otherwise(empty), F.when(F.size(left) > 0, F.array(F.array_join(left, " "))).otherwise(empty))

    def step(a, t):
        return F.when(short(t), F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(t)).alias("run"))).otherwise(F.struct(F.concat(close(a), F.array(t)).alias("out"), empty.alias("run")))

    return F.when(tokens.isNotNull(), F.aggregate(rest, start, step, close))


def synonyms(terms: DataFrame, table: DataFrame, most: int = 8) -> DataFrame:
    """Up to ``most`` synonyms of each term (the term itself left out), an empty list if none is known."""
    lists = table.groupBy("term").agg(F.slice(F.array_sort(F.collect_set("synonym")), 1, most + 1).alias("s"))
    return terms.join(lists, "term", "left").withColumn("synonyms", F.slice(F.array_except(F.coalesce("s", F.array().cast("array<string>")), F.array("term")), 1, most)).drop("s")
