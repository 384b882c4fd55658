"""Text that was decoded with a wrong character encoding.

For all pairs (the encoding a text was written in, the one it was read in) the garbled forms of what texts consist of
are computed beforehand and go into multi-pattern automata (three, as each is fastest with few first characters: forms that tell,
forms within runs, and single characters with a neighbour); what they don't match is never changed.

* Forms of two or more characters that tell the proper character are replaced span by span, once more for text that was
  garbled twice.
* Other forms mark a span with the pairs that they speak for, as the proper text depends on the neighbours: two letters garbled
  between Cyrillic encodings, a Chinese character read in a one-byte or another East Asian encoding, a single Latin letter beside a
  letter, a sign beside a digit. A run of characters with such marks is decoded by the pairs marked, and replaced if it becomes
  common text; a word with a mark is replaced if it can't be one (a sign or a capital between small letters, a letter of no
  language at hand), or if it becomes a known one.

Sequences that a text merely quotes (alone within quotation marks, or an apostrophe standing alone) stay.

Defined results: null, empty and plain ASCII values are never damaged; U+FFFD means damage that can't be undone at
its place; repeated rows of an id give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

_OPEN, _CLOSE = "“«\"'„‘「『《‹", "”»\"'“’」』》›"
_WESTERN = "áàâãäåæçéèêëíìîïñóòôõöøœúùûüßÁÀÂÃÄÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØŒÚÙÛÜ"
#: Letters beyond a-z of the languages at hand (en de fr es pt it), for words that must consist of them.
_LETTERS = "áàâãäçéèêëíîïñóòôõöœúùûüßìÁÀÂÃÄÇÉÈÊËÍÎÏÑÓÒÔÕÖŒÚÙÛÜÌ"
_READ_AS = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "cp1250", "iso8859-15")
_CYRILLIC_PAIRS = (
    ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"),
    ("latin-1", "koi8-r"), ("cp1252", "koi8-r"), ("latin-1", "cp866"), ("cp1252", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251"),
    ("cp850", "cp1251"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("cp437", "cp866"), ("cp866", "koi8-r"), ("koi8-r", "cp866"),
)
#: Rows of the table of known words that go to the workers, at most.
MOST_KNOWN = 500_000
#: What a run may be garbled by: read as, written in, and what it must become.
_PAIRS = [
    ("gb18030", "utf-8", "sound"), *((r, "gb18030", "east") for r in ("big5", "big5hkscs", "shift_jis", "euc_kr")), ("gb18030", "big5", "east"),
    *((r, "gb18030", "han") for r in ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "cp1250")), *((r, w, "russian") for r, w in _CYRILLIC_PAIRS),
]
#: Signs of cp1252 that mac_roman, cp437 and cp850 read as others, where digits tell.
_SIGNS = [
    (re.compile(r"(?<=\d)[ñû](?=\d)"), "–"),
    (re.compile(r"(?<=\d )[∞░](?=C\b)"), "°"),
    (re.compile(r"(?<![^\s(])[ÄÇЂ](?=\d)"), "€"),
    (re.compile(r"(?<=\d[. ])[™¬](?= v)"), "ª"),
    (re.compile(r"(?<=\d )[ÄÇЂ](?=[\s.,;])"), "€"),
    (re.compile(r"^[ñû] (?=\S)", re.MULTILINE), "– "),
    (re.compile(r"^[òï] (?=\S)", re.MULTILINE), "• "),
]
#: Quotation marks of cp1252 that cp437, cp850 and mac_roman read as letters around a word.
_QUOTES = re.compile(r"(?<!\w)([ôì])(?=[A-ZÀ-Þ])([^\nôöîì“”]{1,80}?)([öî])(?!\w)")


def _bytes_as(data: bytes, codec: str) -> str | None:
    """What a lenient reader makes of the bytes: codes that the encoding lacks stay control characters."""
    try:
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)
    except UnicodeError:
        return None


def _common_han() -> set[str]:
    """The 3755 characters of the first level of GB 2312, by rule."""
    return {c for hi in range(0xB0, 0xD8) for lo in range(0xA1, 0xFF) for c in [bytes([hi, lo]).decode("gb2312", "ignore")] if c}


def _repertoire() -> tuple[list[str], list[str]]:
    marks = [0x81, 0x8D, 0x8F, 0x90, 0x9D, *range(0xA0, 0x100), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC, *range(0x2010, 0x2027), 0x2030, 0x2039, 0x203A, 0x20AC, 0x2103, 0x2116, 0x2122, 0x401, *range(0x410, 0x450), 0x451, *range(0x3000, 0x3012), *range(0xFF01, 0xFF5F)]
    han = [c for hi in range(0xB0, 0xF8) for lo in range(0xA1, 0xFF) for c in [bytes([hi, lo]).decode("gb2312", "ignore")] if c]
    return [chr(x) for x in marks], han


def _single() -> dict[str, dict[str, str]]:
    """For each pair of one-byte encodings the proper letter of each garbled character."""
    pairs = [("cp1252", r) for r in ("mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250")] + [(w, r) for w in ("mac_roman", "cp437", "cp850") for r in ("cp1252", "latin-1", "cp1251")]
    out = {}
    for written, read in pairs:
        table = {}
        for c in _WESTERN + "’":
            try:
                g = _bytes_as(c.encode(written), read)
            except UnicodeError:
                continue
            if g and len(g) == 1 and g != c and ord(g) > 0x7F:
                table[g] = c
        out[f"{written} read as {read}"] = table
    return out


class Repairer:
    """Finds and undoes garbled spans; ``known`` are words (with counts) that garbled words may turn into."""

    def __init__(self, known: dict[str, int] | None = None):
        self.__dict__.update(_patterns())
        self.known, self.seen = known or {}, {}

    def _build(self) -> None:
        """All that doesn't depend on known words."""
        import ahocorasick

        forms: dict[str, tuple[str | None, set]] = {}
        marks, han = _repertoire()
        for chars, codecs in ((marks, _READ_AS), (han, _READ_AS[:8])):
            for read in codecs:
                for c in chars:
                    g = _bytes_as(c.encode("utf-8"), read)
                    if g and len(g) > 1 and not g.isascii() and g not in forms and not (len(g) > 2 and re.fullmatch("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+", g)):
                        forms[g] = (c, set())
                    # control characters may have been dropped
                    if g and len(g) == 3 and c in marks and len(h := re.sub("[\x80-\x9f]", "", g)) == 2 and h[0] in "âã" and not h.isalpha() and h not in forms:
                        forms[h] = (c, set())
        for c in marks:  # half-width kana
            try:
                g = c.encode("utf-8").decode("shift_jis")
            except UnicodeError:
                continue
            if len(g) > 1 and not g.isascii() and g not in forms:
                forms[g] = (c, set())
        self.common = _common_han()
        self.single = _single()
        garbled = "".join({g for t in self.single.values() for g in t})
        self.han_letter = {}
        for read in ("gb18030", "big5", "euc_kr"):
            for c in _WESTERN + "°":
                try:
                    g = c.encode("utf-8").decode(read)
                except UnicodeError:
                    continue
                if len(g) == 1:
                    self.han_letter.setdefault(g, c)
        self.automaton, self.runs_of, self.beside = (ahocorasick.Automaton() for _ in range(3))
        for g in self._lost():
            forms.setdefault(g, (None, set()))
        for g, (c, _) in forms.items():
            self.automaton.add_word(g, (c, len(g)))
        pairs: dict[str, set[int]] = {}
        for g, k in self._run_marks():
            pairs.setdefault(g, set()).add(k)
        for g, own in pairs.items():
            self.runs_of.add_word(g, (len(g), tuple(sorted(own))))
        for g in self._beside(garbled + "".join(self.han_letter)):
            self.beside.add_word(g, len(g))
        for automaton in (self.automaton, self.runs_of, self.beside):
            automaton.make_automaton()
        han_letters = re.escape("".join(self.han_letter))
        far = r"(?![\u3400-\u9fff\uac00-\ud7a3])"
        self.mixed = re.compile(rf"(?<=[a-z])[{han_letters}]{far}(?![，。；：])|(?<![\u3400-\u9fff\uac00-\ud7a3，。；：])[{han_letters}](?=[a-z]{{2}})|(?<=[0-9] )[{han_letters}](?=C\b)")
        self.suspect = re.compile(f"[{re.escape(garbled)}]")
        beyond = re.escape(garbled) + _LETTERS
        self.word = re.compile(f"(?<![A-Za-z’'{beyond}])[A-Za-z']*+[’{beyond}][A-Za-z’'{beyond}]*")
        self.rare = re.compile("[^\x00-\x7f" + "".join(sorted(self.common)) + "，。！？；：、“”‘’（）《》「」『』【】…—–·％℃€£¥±×µ°　]")
        clean = "".join(sorted(self.common)) + "а-яА-ЯёЁ" + _LETTERS.replace("Ã", "").replace("Â", "") + "，。！？；：、“”‘’（）《》「」【】…—–·　«»•°ºª€℃¿¡„\xad‐¬№"
        self.unclean = re.compile(f"[^\x00-\x7f{clean}]")
        upper = "ÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ"
        #: What can be garbled though each character is common.
        # each expression begins with the characters that it is about, so that others are passed over quickly
        marks = "„‚“”‘…•–—·ªº°"
        self.combined = [
            re.compile(
                f"[{upper}{marks}ßõñûòïìôâ](?:(?<=[a-zß-ÿ][{upper}])|(?<=[a-z][{marks}])(?=[a-z])|(?<=[ÃÂ])(?![A-ZÀ-Þ])|(?<=[0-9][ñû])(?=[0-9])|(?<=[ÄÇ])(?=[0-9])|(?<=[0-9] [ÄÇ])|(?<=[ßõ])|(?<=[ìôâ])(?=[A-ZÀ-Þ])|(?<=[ñûòï])(?= \\S))"
            ),
            re.compile("[а-яА-ЯёЁ](?:(?=[^\\sа-яА-ЯёЁ\x00-\x7f»«…–—’“”„：，。；！？])|(?<=[а-яё])(?=[А-ЯЁ]))"),
            re.compile("[一-鿿](?:(?<=[a-z][一-鿿])|(?=[a-z])|(?<=[0-9] [一-鿿])(?=C))"),
            re.compile("[\xa1-\xaa\xac\xae-\xba\xbc-\xff]{3}"),
        ]
        self.run = re.compile(r"[^\x00-\x7f]+(?:[ \-_.]?[^\x00-\x7f]+)*")
        self.eastern = re.compile("[\u3041-\u30ff\u3100-\u312f\u3400-\u9fff\uac00-\ud7a3\ue000-\uf8ff\ufe30-\ufe6b\uff00-\uffef]")
        self.cyrillic = re.compile(r"[Ѐ-ӿ]")

    # -- what the automaton has

    def _run_marks(self) -> Iterator[tuple[str, int]]:
        """Garbled forms of pieces of text that don't tell their proper characters by themselves, each with a pair."""
        small = [*map(chr, range(0x430, 0x450)), "ё"]
        usual = [a + b for a in small + [x.upper() for x in small] for b in small] + ["№", "»", "«"]
        for k, (read, written, what) in enumerate(_PAIRS):
            if what == "russian":  # two letters
                for c in usual:
                    try:
                        g = c.encode(written).decode(read)
                    except UnicodeError:
                        continue
                    if g != c and not re.fullmatch("[А-ЯЁ]?[а-яё]+|[ -~]+", g):
                        yield g, k
                continue
            if what == "sound":  # letters and signs of two bytes, and the first two bytes of others, are a character that is rare
                for c in [*_repertoire()[0], *sorted(self.common)]:
                    g = c.encode("utf-8")[:2].decode(read, "ignore")
                    if len(g) == 1 and g not in self.common and not g.isascii():
                        yield g, k
            for c in self.common:
                try:
                    data = c.encode(written)
                except UnicodeError:
                    continue
                if what == "sound":  # three bytes read by twos: the next character's first byte belongs to the form
                    for lead in range(0xE4, 0xEA):
                        g = (data + bytes([lead])).decode(read, "ignore")
                        if len(g) == 2:
                            yield g, k
                    continue
                g = data.decode(read, "ignore") if what == "east" else _bytes_as(data, read)
                if g and (len(g) == 1 and g not in self.common or len(g) == 2) and not g.isascii():
                    yield g, k

    @staticmethod
    def _beside(garbled: str) -> Iterator[str]:
        """Single garbled characters with a letter, a digit or a space beside them."""
        for g in garbled + "".join(sorted(set("ñûòïôìöîÄÇЂ∞░™¬"))):
            for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789’' \n(":
                yield c + g
                yield g + c

    @staticmethod
    def _lost() -> Iterator[str]:
        """What can't be restored."""
        for c in "abcdefghijklmnopqrstuvwxyz":
            yield "Ã" + c
            yield "â" + c.upper()
        yield from ["�", "ï¼", "ï½", *map(chr, range(0x80, 0x85)), *map(chr, range(0x86, 0xA0))]

    def marked(self, s: str, least: float = 0.25) -> list[int]:
        """The pairs whose forms cover a part of a run's characters beyond ASCII, at least."""
        done: dict[int, int] = {}
        cover: dict[int, int] = {}
        for end, (n, pairs) in self.runs_of.iter(s):
            for k in pairs:
                cover[k] = cover.get(k, 0) + end + 1 - max(done.get(k, 0), end - n + 1)
                done[k] = end + 1
        size = max(1, sum(ord(c) > 0x7F for c in s))
        return sorted(k for k, n in cover.items() if n >= least * size)

    def _single_mark(self, text: str, begin: int, end: int) -> bool:
        """Whether a single garbled character stands beside a letter, digit or space here."""
        return next(self.beside.iter(f" {text} ", begin, end + 2), None) is not None

    # -- sequences

    def _quoted(self, text: str, begin: int, end: int, as_: str) -> bool:
        before, after = text[:begin].rstrip("  ")[-1:], text[end:].lstrip("  ")[:1]
        if before and after and before in _OPEN and after in _CLOSE:
            return True
        return as_ == "’" and not text[begin - 1 : begin].strip() and not text[end : end + 1].strip()

    def sequences(self, text: str) -> tuple[str, int]:
        """Replaces matched sequences, the leftmost longest first; how many."""
        best: dict[int, tuple[int, str]] = {}
        for end, (c, n) in self.automaton.iter(text):
            at = end - n + 1
            if c is not None and (at not in best or best[at][0] < n):
                best[at] = (n, c)
        if not best:
            return text, 0
        out, done, count = [], 0, 0
        for at in sorted(best):
            n, c = best[at]
            if at < done or self._proper(text, at, n) or self._quoted(text, at, at + n, c):
                continue
            out += [text[done:at], c]
            done, count = at + n, count + 1
        return ("".join(out) + text[done:], count) if count else (text, 0)

    def _covered(self, s: str) -> float:
        """Share of a run's characters that lie in garbled sequences."""
        done, n = 0, 0
        for end, (c, m) in self.automaton.iter(s):
            if c is not None:
                n += end + 1 - max(done, end - m + 1)
                done = end + 1
        return n / max(1, sum(ord(c) > 0x7F for c in s))

    def _proper(self, text: str, at: int, n: int) -> bool:
        """Two Cyrillic letters, or a letter and a quotation mark, may be text as they are."""
        s = text[at : at + n]
        if n == 2 and self.cyrillic.match(s[0]):
            return s[1] in "«»„“”—–…’" and not self.automaton_near(text, at, n) or bool(re.match(r"[а-яА-ЯёЁ]{2}$", s)) and not self.automaton_near(text, at, n)
        if n == 2 and s[0] == "Â" and not text[at - 1 : at].isalpha():
            return False
        # accents and signs that may follow a capital
        return n == 2 and s[1] in "«»„“”—–…’ °±" and s[0] in _LETTERS.upper() + "В" and not self.automaton_near(text, at, n)

    def automaton_near(self, text: str, at: int, n: int) -> bool:
        """Whether another sequence stands right beside, or the sequence lies within a word of small letters."""
        for part in (text[max(0, at - 3) : at], text[at + n : at + n + 3]):
            if any(c is not None for _, (c, _) in self.automaton.iter(part)):
                return True
        return bool(re.match(r"[a-z]", text[at - 1 : at])) or bool(re.match(r"[a-z]", text[at + n : at + n + 1]))

    # -- single characters

    def words(self, text: str) -> tuple[str, int]:
        """Replaces single garbled characters inside words that can't be words."""
        if not self.suspect.search(text):
            return text, 0
        count = 0

        def fix(m: re.Match) -> str:
            nonlocal count
            w = m.group()
            if w not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[w] = self._word(w)
            new = self.seen[w]
            count += new is not None
            return w if new is None else new

        new = self.word.sub(fix, text)
        return (new, count) if count else (text, 0)

    def _word(self, w: str) -> str | None:
        """What a word that can't be one, or that is rarer than what it may be garbled from, was; null for others."""
        if not self.suspect.search(w) or not self._single_mark(w, 0, len(w)):
            return None
        seen, most, best = self.known.get(_bare(w), 0), 0, None
        for new in self.candidates(w):
            n = self.known.get(_bare(new), 0)
            most = max(most, n)
            score = 2 * (n > 5 * seen) + self._impossible(w)
            if score and (best is None or score > best[0]):
                best = (score, new)
        # a word is proper that recurs, and more often than what it may be garbled from
        if best and best[0] < 2 and seen >= 3 and seen > most and not re.search(r"[a-z][A-ZÀ-Þ]", w):
            return None
        return best and best[1]

    def candidates(self, w: str) -> list[str]:
        """Words that one mix-up of one-byte encodings turns into ``w``."""
        if w.isascii() or not self.suspect.search(w) or not re.search(r"[A-Za-z]", w):
            return []
        made = ("".join(table.get(c, c) if ord(c) > 0x7F else c for c in w) for table in self.single.values())
        return [new for new in made if new != w and re.fullmatch(f"[A-Za-z’'{_LETTERS}]+", new) and not re.search(f"[a-zß-ÿ][A-Z{_LETTERS[_LETTERS.index('Á'):]}]", new)]

    @staticmethod
    def _impossible(w: str) -> int:
        """Whether a word can't be one as it stands."""
        if re.search(f"[a-zß-ÿ](?:[^\x00-\x7f{_LETTERS}’‘“”«»„–—…‚‐­¬°ºª·]|[ÀÁÂÃÈÊËÌÍÎÏÒÓÔÕÙÚÛÇÑÄÖÜ])[a-z]", w):
            return 1
        if re.search(f"^[^\x00-\x7f{_LETTERS}’‘“”«»„–—…‚µ°ºª·§©®±×¬‐­][a-z]{{2}}", w):
            return 1
        return int(bool(re.search("[a-z][ÀÁÂÃÈÊËÌÍÎÏÒÓÔÕÙÚÛÇÑÄÖÜÆØÞÐ]$", w)))

    # -- runs

    def _han_share(self, s: str) -> float:
        own = [c for c in s if ord(c) > 0x7F]
        return sum(c in self.common or c in "，。！？；：、“”《》（）…—·％℃　" for c in own) / len(own) if own else 0.0

    @staticmethod
    def _russian_share(s: str) -> float:
        """Share of Cyrillic letters in the places where small letters and capitals belong."""
        own = [(s[i - 1] if i else " ", c) for i, c in enumerate(s) if ord(c) > 0x7F]
        good = sum(("а" <= c <= "я" or c == "ё") or (("А" <= c <= "Я" or c == "Ё") and not p.isalpha()) or c in "«»—–№…" for p, c in own)
        return good / len(own) if own else 0.0

    def runs(self, text: str) -> tuple[str, int]:
        """Replaces runs that were garbled between multi-byte or Cyrillic encodings."""
        count = 0

        def best_of(s: str, marks: list[int], what: str, worth, least: float) -> str | None:
            best = None
            for k in marks:
                read, written, own = _PAIRS[k]
                if own != what:
                    continue
                try:
                    new = s.encode(read).decode(written)
                except UnicodeError:
                    continue
                value = worth(new, written)
                if value >= least and (best is None or value > best[0]):
                    best = (value, new)
            return best and best[1]

        def fix(m: re.Match) -> str:
            nonlocal count
            s = m.group()
            if not self.rare.search(s) or self._covered(s) >= 0.6:
                return s
            marks = self.marked(s)
            if not marks:
                return s
            han, rus, new = self._han_share(s), self._russian_share(s), None
            own = [c for c in s if ord(c) > 0x7F]
            if rus >= 0.8:
                return s
            eastern = len(self.eastern.findall(s))
            if han < 0.85 and eastern >= 0.6 * len(own) and len(own) > 1:
                new = best_of(s, marks, "sound", lambda x, _: self._sound(x), 0.8)
                new = new or best_of(s, marks, "east", lambda x, _: self._han_share(x), max(0.85, han + 0.3))
            if new is None and eastern < 0.2 * len(own) and len(own) > (3 if re.search("[\x80-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{4}", s) else 5) and re.search("[^А-яЁё\x00-\x7f]", s) and not (s[0] in _OPEN and s[-1] in _CLOSE):
                new = best_of(s, marks, "han", lambda x, _: self._han_share(x), 0.85)
            if new is None and re.search("[^\x00-\x7f\\s«»„“”’–—…]{3}", s) and eastern < 0.2 * len(own):
                new = best_of(s, marks, "russian", lambda x, _: self._russian_share(x) + self._usual(x), max(0.9, rus + 0.3) + 0.4)
            if new is None:
                return s
            count += 1
            return new

        new = self.run.sub(fix, text) if self.rare.search(text) else text
        return (new, count) if count else (text, 0)

    def _sound(self, s: str) -> float:
        """Share of characters that texts of the languages at hand have."""
        own = [c for c in s if ord(c) > 0x7F]
        return sum(c in self.common or c in _LETTERS or "Ѐ" <= c <= "џ" or c in "，。！？；：、“”《》（）…—·％℃　’–€°•ªº«»„" for c in own) / len(own) if own else 0.0

    @staticmethod
    def _usual(s: str) -> float:
        """Share of the ten most frequent Russian letters among the Cyrillic ones."""
        own = [c for c in s.lower() if "а" <= c <= "ё"]
        return sum(c in "оеаинтсрвл" for c in own) / len(own) if own else 0.0

    def signs(self, text: str) -> tuple[str, int]:
        """Replaces signs that were garbled beside digits, or between words, where the automaton marks them."""
        count = 0
        if next(self.beside.iter(text), None) is None:
            return text, 0
        for pattern, proper in _SIGNS:
            text, n = pattern.subn(proper, text)
            count += n
        text, n = _QUOTES.subn(r"“\2”", text)
        return text, count + n

    def latin_in_han(self, text: str) -> tuple[str, int]:
        """Replaces single characters beside small Latin letters that are Latin letters in UTF-8, read as an East Asian encoding."""
        count = 0

        def fix(m: re.Match) -> str:
            nonlocal count
            if not self._single_mark(text[max(0, m.start() - 1) : m.end() + 1], 0, 3):
                return m.group()
            count += 1
            return self.han_letter[m.group()]

        return self.mixed.sub(fix, text), count

    def _doubtful(self, text: str | None) -> bool:
        return bool(text) and not text.isascii() and bool(self.unclean.search(text) or any(x.search(text) for x in self.combined))

    def longer(self, text: str) -> tuple[str, int]:
        """Replaces all that is told without known words."""
        new, found = self.runs(text)
        for _ in range(3):
            new, n = self.sequences(new)
            found += n
            if not n:
                break
        for step in (self.latin_in_han, self.runs):
            new, n = step(new)
            found += n
        return new, found

    def forms(self, text: str | None) -> set[str]:
        """The words that ``words`` looks up."""
        if not self._doubtful(text):
            return set()
        return {w for w in self.word.findall(self.longer(text)[0]) if not w.isascii() and self.suspect.search(w)}

    def repair(self, text: str | None) -> tuple[str | None, bool, bool]:
        """The restored text, whether it was damaged, and whether nothing garbled is left."""
        if not self._doubtful(text):
            return text, False, True
        new, found = self.longer(text)
        for step in (self.words, self.signs):
            new, n = step(new)
            found += n
        lost = "�" in new or any(self._control(new))
        left = self.hopeless(new)
        return new, bool(found) or lost or left, not lost and not left

    @staticmethod
    def _control(text: str) -> Iterator[bool]:
        for m in re.finditer("[\x80-\x84\x86-\x9f]", text):
            yield m is not None

    def hopeless(self, text: str) -> bool:
        """Whether runs are left that no text has, marked by the automaton, but that no pair restores."""
        if next(self.automaton.iter(text), None) is None and not any(self.marked(m.group(), 0.0) for m in self.run.finditer(text)):
            return False
        if re.search(r"\bÃ[a-z]|ï¼|(?<!\w)â[A-ZÀ-Þ]", text):
            return True
        if re.search("[\xa1-\xaa\xac\xae-\xba\xbc-\xff]{4}|[Ѐ-џ][ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“•™љ›њќћџў¤ҐЇґ¶]{2}", text) and not re.search("^[¯\\\\]", text):
            return True
        han = [c for c in text if "㐀" <= c <= "鿿" or "" <= c <= "" or "㄀" <= c <= "ㄯ"]
        return len(han) >= 4 and sum(c not in self.common for c in han) > 0.4 * len(han)


@lru_cache(maxsize=1)
def _patterns() -> dict:
    """The automata and expressions of a repairer, built once in a process."""
    r = object.__new__(Repairer)
    r._build()
    return r.__dict__


@lru_cache(maxsize=2)
def _repairer(known: tuple) -> Repairer:
    return Repairer(dict(known))


def _bare(word: str) -> str:
    return word.lower().strip("’'")


def known_words(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``w`` and ``n``, counts in ``texts`` (one column) of the words with letters beyond ASCII that decide on a doubtful word of ``texts`` or
    ``names``: of the word, if it recurs though it can't be one or if what it may be garbled from occurs, and of the latter."""
    texts = texts.toDF("text")
    # words with a Latin letter beyond ASCII; runs needn't be given back
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}’'])[A-Za-z’']*+[\x{80}-\x{24f}&&[\p{L}]][\p{L}’']*+"), 0)).alias("w")
    words = texts.where(F.col("text").rlike(r"[\x{c0}-\x{24f}]")).select(word).select(F.regexp_replace(F.lower("w"), "^[’']+|[’']+$", "").alias("w")).where(F.length("w") > 2)
    counts = staged(words.groupBy("w").agg(F.count("*").alias("n")), "known")

    def doubtful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _repairer(())
        for pdf in batches:
            found = {w for text in pdf["text"] for w in r.forms(text)}
            out = {(_bare(w), _bare(new), bool(r._impossible(w))) for w in found for new in r.candidates(w)}
            yield pd.DataFrame(list(out), columns=["w", "new", "never"])

    every = texts if names is None else texts.unionByName(names.toDF("text").distinct())
    pairs = every.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(doubtful, "w string, new string, never boolean").distinct()
    pairs = pairs.join(counts, "w", "left").join(counts.select(F.col("w").alias("new"), F.col("n").alias("m")), "new", "left")
    pairs = pairs.where("m is not null or (never and n >= 3)").select(F.explode(F.array(F.struct("w", "n"), F.struct(F.col("new").alias("w"), F.col("m").alias("n")))).alias("k"))
    return staged(pairs.select("k.*").where("n is not null").distinct(), "decisive")


def repair_fields(rows: DataFrame, fields: list[str], known: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """``id``, ``field``, ``damaged``, ``complete`` and ``restored`` of every damaged value of the fields.

    ``known`` (of ``known_words``) goes to the workers if it has ``MOST_KNOWN`` rows at most; beyond that each value is joined with
    those of them that its own words need."""
    some = [] if known is None else known.limit(MOST_KNOWN + 1).collect()
    values = rows.where(F.col(id_col).isNotNull() & F.concat_ws("", *fields).rlike(r"[^\x00-\x7f]")).select(F.col(id_col).cast("string").alias("_id"), *fields)
    kind = "id string, field string, complete boolean, restored string"
    if len(some) > MOST_KNOWN:
        return _repaired_by_join(values, fields, known, kind)
    table = tuple(sorted((r["w"], r["n"]) for r in some))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _repairer(table)
        seen: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for name in fields:
                for i, text in zip(pdf["_id"], pdf[name], strict=True):
                    if not text or text.isascii():
                        continue
                    if len(text) < 200:  # names recur on all chunks of a file
                        got = seen.get(text)
                        if got is None:
                            if len(seen) > 20_000:
                                seen.clear()
                            got = seen[text] = r.repair(text)
                    else:
                        got = r.repair(text)
                    if got[1]:
                        out.append((i, name, got[2], got[0]))
            yield pd.DataFrame(out, columns=["id", "field", "complete", "restored"])

    return values.mapInPandas(run, kind)


def _repaired_by_join(values: DataFrame, fields: list[str], known: DataFrame, kind: str) -> DataFrame:
    each = values.select("_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("v")).select("_id", "v.field", "v.text")
    each = each.where(F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("key", F.xxhash64("text"))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _repairer(())
        for pdf in batches:
            out = set()
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                out |= {(key, _bare(x)) for w in r.forms(text) for x in (w, *r.candidates(w))}
            yield pd.DataFrame(list(out), columns=["key", "w"])

    needed = each.select("key", "text").mapInPandas(asked, "key long, w string").distinct().join(known, "w")
    maps = needed.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, field, text, own in zip(pdf["_id"], pdf["field"], pdf["text"], pdf["known"], strict=True):
                restored, damaged, complete = Repairer(dict(own) if own is not None else {}).repair(text)
                if damaged:
                    out.append((i, field, complete, restored))
            yield pd.DataFrame(out, columns=["id", "field", "complete", "restored"])

    return each.join(maps, "key", "left").select("_id", "field", "text", "known").mapInPandas(run, kind)
