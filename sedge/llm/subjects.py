"""Subject areas of documents, by weighted terms that a multi-pattern automaton finds.

Terms are runs of one to ``MOST`` words. They are taken from labelled samples (a few labels may be wrong), and then
checked and completed over all documents in two passes that count in Spark:

1. The sentences of all documents are scored by the samples' terms. A term is dropped if the other sentences of the
   documents that have it are mostly about another subject. The sentences without a term in documents about one subject
   give candidates: runs that make up a part of ``SHARE`` of the subject's sentences at least (six sentences at least).
2. The candidates are counted in all sentences; those that occur beside one subject nearly always become terms, unless the
   documents contradict them as above.

A term's weight is how much likelier it is in its subject, times its rarity in the documents; a sentence's score for a
subject is the sum of its terms' weights over the root of its length. Each subject's threshold is calibrated on the labelled
sentences. A document has every subject that at least a share of its sentences are about.

Sentences end with a full stop or the like; lines without an end are headings, unless they are long, or the
whole text is a bare table, whose lines count instead.

Defined results: null, empty and blank texts, and texts without sentences, have no subject; repeated rows
give one row (of ``p8_found``; here one each); null ids give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import bounded_sample, codes, slices, words_of

MOST = 5
#: Rows of labelled samples, at most; they go to the driver.
SAMPLE_ROWS = 20_000
#: A candidate's part of its subject's sentences, at least; with sentences of so many words, fewer than MOST * words / SHARE
#: runs of a subject can have it, however large the corpus is. The same for longer words around a term, of all documents.
SHARE, LONGER_SHARE = 5e-4, 2e-5
LEAST, PURITY = 6, 0.93
#: Characters of texts, and different runs, that a worker holds at once.
SLICE_CHARS, MOST_RUNS = 400_000, 500_000
_END = re.compile(r"(?<![\s])(?<!^\d)(?<!^\d\d)(?<!^\d\d\d)[.!?;]+[\"'”’»)]*(?=\s|$)(?!\s+Mal\b)|[。！？；]+[”’」』)）]*", re.MULTILINE)
#: List marks, and the numbers of articles, at the begin of a line.
_MARK = re.compile(r"^\s*(?:(?:[-–•*]|\d+[.)])\s+|(?:§|Art\w*\.?|Статья)\s*\d+[.)]\s*|第\s*\d+\s*条\s*)")
_STOP = re.compile(r"\w[.!?]+[\"'”’»)]*(?=\s|$)|[。！？]")
_ROW = re.compile(r"\t|[:：]|\|")


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text (of each line of a bare table)."""
    if not text:
        return []
    lines = [x for x in text.split("\n") if x.strip()]
    if lines and not any(_STOP.search(_MARK.sub("", x)) for x in lines) and sum(bool(_ROW.search(x)) for x in lines) * 2 > len(lines):
        return [w for x in lines if (w := words_of(x))]
    out = []
    for paragraph in re.split(r"\n(?=\s*(?:[-–•*]|\d+[.)]|\w+ \d+\.|第\s*\d+\s*条)\s)|\n\s*\n|\t", text):
        begin = 0
        # a short line of its own without an end is a heading
        parts = _MARK.sub("", paragraph).split("\n")
        body = "\n".join(x for i, x in enumerate(parts) if not (i < len(parts) - 1 and len(words_of(x)) < 6 and not _END.search(x)))
        for m in [*_END.finditer(body), None]:
            part = body[begin : m.start() if m else len(body)]
            words = words_of(part)
            if words and (m or len(words) >= 8):
                out.append(words)
            begin = m.end() if m else len(body)
    return out


def _runs(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, MOST + 1) for i in range(len(words) - n + 1)}


def _is_term(run: str) -> bool:
    return len(run) > 1 and not run.isdigit()


@dataclass
class SubjectModel:
    """Weighted terms, one subject each, and the subjects' thresholds."""

    subjects: list[str]
    terms: dict[str, tuple[int, float]] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    #: Longer words that a term is part of, with the term, which doesn't count there (Chinese only).
    blocks: dict[str, str] = field(default_factory=dict)

    def weigh(self, counts: dict[str, np.ndarray], total: np.ndarray, least: np.ndarray, purity: float) -> dict[str, tuple[int, float]]:
        """Terms for those of ``counts`` (a run's sentences by subject, the last for none) that at least ``least`` and ``purity``
        of them are about one subject; ``total`` has all sentences by subject."""
        out, size = {}, int(total.sum())
        for t, c in counts.items():
            k, seen = int(c[: len(self.subjects)].argmax()), int(c.sum())
            n = int(c[k])
            if n >= max(1, least[k]) and n >= purity * seen and _is_term(t):
                odds = math.log((n + 0.1) / (total[k] + 1)) - math.log((seen - n + 0.1) / (size - total[k] + 1))
                out[t] = (k, max(0.1, odds) * math.log(1 + size / seen) / 10)
        return out


class Scanner:
    """Finds terms (and, without weight, candidates) in texts of sentences; a text has a line of words per sentence."""

    def __init__(self, model: SubjectModel, candidates: tuple[str, ...] = ()):
        import ahocorasick

        self.count = len(model.subjects)
        self.names = [*model.terms, *(t for t in candidates if t not in model.terms)]
        at = {t: i for i, t in enumerate(self.names)}
        blocks = [(t, at[inner]) for t, inner in model.blocks.items() if t not in at and inner in at]
        self.subject = np.array([model.terms[t][0] if t in model.terms else -1 for t in self.names] + [-2] * len(blocks), np.int64)
        self.weight = np.array([model.terms[t][1] if t in model.terms else 0.0 for t in self.names] + [0.0] * len(blocks))
        self.inner = np.array([*range(len(self.names)), *(i for _, i in blocks)], np.int64)
        self.size = len(self.subject)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate([*self.names, *(t for t, _ in blocks)]):
            self.automaton.add_word(f" {t} ", i)
        if self.size:
            self.automaton.make_automaton()
        self.thresholds = np.array(model.thresholds or [1e-9] * self.count)
        self.han = np.array([bool(t) and "一" <= t[0] <= "鿿" for t in self.names] + [False] * len(blocks), bool)
        self.length = np.array([len(t) for t in self.names] + [len(t) for t, _ in blocks], np.int64)

    def read(self, texts: list[str]) -> _Scan:
        return _Scan(self, texts)


class _Scan:
    """What a scanner finds in some texts: ``sentence`` and ``term`` of each occurrence that counts, once each, and the scores."""

    def __init__(self, s: Scanner, texts: list[str]):
        self.scanner, self.text = s, "\n".join(" " + t.replace("\n", " \n ") + " " for t in texts)
        c = codes(self.text)
        lines = np.flatnonzero(c == 10)
        self.begins = np.concatenate([[0], lines + 1])
        self.lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.of = np.repeat(np.arange(len(texts)), self.lines)
        own = np.fromiter(chain.from_iterable(s.automaton.iter(self.text)) if s.size else [], np.int64).reshape(-1, 2)
        end, term = own[:, 0], own[:, 1]
        self.end, self.raw = end, term
        self.raw_sentence = np.searchsorted(self.begins, end, "right") - 1
        key, n = np.unique(self.raw_sentence * max(1, s.size) + term, return_counts=True)
        sentence, term = key // max(1, s.size), key % max(1, s.size)
        blocked = s.subject[term] == -2 if s.size else np.zeros(0, bool)
        if blocked.any():  # a term counts where it stands outside the longer words, too
            inside, which = np.unique(sentence[blocked] * s.size + s.inner[term[blocked]], return_inverse=True)
            much = np.bincount(which, n[blocked])
            at = np.searchsorted(inside, key)
            hit = (at < len(inside)) & (inside[np.minimum(at, len(inside) - 1)] == key)
            n = n - np.where(hit, much[np.minimum(at, len(inside) - 1)], 0)
        keep = ~blocked & (n > 0)
        self.sentence, self.term = sentence[keep], term[keep]
        spaces, han = (np.concatenate([[0], np.cumsum(x)]) for x in (c == 32, (c >= 0x4E00) & (c <= 0x9FFF)))
        last = np.concatenate([lines, [len(c)]])
        words = spaces[last] - spaces[self.begins] - 1
        root = np.sqrt(np.maximum(0.5, words - 0.5 * (han[last] - han[self.begins])))
        known = s.subject[self.term] >= 0 if s.size else np.zeros(0, bool)
        at = self.sentence[known] * s.count + s.subject[self.term[known]]
        self.sums = np.bincount(at, s.weight[self.term[known]], len(self.begins) * s.count).reshape(len(self.begins), s.count)
        self.scores = self.sums / root[:, None]

    def about(self) -> np.ndarray:
        """Whether each sentence is about each subject."""
        return (self.scores >= self.scanner.thresholds) & (self.scores >= 0.5 * self.scores.max(axis=1, keepdims=True, initial=0)) & (self.scores > 0)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's best subject (-1 without a term), and each text's only one (-1 for several, -2 for none)."""
        label = np.where(self.sums.max(axis=1, initial=0) > 0, self.sums.argmax(axis=1), -1) if self.scanner.count else np.full(len(self.begins), -1)
        n = self.by_text(label)
        top, total = n.max(axis=1, initial=0), n.sum(axis=1)
        return label, np.where(total == 0, -2, np.where((top < 0.9 * total) | (top < 2), -1, n.argmax(axis=1) if n.shape[1] else -2))

    def by_text(self, label: np.ndarray) -> np.ndarray:
        """Sentences of each text by label."""
        k, some = self.scanner.count, label >= 0
        return np.bincount(self.of[some] * k + label[some], minlength=len(self.lines) * k).reshape(len(self.lines), k)

    def contradictions(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For terms, then for the longer words around Chinese ones: a key of each, and by how many texts the majority of the
        other sentences is about each subject (the last column: texts that tell)."""
        s = self.scanner
        yield self._told(self.sentence, self.term, label)
        # a character right before or after a term makes a longer word: key = term, side, character
        c = codes(self.text)
        hit = np.flatnonzero(s.han[self.raw]) if s.size else np.zeros(0, np.int64)
        found = []
        for side in (0, 1):
            at = self.end[hit] + 1 if side else self.end[hit] - s.length[self.raw[hit]] - 2
            ok = (at >= 0) & (at < len(c))
            char = c[at[ok]]
            alone = c[np.clip(at[ok] + (1 if side else -1), 0, len(c) - 1)] == 32  # a whole word
            own = (char >= 0x4E00) & (char <= 0x9FFF) & alone
            which = hit[ok][own]
            found.append((self.raw_sentence[which] << 38) + (self.raw[which] * 2 + side) * 65536 + char[own].astype(np.int64))
        both = np.unique(np.concatenate(found))
        yield self._told(both >> 38, both & ((1 << 38) - 1), label)

    def _told(self, sentence: np.ndarray, name: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.scanner.count
        names, place = np.unique(name, return_inverse=True)
        groups, of = np.unique(self.of[sentence] * max(1, len(names)) + place, return_inverse=True)
        text = groups // max(1, len(names))
        some = label[sentence] >= 0
        with_it = np.bincount(of[some] * k + label[sentence][some], minlength=len(groups) * k).reshape(len(groups), k)
        rest = self.by_text(label)[text] - with_it
        any_ = rest.sum(axis=1) > 0
        tells = any_ | (self.lines[text] > 3)
        agree = (rest == rest.max(axis=1, keepdims=True, initial=0)) & any_[:, None]
        at = groups % max(1, len(names))
        return names, np.stack([np.bincount(at, x, len(names)).astype(np.int64) for x in [*agree.T, tells]], axis=1)


def sentence_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``s``, a line of words per sentence, of each text with sentences."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = ["\n".join(map(" ".join, sentences_of(t))) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "s": s})[[bool(x) for x in s]]

    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id {kind}, s string")


class _Counts:
    """Counts over the texts of a task: of sentences by subject, of terms and candidates by subject, of what texts tell of terms and
    of the longer words around Chinese ones, and of the runs of sentences without a term."""

    def __init__(self, scanner: Scanner, runs: bool):
        self.scanner, self.wanted, k = scanner, runs, scanner.count + 1
        self.texts, self.sentences, self.size = 0, np.zeros(k, np.int64), scanner.size * k
        self.seen, self.terms = np.zeros(self.size, np.int64), np.zeros((scanner.size, k), np.int64)
        self.longer: list[tuple[np.ndarray, np.ndarray]] = []
        self.runs: Counter = Counter()

    def add(self, scan: _Scan) -> None:
        label, only = scan.labels()
        k = self.scanner.count
        # a sentence without a term has its text's only subject; none if nothing in the text has one
        mine = np.where(label >= 0, label, np.where(only[scan.of] >= 0, only[scan.of], np.where(only[scan.of] == -2, k, -1)))
        self.texts += len(scan.lines)
        self.sentences += np.bincount(mine[mine >= 0], minlength=k + 1)
        own = mine[scan.sentence]
        self.seen += np.bincount((scan.term * (k + 1) + own)[own >= 0], minlength=self.size)
        (names, told), longer = scan.contradictions(label)
        self.terms[names] += told
        self.longer.append(longer)
        if self.wanted:
            text = scan.text.split("\n")
            for i in np.flatnonzero((label < 0) & (only[scan.of] >= 0)):
                j = int(only[scan.of[i]])
                self.runs.update((r, j) for r in _runs(text[i].split()))

    def rows(self) -> pd.DataFrame:
        k = self.scanner.count + 1
        parts = [("texts", np.zeros(1, np.int64), np.array([[self.texts]])), ("sentences", np.zeros(1, np.int64), self.sentences[None])]
        parts += [("seen", np.arange(self.scanner.size), self.seen.reshape(-1, k)), ("term", np.arange(self.scanner.size), self.terms)]
        if self.longer:
            names, which = np.unique(np.concatenate([n for n, _ in self.longer]), return_inverse=True)
            told = np.concatenate([t for _, t in self.longer])
            parts.append(("longer", names, np.stack([np.bincount(which, c, len(names)).astype(np.int64) for c in told.T], axis=1)))
        out = []
        for kind, names, table in parts:
            i, j = np.nonzero(table)
            out.append(pd.DataFrame({"kind": kind, "run": "", "name": names[i], "subject": j, "n": table[i, j]}))
        out.append(pd.DataFrame([("run", r, 0, j, n) for (r, j), n in self.runs.items()], columns=["kind", "run", "name", "subject", "n"]))
        return pd.concat(out)


def _scanned(sentences: DataFrame, scanner: Scanner, use, schema: str) -> DataFrame:
    """What ``use`` makes of the portions (ids, scan) of each task."""
    shared = sentences.sparkSession.sparkContext.broadcast(scanner)

    def portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, _Scan]]:
        for pdf in batches:
            texts = pdf["s"].tolist()
            for x, y in slices([len(t) for t in texts], SLICE_CHARS):
                yield pdf["_id"].iloc[x:y], shared.value.read(texts[x:y])

    return sentences.mapInPandas(lambda batches: use(portions(batches)), schema)


def counted(sentences: DataFrame, scanner: Scanner, runs: bool) -> DataFrame:
    """The counts of ``_Counts`` over all sentences: ``kind``, ``run``, ``name``, ``subject``, ``n``."""

    def use(portions) -> Iterator[pd.DataFrame]:
        counts = _Counts(scanner, runs)
        for _, scan in portions:
            counts.add(scan)
            if len(counts.runs) > MOST_RUNS or len(counts.longer) > 200:
                yield counts.rows()
                counts = _Counts(scanner, runs)
        yield counts.rows()

    rows = _scanned(sentences, scanner, use, "kind string, run string, name long, subject int, n long")
    return staged(rows.groupBy("kind", "run", "name", "subject").agg(F.sum("n").alias("n")), "counts")


def _told_against(counts: DataFrame, kind: str, scanner: Scanner, texts: int) -> dict[int, np.ndarray]:
    """Names (of terms, or longer words that occur in enough texts) with the texts that tell, by subject, and all of them last."""
    k = scanner.count
    wide = counts.where(F.col("kind") == kind).groupBy("name").agg(*[F.sum(F.when(F.col("subject") == j, F.col("n")).otherwise(0)).alias(f"c{j}") for j in range(k + 1)])
    least = max(LEAST - 1, LONGER_SHARE * texts) if kind == "longer" else LEAST - 1
    return {r["name"]: np.array(r[1:]) for r in wide.where(F.col(f"c{k}") >= least).collect()}


def _prune(model: SubjectModel, scanner: Scanner, terms: dict[int, np.ndarray], longer: dict[int, np.ndarray], share: float = 0.6) -> None:
    """Drops terms, and takes up longer words as blocks, that the other sentences of their texts contradict: fewer than
    ``share`` of those texts are mostly about the term's subject."""
    for name, told in terms.items():
        t = scanner.names[name]
        if t in model.terms and told[model.terms[t][0]] < share * told[-1]:
            del model.terms[t]
    for name, told in longer.items():
        t, side, char = scanner.names[name >> 17], (name >> 16) & 1, chr(name & 65535)
        if t in model.terms and told[model.terms[t][0]] < share * told[-1]:
            model.blocks[f"{t} {char}" if side else f"{char} {t}"] = t


def from_samples(samples: pd.DataFrame, subjects: list[str]) -> tuple[SubjectModel, list[tuple[int, str]], dict[str, float]]:
    """A model from labelled ``samples`` (subject, text) alone, their sentences by subject, and the terms' rarity in them."""
    m, own = SubjectModel(subjects), []
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(subjects) + 1, np.int64))
    total = np.zeros(len(subjects) + 1, np.int64)
    for s, text in zip(samples["subject"], samples["text"], strict=True):
        if s in subjects:
            k = subjects.index(s)
            for w in sentences_of(text):
                own.append((k, " ".join(w)))
                total[k] += 1
                for r in _runs(w):
                    counts[r][k] += 1
    m.terms = m.weigh(counts, total, np.full(len(subjects), 2), 0.8)
    calibrate(m, own)
    return m, own, {t: math.log(1 + int(total.sum()) / int(counts[t].sum())) for t in m.terms}


def calibrate(m: SubjectModel, own: list[tuple[int, str]]) -> None:
    """Thresholds: three tenths of what all but a fiftieth of the subject's own sentences reach."""
    m.thresholds = [1e-9] * len(m.subjects)
    if not own:
        return
    scores = Scanner(m).read([t for _, t in own]).scores
    labels = np.array([k for k, _ in own])
    for k in range(len(m.subjects)):
        right = np.sort(scores[(labels == k) & (scores[:, k] > 0) & (scores[:, k] == scores.max(axis=1)), k])
        if len(right):
            m.thresholds[k] = 0.3 * float(right[len(right) // 50])


def train(sentences: DataFrame, samples: DataFrame, areas: DataFrame) -> SubjectModel:
    """Fits a model on at most ``SAMPLE_ROWS`` labelled rows, and on counts over all ``sentences`` (of ``sentence_texts``)."""
    subjects = sorted(r[0] for r in areas.where("subject is not null").select("subject").distinct().limit(1000).collect())
    labelled = samples.where("subject is not null and text is not null").select("subject", "text")
    m, own, rarity = from_samples(bounded_sample(labelled, SAMPLE_ROWS, "text", "subject").toPandas(), subjects)
    if not m.terms:
        return m
    k, scanner = len(subjects), Scanner(m)
    first = counted(sentences, scanner, True)
    texts = first.where("kind = 'texts'").agg(F.sum("n")).first()[0] or 0
    _prune(m, scanner, _told_against(first, "term", scanner, texts), _told_against(first, "longer", scanner, texts))

    def totals(counts: DataFrame) -> np.ndarray:
        out = np.zeros(k + 1, np.int64)
        for r in counts.where("kind = 'sentences'").collect():
            out[r["subject"]] = r["n"]
        return out

    least = F.greatest(F.lit(float(LEAST)), F.element_at(F.array(*[F.lit(SHARE * float(x)) for x in totals(first)]), F.col("subject") + 1))
    runs = first.where("kind = 'run'").withColumn("enough", F.col("n") >= least)
    some = runs.groupBy("run").agg(F.max("enough").alias("enough"), F.max("n").alias("most"), F.sum("n").alias("all")).where("enough and most >= 0.8 * all").select("run")
    scanner = Scanner(m, tuple(sorted(r["run"] for r in some.collect() if _is_term(r["run"]))))
    second = counted(sentences, scanner, False)
    total = totals(second)
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k + 1, np.int64))
    for r in second.where("kind = 'seen'").collect():  # a row per term and subject, at most
        seen[scanner.names[r["name"]]][r["subject"]] = r["n"]
    # what the samples know keeps its subject and its odds, with the rarity it has in the documents
    size = int(total.sum())
    for t, (j, w) in list(m.terms.items()):
        if n := int(seen[t].sum()) if t in seen else 0:
            m.terms[t] = (j, w / rarity[t] * math.log(1 + size / n))
    fresh = {t: c for t, c in seen.items() if t not in m.terms}
    m.terms |= m.weigh(fresh, total, np.maximum(LEAST, SHARE * total[:k]), PURITY)
    _prune(m, scanner, _told_against(second, "term", scanner, texts), _told_against(second, "longer", scanner, texts))
    calibrate(m, own)
    return m


def subject_shares(sentences: DataFrame, model: SubjectModel, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``subject``, ``about`` (sentences about it) and ``sentences`` of every text of ``sentence_texts`` with such sentences."""
    kind, names = sentences.schema["_id"].dataType.simpleString(), np.array(model.subjects, object)

    def use(portions) -> Iterator[pd.DataFrame]:
        for ids, scan in portions:
            about = scan.about()
            n = np.stack([np.bincount(scan.of, x, len(ids)).astype(np.int64) for x in about.T], axis=1) if len(names) else np.zeros((len(ids), 0), np.int64)
            text, k = np.nonzero(n)
            yield pd.DataFrame({id_col: ids.to_numpy()[text], "subject": names[k], "about": n[text, k], "sentences": scan.lines[text]})

    return _scanned(sentences, Scanner(model), use, f"`{id_col}` {kind}, subject string, about int, sentences int")
