"""Noise in text from scanned pages: words broken at line ends, misread characters, running lines, page numbers.

1. Each page gives its signs of a scan and its outer lines without digits. By file it is decided whether the file is a
   scan and which of its outer lines recur, the running titles (the same up to a few misread characters).
2. On each page of a scan the outer lines that are page numbers, running titles or both are taken off, broken words are
   joined, and the rest is the running text.
3. Skip-gram vectors are learnt from the running text of all scans: the positive pointwise mutual information of words and of
   hashed places (words up to ``REACH`` before or after) is factorised, which is what skip-gram training with negative
   samples does; the best ``RANK`` directions come from a few passes of subspace iteration over all frequent words.
4. A rare word that a plausible misreading turns into a frequent one is linked to it if that one is ``RATIO`` times as frequent
   and its vector points the same way, the more closely the more often the rare word occurs. Each occurrence of a
   linked word is then judged by the words around it: the linked word that they suit best is taken, if they suit it at all.
5. Paragraphs are reflowed: lines are joined until a sentence ends at the end of a short line.

Defined results: null, empty and blank contents, and files that aren't scans, give no row; null or wrong page numbers of
chunks don't matter; repeated rows of an id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Misreadings of scanned letters: what is printed, and what is read (fixed values, curated).
MISREAD = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("a", "o"), ("t", "f"), ("i", "1"), ("l", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("é", "6"),
    ("n", "ri"), ("ri", "n"), ("m", "rn"), ("rn", "m"), ("u", "ii"), ("ü", "ii"), ("d", "cl"), ("cl", "d"), ("h", "b"), ("b", "h"), ("w", "vv"), ("vv", "w"),
    ("li", "h"), ("h", "li"), ("z", "2"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("I", "l"), ("G", "6"), ("E", "F"), ("D", "O"), ("i", "l"), ("l", "i"), ("n", "u"), ("u", "n"), ("y", "v"), ("f", "t"),
]
FREQUENT, REACH, DIMENSIONS, RANK, PASSES = 4, 3, 2048, 128, 3
#: A right word is ``RATIO`` times as frequent at least (five times that where a word has two or three letters only, and where the
#: misreading is taken for one throughout the word); a digit among letters is hardly a right word, so 1 will do.
RATIO = 8
#: Cosine of a link's two words, at least: ``AGREE`` for a word seen once, more for one that is seen more often (by that power), up
#: to ``CLEAR``; half of that with a digit among the letters. Cosine of an occurrence's own neighbours with the right word.
AGREE, POWER, CLEAR, HERE = 0.13, 0.45, 0.45, 0.05
#: Misread words that are looked for by a set in each worker, at most; beyond it by a join.
KNOWN_WORDS = 200_000
#: Rows of the broadcast table of frequent words, at most: those that are more than this part of all words. Others are shuffled.
VOCABULARY = 200_000

_HYPHEN = "-¬\xad‐"
_BROKEN = re.compile(rf"[a-zß-ÿа-яё][{_HYPHEN}][ \t]*$")
_ROMAN = r"(?=[ivx])x{0,3}(?:ix|iv|v?i{0,3})"
#: Digits, of which some may be misread; a number of letters only has a capital, or is 11.
_DIGITS = r"(?-i:(?=[OolI]*[0-9]|[OlI]*[OI]|ll(?![a-z]))[0-9OolI]{1,4})"
_NUMBER = rf"(?:{_DIGITS}|{_ROMAN})"
_NAMED = r"(?:page|seite|página|pagina|p\.|s\.|pág\.|pag\.|стр\.?|страница)"
_OF = r"(?:\s*(?:of|von|de|di|sur|из|/)\s*(?-i:[0-9OolI]{1,4}))?"
_PAGE = re.compile(rf"^\W*(?:(?:{_NAMED}\s*)?{_NUMBER}|{_NAMED}\s*[0-9OolI]{{1,4}}){_OF}\W*$|^第?\s*[0-9]{{1,4}}\s*页(?:.*[0-9]+\s*页)?$", re.IGNORECASE)
#: A page number at an end of a line that has something else, too.
_BESIDE = re.compile(rf"^(?:{_NAMED}\s*)?[\[(]?[0-9]{{1,4}}{_OF}[\])]?(?:\s*[|·•—–\-/]\s*|\s+)(?=\D*\w)|(?:\s+[|·•—–\-/]\s*|\s+)(?:{_NAMED}\s*)?[\[(]?{_NUMBER}{_OF}[\])]?$", re.IGNORECASE)


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if x.strip()]


def _bare(line: str) -> str:
    """A line's letters, without a page number beside them."""
    return "".join(c for c in _BESIDE.sub("", line).lower() if c.isalpha())


def _is_number(line: str) -> bool:
    return len(line) <= 24 and bool(_PAGE.match(line))


def _outer(lines: list[str]) -> tuple[list[str], list[str]]:
    """The two outermost lines above and below."""
    return lines[:2], lines[-2:] if len(lines) > 3 else lines[-1:]


def page_signs(text: str | None) -> tuple[bool, bool, bool, list[str]] | None:
    """Whether a page has words broken at line ends, a page number, wrapped text; and its outer lines' letters."""
    if not text:
        return None
    lines = _lines(text)
    if len(lines) < 3:
        return None
    broken = any(_BROKEN.search(x) for x in lines)
    top, foot = _outer(lines)
    number = _is_number(top[0]) or _is_number(foot[-1])
    inner = lines[1:-1]
    wrapped = sum(25 <= len(x) <= 100 and x[-1] not in ".!?;:。" for x in inner) * 2 >= len(inner) and sum(map(len, inner)) > 60
    outer = list(dict.fromkeys(b for x in (top[0], foot[-1], top[1], foot[0]) if not _is_number(x) and 9 <= len(b := _bare(x)) <= 60 and len(x) <= 70))
    return broken, number, wrapped, outer


def _near(a: str, b: str) -> bool:
    """Whether two lines' letters are the same up to a fifth of edits."""
    if a == b:
        return True
    most = max(1, len(b) // 5)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def scanned_files(pages: DataFrame) -> DataFrame:
    """``doc_id`` and ``titles`` (letters of recurring outer lines, the most frequent first) of the files that are scans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, single, text in zip(pdf["doc_id"], pdf["single"], pdf["_text"], strict=True):
                signs = page_signs(text)
                if signs:
                    out.append((doc, bool(single), *signs))
                else:
                    out.append((doc, bool(single), False, False, False, []))
            yield pd.DataFrame(out, columns=["doc_id", "single", "broken", "number", "wrapped", "outer"])

    signs = pages.select("doc_id", "single", "_text").mapInPandas(run, "doc_id string, single boolean, broken boolean, number boolean, wrapped boolean, outer array<string>")
    signs = staged(signs, "signs")
    n = lambda c: F.sum(F.col(c).cast("int"))
    by_file = signs.groupBy("doc_id").agg(F.count("*").alias("n"), n("broken").alias("broken"), n("number").alias("number"), n("wrapped").alias("wrapped"), n("single").alias("single"))
    # a title recurs on a quarter of the file's pages at least, and a page has four outer lines: no file has more than sixteen
    lines = signs.select("doc_id", F.explode("outer").alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("k")).where("k >= 2")
    lines = lines.join(by_file.select("doc_id", "n"), "doc_id").where("k * 4 >= n")
    titles = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "line")), asc=False).alias("t"), F.max("k").alias("most"))
    files = by_file.where("single * 10 >= n * 9 and n >= 2 and wrapped * 2 >= n").join(titles, "doc_id", "left")
    most = F.coalesce("most", F.lit(0))
    scan = (F.col("broken") * 5 >= F.col("n")) | ((F.col("number") * 2 >= F.col("n")) & (F.col("wrapped") * 3 >= 2 * F.col("n"))) | ((most * 2 >= F.col("n")) & (most >= 3) & (F.col("wrapped") * 3 >= 2 * F.col("n")))
    return files.where(scan).select("doc_id", F.transform(F.coalesce("t", F.array().cast("array<struct<k:bigint,line:string>>")), lambda x: x["line"]).alias("titles"))


def clean_page(text: str, titles: list[str]) -> tuple[list[str], bool, bool, bool, str]:
    """The running text's lines, whether a running title and a page number were taken off and whether words were broken at
    line ends, and the text with broken words joined."""
    lines = _lines(text)
    header = number = False
    for side in (0, -1):
        for _ in range(2):
            if not lines:
                break
            x = lines[side]
            if _is_number(x) and not number:
                number = True
            elif not header and len(x) <= 90 and (b := _bare(x)) and any(_near(b, t) for t in titles):
                header = True
                rest = "".join(c for c in x if not c.isspace())
                number = number or (bool(_BESIDE.search(x)) and bool(re.search(r"\d|[ivxl]+\W*$", rest)) and len(_bare(x)) < len([c for c in x if c.isalnum()]))
            else:
                break
            del lines[side]
    broken = any(_BROKEN.search(x) for x in lines)
    joined = re.sub(rf"([a-zß-ÿа-яё])[{_HYPHEN}][ \t]*\n(?=[a-zß-ÿа-яё])", r"\1", "\n".join(lines))
    return lines, header, number, broken, joined


def clean_pages(chunk: DataFrame) -> DataFrame:
    """``id``, ``doc_id``, ``header``, ``page_number``, ``hyphen`` and ``text`` (lines without furniture) of all pages of scans."""
    pages = chunk.where("id is not null and doc_id is not null").select("id", "doc_id", F.coalesce(F.size("page_num_int") <= 1, F.lit(True)).alias("single"), F.col("content_with_weight").alias("_text"))
    files = staged(scanned_files(pages), "scans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, doc, text, titles in zip(pdf["id"], pdf["doc_id"], pdf["_text"], pdf["titles"], strict=True):
                _, header, number, broken, joined = clean_page(text, list(titles))
                out.append((i, doc, header, number, broken, joined))
            yield pd.DataFrame(out, columns=["id", "doc_id", "header", "page_number", "hyphen", "text"])

    own = pages.where("_text is not null and trim(_text) <> ''").join(files, "doc_id").select("id", "doc_id", "_text", "titles").dropDuplicates(["id"])
    return own.mapInPandas(run, "id string, doc_id string, header boolean, page_number boolean, hyphen boolean, text string")


# -- misread characters

_TOKEN = re.compile(r"[^\W_]+")


def body_words(text: str) -> list[tuple[int, str]]:
    """Words of the running text and where they begin; what is cut off at a page's begin or end is none."""
    words = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    if words and text[:1].islower():
        words = words[1:]
    if words and _BROKEN.search(text):
        words = words[:-1]
    return words


def _digit(word: str) -> bool:
    return bool(re.search(r"[^\W\d_]", word) and re.search(r"\d", word))


def corrections(word: str) -> dict[str, int]:
    """Words that a single misreading (or the same one throughout) turns into ``word``, and how often as frequent they must be."""
    out: dict[str, int] = {}
    least = 1 if _digit(word) else RATIO * (5 if len(word) < 4 else 1)
    for printed, read in MISREAD:
        at = word.find(read)
        if at >= 0 and word.count(read) > 1:
            out.setdefault(word.replace(read, printed), least if least == 1 else 5 * least)
        while at >= 0:
            out[word[:at] + printed + word[at + len(read) :]] = least
            at = word.find(read, at + 1)
    out.pop(word, None)
    return out


def _places(words: list[str]) -> np.ndarray:
    """The hashed places of words before and after others."""
    import xxhash

    return np.array([[xxhash.xxh32_intdigest(side + w.lower()) % DIMENSIONS for w in words] for side in "<>"], np.int64).reshape(2, -1)


def _neighbours(own: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts; for each word of the texts which it is, and the places of those around it (-1 for none)."""
    sizes = np.array([len(w) for w in own], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for text in own for w in text]
    code, words = pd.factorize(flat)
    places = _places(list(words))
    text = np.repeat(np.arange(len(own)), sizes)
    around = np.full((len(flat), 2 * REACH), -1, np.int64)
    for k in range(1, REACH + 1):
        same = text[k:] == text[:-k]
        around[k:, 2 * k - 2] = np.where(same, places[0][code[:-k]], -1)
        around[:-k, 2 * k - 1] = np.where(same, places[1][code[k:]], -1)
    return words, code, around


def context_counts(pages: DataFrame) -> DataFrame:
    """``word``, ``place``, ``n``: how often a word has a neighbour of a hashed place, and (place -1) how often it occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, code, around = _neighbours([[w for _, w in body_words(t)] for t in pdf["text"]])
            key = code[:, None] * (DIMENSIONS + 1) + around + 1
            all_ = np.concatenate([key[around >= 0], code * (DIMENSIONS + 1)])
            key, n = np.unique(all_, return_counts=True)
            yield pd.DataFrame({"word": words[key // (DIMENSIONS + 1)], "place": key % (DIMENSIONS + 1) - 1, "n": n})

    return pages.select("text").mapInPandas(run, "word string, place int, n long").groupBy("word", "place").agg(F.sum("n").alias("n"))


def _information(lists, totals: np.ndarray) -> np.ndarray:
    """The positive pointwise mutual information of rows of (place, n) with the places, dense."""
    x = np.zeros((len(lists), DIMENSIONS), np.float32)
    for row, own in zip(x, lists, strict=True):
        for r in own:
            row[r["place"]] = r["n"]
    share = x / np.maximum(1, x.sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore"):
        return np.maximum(0, np.log(share / totals))


def skip_gram_space(rows: DataFrame, totals: np.ndarray) -> np.ndarray:
    """Directions (places x ``RANK``) of the vectors of words; ``rows`` has ``word``, ``m`` (its occurrences) and ``v`` (place, n).

    Each pass multiplies a basis with the words' matrix in parts: a task gives one block of fixed size."""
    rank = min(RANK, DIMENSIONS)
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((DIMENSIONS, rank)))[0]
    for _ in range(PASSES):

        def multiply(batches: Iterator[pd.DataFrame], b=basis.astype(np.float32)) -> Iterator[pd.DataFrame]:
            out = np.zeros((DIMENSIONS, rank), np.float32)
            for pdf in batches:
                for a in range(0, len(pdf), 1000):
                    part = pdf.iloc[a : a + 1000]
                    x = _information(part["v"], totals)
                    out += x.T @ ((x @ b) * np.sqrt(part["m"].to_numpy(np.float32))[:, None])
            yield pd.DataFrame({"place": np.arange(DIMENSIONS), "row": list(out)})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: dict[int, np.ndarray] = {}
            for pdf in batches:
                for p, row in zip(pdf["place"], pdf["row"], strict=True):
                    out[p] = out[p] + row if p in out else np.asarray(row, np.float64)
            yield pd.DataFrame({"place": list(out), "row": pd.Series(list(out.values()), dtype=object)})

        kind = "place int, row array<float>"
        summed = np.zeros((DIMENSIONS, rank))
        for r in rows.mapInPandas(multiply, kind).repartition(8, "place").mapInPandas(add, kind).collect():
            summed[r["place"]] = r["row"]
        basis = np.linalg.qr(summed + 1e-9 * basis)[0]
    return basis.astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def links(counts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``word``, ``correct`` and ``v`` (the vector of ``correct``) of misread words; the directions, and the places' shares."""
    words = counts.where("place = -1").select("word", "n")
    all_words = words.agg(F.sum("n")).first()[0] or 0
    right = words.select(F.col("word").alias("correct"), F.col("n").alias("m"))
    hot = F.col("m") * VOCABULARY > all_words

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, n, c, least) for w, n in zip(pdf["word"], pdf["n"], strict=True) if len(w) > 1 and not w.isdigit() and not re.fullmatch(r"[A-Z]?\d+|\d+[a-zªº]{0,2}", w) for c, least in corrections(w).items()]
            yield pd.DataFrame(out, columns=["word", "n", "correct", "least"])

    made = words.mapInPandas(variants, "word string, n long, correct string, least int")
    marked = made.join(F.broadcast(right.where(hot)), "correct", "left")
    found = marked.where("m is not null")
    if all_words >= VOCABULARY:  # else all right words are in the broadcast
        found = found.unionByName(marked.where("m is null").drop("m").join(right.where(~hot), "correct"))
    found = staged(found.where((F.col("m") >= F.col("least") * F.col("n")) & ((F.col("m") >= FREQUENT) | (F.col("least") == 1))), "links")
    # a place's total over all words is a table of fixed size
    totals = np.zeros(DIMENSIONS)
    for r in counts.where("place >= 0").groupBy("place").agg(F.sum("n").alias("t")).collect():
        totals[r["place"]] = r["t"]
    totals = (totals / max(1.0, totals.sum()) + 1e-9).astype(np.float32)
    linked = found.select(F.explode(F.array("word", "correct")).alias("word")).distinct().withColumn("linked", F.lit(True))
    rows = counts.groupBy("word").agg(F.max(F.when(F.col("place") == -1, F.col("n"))).alias("m"), F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "n"))).alias("v"))
    rows = staged(rows.join(linked, "word", "left").where(F.col("linked") | (F.col("m") >= FREQUENT)), "contexts")
    space = skip_gram_space(rows.where(F.col("m") >= FREQUENT), totals)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                yield pd.DataFrame({"word": part["word"], "v": list(_unit(_information(part["v"], totals) @ space))})

    vectors = rows.where("linked").select("word", "v").mapInPandas(project, "word string, v array<float>")
    both = found.join(vectors, "word").withColumnRenamed("v", "w").join(vectors.withColumnRenamed("word", "correct"), "correct")
    cosine = F.aggregate(F.zip_with("v", "w", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda a, x: a + x)
    least = F.least(F.lit(CLEAR), AGREE * F.pow("n", F.lit(POWER))) * F.when(F.col("least") == 1, 0.5).otherwise(1.0)
    return staged(both.where(cosine >= least).select("word", "correct", "v"), "misread"), space, totals


def misread_words(pages: DataFrame) -> DataFrame:
    """``id``, ``begin``, ``word`` and ``correct`` of every occurrence of a misread word; ``pages`` has ``id`` and ``text``."""
    found, space, totals = links(staged(context_counts(pages), "skipgrams"))
    names = found.select("word").distinct()
    some = names.limit(KNOWN_WORDS + 1).collect()
    known = frozenset(r["word"] for r in some) if len(some) <= KNOWN_WORDS else None

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [body_words(t) for t in pdf["text"]]
            words, code, around = _neighbours([[w for _, w in text] for text in own])
            begins = np.array([b for text in own for b, _ in text], np.int64)
            ids = np.repeat(pdf["id"].to_numpy(), [len(text) for text in own])
            at = np.flatnonzero(np.array([known is None or w in known for w in words], bool)[code]) if len(code) else code
            yield pd.DataFrame({"id": ids[at], "begin": begins[at], "word": words[code[at]], "around": pd.Series([x[x >= 0] for x in around[at]], dtype=object)})

    at = pages.select("id", "text").mapInPandas(occurrences, "id string, begin int, word string, around array<int>")
    grouped = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("correct", "v"))).alias("c"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                x = np.zeros((len(part), DIMENSIONS), np.float32)
                for row, own in zip(x, part["around"], strict=True):
                    np.add.at(row, own, 1)
                with np.errstate(divide="ignore"):
                    here = _unit(np.maximum(0, np.log(x / np.maximum(1, x.sum(axis=1, keepdims=True)) / totals)) @ space)
                for i, begin, w, own, u in zip(part["id"], part["begin"], part["word"], part["c"], here, strict=True):
                    fits = [(float(np.asarray(c["v"], np.float32) @ u), c["correct"]) for c in own]
                    best, correct = max(fits)
                    if best >= (0 if _digit(w) else HERE):
                        out.append((i, begin, w, correct))
            yield pd.DataFrame(out, columns=["id", "begin", "word", "correct"])

    return at.join(grouped, "word").select("id", "begin", "word", "around", "c").mapInPandas(judge, "id string, begin int, word string, correct string")


def repaired_pages(chunk: DataFrame) -> DataFrame:
    """``id``, ``kinds`` of noise, and ``text`` of every page of a scan in continuous paragraphs."""
    pages = staged(clean_pages(chunk), "pages")
    words = misread_words(pages).groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("begin", "correct"))).alias("_fix"))
    kinds = F.array_compact(F.array(F.when(F.col("hyphen"), "hyphen"), F.when(F.col("_fix").isNotNull(), "ocr_char"), F.when(F.col("header"), "header"), F.when(F.col("page_number"), "page_number")))

    def reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, fix in zip(pdf["text"], pdf["_fix"], strict=True):
                fixes = dict(fix) if fix is not None else {}
                text = _TOKEN.sub(lambda m, f=fixes: f.get(m.start(), m.group()), text)
                lines = text.split("\n")
                width = max(map(len, lines), default=0)
                out.append("".join(x + ("\n" if re.search(r"[.!?:;]$", x) and len(x) < 0.8 * width else " ") for x in lines).strip())
            yield pdf[["id", "doc_id", "kinds"]].assign(text=out)

    both = pages.join(words, "id", "left").select("id", "doc_id", kinds.alias("kinds"), "text", "_fix")
    return both.mapInPandas(reflow, "id string, doc_id string, kinds array<string>, text string")


def noise_kinds(chunk: DataFrame) -> DataFrame:
    """``id`` and ``kind``, one row per kind of noise on a page of a scan."""
    pages = staged(clean_pages(chunk), "pages")
    flags = pages.select("id", F.explode(F.array_compact(F.array(F.when(F.col("hyphen"), "hyphen"), F.when(F.col("header"), "header"), F.when(F.col("page_number"), "page_number")))).alias("kind"))
    return flags.unionByName(misread_words(pages).select("id", F.lit("ocr_char").alias("kind")).distinct())
