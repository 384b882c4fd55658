"""Passages of held-out test items inside a corpus.

Q-gram lemma filtering: a region of ``w`` characters that is ``e`` edits away from a text shares at least
``w + 1 - q - q * e`` character q-grams with it, all near one diagonal (place in the document less place in
the item). Shared q-grams are counted in overlapping diagonal bands; bands that reach the bound are
retained and verified by banded alignment: of the region of the document with the item along the band's diagonals,
without edits (whole words in a row on a diagonal) and, if edits are allowed, with the least number of them. ``w`` is the
length of the shortest run of words that counts, taken from the items themselves, so that the filter loses nothing.

The items are measured first and worked off in blocks of about ``MAX_ITEM_CHARS`` at most: only one block is collected at a
time, its index is built once and broadcast, and meets all documents. Documents stay where they are: there is no shuffle of texts.

Defined results: null, empty and blank documents and items give no row; an item with fewer words than a
run needs can't be found; repeated documents of one id give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, mix64, slices, words_of

#: Characters of one block of items that is sent to the executors (a copy of the index takes about 25 bytes for each, and 4 MB).
MAX_ITEM_CHARS = 4_000_000
#: Characters of documents that a worker handles at once.
SLICE_CHARS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BITS = 22


def _hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of ``q`` code points."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(len(c), _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.empty(len(c) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix64(c.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        back = np.full(n, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        return mix64((total[q : q + n] - total[:n]) * back)


class ItemIndex:
    """Q-grams of the items' fields, with the bound that a region must reach."""

    def __init__(self, fields: list[tuple[int, str, str, int]], edits: int = 0, region: int = 0):
        """fields: item, field, normalised text, words in a row that count; region: characters of a region, if not
        those of the shortest run of words."""
        self.edits, self.fields, shortest = edits, [], 1 << 30
        for item, field, text, need in fields:
            ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
            if text and (len(ends) >= need or region and len(text) >= region):
                self.fields.append((item, field, text, need))
                begins = np.concatenate([[0], ends[:-1]])
                if len(ends) >= need:
                    shortest = min(shortest, int((ends[need - 1 :] - 1 - begins[: len(ends) - need + 1]).min()))
        self.shortest = shortest = region or shortest
        self.q = max(3, shortest // (2 + 2 * edits)) if self.fields else 3
        self.bound = max(1, shortest + 1 - self.q - self.q * edits)
        self.band = max(8, 2 * edits)
        joined = "\n".join(f[2] for f in self.fields)
        self.codes = codes(joined)
        self.starts = np.concatenate([[0], np.cumsum([len(f[2]) + 1 for f in self.fields])])
        h = _hashes(self.codes, self.q)
        inside = np.flatnonzero(np.searchsorted(self.starts, np.arange(len(h)), "right") == np.searchsorted(self.starts, np.arange(len(h)) + self.q - 1, "right"))
        order = inside[np.argsort(h[inside], kind="stable")]
        self.sorted, self.places = h[order], order
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.sorted >> np.uint64(64 - _BITS)] = True

    def regions(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """Bands that reach the bound: text, field, least diagonal, first and last place of a shared q-gram in the text."""
        c = codes("\n".join(texts))
        h = _hashes(c, self.q)
        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(self.sorted, h[at], "left"), np.searchsorted(self.sorted, h[at], "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            return
        place = np.repeat(at, n)
        item_place = self.places[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(starts, place, "right") - 1
        field = np.searchsorted(self.starts, item_place, "right") - 1
        place, item_place = place - starts[doc], item_place - self.starts[field]
        diagonal = place - item_place
        pair = doc * len(self.fields) + field
        for shift in (0, self.band // 2):  # bands overlap by half, so that each run of diagonals lies within one
            number = (diagonal + shift) // self.band
            order = np.lexsort((number, pair))
            edge = np.flatnonzero((np.diff(pair[order]) != 0) | (np.diff(number[order]) != 0)) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(order)]])
            for i in np.flatnonzero(last - first >= self.bound):
                own = order[first[i] : last[i]]
                yield int(doc[own[0]]), int(field[own[0]]), int(diagonal[own].min()), int(place[own].min()), int(place[own].max()) + self.q


def _bands(a: list[np.ndarray], b: list[np.ndarray], lows: list[int], width: int) -> np.ndarray:
    """Whether place i of each text ``a`` equals the place of ``b`` on diagonal ``low + d``, as an array (text, d, i)."""
    n = max(map(len, a))
    left = np.full((len(a), n), -1, np.int64)
    right = np.full((len(a), n + width), -2, np.int64)
    for k, (x, y, low) in enumerate(zip(a, b, lows, strict=True)):
        left[k, : len(x)] = x
        first = -(low + width - 1)  # the place of b that the last diagonal has beside place 0
        own = y[max(0, first) : max(0, first + n + width)]
        right[k, max(0, -first) : max(0, -first) + len(own)] = own[: n + width - max(0, -first)]
    return np.stack([left == right[:, width - 1 - d : width - 1 - d + n] for d in range(width)], axis=1)


def banded_alignment(a: list[np.ndarray], b: list[np.ndarray], lows: list[int], width: int, edits: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For each text ``a`` and ``b`` with it, along diagonals ``low`` to ``low + width - 1`` (place in a less place in b): the most
    whole words in a row that are the same on one diagonal; and, if ``edits`` are allowed, the least edits from ``a`` to any part of ``b``."""
    same = _bands(a, b, lows, width)
    count, _, n = same.shape
    # without edits: stretches on a diagonal, and the spaces in them
    flat = np.concatenate([same, np.zeros((count, width, 1), bool)], axis=2).ravel()
    spaces = np.zeros((count, n + 1), np.int64)
    for k, x in enumerate(a):
        spaces[k, 1 : len(x) + 1] = np.cumsum(x == 32)
        spaces[k, len(x) + 1 :] = spaces[k, len(x)]
    cut = np.flatnonzero(~flat)
    begin = np.concatenate([[0], cut[:-1] + 1])
    size = cut - begin
    some = size > 2
    text, at = begin[some] // ((n + 1) * width), begin[some] % (n + 1)
    words = spaces[text, at + size[some]] - spaces[text, at] - 1
    run = np.zeros(count, np.int64)
    np.maximum.at(run, text, words)
    if not edits:
        return run, None
    # with edits: diagonals go down as the place in b goes up, so that they are turned round here
    big = 1 << 30
    sizes, step = np.array([len(x) for x in a]), np.arange(width)
    places = -(np.array(lows)[:, None] + width - 1) + step  # of b, for place 0 of a
    length = np.array([len(y) for y in b])[:, None]
    row = np.where((places >= 0) & (places <= length), 0, big)
    least = np.full(count, big)
    turned = same[:, ::-1, :]
    for i in range(n + 1):
        ends = sizes == i
        if ends.any():
            least[ends] = np.where((places[ends] + i >= 0) & (places[ends] + i <= length[ends]), row[ends], big).min(axis=1)
        if i == n:
            break
        new = np.minimum(row + ~turned[:, :, i], np.concatenate([row[:, 1:], np.full((count, 1), big)], axis=1) + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return run, least


def item_blocks(items: DataFrame, window: int, window_zh: int) -> Iterator[list[tuple[int, str, str, int]]]:
    """Fields of the items (item, name, text, words in a row), a block of them at a time."""
    size = F.coalesce(F.length("passage"), F.lit(0)) + F.coalesce(F.length("question"), F.lit(0))
    items = items.where("item_id is not null").select("item_id", "lang", "passage", "question").distinct()
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = -(-2 * total // MAX_ITEM_CHARS)
    for k in range(max(1, parts)):
        own = items.where(F.pmod(F.xxhash64(*items.columns), F.lit(parts)) == k) if parts > 1 else items
        fields = []
        for r in sorted(own.collect(), key=lambda r: (r["item_id"], r["passage"] or "", r["question"] or "")):
            for name in ("passage", "question"):
                fields.append((r["item_id"], name, " ".join(words_of(r[name])), window_zh if r["lang"] == "zh" else window))
        yield fields


def _verified(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int | None]]:
    """Text, field, longest run and distance of the regions of the texts that hold."""
    hits = sorted(index.regions(texts), key=lambda h: h[4] - h[3])
    for x, y in slices([(h[4] - h[3] + index.band) * index.band for h in hits], 2_000_000):
        own = hits[x:y]
        a, b, lows = [], [], []
        for doc, field, low, begin, end in own:
            # one more place on either side, so that a word's end shows
            text, item = texts[doc], index.fields[field][2]
            a.append(codes((" " if begin == 0 else text[begin - 1]) + text[begin:end] + (" " if end >= len(text) else text[end])))
            b.append(codes(f" {item} "))
            lows.append(low - begin)
        runs, _ = banded_alignment(a, b, lows, index.band, False)
        distances = banded_alignment([c[1:-1] for c in a], [c[1:-1] for c in b], [low - index.band for low in lows], 2 * index.band + 1, True)[1] if index.edits else [None] * len(own)
        for (doc, field, _, begin, end), run, distance in zip(own, runs.tolist(), distances, strict=True):
            if run >= index.fields[field][3] or (distance is not None and distance * index.shortest <= index.edits * (end - begin)):
                yield doc, field, run, None if distance is None else int(distance)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, window_zh: int = 24, edits: int = 0, region: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``field``, ``run`` (longest common run of words), ``window`` (the run that counts as whole)
    and ``distance`` (least edits of a region against the item, with ``edits`` > 0 only), one row per document,
    item and field that holds: a whole run, or a region of ``region`` characters or more with at most ``edits`` edits for each ``region``.

    Ids keep their types."""
    of_doc, of_item = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, "item_id")))
    schema = f"doc_id {of_doc}, item_id {of_item}, field string, run int, window int, distance int"
    spark = docs.sparkSession

    def over(block):
        # whole runs may be shorter than a region, so they have a pass with a bound of their own
        passes = [x for x in [ItemIndex(block), *([ItemIndex(block, edits, region)] if edits or region else [])] if x.fields]
        shared = spark.sparkContext.broadcast(passes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                ids = pdf["_id"].tolist()
                texts = [" ".join(words_of(t)) for t in pdf["_text"]]
                for x, y in slices([len(t) for t in texts], SLICE_CHARS):
                    seen: dict[tuple, tuple] = {}
                    for index in shared.value:
                        for doc, field, found, distance in _verified(index, texts[x:y]):
                            item, name, _, need = index.fields[field]
                            old = seen.get((x + doc, item, name), (0, None))
                            least = distance if old[1] is None or (distance is not None and distance < old[1]) else old[1]
                            seen[x + doc, item, name] = (max(found, old[0]), least, need)
                    out += [(ids[k], item, name, run, need, distance) for (k, item, name), (run, distance, need) in seen.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "field", "run", "window", "distance"]).astype({"distance": "Int32"})

        return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)

    found = None
    for block in item_blocks(items, window, window_zh):
        found = over(block) if found is None else found.unionByName(over(block))
    return found
