"""Encoding a corpus with a public tokenizer through a table of its distinct words.

The texts are split into the tokenizer's pre-tokens ("words") by the JVM, each distinct word is encoded
once, and the ids return to their places by (document, position). The most frequent words, a table of
bounded size, are put in place where the documents are: a document keeps the ids of its frequent words, with the
places where others are missing, so no reducer gets the occurrences of a common word. The other words travel to the
table of words and back to their documents' gaps.

Defined results: an empty and a null text give an empty list; strings that look like special tokens are
ordinary text; repeated rows give one row; rows of one id with different texts give a row for each text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .common import slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pre-token pattern of byte_bpe_50k (a fixed value of that public tokenizer); (?U): white space as Unicode has it. What
#: begins with an apostrophe can't begin with a letter, so letters come first here, and runs needn't be given back.
PATTERN = r"(?U) ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Rows of the table of frequent words that goes to all workers, at most, and characters of each, at most.
HOT_WORDS, HOT_CHARS = 100_000, 64
#: Words that a worker handles at once.
SLICE_WORDS = 200_000


def _encoder(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_words(words: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Adds ``ids`` to rows of distinct ``word`` (with ``n``, its count)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()  # about 1.5 MB whatever the corpus; executors need no file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _encoder(spec)
        for pdf in batches:
            found = tok.encode_batch(pdf["word"].tolist(), add_special_tokens=False)
            yield pdf.assign(ids=[e.ids for e in found])

    return words.select("word", "n").mapInPandas(run, "word string, n long, ids array<int>")


class _Frequent:
    """Ids of frequent words by the hashes of the words."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        rows = sorted(rows)
        self.keys = np.array([k for k, _ in rows], np.int64)
        self.sizes = np.array([len(x) for _, x in rows], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([i for _, x in rows for i in x], np.int32)

    def place(self, keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts of consecutive words: ids of their frequent words and where those of each text begin; the words that
        aren't frequent, and before how many ids of its text each belongs."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        n = np.zeros(len(keys), np.int64)
        n[known] = self.sizes[at[known]]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(self.begins[at[known]] - ends[:-1][known], n[known]) + np.arange(ends[-1])
        missing = np.flatnonzero(~known)
        text = np.searchsorted(bounds, missing, "right") - 1
        return self.ids[flat], ends[bounds], missing, ends[missing] - ends[bounds[text]]


def _skeletons(rows: DataFrame, frequent: _Frequent) -> DataFrame:
    """``_id``, ``_key``, ``ids`` of the frequent words, and ``at`` and ``word`` of the others, in order, of each row with ``_words`` and ``_hashes``."""
    kind = rows.schema["_id"].dataType.simpleString()

    def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = whole.column("_hashes").offsets.to_numpy()
            for x, y in slices(np.diff(ends).tolist(), SLICE_WORDS):
                batch = whole.slice(x, y - x)
                bounds = ends[x : y + 1].astype(np.int64)
                words = batch.column("_words")
                flat = words.values.slice(words.offsets[0].as_py(), int(bounds[-1] - bounds[0]))
                keys = batch.column("_hashes").values.to_numpy()[bounds[0] : bounds[-1]]
                bounds -= bounds[0]
                ids, begins, missing, at = frequent.place(keys, bounds)
                gaps = np.searchsorted(missing, bounds)
                columns = [lists(pa.array(ids, pa.int32()), begins), lists(pa.array(at, pa.int32()), gaps), lists(flat.take(pa.array(missing)), gaps)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), *columns], ["_id", "_key", "ids", "at", "word"])

    return rows.mapInArrow(run, f"_id {kind}, _key long, ids array<int>, at array<int>, word array<string>")


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    parts = F.regexp_extract_all("_text", F.lit(PATTERN), 0)
    rows = texts.select("_id", "_key", F.coalesce(parts, F.array().cast("array<string>")).alias("_words"))
    counts = rows.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    table = staged(encode_words(counts, vocabulary).withColumn("key", F.xxhash64("word")), "words")
    # the JVM may know fewer letters than the tokenizer: texts with what is unassigned there are encoded whole, as one "word"
    odd, entire = staged(table.where(F.col("word").rlike(r"\p{Cn}")).select("word"), "unassigned"), None
    if not odd.isEmpty():
        keys = staged(rows.select("_key", F.explode("_words").alias("word")).join(odd, "word").select("_key").distinct(), "keys")
        some = texts.join(keys, "_key").select("_id", "_key", F.col("_text").alias("word")).distinct()
        entire = some.join(encode_words(some.groupBy("word").agg(F.count("*").alias("n")), vocabulary), "word").select("_id", "ids")
        rows = rows.join(keys, "_key", "left_anti")
    # the words of as many classes of frequency (eight for each doubling), from the top, as have hot_words rows together
    level, short = F.floor(F.log2("n") * 8), table.where(F.length("word") <= HOT_CHARS)
    least, rows_ = None, 0
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), reverse=True):
        rows_ += r["c"]
        if rows_ > hot_words:
            break
        least = r["level"]
    hot = short.where(level >= F.lit(least)) if least is not None else short.limit(0)
    # one that shares its hash with any other word isn't told apart by it, and goes the other way
    shared = table.select("key").join(F.broadcast(hot.select("key")), "key", "left_semi").groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    frequent = _Frequent([(r["key"], r["ids"]) for r in hot.join(F.broadcast(shared), "key", "left_anti").select("key", "ids").collect()])
    hashed = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    done = staged(_skeletons(hashed, frequent), "skeletons")
    whole, gaps = done.where(F.size("at") == 0).select("_id", "_key", "ids"), done.where(F.size("at") > 0)
    # rows that repeat are told by their ids alone, so that the others stay where they are
    again = staged(whole.groupBy("_id", "_key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("_id").alias("_i"), F.col("_key").alias("_k")), "again")
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_key").eqNullSafe(F.col("_k"))
    whole = whole.join(again, same, "left_anti").unionByName(whole.join(again, same, "left_semi").dropDuplicates(["_id", "_key"]))
    # the words beyond the frequent ones: to the table, and back to their gaps
    of = gaps.select("_id", "_key", F.posexplode("word").alias("pos", "word")).join(table.select("word", F.col("ids").alias("own")), "word")
    both = of.select("_id", "_key", F.struct("pos", "own").alias("p"), F.lit(None).cast("struct<ids:array<int>,at:array<int>>").alias("s"))
    both = both.unionByName(gaps.select("_id", "_key", F.lit(None).cast("struct<pos:int,own:array<int>>").alias("p"), F.struct("ids", "at").alias("s")))
    both = both.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("p")).alias("p"), F.first("s", True).alias("s"))
    at = F.col("s.at")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1))
    filled = F.transform("p", lambda x, i: F.concat(F.slice("s.ids", before(i) + 1, F.get(at, i) - before(i)), x["own"]))
    last = F.element_at(at, -1)
    rest = F.array(F.slice("s.ids", last + 1, F.size("s.ids") - last))
    out = whole.unionByName(both.select("_id", "_key", F.flatten(F.concat(filled, rest)).alias("ids"))).select("_id", "ids")
    return (out if entire is None else out.unionByName(entire)).select(F.col("_id").alias(id_col), "ids")


def pieces(spark: SparkSession, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id`` and ``piece_hex`` (its bytes) of the tokenizer's vocabulary, about 50,000 rows."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    rows = [(i, bytes(byte_of[c] for c in piece).hex()) for piece, i in spec["model"]["vocab"].items() if all(c in byte_of for c in piece)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece_hex"]), "id int, piece_hex string")


def decode_corpus(ids: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` from ``ids``, through a join with the table of pieces (of fixed size)."""
    at = ids.select(F.col(id_col), F.xxhash64(F.col("ids")).alias("_key"), F.posexplode_outer("ids").alias("pos", "id"))
    named = at.join(F.broadcast(pieces(ids.sparkSession, vocabulary)), "id", "left")
    back = named.groupBy(id_col, "_key").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece_hex")))).alias("p"))
    return back.select(id_col, F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece_hex"]), "")), "UTF-8").alias("text"))
