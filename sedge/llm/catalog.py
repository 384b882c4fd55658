"""Queries of the text operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import encoding, language, leaks, neardup, scans, splitting, subjects, tokens
from .common import tables


def _filter(spark: SparkSession, d: str) -> language.LanguageFilter:
    samples, items, docs = tables(spark, d, "subject_sample", "eval_item", "documents")
    return language.train(samples, items, docs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chunk, files, configs = tables(spark, d, "chunk", "source_file", "chunking_config")
    return language.mislabelled(chunk, files, configs, _filter(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every chunk with its language and confidence."""
    return language.label_segments(tables(spark, d, "chunk")[0], _filter(spark, d)).distinct()


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every chunk with its confidence."""
    return language.main_languages(tables(spark, d, "chunk")[0], _filter(spark, d)).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.id_pairs(*neardup.near_pairs(tables(spark, d, "chunk")[0], threshold=0.6, shingle=3, min_words=30))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with its class of copies, its group of near-duplicates (five words, 0.8) and its links."""
    return neardup.near_groups(tables(spark, d, "chunk")[0])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(*tables(spark, d, "chunk", "source_file", "chunking_config")).select("id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    got = splitting.split_chunks(*tables(spark, d, "chunk", "source_file", "chunking_config"))
    return got.select("id", "piece_no", "piece_tokens", "piece")


def _known(spark: SparkSession, d: str) -> DataFrame:
    files, samples, chunk = tables(spark, d, "source_file", "subject_sample", "chunk")
    texts = files.select("docnm_kwd").unionAll(samples.select("text")).unionAll(chunk.select("content_with_weight"))
    return encoding.known_words(texts, chunk.select("docnm_kwd"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Damaged values with what could be restored of them."""
    chunk = tables(spark, d, "chunk")[0]
    return encoding.repair_fields(chunk, ["content_with_weight", "docnm_kwd"], _known(spark, d)).dropDuplicates(["id", "field"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunk = tables(spark, d, "chunk")[0]
    return encoding.repair_fields(chunk, ["content_with_weight", "docnm_kwd"], _known(spark, d)).select("id", "field").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_kinds(tables(spark, d, "chunk")[0]).distinct()


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as continuous paragraphs, with the kinds of noise they had."""
    return scans.repaired_pages(tables(spark, d, "chunk")[0])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(*tables(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each document's text as decoded from its ids."""
    docs = tables(spark, d, "documents")[0]
    return tokens.decode_corpus(tokens.encode_corpus(docs)).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = tables(spark, d, "documents", "eval_item")
    return leaks.find_leaks(docs, items).where("run >= window").select("doc_id", "item_id").distinct()


def p7_altered(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of items that were altered by a few edits."""
    docs, items = tables(spark, d, "documents", "eval_item")
    return leaks.find_leaks(docs, items, edits=3, region=80).select("doc_id", "item_id", "field", "run", "distance").distinct()


def _shares(spark: SparkSession, d: str) -> DataFrame:
    docs, samples, areas = tables(spark, d, "documents", "subject_sample", "subject_area")
    sentences = staged(subjects.sentence_texts(docs, "doc_id", "text"), "sentences")
    return subjects.subject_shares(sentences, subjects.train(sentences, samples, areas))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("about * 10 >= sentences * 3").select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    got = _shares(spark, d).where("about * 10 >= sentences * 3").distinct()
    return got.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("about").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p1_languages, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_repaired, p5_found, p5_pages, p6_ids, p6_roundtrip, p7_found, p7_altered, p8_found, p8_composition)}

_CONFIG = """config AS (
  SELECT f.doc_id, c.chunk_token_num AS lim FROM
    (SELECT doc_id, max_by(config_id, struct_pack(a := uploaded_at, b := config_id)) AS config_id FROM source_file WHERE config_id IS NOT NULL GROUP BY doc_id) f
    JOIN (SELECT DISTINCT config_id, chunk_token_num FROM chunking_config) c USING (config_id))"""

_WORDS = r"regexp_extract_all(regexp_replace(lower({0}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"

ORACLE = {
    "p2_found": f"""WITH w AS (SELECT id, any_value({_WORDS.format("content_with_weight")}) AS w FROM chunk WHERE id IS NOT NULL AND content_with_weight IS NOT NULL GROUP BY id),
s AS (SELECT DISTINCT id, hash(w[k], w[k + 1], w[k + 2]) AS h FROM w, unnest(range(1, len(w) - 1)) AS t(k) WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, CASE WHEN lang = 'zh' THEN 24 ELSE 10 END AS n, {_WORDS.format("passage")} AS w FROM eval_item UNION ALL SELECT item_id, CASE WHEN lang = 'zh' THEN 24 ELSE 10 END, {_WORDS.format("question")} FROM eval_item),
iw AS (SELECT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM i, unnest(range(1, len(w) - n + 2)) AS t(k)),
dw AS (SELECT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM d, (VALUES (10), (24)) AS v(n), unnest(range(1, len(w) - n + 2)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, s)""",
    "p3_found": rf"""WITH {_CONFIG}
SELECT DISTINCT id FROM chunk JOIN config USING (doc_id)
WHERE lim > 0 AND len(regexp_extract_all(content_with_weight, '[\x{{4e00}}-\x{{9fff}}]|[^ \t\n\r\x{{a0}}\x{{3000}}\x{{4e00}}-\x{{9fff}}]+')) > lim""",
    "p6_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
