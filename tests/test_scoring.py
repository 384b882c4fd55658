import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sedge.operators import index as I
from sedge.operators import retrieval as R
from sedge.operators import scoring as S
from sedge.plans import catalog

#: Queries that make no row for each pair of a query and a text, nor for each term of a text.
WITHOUT_POSTINGS = [
    "best_fields_topk",
    "reranked_by_model",
    "hits_above_threshold",
    "coverage_topk",
    "bm25_topk",
    "highlighted_hits",
    "scripted_similarity_topk",
    "min_should_match",
    "doc_aggregates",
]


@pytest.mark.parametrize("name", WITHOUT_POSTINGS)
def test_no_postings_are_made(spark, small, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("postings")

    monkeypatch.setattr(I, "postings", refuse)
    assert entry.queries()[name](spark, small.replace("0.001", "0.01")).count() > 0


def corpus(spark, n=700):
    r = random.Random(3)
    # a few frequent words, many rare ones; ids out of order, texts without words, an id with two texts
    docs = [(f"d{(i * 37) % n:04d}", " ".join(r.choices(["the", "of", "a", "in"], k=3) + [f"w{int(r.expovariate(0.05))}" for _ in range(r.randrange(12))]) if i % 50 else None) for i in range(n)]
    terms = [(q, t, r.random()) for q in range(40) for t in {*r.sample(["the", "of", "a", "in", "none"], r.randrange(1, 4)), *(f"w{int(r.expovariate(0.05))}" for _ in range(r.randrange(5)))}]
    return docs, spark.createDataFrame(docs, "id string, t string"), terms, spark.createDataFrame(terms, "q long, term string, w double")


@pytest.mark.parametrize(("texts", "long", "block"), [(64, 1, 7), (1 << 14, 256, 8192)])
def test_scores_are_the_brute_ones(spark, monkeypatch, texts, long, block):
    for k, v in (("TEXTS", texts), ("LONG", long), ("QUERIES", block)):
        monkeypatch.setattr(S, k, v)
    docs, df, terms, asked = corpus(spark)
    words = S.vocabulary(asked)
    coded = S.coded(df, "id", F.split("t", " "), words)
    sums = {}
    for i, t in docs:
        for q, term, w in terms:
            if t and term in t.split():
                sums[q, i] = sums.get((q, i), 0.0) + w
    got = {(r["q"], r["rank"]): (r["id"], r["score"]) for r in R.top(S.best(coded, S.blocks(asked, "q", words, "w"), len(words), "q", "id", 5), "q", "id", 5).collect()}
    want = {}
    for q in range(40):
        for rank, (score, i) in enumerate(sorted((-round(s, 6), i) for (p, i), s in sums.items() if p == q)[:5], 1):
            want[q, rank] = (i, -score)
    assert got == want and got
    bound = asked.withColumn("least", F.lit(0.8))
    pairs = [(r["q"], r["id"], r["score"]) for r in S.at_least(coded, S.blocks(bound, "q", words, "w", "least"), len(words), "q", "id").collect()]
    assert sorted(pairs) == sorted((q, i, round(s, 6)) for (q, i), s in sums.items() if round(s, 6) >= 0.8) and pairs


def test_saturated_frequencies_are_those_of_bm25(spark):
    _, df, _, asked = corpus(spark)
    p = I.postings(df.withColumn("t", F.coalesce("t", F.lit(""))), "id", "t", keep_empty=True)
    want = {(r["q"], r["id"]): round(r["score"], 6) for r in R.top(R.bm25(asked, p.where("term is not null"), I.document_frequency(p), I.postings_stats(p, "id"), "q", "id").withColumn("score", F.round("score", 6)), "q", "id", 7).collect()}
    words = S.vocabulary(asked)
    coded = S.coded(df, "id", F.split("t", " "), words).withColumn("length", F.greatest("length", F.lit(0)))
    weights, avgdl = R.bm25_weights(asked.drop("w"), *S.statistics(coded, words))
    got = {(r["q"], r["id"]): r["score"] for r in R.top(S.best(coded, S.blocks(weights, "q", words, "w"), len(words), "q", "id", 7, saturation=(1.2, 0.75, avgdl)), "q", "id", 7).collect()}
    assert got == pytest.approx(want) and got


def test_of_two_texts_of_an_id_the_best_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x y"), ("b", "y"), ("c", "x")], "id string, t string")
    asked = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "q long, term string, w double")
    coded = S.coded(df.coalesce(1), "id", F.split("t", " "), ["x", "y"])
    assert [(r["id"], r["score"]) for r in R.top(S.best(coded, S.blocks(asked, "q", ["x", "y"], "w"), 2, "q", "id", 2), "q", "id", 2).orderBy("rank").collect()] == [("a", 3.0), ("b", 2.0)]
    assert S.best(coded, S.blocks(asked.limit(0), "q", [], "w"), 0, "q", "id", 2).count() == 0


#: Queries that rank documents by vectors, of which only those with one can be hits.
BY_VECTOR = [
    "hybrid_filter",
    "rerank_second_page",
]


@pytest.mark.parametrize("name", BY_VECTOR)
def test_only_documents_with_a_vector_are_compared(spark, small, monkeypatch, name):
    given, plain = [], R.overlapping_terms
    monkeypatch.setattr(R, "overlapping_terms", lambda sets, *a: given.append(sets.count()) or plain(sets, *a))
    d = small.replace("0.001", "0.01")
    assert entry.queries()[name](spark, d).count() > 0
    assert given == [spark.read.parquet(f"{d}/embeddings.parquet").join(spark.read.parquet(f"{d}/documents.parquet").where("text is not null"), F.col("doc_id") == F.col("vec_id")).count()]


def test_hybrid_search_joins_no_terms(spark, small, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(R, "coverage", refuse)
    assert entry.queries()["hybrid_search"](spark, small.replace("0.001", "0.01")).count() == 60


@pytest.mark.parametrize(("texts", "most"), [(64, 1), (1 << 14, 10_000)])
def test_a_search_over_segments_is_that_over_texts(spark, monkeypatch, texts, most):
    docs, df, _, asked = corpus(spark)
    words = S.vocabulary(asked)
    coded = S.coded(df, "id", F.split("t", " "), words)
    _, n, avgdl = S.statistics(coded, words)
    plain = R.top(S.best(coded, S.blocks(asked, "q", words, "w"), len(words), "q", "id", 7, saturation=(1.2, 0.75, avgdl)), "q", "id", 7)
    monkeypatch.setattr(S, "TEXTS", texts)
    index = S.segments(df, "id", F.split("t", " ")).persist()
    assert S.segment_statistics(index) == pytest.approx((n, sum(len(t.split()) for _, t in docs if t) / n))
    assert {(r["term"], r["df"]) for r in S.segment_frequency(index).collect()} == {(w, sum(w in (t or "").split() for _, t in docs)) for w in {w for _, t in docs if t for w in t.split()}}
    got = R.top(S.best(S.looked_up(index, words, most), S.blocks(asked, "q", words, "w"), len(words), "q", "id", 7, saturation=(1.2, 0.75, avgdl), words=words), "q", "id", 7)
    assert sorted(map(tuple, got.drop("raw").collect())) == sorted(map(tuple, plain.drop("raw").collect())) and got.count() > 0


def test_an_index_is_searched_without_a_row_for_each_pair(spark, small, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(catalog, "_indices", {})
    monkeypatch.setattr(I, "postings", refuse)
    monkeypatch.setattr(R, "bm25_on_index", refuse)
    assert entry.queries()["bm25_on_index"](spark, small.replace("0.001", "0.01")).count() == 60


@pytest.mark.parametrize("name", BY_VECTOR)
def test_only_texts_of_documents_with_a_vector_become_tokens(spark, small, monkeypatch, name):
    plans, plain = {}, catalog.staged
    monkeypatch.setattr(catalog, "staged", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and plain(df, label))
    assert entry.queries()[name](spark, small.replace("0.001", "0.01")).count() > 0
    above, _, below = plans["sets"].partition("BroadcastHashJoin")
    assert "regexp_extract_all" in above and below and "regexp_extract_all" not in below
