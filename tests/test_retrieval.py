import numpy as np
from pyspark.sql import functions as F

from sedge.operators import index as I
from sedge.operators import retrieval as R
from sedge.plans.query import Fusion, MatchDense, MatchSparse, MatchText, OrderBy, Request, plan, search


def corpus(spark):
    rows = [("a", "the parser reads the queue", [1.0, 0.0], 1, [2, 4]), ("b", "parser parser compiler", [0.8, 0.6], 1, [1]), ("c", "violin and choir", [0.0, 1.0], 1, None), ("d", "parser of another time", [1.0, 0.1], 0, [9]), ("e", None, None, 1, [3])]
    return spark.createDataFrame(rows, "id string, content_with_weight string, q_2_vec array<double>, available_int int, page_num_int array<int>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_text_search(spark):
    t = corpus(spark)
    assert ids(plan(t, Request(text=MatchText("parser compiler", min_match=0.5)))) == ["b", "a"]
    assert ids(plan(t, Request(text=MatchText("parser compiler", min_match=1.0)))) == ["b"]
    assert "<em>parser</em>" in plan(t, Request(text=MatchText("parser"), highlight=True)).first()["highlight"]


def test_vector_and_hybrid_search(spark):
    t = corpus(spark)
    dense = MatchDense("q_2_vec", (0.0, 1.0), 10, 0.1)
    assert ids(plan(t, Request(dense=dense))) == ["c", "b"]
    assert ids(plan(t, Request(text=MatchText("parser"), dense=dense))) == ["b"]
    assert ids(plan(t, Request(text=MatchText("parser"), dense=dense, fusion=Fusion("sum")))) == ["c", "b", "a"]
    assert ids(plan(t.drop("q_2_vec"), Request(text=MatchText("parser"), dense=dense))) == ["b", "a"]


def test_lists_filters_and_pages(spark):
    t = corpus(spark)
    assert ids(plan(t, Request(order=OrderBy().asc("page_num_int")))) == ["b", "a", "e", "c"]
    assert ids(plan(t, Request(order=OrderBy().asc("page_num_int"), page=2, size=2))) == ["e", "c"]
    assert ids(plan(t, Request(filters={"id": ["a", "c"], "x": None}))) == ["a", "c"]


def test_fallback_is_wider(spark):
    t = corpus(spark)
    assert ids(search(t, Request(text=MatchText("parser zebra unicorn dragon", min_match=1.0)))) == ["b", "a"]
    assert ids(search(t, Request(text=MatchText("zebra")))) == []


def test_sparse(spark):
    t = spark.sql("select 'a' id, map(1, 2D) m union all select 'b', map(2, 1D)")
    assert ids(plan(t, Request(sparse=MatchSparse("m", (1, 3), (1.0, 1.0))))) == ["a"]


def test_knn_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "i long, v array<double>")
    q = rows.where("i % 100 = 0").withColumnRenamed("i", "q")
    got = {}
    for r_ in R.knn(q, rows, "q", "i", "v", 5, block=2).collect():
        got.setdefault(r_["q"], []).append((r_["rank"], r_["i"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 100, 200):
        assert [j for _, j in sorted(got[i])] == np.argsort(-(unit @ unit[i]), kind="stable")[:5].tolist()
    assert set(got) == {0, 100, 200}


def test_zero_cosines_leave_the_tokens(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.4), (1, "b", 0.0, 0.2), (2, "c", 0.5, 0.1)], "q int, id string, cos double, tok double")
    got = {r["id"]: round(r["score"], 6) for r in R.hybrid(df, "q").collect()}
    assert got == {"a": 0.4, "b": 0.2, "c": 0.38}


def test_rank_features_and_min_max(spark):
    df = spark.sql("select 1 q, map('x', 3D, 'y', 4D) t, 2D p")
    assert abs(df.select(R.rank_feature(F.col("t"), F.col("p"), {"x": 1.0}).alias("s")).first()["s"] - 8) < 1e-9
    same = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "q int, s double")
    assert sorted(r["m"] for r in same.select(R.min_max(F.col("s"), "q").alias("m")).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_ties_go_by_id(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0)], "q int, id string, score double")
    assert [r["id"] for r in R.top(df, "q", "id", 1).collect()] == ["a"]


def test_postings(spark):
    df = spark.createDataFrame([("a", "x y x 中文"), ("b", ""), ("c", None)], "id string, t string")
    got = {(r["term"], r["tf"], r["length"]) for r in I.postings(df, "id", "t").collect()}
    kept = I.postings(df, "id", "t", keep_empty=True)
    assert tuple(I.postings_stats(kept, "id").first()) == (3, 5 / 3) and I.document_frequency(kept).count() == 4
    assert got == {("x", 2, 5), ("y", 1, 5), ("中", 1, 5), ("文", 1, 5)}


def test_search_over_an_index_is_the_plain_search(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 2 + i % 5))) for i in range(30)], "id long, t string")
    p = I.postings(docs, "id", "t")
    terms = spark.createDataFrame([(1, "w1"), (1, "w3"), (2, "w0"), (2, "none")], "q int, term string")
    stats, df = I.postings_stats(p, "id"), I.document_frequency(p)
    one = stats.first()
    want = sorted((r["q"], r["id"], round(r["score"], 9), r["matched"]) for r in R.bm25(terms, p, df, stats, "q", "id").collect())
    for most in (1, 100):
        got = sorted((r["q"], r["id"], round(r["score"], 9), r["matched"]) for r in R.bm25_on_index(terms, p, df, one["n"], one["avgdl"], "q", "id", most=most).collect())
        assert got == want and got
    assert R.bm25_on_index(terms.limit(0), p, df, 30, 2.0, "q", "id").count() == 0


def test_dense_candidates_without_text_are_added_to_the_weighted_sum(spark):
    text = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0), (2, "a", 0.25)], "q int, i string, score double")
    dense = spark.createDataFrame([(1, "b", 0.5), (1, "c", 0.75)], "q int, i string, score double")
    want = {(r["q"], r["i"]): r["score"] for r in R.weighted_sum(text, dense, "q", "i").collect()}
    got = {(r["q"], r["i"]): r["score"] for r in R.weighted_sum(text, dense, "q", "i", alone=dense.where("i = 'c'")).collect()}
    assert got == want and len(got) == 4
