import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions import tokenizer as K
from sedge.operators import rerank as M
from sedge.operators import vision as V
from sedge.plans.config import ChunkingConfig, chunk_files, chunk_texts
from sedge.sources import parsers as P

WORDS = K.Dictionary.of([("机器", 900, "n"), ("学习", 800, "v"), ("机器学习", 700, "n"), ("研究", 900, "v"), ("研究生", 500, "n"), ("生命", 800, "n"), ("起源", 400, "n")])


def test_segmentation(spark):
    assert WORDS.segment("研究生命起源") == ["研究", "生命", "起源"] and WORDS.fine("机器学习") == ["机器", "学习"]
    df = spark.createDataFrame([("机器学习 Running tests，ＡＢ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(K.tokenize(F.col("t"), WORDS)).collect()] == ["机器学习 run test ab", None, ""]
    assert df.select(K.tokenize(F.col("t"), None)).first()[0].startswith("机 器 学 习")


def test_token_runs(spark):
    df = spark.sql("select array('machine', 'learning', '中', 'ab', 'c', 'parser', 'd', 'e', 'f', 'g', 'h') t")
    assert df.select(K.glue_latin(F.col("t")).alias("x")).first()["x"][:2] == ["machine learning", "中"]
    assert df.select(K.merge_short(F.col("t")).alias("x")).first()["x"] == ["machine", "learning", "中", "ab c", "parser", "d e", "f g h"]
    cases = {
        "a b c d e f g h": ["a b", "c d", "e f g h"], "a b c d e f g": ["a b", "c d", "e f g"], "a b c d": ["a b c d"], "x": ["x"], "": [], "多 工位 a": ["多 工位", "a"], "多 word a b": ["多", "word", "a b"],
        "机 的 器 学": ["机", "的", "器 学"], "long a": ["long", "a"],
    }
    for text, want in cases.items():
        assert spark.createDataFrame([(text.split(),)], "t array<string>").select(K.merge_short(F.col("t")).alias("x")).first()["x"] == want, text
    assert spark.sql("select cast(null as array<string>) t").select(K.merge_short(F.col("t")).alias("x")).first()["x"] is None


def test_synonyms(spark):
    t = spark.createDataFrame([("a", "b"), ("a", "a")], "term string, synonym string")
    got = {r["term"]: r["synonyms"] for r in K.synonyms(spark.createDataFrame([("a",), ("z",)], "term string"), t).collect()}
    assert got == {"a": ["b"], "z": []}


def test_model_ranking(spark):
    df = spark.createDataFrame([(1, "x y", "x y z", 0.1), (1, "x y", None, 0.9), (2, "q", "q", 0.0)], "q int, question string, text string, tok double").withColumn("rank_fea", F.lit(None).cast("double"))
    got = [round(r["score"], 4) for r in M.rerank_by_model(df, "q", "question", "text", M.OverlapScorer()).orderBy("q", F.desc("score")).collect()]
    assert got == [0.73, 0.27, 0.0]


def test_tags(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "q int, tag string")
    p = M.tag_portions(hits, "tag", 6.0)
    assert {r["tag"]: r["portion"] for r in p.collect()} == {"a": 0.3, "b": 0.3}
    assert [r["tag"] for r in M.tag_scores(hits, p, "q", "tag", 1).orderBy("q").collect()] == ["a", "b"]


def test_top_terms(spark):
    p = spark.createDataFrame([("d", t) for t in "abcdefghijklmnopqrstuvwxyz"], "id string, term string")
    w = spark.createDataFrame([(t, float(i)) for i, t in enumerate("abcdefghijklmnopqrstuvwxyz")], "term string, weight double")
    r = M.top_terms(p, w, "id", 20).first()
    assert len(r["terms"]) == 20 and r["must"] == 2


def test_array_steps(spark):
    p = np.zeros((1, 5, 3))
    p[0, range(5), [1, 1, 0, 1, 2]] = 0.9
    assert V.ctc_decode(p, "ab") == [("aab", pytest.approx(0.9))]
    heat = np.zeros((20, 20))
    heat[5:8, 5:15] = 0.9
    assert len(V.boxes_of_map(heat)) == 1
    out, scale, border = V.letterbox(np.ones((10, 20, 3), np.uint8), 40, 40)
    assert out.shape == (40, 40, 3) and scale == 2 and border == (10, 0) and V.normalised(out).shape == (3, 40, 40)
    assert V.suppressed(np.array([[0, 10, 0, 10], [1, 10, 0, 10], [20, 30, 0, 10]], float), np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]
    df = spark.createDataFrame([(bytearray(b"ab"),), (None,)], "i binary")
    assert [r[0] for r in df.select(V.apply_model(F.col("i"), lambda: lambda bs: [len(b) for b in bs], "int")).collect()] == [2, None]


def test_configs(tmp_path):
    c = ChunkingConfig.from_dict({"parser_type": "resume", "chunk_token_num": 0, "other": 1, "zoomin": None})
    assert len(c.problems()) == 2 and ChunkingConfig().problems() == []
    ChunkingConfig(chunk_token_num=7).save(f"{tmp_path}/c.json")
    assert ChunkingConfig.load(f"{tmp_path}/c.json").chunk_token_num == 7


@pytest.mark.parametrize("kind", ["general", "qa", "paper", "manual", "laws", "book", "presentation", "table", "one"])
def test_every_strategy(spark, kind):
    texts = spark.createDataFrame([("a", "Article 1\nwords of one\nArticle 2\nwords\tof two"), ("b", "plain text. more text"), ("c", None), ("d", "")], "doc_id string, text string")
    got = chunk_texts(texts, ChunkingConfig(parser_type=kind)).collect()
    assert {r["doc_id"] for r in got} >= {"a"} and all(r["content"] is not None for r in got)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown parser"):
        chunk_texts(spark.createDataFrame([], "doc_id string, text string"), ChunkingConfig(parser_type="picture"))


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two three\nfour")
    (tmp_path / "b.html").write_text("<html><body><p>html text</p></body></html>")
    (tmp_path / "c.eml").write_text("Subject: s\n\nmail body")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = chunk_files(P.read_files(spark, str(tmp_path)), ChunkingConfig()).collect()
    assert {r["docnm_kwd"] for r in got} == {"a.txt", "b.html", "c.eml"} and len({r["id"] for r in got}) == len(got)
