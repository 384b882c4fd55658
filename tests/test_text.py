import pytest
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions import vectors as V
from sedge.functions import weights as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (T.half_width, "ＡＢ１　：x", "AB1 :x"),
        (T.remove_spaces, "中 文 and English words", "中文 and English words"),
        (T.strip_table_tags, "<table><td colspan=2>a</td></table>", "  a  "),
        (T.clean_query, "what is the capital", " the capital"),
        (T.clean_query, "请问什么", "请问什么"),
        (T.escape_query, ' a:b (c) ', "a\\:b \\(c\\)"),
        (T.cell_type, "2024-01-02", "Dt"),
        (T.cell_type, "12.5%", "Nu"),
        (T.cell_type, "AB-12", "Ca"),
        (T.cell_type, "x", "En"),
        (T.cell_type, "one two three four five", "En"),
        (T.outline_level, "第三章 总则", 1),
        (T.outline_level, "1.2 text", 6),
        (T.outline_level, "12 (3)", None),
        (T.remove_answer_prefix, "Answer: yes", "yes"),
        (T.yes_no, " TRUE ", "yes"),
        (T.yes_no, "×", "no"),
        (T.yes_no, "maybe", None),
        (T.extension, "a.b.PDF", "pdf"),
        (T.recommended_strategy, "research_paper.pdf", "paper"),
        (T.recommended_strategy, "user_manual.docx", "manual"),
        (T.recommended_strategy, "data_table.xlsx", "table"),
        (T.recommended_strategy, "presentation.pptx", "presentation"),
        (T.recommended_strategy, "unknown_file.xyz", "general"),
    ],
)
def test_scalars(spark, function, given, expected):
    assert one(spark, function(F.col("c")), c=given) == expected


@pytest.mark.parametrize("function", [T.half_width, T.remove_spaces, T.clean_query, T.cell_type, T.outline_level, T.yes_no, T.is_chinese, T.token_count, T.loose_timestamp, T.year_month_day, T.preview])
def test_null_gives_null(spark, function):
    assert one(spark, function(F.col("c")), c=None) is None


def test_languages(spark):
    assert one(spark, T.is_english(F.col("l")), l=["one", "(two)", "three", "four", "five", "шесть"])
    assert not one(spark, T.is_english(F.col("l")), l=[])
    assert one(spark, T.is_chinese_query(F.col("c")), c="machine learning")
    assert not one(spark, T.is_chinese_query(F.col("c")), c="what is machine learning good for")


def test_bullets(spark):
    assert one(spark, T.bullet_family(F.col("l")), l=["第一章 a", "第二章 b", "x"]) == 0
    assert one(spark, T.bullet_family(F.col("l")), l=["Article 1", "Article 2"]) == 3
    assert one(spark, T.bullet_family(F.col("l")), l=["plain"]) == -1


def test_dates(spark):
    assert str(one(spark, T.loose_timestamp(F.col("c")), c="1700000000")) == "2023-11-14 22:13:20"
    assert str(one(spark, T.loose_timestamp(F.col("c")), c="2024/3/5")) == "2024-03-05 00:00:00"
    assert str(one(spark, T.year_month_day(F.col("c")), c="born 1999.13.40")) == "1999-01-01"


def test_weights_have_the_closed_form(spark):
    df = spark.createDataFrame([("parser",), ("ab",), ("1234",), ("中",)], "t string").select("t", W.raw_weight(F.col("t")).alias("w"))
    got = {r["t"]: round(r["w"], 5) for r in df.collect()}
    assert got == {"parser": 5.92219, "ab": 0.05922, "1234": 15.43705, "中": 7.7128}


def test_coverage_counts_membership_only(spark):
    df = spark.sql("select array('a','b') q, array(3D, 1D) w, array('a','a','c') d")
    assert abs(df.select(W.coverage(F.col("q"), F.col("w"), F.col("d")).alias("x")).first()["x"] - 0.75) < 1e-6


def test_vectors(spark):
    df = spark.sql("select array(3D, 4D) a, array(0D, 0D) z, map('x', 3D, 'y', 4D) m")
    r = df.select(V.cosine(F.col("a"), F.col("a")).alias("one"), V.cosine(F.col("a"), F.col("z")).alias("none"), V.map_cosine({"x": 1.0}, F.col("m")).alias("tags")).first()
    assert abs(r["one"] - 1) < 1e-12 and r["none"] is None and abs(r["tags"] - 0.6) < 1e-12


def test_highlight_and_between(spark):
    assert one(spark, T.highlight(F.col("c"), F.array(F.lit("parser"))), c="The Parser and parsers") == "The <em>Parser</em> and parsers"
    assert one(spark, T.between(F.col("c"), "[", "]"), c="[a] b [c\nd]") == ["a", "c\nd"]
