import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import joins as J


@pytest.fixture(scope="module")
def names():
    r = random.Random(5)
    place = lambda: "".join(r.choice(["gar", "mel", "vin", "tor", "aï", "sk", "len"]) for _ in range(r.randrange(1, 5)))
    some = [f"{r.choice(['annual report', 'minutes', '用户手册', 'x'])} {place()}{r.choice(['', ' 2018', ' 2019'])}.{r.choice(['pdf', 'docx'])}" for _ in range(300)]
    return sorted({*some, "ab", "ba", "aba", "中文", *(f"{'word' * 90}{i} " + "".join(map(chr, range(300, 500 + i))) for i in range(3))})


def shares(names):
    grams = {n: {n[i : i + 2] for i in range(len(n) - 1)} for n in names}
    return {(a, b): len(grams[a] & grams[b]) / max(len(grams[a]), len(grams[b])) for a in names for b in names}


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.8])
def test_similar_names_are_the_brute_ones(spark, names, threshold):
    n = spark.createDataFrame([(x,) for x in names + names[:5]], "n string")
    got = [(r["a"], r["b"], r["similarity"]) for r in J.similar_names(n, n, "n", "n", T.bigrams(F.col("a")), T.bigrams(F.col("b")), threshold).collect()]
    assert sorted(got) == sorted((*p, s) for p, s in shares(names).items() if s > threshold) and len(got) > 2 * len(names)


def test_the_join_of_names_gives_few_pairs_that_are_not_similar(spark, names):
    n = spark.createDataFrame([(x,) for x in names], "n string")
    x, y = n.select(F.col("n").alias("a"), T.bigrams(F.col("n")).alias("ga")), n.select(F.col("n").alias("b"), T.bigrams(F.col("n")).alias("gb"))
    similar = sum(s > 0.8 for s in shares(names).values())
    assert similar <= J.name_candidates(x, y, 0.8).count() < 2 * similar
