from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.operators import chunking as C


def merge(spark, sections, budget):
    df = spark.createDataFrame([(1, sections)], "doc int, s array<string>")
    return [(r["content"], r["tokens"]) for r in C.greedy_merge(df, "s", budget, " ").orderBy("chunk_index").collect()]


def test_a_chunk_is_closed_after_the_budget_is_exceeded(spark):
    assert merge(spark, ["a b c", "d e f", "g h i", "j"], 4) == [("a b c d e f", 6), ("g h i j", 4)]
    assert merge(spark, [], 4) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["x", "yy", "z"]), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=12), st.integers(1, 9))
def test_nothing_is_lost_in_merging(spark, sections, budget):
    got = merge(spark, sections, budget)
    assert " ".join(c for c, _ in got) == " ".join(sections)
    assert all(n > budget for _, n in got[:-1])


def test_islands(spark):
    rows = [(1, i, lv, 0) for i, lv in enumerate([5, 1, 1, 5, 2, 5])]
    lines = spark.createDataFrame(rows, "doc int, i int, level int, family int").withColumn("line", F.lit("x"))
    most = spark.createDataFrame([(1, 1)], "doc int, most_level int")
    assert [r["sid"] for r in C.section_islands(lines, most, "doc").orderBy("i").collect()] == [0, 1, 1, 1, 1, 1]


def test_questions_and_answers(spark):
    df = spark.createDataFrame([("lost\nQ: a\tA: b\nmore\nc\td",)], "t string")
    assert [tuple(x) for x in df.select(C.question_answers(F.col("t")).alias("p")).first()["p"]] == [("a", "b\nmore"), ("c", "d")]


def test_contents_are_dropped(spark):
    text = "Intro\nContents\nFirst part 1\nSecond part 2\nFirst part begins\nbody"
    df = spark.createDataFrame([(text,), ("no contents",)], "t string")
    assert [r[0] for r in df.select(C.drop_contents(F.col("t"))).collect()] == ["Intro\nFirst part begins\nbody", "no contents"]
    two = "目 录\n第一章 甲\n第二章 乙\n第一章 甲\n正文\nTable of Contents\nOne thing 1\nTwo 2\nOne thing\nend"
    df = spark.createDataFrame([(two,), ("Contents",), ("Contents\nOnly entry\nother\nlines",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(C.drop_contents(F.col("t"))).collect()] == ["第一章 甲\n正文\nOne thing\nend", "", "other\nlines", None, ""]


def test_delimiters(spark):
    df = spark.createDataFrame([("an n\nb&c!d##e\\n;f",), (None,)], "t string")
    for delimiter, want in (("\n!", ["an n", "b&c", "d##e\\n;f"]), ("`##`;", ["an n\nb&c!d", "e\\n", "f"]), ("&&", ["an n\nb", "c!d##e\\n;f"]), ("]^-", ["an n\nb&c!d##e\\n;f"]), ("", ["an n\nb&c!d##e\\n;f"])):
        assert [r[0] for r in df.select(C.delimiter_sections(F.col("t"), delimiter)).collect()][0] == want, delimiter


def test_packing(spark):
    df = spark.sql("select array(struct(10L as n, 0L as sid), struct(30L as n, 1L as sid), struct(5L as n, 1L as sid), struct(900L as n, 2L as sid)) x")
    assert df.select(C.packed_sections(F.col("x")).alias("p")).first()["p"] == [0, 0, 1, 1]


def test_heading_paths(spark):
    lines = ["# A", "a", "## B", "b", "# C", "c"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, i int, line string")
    assert [r["path"] for r in C.heading_paths(df, "doc").orderBy("i").collect()] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]


def test_hierarchy(spark):
    text = "Article 1\none\ntwo\nArticle 2\nthree"
    lines = C.lines_with_levels(spark.createDataFrame([(1, text), (2, "plain")], "doc int, t string"), "doc", "t")
    got = [r["content"] for r in C.hierarchical_merge(lines, "doc").orderBy("chunk_index").collect()]
    assert sorted(x for c in got for x in c.split("\n")) == sorted(["Article 1", "one", "Article 1", "two", "Article 2", "three"])


def test_documents_without_a_chunk_of_a_hierarchy(spark):
    # bullets of the highest levels alone begin no chunk; the last document of a task, or all of a batch, may be such
    lines = C.lines_with_levels(spark.createDataFrame([(1, "1. a\n2. b"), (2, "Article 1\none"), (3, "1. c\n2. d")], "doc int, t string").coalesce(1), "doc", "t", strict=False)
    assert C.hierarchical_merge(lines.where("doc <> 2"), "doc").count() == 0
    assert [(r["doc"], r["content"]) for r in C.hierarchical_merge(lines, "doc").collect()] == [(2, "Article 1\none")]


def hierarchy_by_hand(rows, size, depth, budget):
    """Chunks of (level, text) lines of a family of ``size`` levels, found line by line."""
    chunks, used = [], set()
    for level in [size + 1, size, *range(size - 1, -1, -1)][:depth]:
        for at, (own, _) in enumerate(rows):
            if own != level or at in used:
                continue
            path = [at]
            for higher in range(level - 1, -1, -1) if level != 1 else ():
                heads = [k for k in range(at) if rows[k][0] == higher]
                if heads:
                    if heads[-1] > path[-1]:
                        path.pop()
                    path.append(heads[-1])
            used.update(path)
            chunks.append(path[::-1])
    out, room = [], budget
    for c in chunks:
        n = len(rows[c[0]][1].split())
        if len(c) == 1 and n < room and out and out[-1][1]:
            out[-1][0].extend(c)
            room -= n
        elif len(c) == 1 and n < room and not out:
            out.append((list(c), True))
            room -= n
        else:
            out.append((list(c), True))
            room = budget - n if len(c) == 1 else 0
    return ["\n".join(rows[k][1] for k in c) for c, _ in out]


def test_hierarchy_against_a_plain_search(spark):
    import random

    r = random.Random(7)
    docs, want = [], {}
    for d in range(30):
        family = d % 4
        size = [5, 6, 5, 4][family]
        rows = [(r.choice([*range(size), size + 1, size + 1]), f"line {d} {i} " + "w " * r.randrange(60)) for i in range(r.randrange(1, 25))]
        docs += [(d, family, i, text.strip(), level) for i, (level, text) in enumerate(rows)]
        want[d] = hierarchy_by_hand([(level, text.strip()) for level, text in rows], size, 5, 218)
    lines = spark.createDataFrame(docs, "doc int, family int, i int, line string, level int")
    got = {}
    for x in C.hierarchical_merge(lines, "doc").orderBy("doc", "chunk_index").collect():
        got.setdefault(x["doc"], []).append(x["content"])
    assert got == {d: w for d, w in want.items() if w}


def test_numbers_that_look_like_bullets_count_in_hierarchies(spark):
    lines = spark.createDataFrame([(1, "第1章 甲\n第2章 乙\n0 x\n1. a\n2. b")], "d int, t string")
    strict, loose = (C.lines_with_levels(lines, "d", "t", s).orderBy("i").collect() for s in (True, False))
    assert [x["level"] for x in strict][:2] == [x["level"] for x in loose][:2] and strict[2]["level"] != loose[2]["level"]


def test_json_is_split_without_loss(spark):
    import json

    value = {"a": {"b": "x" * 30, "c": [1, 2, 3]}, "d": "y" * 40}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "no json"), (3, None)], "k int, j string")
    got = C.split_json(df, "k", "j", 60, 20).orderBy("chunk_index").collect()
    merged = {}

    def put(a, b):
        for k, v in b.items():
            put(a.setdefault(k, {}), v) if isinstance(v, dict) else a.__setitem__(k, v)

    for r in got:
        assert r["k"] == 1
        put(merged, json.loads(r["content"]))
    assert merged == {"a": {"b": "x" * 30, "c": {"0": 1, "1": 2, "2": 3}}, "d": "y" * 40}


JSON = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text("ab\"é", max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("xyz", min_size=1, max_size=3), x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(20, 120), st.integers(0, 60))
def test_json_portions(value, most, least):
    import json

    def leaves(x, path=()):
        inner = [(str(i), v) for i, v in enumerate(x)] if isinstance(x, list) else list(x.items()) if isinstance(x, dict) else []
        if not inner:
            return [(path, {} if isinstance(x, list | dict) else x)]
        return [y for k, v in inner for y in leaves(v, (*path, k))]

    got = C.json_portions(json.dumps(value), most, least)
    want = [(p or ("value",), v) for p, v in leaves(value)] if value not in ([], {}) else []
    assert [y for x in got for y in leaves(json.loads(x))] == want
    assert all(len(x) >= least for x in got[:-1])


def test_json_is_cut_where_a_part_does_not_fit():
    import json

    value = {"a": {"b": "x" * 30, "c": [1, 2, 3]}, "d": "y" * 40, "e": 1}
    got = [json.loads(x) for x in C.json_portions(json.dumps(value), 60, 20)]
    assert got == [{"a": {"b": "x" * 30}}, {"a": {"c": {"0": 1, "1": 2, "2": 3}}}, {"d": "y" * 40, "e": 1}]


def test_outline_matching(spark):
    s = spark.createDataFrame([(1, 0, "General provisions"), (1, 1, "other text")], "doc int, i int, line string")
    o = spark.createDataFrame([(1, 0, "General provision", 2)], "doc int, outline_no int, title string, outline_level int")
    assert [r["outline_level"] for r in C.outline_levels(s, o, "doc").orderBy("i").collect()] == [2, None]
