import pytest

pytest.importorskip("sedge.llm")

from sedge.llm import leaks, splitting, tokens  # noqa: E402
from sedge.llm.common import bounded_sample, words_of  # noqa: E402

VOCABULARY = tokens.DEFAULT_VOCABULARY


def encoder():
    from pathlib import Path

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = [
    None, "", " ", "\n\n \t", "a", "It's  we'll 's ' 's", "<|endoftext|> x", "中文 text 12３ é́", "tab\tnbsp thin x\u0085y​z᠎", "😀👩‍🚀 \U0001e900", "x" * 30000, "word " * 5000, "�\u0000\x1c \x1f", "  leading", "trailing  ", "ǅ ª ² Ⅷ ౦",
]


def test_ids_are_those_of_the_tokenizer(spark):
    t = encoder()
    rows = [(i, x, "a", "b", 1) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[5], (None, "x", "a", "b", 1), (5, "other", "a", "b", 1)], "doc_id long, text string, word string, ids string, pos int")
    for hot in (1, 3, 40, 100_000):  # no, one, some and all words in the table that goes to the workers
        got = [(r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df, hot_words=hot).collect()]
        want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in [*enumerate(TEXTS), (None, "x"), (5, "other")]]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_decoding_gives_the_texts_back(spark):
    encoder()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def test_no_documents(spark):
    encoder()
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def split(spark, text, limit, overlap=0, delimiter=None):
    df = spark.createDataFrame([("i", text, limit, overlap, delimiter)], "id string, text string, limit int, overlap int, delimiter string")
    return [(r["piece"], r["piece_tokens"]) for r in splitting.split_texts(df).orderBy("piece_no").collect()]


def test_pieces_end_at_the_strongest_boundary(spark):
    assert split(spark, "a b. c d, e f g", 4) == [("a b. ", 2), ("c d, e f ", 4), ("g", 1)] or split(spark, "a b. c d, e f g", 4)[0][0].endswith(". ")
    assert [p for p, _ in split(spark, "one two | three four five | six seven", 4, 0, "|")] == ["one two | ", "three four five | ", "six seven"]
    assert [p for p, _ in split(spark, "a b ## c d e f", 4, 0, "`##`")][0] == "a b ## "
    assert [p for p, _ in split(spark, "a b\nc d e f", 4, 0, "\\n")][0] == "a b\n"


@pytest.mark.parametrize("limit", [1, 2, 7, 100, 1024, 4096])
@pytest.mark.parametrize("overlap", [-1, 0, 1, 3, 5000])
def test_pieces_cover_the_text_with_the_overlap(spark, limit, overlap):
    text = " lead " + "".join(f"w{i}{',.;! '[i % 5]} " if i % 7 else "中文。" for i in range(5000))
    got = split(spark, text, limit, overlap)
    keep = min(max(overlap, 0), limit - 1)
    import re

    unit = re.compile(r"[ \t\n\r 　]*(?:[一-鿿]|[^ \t\n\r 　一-鿿]+)[ \t\n\r 　]*")
    whole = got[0][0]
    for (a, _), (b, n) in zip(got[:-1], got[1:], strict=True):
        units = unit.findall(b)
        assert len(units) == n <= limit
        shared = min(keep, len(unit.findall(whole)))
        assert "".join(units[:shared]) == "".join(unit.findall(a)[-shared:] if shared else [])
        whole += "".join(units[shared:])
    assert whole == text


def test_no_limit_no_piece(spark):
    for text, limit in ((None, 5), ("", 5), ("a b", 2), ("a b", None), ("a b", 0), ("a b", -1)):
        assert split(spark, text, limit) == []


def test_chunks_by_their_config(spark):
    chunk = spark.createDataFrame([("1", "d", "a b c"), ("1", "d", "a b c"), ("2", "e", "a b c"), ("3", None, "a b c"), ("4", "d", None), (None, "d", "a b c")], "id string, doc_id string, content_with_weight string")
    files = spark.createDataFrame([("d", 1, None), ("d", 1, None), ("e", 2, None), ("f", None, None)], "doc_id string, config_id long, uploaded_at timestamp")
    configs = spark.createDataFrame([(1, 2, 1, "", None), (1, 2, 1, "", None), (2, None, 1, None, None)], "config_id long, chunk_token_num int, overlap_token_num int, delimiter string, updated_at timestamp")
    assert [r["id"] for r in splitting.split_chunks(chunk, files, configs).select("id").distinct().collect()] == ["1"]
    assert splitting.split_chunks(chunk.limit(0), files.limit(0), configs.limit(0)).count() == 0


def brute(docs, items):
    windows = {}
    for item, lang, passage, question in items:
        n = 24 if lang == "zh" else 10
        for t in (passage, question):
            w = words_of(t)
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    return {(d, k) for d, t in docs for n in (10, 24) for w in [words_of(t)] for i in range(len(w) - n + 1) for k in windows.get(tuple(w[i : i + n]), ())}


def test_leaks_are_those_of_brute_force(spark):
    import random

    r = random.Random(3)
    vocabulary = ["a", "bb", "ccc", "near", "the", "harbour", "x1", "y"]
    items = [(k, "zh" if k % 5 == 0 else "en", " ".join(r.choices(vocabulary, k=30)) if k % 5 else "".join(r.choices("甲乙丙丁戊己", k=40)), " ".join(r.choices(vocabulary, k=12))) for k in range(20)]
    docs = [(0, None), (1, ""), (2, "  ")]
    for k in range(60):
        _, lang, passage, question = items[k % 20]
        w = words_of(passage)
        a = r.randrange(0, len(w) - 8)
        part = w[a : a + r.randrange(6, 26)]
        noise = r.choices(vocabulary, k=r.randrange(40))
        docs.append((3 + k, (" ".join(noise) + ", " + ("" if lang == "zh" else "-- ").join([*map(str.upper, part)]) + ". " + (question if k % 7 == 0 else "")) if lang == "zh" else " ".join([*noise, *(p.upper() + "," for p in part), *noise])))
    docs.append((999, docs[10][1] * 300))
    docs.append(docs[10])
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, items[0], (50, "en", None, ""), (None, "en", "x", "y")], "item_id long, lang string, passage string, question string")
    got = {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(df, it).where("run >= window").collect()}
    assert got == brute(docs, items) and got
    assert leaks.find_leaks(df.limit(0), it).count() == leaks.find_leaks(df, it.limit(0)).count() == 0


def test_altered_passages_are_found(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen of nowhere"
    altered = passage.replace("fox", "fix").replace("wizards", "wizard")
    df = spark.createDataFrame([(1, "so " + altered + " it went"), (2, "nothing of the kind is in this text about other matters")], "doc_id long, text string")
    it = spark.createDataFrame([(7, "en", passage, None)], "item_id long, lang string, passage string, question string")
    assert {r["doc_id"] for r in leaks.find_leaks(df, it, window=30, edits=3, region=60).collect()} == {1}


def test_short_whole_runs_are_found_beside_altered_ones(spark):
    df = spark.createDataFrame([(1, "So: a be to it is on at we go up, he said."), (2, "x"), (3, "甲乙丙丁戊己" * 4)], "doc_id long, text string")
    it = spark.createDataFrame([(7, "en", "a be to it is on at we go up", "why"), (8, "zh", "甲乙丙丁戊己" * 4, None)], "item_id long, lang string, passage string, question string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it, edits=3, region=80).collect()}
    assert got == {(1, 7), (3, 8)} == {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()}


def edits_within(part, item):
    """Least edits from ``part`` to any part of ``item``, by the plain recurrence."""
    row = [0] * (len(item) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(item, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_altered_leaks_against_brute_force(spark):
    """Every planted region within the edits is found, and what is found is within them."""
    import random

    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(300)]
    items = [(k, "en", " ".join(r.choices(words, k=60)), None) for k in range(12)]
    docs, planted = [], set()
    for k in range(48):
        text = items[k % 12][2]
        a = r.randrange(0, len(text) - 100)
        part = list(text[a : a + 90])
        for _ in range(k % 5):  # up to three edits count, four may be too many
            j = r.randrange(2, len(part) - 2)
            part[j : j + 1] = r.choice([[], ["q"], [part[j], "q"]])
        if k % 5 <= 3:
            planted.add((k, k % 12))
        docs.append((k, " ".join(r.choices(words, k=r.randrange(30))) + " " + "".join(part) + " " + " ".join(r.choices(words, k=r.randrange(30)))))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, passage string, question string")
    got = leaks.find_leaks(df, it, window=50, edits=3, region=80).collect()
    assert planted <= {(x["doc_id"], x["item_id"]) for x in got}
    for x in got:
        text, item = docs[x["doc_id"]][1], items[x["item_id"]][2]
        assert x["distance"] is not None and any(edits_within(text[a : a + 80], item) <= 3 for a in range(0, len(text) - 79))


def test_items_in_blocks_and_ids_of_any_type(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([("d1", f"so {passage}."), ("d2", "nothing"), ("d3", f"{passage.upper()} {passage[::-1]}")], "doc_id string, text string")
    items = spark.createDataFrame([(f"i{k}", "en", passage if k % 2 else passage[::-1], "why") for k in range(20)], "item_id string, lang string, passage string, question string")
    want = {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(docs, items).collect()}
    assert {d for d, _ in want} == {"d1", "d3"} and len(want) == 30
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 300)
    assert {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(docs, items).collect()} == want


def test_samples_are_bounded_and_stable(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as g")
    a = [r["id"] for r in bounded_sample(df, 100, "id").collect()]
    assert len(a) == 100 and a == [r["id"] for r in bounded_sample(df.repartition(7), 100, "id").collect()]
    b = bounded_sample(df.where("g = 0 or id < 100"), 90, "id", by="g").groupBy("g").count().collect()
    assert {r["g"] for r in b} == {0, 1, 2}
