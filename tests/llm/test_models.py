import pandas as pd
import pytest

pytest.importorskip("sedge.llm")

from pyspark.sql import functions as F  # noqa: E402

from sedge.llm import encoding, language, scans, subjects  # noqa: E402


@pytest.fixture(scope="module")
def samples():
    try:
        return pd.read_parquet("/root/testdata/sf0.001/subject_sample.parquet")
    except OSError:
        pytest.skip("test tables aren't here")


# -- encodings

CASES = [
    ("Der Bericht über die Prüfung", "utf-8", "cp1252"), ("La sesión está aquí", "utf-8", "latin-1"), ("Отчёт о проверке системы", "utf-8", "cp1251"), ("résumé collection", "utf-8", "mac_roman"),
    ("用户手册与说明", "utf-8", "cp437"), ("常见问题说明", "gb18030", "latin-1"), ("Обзор системы", "cp1251", "latin-1"), ("Справочник проверки", "cp866", "cp1251"), ("Договор поставки товара", "koi8-r", "cp1251"),
    ("le génome très récent", "cp1252", "mac_roman"), ("die Düngung überall", "cp1252", "cp850"), ("研究论文报告", "utf-8", "gb18030"), ("常见问题报告说明", "gb18030", "big5"),
    ("操作规程说明", "gb18030", "cp1251"), ("操作规程说明", "gb18030", "mac_roman"), ("the ward：K-1674", "utf-8", "koi8-r"), ("die Lunge：Felna", "utf-8", "gb18030"), ("la página según el plan", "utf-8", "gb18030"), ("bei 474 °C sorgfältig", "utf-8", "gb18030"), ("the “Question” near “Rendahar” was", "cp1252", "cp850"), ("– The trial ran", "cp1252", "mac_roman"),
]


@pytest.mark.parametrize(("text", "written", "read"), CASES)
def test_garbled_text_is_restored(text, written, read):
    r = encoding.Repairer({"düngung": 9, "überall": 9, "génome": 9, "très": 9, "récent": 9})
    garbled = text.encode(written).decode(read, "strict") if read not in ("cp1252",) else encoding._bytes_as(text.encode(written), read)
    new, damaged, complete = r.repair(garbled)
    assert damaged and new == text and complete


def test_twice_garbled_and_partly_garbled():
    r = encoding.Repairer()
    twice = encoding._bytes_as(encoding._bytes_as("Geräte für alle".encode(), "cp1252").encode(), "cp1252")
    assert r.repair(twice)[0] == "Geräte für alle"
    assert r.repair("Schöne GrÃ¼ÃŸe, café")[0] == "Schöne Grüße, café"
    assert r.repair("at 337 Â°C, for â¬484")[0] == "at 337 °C, for €484"  # a control character was dropped
    assert r.repair("产å“\x81说明书，普通文本没有问题")[0] == "产品说明书，普通文本没有问题"


def test_nothing_is_changed_that_no_automaton_marks():
    import random

    r, rng = encoding.Repairer(), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("abc àéßÃÂñ‚ „”«»°±Ж я中文鈥Ú³õ1 ", k=30))
        new, damaged, _ = r.repair(text)
        hit = any(True for a in (r.automaton, r.runs_of, r.beside) for _ in a.iter(f" {text} "))
        assert hit or (new == text and not damaged)


@pytest.mark.parametrize(
    "text",
    [
        None, "", " ", "plain ascii", "Größe Ä–Ü ±2 µm", "MANHÃ DE SÃO CRISTAL, AÇÃO Nº 7", "The symbols §, ¶, © and ¬ are printed", "why “Ã©” shows up", "La séquence « Ã© » n’est citée", "the string â€™ as seen", "¯\\_(ツ)_/¯",
        "обычный текст «в кавычках» — да", "ОБЫЧНЫЙ ТЕКСТ, МОСКВА № 5", "La cadena «Ã±» aparece aquí", "普通的中文文本，没有问题。", "ÅNGSTRÖM ±0.5 µm × 3", "L’étiquette à 20 °C", "Die Zeichenfolge „Ã¼“ steht hier", "p. 3 – № 5",
    ],
)
def test_proper_text_stays(text):
    new, damaged, _ = encoding.Repairer().repair(text)
    assert new == text and not damaged


def test_what_is_lost_is_told(spark):
    df = spark.createDataFrame([("a", "caf�", "x"), ("a", "caf�", "x"), ("b", None, None), (None, "Ã¤", "x"), ("c", "ok", "fÃ¼r"), ("d", "x" * 50000 + "Ã¼", None)], "id string, content_with_weight string, docnm_kwd string")
    got = {(r["id"], r["field"]): (r["complete"], r["restored"][-6:]) for r in encoding.repair_fields(df, ["content_with_weight", "docnm_kwd"]).collect()}
    assert got == {("a", "content_with_weight"): (False, "caf�"), ("c", "docnm_kwd"): (True, "für"), ("d", "content_with_weight"): (True, "xxxxxü")}
    assert encoding.repair_fields(df.limit(0), ["docnm_kwd"]).count() == 0


def test_damaged_words_that_recur_are_still_damaged(spark):
    r = encoding.Repairer({"orþamento": 4, "orçamento": 60})
    assert r.repair("orþamento anual")[0] == "orçamento anual"
    texts = ["orþamento anual"] * 4 + ["orçamento anual"] * 60 + [f"{a}é{b}lo" for a in "bcdfgklmnp" for b in "bcdfgklmnp"] * 70
    known = encoding.known_words(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert {r["w"]: r["n"] for r in known.collect()} == {"orþamento": 4, "orçamento": 60}


def test_known_words_beyond_a_set_are_joined(spark, monkeypatch):
    rows = [("a", "orþamento anual", "fÃ¼r"), ("b", "orçamento", None), ("c", "orþamento", "orþamento"), ("d", None, "x"), (None, "fÃ¼r", None)]
    df = spark.createDataFrame(rows, "id string, t string, u string")
    known = spark.createDataFrame([("orþamento", 4), ("orçamento", 60)], "w string, n long")
    want = {tuple(r) for r in encoding.repair_fields(df, ["t", "u"], known).collect()}
    assert {(i, f) for i, f, *_ in want} == {("a", "t"), ("a", "u"), ("c", "t"), ("c", "u")} and ("c", "t", True, "orçamento") in want
    monkeypatch.setattr(encoding, "MOST_KNOWN", 1)
    assert {tuple(r) for r in encoding.repair_fields(df, ["t", "u"], known).collect()} == want


# -- languages


def test_languages_of_held_out_sentences(samples):
    train, test = samples[samples.sample_id % 4 != 0], samples[samples.sample_id % 4 == 0]
    f = language.LanguageFilter.fit(list(zip(train.lang, train.text, strict=True)))
    texts = [t if len(t) > 150 else t + " " + t for t in test.text]
    labels = list(language.label_batch(texts, f, encoding.Repairer()))
    right = [lang == test.lang.iloc[i] for i, _, _, _, lang, _, full in labels if full]
    assert len(right) > 100 and sum(right) / len(right) > 0.97


def test_every_segment_gets_a_language(samples):
    """Short segments, too, and those of mixed texts; their confidence is lower."""
    train, test = samples[samples.sample_id % 4 != 0], samples[samples.sample_id % 4 == 0]
    f = language.LanguageFilter.fit(list(zip(train.lang, train.text, strict=True)))
    short = [" ".join(t.split()[:4]) if lang != "zh" else t[:5] for lang, t in zip(test.lang, test.text, strict=True)]
    got = list(language.label_batch([*short, None, "", "12 34"], f, encoding.Repairer(), True))
    assert {i for i, *_ in got} >= set(range(len(short))) and not any(full for *_, full in got) and [x[4:6] for x in got if x[0] == len(short) + 2] == [(None, 0.0)]
    assert sum(lang == test.lang.iloc[i] for i, _, _, _, lang, _, _ in got if i < len(short)) / len(got) > 0.85
    mixed = [a + "\n\n" + b for a, b in zip(test.text, test.text[::-1], strict=True)]
    got = list(language.label_batch(mixed, f, encoding.Repairer(), True))
    right = []
    for i, _, b, e, lang, _, full in got:
        if full:
            right.append(lang == (test.lang.iloc[i] if e <= len(test.text.iloc[i]) + 2 else test.lang.iloc[-1 - i]))
    assert sum(right) / len(right) > 0.97
    whole = {}
    for i, _, b, e, *_ in got:
        assert b == whole.get(i, 0)
        whole[i] = e
    assert all(whole[i] == len(t.lower()) for i, t in enumerate(mixed))


def test_main_languages(spark, samples):
    f = language.LanguageFilter.fit(list(zip(samples.lang, samples.text, strict=True)))
    by = {k: max(v, key=len) for k, v in samples.groupby("lang").text}
    df = spark.createDataFrame([(k, t, "x") for k, t in by.items()] + [("none", "12 34", "x"), ("null", None, "x"), ("two", by["de"] * 3 + "\n\n" + by["it"], "x")], "id string, content_with_weight string, lang string")
    got = {r["id"]: (r["lang"], r["confidence"]) for r in language.main_languages(df, f).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{k: k for k in by}, "none": None, "two": "de"}
    assert got["two"][1] < got["de"][1] and got["none"][1] == 0
    assert language.main_languages(df.limit(0), f).count() == 0


def test_sentences_after_an_overlong_stretch():
    text = "x " * 65_000 + "end. One sentence here. Another one there. "
    got = language._segments(text)
    assert [(b, e) for b, e, _ in got] == [*zip([0, *[e for _, e, _ in got[:-1]]], [e for _, e, _ in got], strict=True)] and got[-1][1] == len(text)
    assert max(e - b for b, e, _ in got) <= 60_000 and sum(k == 1 for _, _, k in got) >= 2


def test_mixed_and_declared(spark, samples):
    f = language.LanguageFilter.fit(list(zip(samples.lang, samples.text, strict=True)))
    by = samples.groupby("lang").text.apply(lambda s: " ".join(list(s)[:3]))
    chunk = spark.createDataFrame([("1", "d", by["en"]), ("2", "e", by["en"]), ("3", "d", by["en"] + "\n\n" + by["ru"]), ("3", "d", by["en"] + "\n\n" + by["ru"]), ("4", "x", by["fr"]), ("5", "d", None), ("6", "d", "short."), (None, "d", by["de"]), ("7", "d", "the cat: 1; the dog: 2;\n" * 20)], "id string, doc_id string, content_with_weight string")
    files = spark.createDataFrame([("d", 1, None), ("e", 2, None)], "doc_id string, config_id long, uploaded_at timestamp")
    configs = spark.createDataFrame([(1, " EN-us ", None), (2, "auto", None)], "config_id long, language string, updated_at timestamp")
    got = {tuple(r) for r in language.mislabelled(chunk, files, configs, f).collect()}
    assert got == {("2", "en"), ("3", "en"), ("3", "ru"), ("4", "fr")}
    assert language.mislabelled(chunk.limit(0), files.limit(0), configs.limit(0), f).count() == 0
    assert language.LanguageFilter.fit([]).false.sum() == 0


def test_declared_names(spark):
    names = ["English", "ZH_cn", "pt-BR", "Español", "法文", "Deutsch", "auto", "", None, "N/A", "unknown", "Portuguese (Brazil)", "Simplified Chinese", "English, German"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(language.declared_language(F.col("n")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["en", "zh", "pt", "es", "fr", "de", None, None, None, None, None, "pt", "zh", None]


# -- subjects


def lines(text):
    return "\n".join(map(" ".join, subjects.sentences_of(text)))


def test_subjects_of_held_out_texts(samples):
    train, test = samples[samples.sample_id % 5 != 0], samples[samples.sample_id % 5 == 0]
    m, *_ = subjects.from_samples(train, sorted(set(samples.subject)))
    scan = subjects.Scanner(m).read([lines(t) for t in test.text])
    right = [m.subjects[scan.sums[scan.of == i].sum(axis=0).argmax()] == s for i, s in enumerate(test.subject)]
    assert sum(right) / len(test) > 0.85


def test_subject_rules(spark, samples):
    areas = spark.createDataFrame([(s,) for s in sorted(set(samples.subject))] * 2 + [(None,)], "subject string")
    texts = list(samples[(samples.subject == "law") & (samples.lang == "en")].text)
    law = max(texts, key=len)
    df = spark.createDataFrame([(1, law, "x"), (1, law, "x"), (2, None, "x"), (3, "", "x"), (4, "\n\n", "x"), (5, "Nothing of any kind.", "x"), (None, law, "x"), (6, law * 500, "x")], "doc_id long, text string, s string")
    known = spark.createDataFrame(samples[["subject", "text"]])
    sentences = subjects.sentence_texts(df, "doc_id", "text")
    m = subjects.train(sentences, known, areas)
    got = {(r["doc_id"], r["subject"]) for r in subjects.subject_shares(sentences, m).where("about * 10 >= sentences * 3").collect()}
    assert {(1, "law"), (6, "law")} <= got and {d for d, _ in got} <= {1, 6}
    none = subjects.sentence_texts(df.limit(0), "doc_id", "text")
    assert subjects.subject_shares(none, subjects.train(none, known, areas)).count() == 0
    for m in (subjects.train(sentences, known.limit(0), areas), subjects.train(sentences, known, areas.limit(0))):
        assert subjects.subject_shares(sentences, m).count() == 0


def test_terms_are_completed_and_dropped_over_all_documents(spark):
    """A word that only documents of a subject have becomes a term; one that documents contradict is dropped."""
    known = pd.DataFrame({"subject": ["a"] * 4 + ["b"] * 4, "text": ["The alpha ray bends here."] * 2 + ["An ordinary alpha quark."] * 2 + ["The beta wave falls there."] * 2 + ["Some beta wave passes by."] * 2})
    docs = [(i, "The alpha ray bends. A gluon was seen alone. The alpha ray bends.") for i in range(20)]
    docs += [(100 + i, "Some beta wave passes. The ordinary sort is there. Wave falls. Wave falls.") for i in range(20)]
    sentences = subjects.sentence_texts(spark.createDataFrame(docs, "i long, t string"), "i", "t")
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    assert "ordinary" in subjects.from_samples(known, ["a", "b"])[0].terms
    m = subjects.train(sentences, spark.createDataFrame(known), areas)
    assert m.terms["gluon"][0] == 0 and m.terms["beta wave"][0] == 1 and "ordinary" not in m.terms


def test_scores_are_those_of_a_plain_count():
    m = subjects.SubjectModel(["a", "b"], {"x y": (0, 1.0), "y": (1, 0.5), "学 习": (0, 2.0)}, [0.1, 0.1], {"学 习 机": "学 习"})
    scan = subjects.Scanner(m, ("z",)).read(["q x y y\nz z", "学 习 机 的\n学 习 机 学 习"])
    assert scan.of.tolist() == [0, 0, 1, 1] and scan.lines.tolist() == [2, 2]
    assert scan.sums.tolist() == [[1.0, 0.5], [0, 0], [0, 0], [2.0, 0]]
    assert scan.scores[0].tolist() == [0.5, 0.25] and scan.scores[3, 0] == 2.0 / 2.5**0.5
    assert {(s, t) for s, t in zip(scan.sentence.tolist(), scan.term.tolist(), strict=True)} == {(0, 0), (0, 1), (1, 3), (3, 2)}


def test_sentences():
    assert len(subjects.sentences_of("3) One sentence here. Another one!\nArticle 5. And a third; End of it.")) == 4
    assert len(subjects.sentences_of("a: 1; b: 2\nc: 3")) == 2
    assert subjects.sentences_of(None) == subjects.sentences_of("") == []


# -- scans


def pages():
    import random

    r, rows = random.Random(1), []
    body = "the parser precedes the message queue near the old harbour and the compiler supports the build server".split()
    for p in range(12):
        words = [w for _ in range(3) for w in r.sample(body, len(body))]
        if p == 3:
            words.insert(4, "cornpiler")
        lines = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
        lines[1] = lines[1].rsplit(" ", 1)[0] + " compi-"
        lines[2] = "ler " + lines[2]
        head = "Chapter Parser Harbour" if p != 5 else "Chaptcr Parser Harbour"
        rows.append((f"p{p}", "scan", [p + 1], "\n".join(([head] if p else []) + lines + [f"- {p + 10} -"])))
    return rows


def test_kinds_of_noise(spark):
    extra = [("n", "text", [1], "One line only."), ("m", "text", None, None), (None, "scan", [1], "x\ny\nz"), ("e", "scan2", [], "")]
    df = spark.createDataFrame(pages() + pages()[:2] + extra, "id string, doc_id string, page_num_int array<int>, content_with_weight string")
    kinds = {}
    for r in scans.noise_kinds(df).distinct().collect():
        kinds.setdefault(r["kind"], set()).add(r["id"])
    every = {f"p{i}" for i in range(12)}
    assert kinds["page_number"] == every and kinds["hyphen"] == every and kinds["header"] == every - {"p0"} and kinds["ocr_char"] == {"p3"}
    text = {r["id"]: r["text"] for r in scans.repaired_pages(df).collect()}
    assert "compiler" in text["p3"] and "cornpiler" not in text["p3"] and "compi-" not in text["p1"] and "Chapter" not in text["p1"] and "- 11 -" not in text["p1"]
    for i, _, _, raw in pages():  # the whole text as it was printed, in one paragraph
        lines = [x for x in raw.split("\n") if "Harbour" not in x and not x.startswith("- ")]
        assert text[i] == " ".join(lines).replace("compi- ler ", "compiler ").replace("cornpiler", "compiler")
    assert scans.noise_kinds(df.limit(0)).count() == 0


def misread(spark, often):
    """Links among words that occur ``often`` times each, "raccolto" beside other words than the rest."""
    import random

    r, lines = random.Random(2), []
    for word, n in often.items():
        near = ["tutto", "hanno", "molto"] if word == "raccolto" else ["old", "busy", "northern", "of", "near"]
        lines += [" ".join(["The", r.choice(near), r.choice(near), word, r.choice(near), r.choice(near), "."]) for _ in range(n)]
    r.shuffle(lines)
    df = spark.createDataFrame([(f"p{i}", "\n".join(lines[i::20])) for i in range(20)], "id string, text string")
    return {(x["word"], x["correct"]) for x in scans.misread_words(df).collect()}


def test_contexts_decide_however_often_a_word_is_misread(spark):
    for times in (1, 2, 6, 30):
        assert misread(spark, {"harbour": 10 * times, "harbonr": times, "compiler": 9}) == {("harbonr", "harbour")}
    assert misread(spark, {"harbour": 100, "harbonr": 10, "raccolta": 300, "raccolto": 30}) == {("harbonr", "harbour")}


def test_an_occurrence_is_judged_by_its_own_neighbours(spark):
    """What two words may be misread as goes to the one that the words around it suit."""
    import random

    near = {"flat": "rent room street lease roof stairs".split(), "fiat": "decree ruler power court order crown".split()}
    r, rows = random.Random(5), []
    for _ in range(60):
        rows += [" ".join(["The", *r.sample(own, 3), word, *r.sample(own, 3), "."]) for word, own in near.items()]
    rows += [" ".join(["The", *r.sample(own, 3), "f1at", *r.sample(own, 3), "."]) for own in near.values()]
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(rows)], "id string, text string")
    got = {x["id"]: (x["word"], x["correct"]) for x in scans.misread_words(df).collect()}
    assert got == {"p120": ("f1at", "flat"), "p121": ("f1at", "fiat")}


def test_right_words_beyond_the_broadcast_are_linked(spark, monkeypatch):
    often = {"harbour": 40, "harbonr": 1, "compiler": 9, "cornpiler": 1}
    want = misread(spark, often)
    assert want == {("harbonr", "harbour"), ("cornpiler", "compiler")}
    for part in (1, 20):  # no word, and the most frequent ones only, by broadcast
        monkeypatch.setattr(scans, "VOCABULARY", part)
        assert misread(spark, often) == want
