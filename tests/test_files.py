"""PDF files, tables of office files, attachments, and the strategies that build on them."""

import io
import zipfile
import zlib
from email.message import EmailMessage

from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import chunking as C
from sedge.operators import tables as Tb
from sedge.plans.config import ChunkingConfig, chunk_files, chunk_texts, file_texts
from sedge.sources import parsers as P
from sedge.sources import pdf as D


def pdf_file(pages, compress=True):
    """A small PDF: a page per list of lines, an outline entry per page, and a font with a map to Unicode for <> strings."""
    streams = []
    for lines in pages:
        body = "BT /F1 12 Tf 72 700 Td " + " ".join(f"/F1 12 Tf ({x}) Tj 0 -14 Td" if not x.startswith("<") else f"/F2 12 Tf {x} Tj 0 -14 Td" for x in lines) + " /F1 12 Tf [(spa) -20 (ced) -300 (apart)] TJ ET"
        streams.append(zlib.compress(body.encode("cp1252")) if compress else body.encode("cp1252"))
    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)) + b"] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>"}
    objects |= {3: b"<< /Type /Font /BaseFont /Helvetica >>", 4: b"<< /Type /Font /ToUnicode 6 0 R >>", 6: b"<< /Length %d >> stream\n" % len(cmap) + cmap + b"\nendstream"}
    objects[5] = b"<< /Type /Outlines /First 100 0 R >>"
    for i, s in enumerate(streams):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(s), b"/Filter /FlateDecode" if compress else b"") + s + b"\nendstream"
        objects[100 + i] = b"<< /Title (Part %d) %s %s >>" % (i, b"/Next %d 0 R" % (101 + i) if i + 1 < n else b"", b"/First 200 0 R" if i == 0 else b"")
    objects[200] = b"<< /Title (Inner) >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + b"%%EOF"


def test_pdf_text(spark):
    for compress in (True, False):
        df = spark.createDataFrame([(1, pdf_file([["Hello \\(you\\)", "Gr\\374\\337e"], ["<000100020003>", "end"]], compress)), (2, b"no pdf"), (3, b"%PDF-1.4 /Encrypt 5 0 R")], "k int, content binary")
        got = {r["k"]: r for r in D.parse_pdf(df, "content").collect()}
        assert [p["text"] for p in got[1]["pages"]] == ["Hello (you)\nGrüße\nspaced apart", "中AB\nend\nspaced apart"]
        assert [(o["title"], o["level"]) for o in got[1]["outline"]] == [("Part 0", 0), ("Inner", 1), ("Part 1", 0)]
        assert got[2]["error"] == "no PDF file" and got[3]["error"] == "encrypted"
    assert [p["no"] for p in D.parse_pdf(df, "content", 1, 2).where("k = 1").first()["pages"]] == [1]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def row(cells, tag="w"):
    return f"<{tag}:tr>" + "".join(f"<{tag}:tc><{tag}:p><{tag}:r><{tag}:t>{c}</{tag}:t></{tag}:r></{tag}:p></{tag}:tc>" for c in cells) + f"</{tag}:tr>"


def docx():
    table = "<w:tbl>" + row(["year", "sum"]) + row(["2020", "1"]) + row(["2021", "2"]) + "</w:tbl>"
    break_ = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    return office({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>{table}{break_}<w:p><w:r><w:t>second page</w:t></w:r></w:p></w:body></w:document>'})


def pptx():
    def shape(y, x, text):
        return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="500"/></p:xfrm><a:tbl>' + row(["h1", "h2"], "a") + row(["v1", "v2"], "a") + "</a:tbl></p:graphicFrame>"
    slide = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{table}{shape(900, 0, "low")}{shape(105, 50, "right")}{shape(101, 10, "left")}</p:spTree></p:cSld></p:sld>'
    return office({"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide.replace("low", "other")})


def test_office_tables_and_order(spark):
    df = spark.createDataFrame([("d", docx()), ("p", pptx())], "k string, content binary")
    got = {r["k"]: [p["text"] for p in r["parts"]] for r in P.parse_office(df, "content").collect()}
    assert got["d"] == ["Title", "second page", "year: 2020;sum: 1\nyear: 2021;sum: 2"]
    assert got["p"][0] == "left\nright\nh1: v1; h2: v2\nlow" and len(got["p"]) == 2
    first = {r["k"]: [p["text"] for p in r["parts"]] for r in P.parse_office(df, "content", 0, 1).collect()}
    assert first["d"][0] == "Title" and "second page" not in first["d"] and len(first["p"]) == 1


def test_headers_of_tables():
    rows = [["a", "b", "c", "d"], ["1", "2", "3", "4"], ["first head", "x one", "y two", "z three"], ["5", "6", "", "8"]]
    assert P.table_lines(rows) == ["a: 1;b: 2;c: 3;d: 4", "first head: 5;x one: 6;z three: 8"]
    assert P.table_lines([["a"]]) == [] and P.table_lines([]) == []


def test_files_with_attachments_and_errors(spark, tmp_path):
    m = EmailMessage()
    m["Subject"] = "hello"
    m.set_content("the body")
    m.add_attachment(b"inner text\nmore", maintype="text", subtype="plain", filename="note.txt")
    m.add_attachment(docx(), maintype="application", subtype="octet-stream", filename="paper.docx")
    m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="old.doc")
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "same.txt").write_text("words of one")
    (tmp_path / "two" / "same.txt").write_text("words of two")
    (tmp_path / "m.eml").write_bytes(m.as_bytes())
    (tmp_path / "f.pdf").write_bytes(pdf_file([["page text"]]))
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "big.txt").write_text("x" * 5000)
    files = P.read_files(spark, str(tmp_path), largest=4000)
    got = file_texts(files).collect()
    by = {(r["docnm_kwd"], r["error"]): r["text"] for r in got}
    assert by["old.xls", "no parser for xls"] is None and by["old.doc", "no parser for doc"] is None and by["big.txt", "too large"] is None
    assert by["note.txt", None] == "inner text\nmore" and by["paper.docx", None].startswith("Title") and by["f.pdf", None].startswith("page text") and "the body" in by["m.eml", None]
    assert len({r["doc_id"] for r in got if r["docnm_kwd"] == "same.txt"}) == 2
    chunks = chunk_files(files, ChunkingConfig()).collect()
    assert sorted(r["content_with_weight"] for r in chunks if r["docnm_kwd"] == "same.txt") == ["words of one", "words of two"]
    assert all(r["content_ltks"] and r["position_int"] == [[r["chunk_index"] + 1] + [r["chunk_index"]] * 4] for r in chunks)
    assert {r["name"]: r["rows"] for r in P.row_numbers(files.where("content is not null")).collect()} == {"same.txt": 1}


def test_tables_as_chunks(spark):
    text = "name/alias\tid\tsize(M, L)\twhen\tok\nann\t1\t3\t2024-01-02\tyes\nbob\t2\tx\t2024/1/3\tno\nshort\t1\n\ncarl\t3\t4.0\t\tmaybe"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "only header")], "doc_id string, text string")
    got = Tb.table_chunks(df, "doc_id", "text").orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == ["name/alias:ann; size(M, L):3; when:2024-01-02 00:00:00; ok:yes", "name/alias:bob; when:2024-01-03 00:00:00; ok:no", "name/alias:carl; size(M, L):4"]
    assert got[0]["fields"] == {"name_tks": "ann", "size_long": "3", "when_dt": "2024-01-02 00:00:00", "ok_kwd": "yes"}


def test_manual_and_paper(spark):
    manual = "\n".join(f"Article {i}\n" + "word " * 20 for i in range(1, 4))
    df = spark.createDataFrame([("m", manual)], "doc_id string, text string")
    got = [r["content"] for r in chunk_texts(df, ChunkingConfig(parser_type="manual")).orderBy("chunk_index").collect()]
    assert len(got) == 2 and got[0].count("Article") == 2 and got[1].startswith("Article 3")
    paper = "Some heading\nAbstract\nthe short of it\nArticle 1\nfirst\nArticle 2\nsecond"
    got = [r["content"] for r in chunk_texts(df.select("doc_id", F.lit(paper).alias("text")), ChunkingConfig(parser_type="paper")).orderBy("chunk_index").collect()]
    assert got == ["Abstract\nthe short of it", "Some heading", "Article 1\nfirst", "Article 2\nsecond"]


def test_images_go_with_their_chunks(spark):
    df = spark.sql("select 1 d, array(struct('a b c ' as text, 'i1' as image), struct('d ' as text, cast(null as string) as image), struct('e f' as text, 'i2' as image)) s")
    got = C.greedy_merge_images(df, "s", 2).orderBy("chunk_index").collect()
    assert [(r["content"], r["images"]) for r in got] == [("a b c ", ["i1"]), ("d e f", ["i2"])]


def test_positions_of_chunks(spark):
    df = spark.createDataFrame([(0, "text@@2\t1.5\t9.0\t3.0\t4.0##"), (1, "plain"), (2, " "), (3, None)], "chunk_index int, content_with_weight string")
    got = {r["chunk_index"]: r for r in C.chunk_fields(df).collect()}
    assert set(got) == {0, 1} and got[0]["position_int"] == [[3, 1, 9, 3, 4]] and got[0]["page_num_int"] == [3] and got[0]["top_int"] == [3] and got[0]["content_with_weight"] == "text" and got[1]["position_int"] == [[2, 1, 1, 1, 1]]


def test_question_numbers(spark):
    df = spark.createDataFrame([(["x", "QUESTION TWO a"],), (["1. a", "第3问 b"],), (["none"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(C.question_family(F.col("l"))).collect()] == [8, 0, -1, -1, None]
    words = ["7", "SEVEN", "IV", "十二", "二十", "三百二十一", "九", "零", "abc", None]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.number_of(F.col("w"))).collect()] == [7, 7, 4, 12, 20, 321, 9, 0, -1, None]


def test_boxes_are_joined_downward(spark):
    rows = [
        (1, 1, "t", 0, 100, 0, 10, "This goes on,"), (1, 1, "t", 0, 100, 12, 22, "and ends here。"), (1, 1, "t", 0, 100, 24, 34, "A new one without end"), (1, 1, "t", 0, 100, 80, 90, "far below"),
        (1, 1, "t", 0, 100, 95, 105, " "), (1, 1, "t", 40, 60, 110, 120, "- 3 -"), (1, 2, "t", 0, 100, 0, 10, "。next page"), (1, 2, "other", 0, 100, 12, 22, "other layout"), (1, 2, "other", 200, 300, 12, 22, "beside"), (2, 1, "t", 0, 1, 0, 1, None),
    ]
    df = spark.createDataFrame(rows, "doc int, page int, layout string, x0 int, x1 int, top int, bottom int, text string")
    from sedge.operators import layout as L

    got = [r["text"] for r in L.merge_downward(df, "doc").orderBy("doc", "block").collect()]
    assert got == ["This goes on,and ends here。", "A new one without end", "far below。next page", "other layout", "beside"]
    assert L.merge_downward(df.limit(0), "doc").count() == 0


def test_functions_in_sql(spark):
    from sedge.functions import registry

    assert "rag_tokenize" in registry.register(spark)
    r = spark.sql("select half_width('ＡＢ！') h, rag_tokenize('Ab 中文') t, count_tokens(' a  b ') n, vector_cosine(array(1D, 0D), array(1D, 1D)) c, vector_cosine(array(0D), array(1D)) z").first()
    assert (r["h"], list(r["t"]), r["n"], round(r["c"], 4), r["z"]) == ("AB!", ["ab", "中", "文"], 2, 0.7071, None)
    assert [tuple(x) for x in spark.sql("select * from chunk_text('a b\n\nc', 1)").collect()] == [(0, "a b"), (1, "c")]
    assert spark.sql("""select * from split_json('{"a": 1}', 100)""").first()["content"] == '{"a": 1}' and spark.sql("select * from split_json('no', 100)").count() == 0


def test_shared_terms_are_those_of_all_pairs(spark):
    import random

    from sedge.operators import retrieval as R

    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, sorted(set(r.choices(words, weights=[30 - k for k in range(30)], k=r.randrange(1, 12))))) for i in range(80)]
    df = spark.createDataFrame([*rows, (200, [])], "i long, t array<string>")
    got = {(x["q"], x["i"]): round(x["tok"], 6) for x in R.overlapping_terms(df, df.where("i % 10 = 0"), "q", "i", "t", 0.3).collect()}
    want = {(q, i): round(len(set(a) & set(b)) / len(a), 6) for q, a in rows if q % 10 == 0 for i, b in rows if len(set(a) & set(b)) >= 0.3 * len(a)}
    assert got == want


def test_markdown_sections_and_tables(spark):
    md = "# Head\n\nshort text\n\n# Other\n\n" + "word " * 12 + "\n\n" + " ".join("One two three four." for _ in range(20)) + "\n\ntail"
    df = spark.createDataFrame([(md,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(P.markdown_sections(F.col("t"), 10)).collect()]
    assert got[0][:3] == ["# Head\nshort text", "# Other", "word " * 12] or got[0][:2] == ["# Head\nshort text", "# Other"]
    assert got[0][-1] == "tail" and all(len(x.split()) <= 10 for x in got[0][3:]) and sum(x.count("One") for x in got[0]) == 20 and got[1:] == [[], None]
    table = "<table><thead><tr><th>a b</th></tr></thead>" + "".join(f"<tr><td>{i} x y z</td></tr>" for i in range(20)) + "</table>"
    parts, small = (r[0] for r in spark.createDataFrame([(table,), ("<table><tr><td>1</td></tr></table>",)], "t string").select(P.split_html_table(F.col("t"), 3)).collect())
    assert len(parts) > 1 and all("<thead>" in p for p in parts) and "".join(parts).count("<td>") == 20 and len(small) == 1


def test_boxes_of_one_bullet_are_joined(spark):
    from sedge.operators import layout as L

    rows = [(1, 0, 0, 9, 0, 1, "• a"), (1, 1, 1, 10, 2, 3, " • b"), (1, 2, 0, 9, 4, 5, ""), (1, 3, 0, 9, 6, 7, "• c"), (1, 4, 0, 9, 8, 9, "text"), (1, 5, 0, 9, 10, 11, "text"), (1, 6, 0, 9, 0, 1, None)]
    df = spark.createDataFrame(rows, "doc int, i int, x0 int, x1 int, top int, bottom int, text string")
    got = L.merge_same_bullet(df, "doc").orderBy("block").collect()
    assert [r["text"] for r in got] == ["• a\n • b\n• c", "text", "text"] and (got[0]["x0"], got[0]["x1"], got[0]["bottom"]) == (0, 10, 7)
