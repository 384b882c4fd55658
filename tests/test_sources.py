import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sedge.operators import embedding as E
from sedge.operators import joins as J
from sedge.operators import layout as L
from sedge.operators import records as Rec
from sedge.sources import parsers as P


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("中文文本".encode("gbk"))
    (tmp_path / "y.md").write_bytes("é".encode())
    (tmp_path / "z.bin").write_bytes(b"no")
    files = P.read_files(spark, str(tmp_path))
    got = {r["name"]: (r["kind"], r["t"]) for r in files.withColumn("t", P.decoded("content")).collect()}
    assert got == {"x.txt": ("text", "中文文本"), "y.md": ("markdown", "é")}


def test_html(spark):
    page = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><p>a &amp; b</p><script>s</script><div>c</div></body></html>"
    df = spark.createDataFrame([(page,)], "h string").select(P.html_title(F.col("h")).alias("t"), P.html_text(F.col("h")).alias("b"))
    assert tuple(df.first()) == ("T", "a & b\nc")


def test_markdown(spark):
    text = "intro\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nafter <table><tr></tr></table>"
    df = spark.createDataFrame([(text,)], "m string")
    r = df.select(P.markdown_tables(F.col("m")).alias("t"), P.markdown_remainder(F.col("m")).alias("r")).first()
    assert len(r["t"]) == 2 and "|" not in r["r"] and "intro" in r["r"] and "after" in r["r"]


def test_mail(spark):
    raw = b"Subject: hello\nFrom: a@b.example\nContent-Type: text/plain\n\nbody text\n"
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2], "c": [raw, None]}), "k int, c binary")
    got = {r["k"]: r for r in P.parse_mail(df, "c").collect()}
    assert "Subject: hello" in got[1]["headers"] and got[1]["body"].strip() == "body text" and got[2]["error"]


def test_office(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:document>')
    df = spark.createDataFrame([(bytearray(out.getvalue()),), (bytearray(b"no zip"),)], "c binary")
    got = P.parse_office(df, "c").collect()
    assert [(p["style"], p["text"]) for p in got[0]["parts"]] == [("Heading1", "Title"), ("", "Text")] and got[1]["error"]


def test_sheet_rows_and_export(spark, tmp_path):
    df = spark.createDataFrame([("1", ""), ("2", "x")], "a string, b string")
    assert [r[0] for r in df.select(P.sheet_rows(df, "Data")).collect()] == ["a：1 ——Data", "a：2; b：x ——Data"]
    chunks = spark.createDataFrame([("i", "t", ["k"])], "id string, content_with_weight string, important_kwd array<string>")
    for form in ("json", "csv", "text"):
        P.export(chunks, f"{tmp_path}/{form}", form)
    assert spark.read.json(f"{tmp_path}/json").first()["important_kwd"] == ["k"]


def test_embedding(spark):
    df = spark.createDataFrame([("n", "text", None), ("n", "", ["q"]), (None, None, None)], "docnm_kwd string, content_with_weight string, question_kwd array<string>")
    got = [r["q_16_vec"] for r in E.embed_chunks(df, E.HashingEmbedder(16)).collect()]
    assert all(len(v) == 16 for v in got) and got[0] != got[1]


def test_joins(spark):
    a = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 4, 30), (2, "c", 0, 1)], "k int, n string, b int, e int")
    got = J.overlap_join(a, a, "k", "b", "e", 3).where("n < n_r").select("n", "n_r").collect()
    assert [tuple(r) for r in got] == [("a", "b")]
    x = spark.createDataFrame([(1, "x", 10), (1, "y", 13), (3, "z", 1)], "k int, n string, t int")
    y = spark.createDataFrame([(1, 7, 11), (1, 8, 15)], "k int, id int, t int")
    assert {r["n"]: r["nearest"] for r in J.nearest_join(x, y, "k", "t", "id", "t").collect()} == {"x": 7, "y": 7, "z": None}
    y2 = y.withColumnRenamed("t", "u")
    assert {r["n"]: r["id"] for r in J.as_of_join(x, y2, "k", "t", "id", "u").collect()} == {"x": None, "y": 7, "z": None}


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0, 0.9), (1, 2, 1.0, 10.0, 0.0, 10.0, 0.5), (1, 3, 50.0, 60.0, 0.0, 10.0, 0.1)], "page int, box int, x0 double, x1 double, top double, bottom double, score double")
    assert sorted(r["box"] for r in L.suppress(b, ["page"], "box").collect()) == [1, 3]
    r = spark.createDataFrame([(1, 7, 0.0, 5.0, 0.0, 10.0), (1, 8, 5.0, 99.0, 0.0, 10.0)], "page int, region_id int, x0 double, x1 double, top double, bottom double")
    assert {x["box"]: x["region_id"] for x in L.best_region(b, r, ["page"], "box").collect()} == {1: 7, 2: 8, 3: 8}


def test_suppression_is_greedy_on_every_page(spark):
    import random

    r = random.Random(4)
    rows = []
    for p in range(300):
        for k in range(r.randrange(1, 9)):
            x, y = r.uniform(0, 20), r.uniform(0, 20)
            rows.append((p, k, x, x + r.uniform(5, 15), y, y + r.uniform(5, 15), r.random()))
    df = spark.createDataFrame(rows, "page int, box int, x0 double, x1 double, top double, bottom double, score double")
    want = set()
    for p in range(300):
        own = sorted((b for b in rows if b[0] == p), key=lambda b: -b[6])
        left = []
        for b in own:
            for c in left:
                w, h = min(b[3], c[3]) - max(b[2], c[2]), min(b[5], c[5]) - max(b[4], c[4])
                x = max(w, 0) * max(h, 0)
                if x / ((b[3] - b[2]) * (b[5] - b[4]) + (c[3] - c[2]) * (c[5] - c[4]) - x) > 0.3:
                    break
            else:
                left.append(b)
        want |= {(b[0], b[1]) for b in left}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(x["page"], x["box"]) for x in L.suppress(df, ["page"], "box", 0.3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want


def test_table_from_boxes(spark):
    cells = [(1, float(c * 20), float(c * 20 + 10), float(r * 20), float(r * 20 + 10), t) for r, row in enumerate([["name", "sum"], ["1", "2"], ["3", "4"]]) for c, t in enumerate(row)]
    df = L.table_cells(spark.createDataFrame(cells, "t int, x0 double, x1 double, top double, bottom double, text string"), ["t"])
    html = L.table_html(df, L.header_rows(df, ["t"]), ["t"]).first()["html"]
    assert html == "<table><tr><th>name</th><th>sum</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"


def test_position_tags(spark):
    df = spark.createDataFrame([("text@@3\t1.0\t2.0\t3.0\t4.5##",)], "t string")
    r = df.select(L.position_tags(F.col("t")).alias("p"), L.strip_position_tags(F.col("t")).alias("s")).first()
    assert tuple(r["p"][0]) == (3, 1.0, 2.0, 3.0, 4.5) and r["s"] == "text"


def test_records(spark):
    df = spark.sql("select array('本科', '博士', 'x') d, array(struct('2010.1' as start, '2012.1' as end), struct('2015-03' as start, null as end)) j, 'A' a, '' b, '{\"edu\":{\"school\":\"S\"}}' js")
    r = df.select(Rec.highest_degree(F.col("d")).alias("d"), Rec.work_summary(F.col("j")).alias("w"), Rec.latest_job(F.col("j"))["start"].alias("l")).first()
    assert r["d"] == "博士" and round(r["w"]["years"], 1) == 2.0 and r["w"]["jobs"] == 2 and r["l"] == "2015-03"
    assert Rec.flatten_groups(df.select("js"), "js", "struct<edu:struct<school:string>>").first()["edu_school"] == "S"
    assert df.select(Rec.completeness(df.select("a", "b"), {"b": 0.8}).alias("c")).first()["c"] == 0.4
    assert df.select(Rec.company_norm(F.lit("上海某某有限公司"), ["上海"]).alias("c")).first()["c"] == "某某"
