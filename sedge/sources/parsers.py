"""Readers of files and texts: what can be expressed in the JVM stays there; containers go through Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators import chunking as C

#: Encodings that are tried in order (fixed values; the first that decodes the bytes counts).
CODECS = ["utf-8", "gb2312", "gbk", "utf-16", "ascii", "big5", "big5hkscs", "cp1252", "gb18030", "shift_jis", "euc_jp", "euc_kr", "koi8_r", "cp1251", "latin-1"]
LARGEST = 100 * 1024 * 1024


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = tuple(T.FILE_KINDS), largest: int = LARGEST) -> DataFrame:
    """Files of known kinds below a folder: ``path``, ``name``, ``kind``, ``length``, ``content``, ``error``.

    The size is tested before the content is read: a file beyond ``largest`` has no content, but an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", name.alias("name"), T.file_kind(name).alias("kind"), "length"]
    small = files.where(F.col("length") <= largest).select(*cols, "content", F.lit(None).cast("string").alias("error"))
    return small.unionByName(files.where(F.col("length") > largest).select(*cols, F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error")))


def row_numbers(files: DataFrame) -> DataFrame:
    """``name`` and ``rows`` of each file: rows of all sheets, else lines of the text."""
    office = parse_office(files.where(F.col("name").rlike(r"(?i)\.xlsx$")).select("name", "content"), "content")
    sheets = office.select("name", (F.size("parts") + F.size(F.array_distinct(F.transform("parts", lambda p: p["style"])))).cast("long").alias("rows"))
    text = files.where(F.col("kind").isin("text", "markdown", "html", "json", "sheet") & ~F.col("name").rlike(r"(?i)\.xlsx?$"))
    return sheets.unionByName(text.select("name", F.size(F.split(decoded("content"), "\n")).cast("long").alias("rows")))


def cell_class(text: str) -> str:
    """The class of a table cell, as ``text.cell_type`` has it."""
    text = text.strip()
    for pattern, kind in T.CELL_TYPES:
        if re.search(pattern, text):
            return kind
    n = sum(len(w) > 1 for w in re.split(r"[\W_]+", text.lower()))
    return "Tx" if 3 < n < 12 else "Lx" if n >= 12 else "Ot"


def table_lines(rows: list[list[str]]) -> list[str]:
    """A table's rows as ``header: value;...``, one text each, or (up to three columns) all in one text.

    The first row is a header; where most cells are numbers, so are rows that aren't. A row's headers are those of the last
    block of header rows above it."""
    from collections import Counter

    if len(rows) < 2:
        return []
    kinds = [Counter(map(cell_class, r)) for r in rows]
    most = sum(kinds[1:], Counter()).most_common(1)
    numbers = bool(most) and most[0][0] == "Nu"
    heads = {0} | ({i for i, k in enumerate(kinds) if i and k and k.most_common(1)[0][0] != "Nu"} if numbers else set())
    lines, block = [], []
    for i, row in enumerate(rows):
        if i in heads:
            block = [*block, i] if block and block[-1] == i - 1 else [i]
            continue
        cells = []
        for j, cell in enumerate(row):
            names = dict.fromkeys(rows[h][j].strip() for h in block if j < len(rows[h]))
            head = ",".join(names)
            if cell:
                cells.append((head + ": " if head else "") + cell)
        lines.append(";".join(cells))
    return lines if len(rows[0]) > 3 else ["\n".join(lines)]


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits; what can't be decoded is dropped."""

    def one(b):
        if b is None:
            return None
        b = bytes(b)
        for codec in CODECS:
            try:
                return b.decode(codec)
            except (UnicodeError, LookupError):
                continue
        return b.decode("utf-8", "ignore")

    return content.map(one)


def text_chunks(df: DataFrame, text: str, budget: int = 128, delimiter: str = "\n!?;。；！？") -> DataFrame:
    """Plain text: split at delimiters, merged up to a budget of tokens."""
    return C.greedy_merge(df.withColumn("_s", C.delimiter_sections(F.col(text), delimiter)).drop(text), "_s", budget)


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """The text of a page, a line per block, without scripts, styles, navigation and the head."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|head|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/td|/th)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != ""), "\n")


MARKDOWN_TABLE = r"(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|$))+|(?:^.*\S.*\|.*(?:\n|$))(?:^[ \t]*[-:]+[-| :]*\|[-| :]*(?:\n|$))(?:^.*\|.*(?:\n|$))*"


def markdown_tables(c: Column) -> Column:
    """Tables of a Markdown text: with borders, without, and HTML ones."""
    return F.concat(F.regexp_extract_all(c, F.lit(MARKDOWN_TABLE), F.lit(0)), F.regexp_extract_all(c, F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0)))


def markdown_remainder(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, MARKDOWN_TABLE, ""), r"(?is)<table[^>]*>.*?</table>", "")


def _packed(pieces: Column, budget: int, joiner: str, first: int = 0) -> Column:
    """Pieces joined while a portion has ``budget`` tokens at most, of which ``first`` are taken from the start; portions as arrays."""
    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("out"), F.array().cast("array<string>").alias("own"), F.lit(first).cast("long").alias("n"))

    def step(a, x):
        n = T.token_count(x)
        full = (a["n"] + n > budget) & (F.size(a["own"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(a["own"]))).otherwise(a["out"]).alias("out"), F.when(full, F.array(x)).otherwise(F.concat(a["own"], F.array(x))).alias("own"), F.when(full, n + first).otherwise(a["n"] + n).alias("n")
        )

    parts = F.aggregate(pieces, start, step, lambda a: F.when(F.size(a["own"]) > 0, F.concat(a["out"], F.array(a["own"]))).otherwise(a["out"]))
    return F.transform(parts, lambda x: F.array_join(x, joiner))


def markdown_sections(c: Column, budget: int = 128) -> Column:
    """Paragraphs; those beyond seven times the budget by sentences, sentences beyond four times by clauses, packed up to the budget.
    A heading goes together with the paragraph after it if both are within the budget."""
    size = T.token_count
    sentence = lambda s: F.when(size(s) > 4 * budget, F.split(s, r"(?<=[,;:])\s+")).otherwise(F.array(s))
    cut = lambda p: _packed(F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), sentence)), budget, " ")
    paragraphs = F.filter(F.split(c, r"\n\s*\n"), lambda x: F.trim(x) != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(size(p) > 7 * budget, F.transform(cut(p), lambda x: F.struct(x.alias("t"), F.lit(True).alias("cut")))).otherwise(F.array(F.struct(p.alias("t"), F.lit(False).alias("cut"))))))

    def glue(a, x):
        last = F.try_element_at(a, F.lit(-1))
        heading = lambda t: F.ltrim(t).startswith("#")
        both = F.concat(last, F.lit("\n"), x["t"])
        fits = (F.size(a) > 0) & heading(last) & ~heading(x["t"]) & ~x["cut"] & (size(both) <= budget)
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(x["t"])))

    return F.aggregate(parts, F.array().cast("array<string>"), glue)


def split_html_table(c: Column, budget: int = 128) -> Column:
    """A table of HTML in parts of up to seven times the budget, each with the table's header; smaller ones as they are."""
    most = 7 * budget
    head = F.regexp_extract(c, r"(?is)(<thead>.*?</thead>|<tr>(?:(?!</tr>).)*</th>.*?</tr>)", 1)
    rows = F.regexp_extract_all(F.when(head == "", c).otherwise(F.replace(c, head, F.lit(""))), F.lit(r"(?is)<tr>.*?</tr>"), F.lit(0))
    parts = F.transform(_packed(rows, most, ""), lambda r: F.concat(F.lit("<table>"), head, r, F.lit("</table>")))
    return F.when(T.token_count(c) > most, parts).otherwise(F.array(c))


def parse_mail(df: DataFrame, content: str) -> DataFrame:
    """E-mails: ``headers`` as lines, ``body`` (text and HTML parts), ``attachments`` (name and bytes), ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        from email import policy

        for pdf in batches:
            rows = []
            for raw in pdf[content]:
                try:
                    m = email.message_from_bytes(bytes(raw), policy=policy.default)
                    head = "\n".join(f"{k}: {v}" for k, v in m.items())
                    body, files = [], []
                    for part in m.walk():
                        if part.get_content_disposition() == "attachment":
                            files.append({"name": part.get_filename() or "", "content": part.get_payload(decode=True) or b""})
                        elif part.get_content_type() == "text/plain":
                            body.append(part.get_content())
                        elif part.get_content_type() == "text/html":
                            body.append(re.sub(r"<[^>]+>", " ", part.get_content()))
                    rows.append((head, "\n".join(body), files, None))
                except Exception as e:  # one broken mail mustn't end the job
                    rows.append((None, None, [], str(e)[:200]))
            yield pdf.drop(columns=[content]).assign(**{k: [r[i] for r in rows] for i, k in enumerate(("headers", "body", "attachments", "error"))})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content)
    return df.mapInPandas(run, (kept + ", " if kept else "") + "headers string, body string, attachments array<struct<name:string,content:binary>>, error string")


def parse_office(df: DataFrame, content: str, from_page: int = 0, to_page: int = 100_000) -> DataFrame:
    """Office files (docx, pptx, xlsx): ``parts`` (number, style or sheet, text), ``error``. A zip with XML needs no library.

    Tables of a document come after its paragraphs, with their headers; pages and slides outside the range are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.etree import ElementTree as X

        local = lambda e: e.tag.rsplit("}", 1)[-1]
        words = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")

        def grid(table, row: str, cell: str) -> list[list[str]]:
            return [["\n".join(filter(None, (words(p) for p in c.iter() if local(p) == "p"))) for c in r if local(c) == cell] for r in table.iter() if local(r) == row]

        def place(shape) -> tuple[int, int]:
            off = next((o for o in shape.iter() if local(o) == "off"), None)
            return (int(off.get("y", 0)) // 10, int(off.get("x", 0))) if off is not None else (0, 0)

        def shapes(tree) -> Iterator[str]:
            """The texts of a slide's shapes, from the top and the left; groups have an order of their own."""
            for s in sorted((s for s in tree if local(s) in ("sp", "graphicFrame", "grpSp")), key=place):
                if local(s) == "grpSp":
                    text = "\n".join(shapes(s))
                elif any(local(t) == "tbl" for t in s.iter()):
                    rows = grid(s, "tr", "tc")
                    text = "\n".join("; ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False)) for r in rows[1:])
                else:
                    text = "\n".join(filter(None, (words(p) for p in s.iter() if local(p) == "p")))
                if text:
                    yield text

        def parts(raw: bytes) -> list[dict]:
            z = zipfile.ZipFile(io.BytesIO(raw))
            names = z.namelist()
            out: list[tuple[str, str]] = []
            if "word/document.xml" in names:
                page, tables = 0, []
                root = X.fromstring(z.read("word/document.xml"))
                body = next((b for b in root.iter() if local(b) == "body"), root)
                for p in body:
                    if local(p) == "p":
                        style = next((v for s in p.iter() if local(s) == "pStyle" for k, v in s.attrib.items()), "")
                        if from_page <= page < to_page:
                            out.append((style, words(p)))
                        page += sum(local(e) == "lastRenderedPageBreak" or local(e) == "br" and any(v == "page" for v in e.attrib.values()) for e in p.iter())
                    elif local(p) == "tbl":
                        tables.append(grid(p, "tr", "tc"))
                out += [("table", t) for rows in tables for t in table_lines(rows)]
            elif any(n.startswith("ppt/slides/slide") for n in names):
                slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
                for n in slides[from_page:to_page]:
                    root = X.fromstring(z.read(n))
                    tree = next((t for t in root.iter() if local(t) == "spTree"), None)
                    out.append(("slide", "\n".join(shapes(tree) if tree is not None else filter(None, (words(p) for p in root.iter() if local(p) == "p")))))
            elif "xl/workbook.xml" in names:
                shared = [words(s) for s in X.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"] if "xl/sharedStrings.xml" in names else []
                for n in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                    header: list[str] = []
                    for row in (r for r in X.fromstring(z.read(n)).iter() if local(r) == "row"):
                        cells = []
                        for c in (c for c in row if local(c) == "c"):
                            v = next((v.text or "" for v in c if local(v) == "v"), words(c))
                            cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                        if not header:
                            header = cells
                        else:
                            out.append((n.rsplit("/", 1)[-1][:-4], "; ".join(f"{h}：{v}" for h, v in zip(header, cells, strict=False) if v)))
            else:
                raise ValueError("no office file")
            return [{"no": i, "style": s, "text": t} for i, (s, t) in enumerate(x for x in out if x[1].strip())]

        for pdf in batches:
            rows = []
            for raw in pdf[content]:
                try:
                    rows.append((parts(bytes(raw)), None))
                except Exception as e:
                    rows.append(([], str(e)[:200]))
            yield pdf.drop(columns=[content]).assign(parts=[r[0] for r in rows], error=[r[1] for r in rows])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content)
    return df.mapInPandas(run, (kept + ", " if kept else "") + "parts array<struct<no:int,style:string,text:string>>, error string")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files with a JSON array each."""
    return spark.read.option("multiLine", "true").json(path)


def sheet_rows(df: DataFrame, sheet: str = "") -> Column:
    """A row of a sheet as ``header：value; ...``, empty cells left out, with the sheet's name unless it is a default one."""
    text = F.concat_ws("; ", *[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}："), F.col(c).cast("string"))) for c in df.columns])
    return F.concat(text, F.lit(f" ——{sheet}")) if sheet and "sheet" not in sheet.lower() else text


def export(df: DataFrame, path: str, form: str = "json", metadata: bool = True) -> None:
    """Chunks to JSON, CSV or text; without metadata the id and content only."""
    df = df if metadata else df.select(*[c for c in ("id", "content_with_weight") if c in df.columns])
    if form == "text":
        df.select(F.col("content_with_weight").alias("value")).write.mode("overwrite").text(path)
    elif form == "csv":
        df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").json(path)


def vector_columns(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """A vector as ``dimensions`` columns, for export as a matrix."""
    return df.select(*[F.try_element_at(F.col(vector), F.lit(i + 1)).alias(f"v{i}") for i in range(dimensions)])
