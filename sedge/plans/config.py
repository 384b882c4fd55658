"""Settings of chunking, and the pipeline from files to chunks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import index as I
from ..operators import tables as Tb
from ..sources import parsers as P
from ..sources.pdf import parse_pdf

PARSERS = ("general", "qa", "paper", "manual", "laws", "book", "presentation", "table", "one", "email")


@dataclass(frozen=True)
class ChunkingConfig:
    parser_type: str = "general"
    chunk_token_num: int = 128
    delimiter: str = "\n!?;。；！？"
    language: str = "English"
    layout_recognize: str = ""
    zoomin: int = 3
    from_page: int = 0
    to_page: int = 100_000

    def problems(self) -> list[str]:
        """What is wrong with the settings; nothing if they can be used."""
        out = []
        if self.parser_type not in PARSERS:
            out.append(f"unknown parser {self.parser_type}")
        if not 1 <= self.chunk_token_num <= 4096:
            out.append("chunk_token_num must be from 1 to 4096")
        if self.from_page < 0 or self.to_page < self.from_page:
            out.append("pages out of order")
        if not 1 <= self.zoomin <= 10:
            out.append("zoomin must be from 1 to 10")
        return out

    @classmethod
    def from_dict(cls, values: dict) -> ChunkingConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> ChunkingConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))


def chunk_texts(texts: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Chunks of texts (``doc_id``, ``text``) by the strategy of the config: ``doc_id, chunk_index, content``."""
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    t, some = F.col("text"), texts.where("text is not null").select("doc_id", "text")
    kind = config.parser_type
    if kind == "one":
        return C.one_chunk(some, "text").select("doc_id", "chunk_index", "content")
    if kind == "qa":
        pairs = some.select("doc_id", T.is_chinese(t).alias("zh"), F.posexplode(C.question_answers(t)).alias("chunk_index", "p"))
        return pairs.select("doc_id", "chunk_index", C.qa_text(F.col("p.q"), F.col("p.a"), ~F.col("zh")).alias("content"))
    if kind in ("paper", "manual"):
        lines = C.lines_with_levels(some, "doc_id", "text")
        islands = C.section_islands(lines, C.most_frequent_level(lines, "doc_id"), "doc_id")
        if kind == "manual":
            parts = C.packed_chunks(islands, "doc_id")
        else:
            parts = C.with_abstract(C.section_chunks(islands, "doc_id"), "doc_id").select("doc_id", F.col("no").cast("int").alias("chunk_index"), "content")
        rest = some.join(parts.select("doc_id").distinct(), "doc_id", "left_anti")
        merged = C.greedy_merge(rest.withColumn("_s", C.delimiter_sections(t, config.delimiter)).drop("text"), "_s", config.chunk_token_num)
        return parts.unionByName(merged.select("doc_id", "chunk_index", "content"))
    if kind in ("laws", "book"):
        body = some.withColumn("text", C.drop_contents(t)) if kind == "laws" else some
        lines = C.lines_with_levels(body, "doc_id", "text", strict=False)
        parts = C.hierarchical_merge(lines, "doc_id")
        rest = body.join(parts.select("doc_id").distinct(), "doc_id", "left_anti")
        merged = C.greedy_merge(rest.withColumn("_s", C.delimiter_sections(t, config.delimiter)).drop("text"), "_s", 256 if kind == "book" else config.chunk_token_num)
        return parts.unionByName(merged.select("doc_id", "chunk_index", "content"))
    if kind == "presentation":
        pages = some.select("doc_id", F.posexplode(F.split("text", "\f")).alias("chunk_index", "content"))
        return pages.where((F.col("chunk_index") >= config.from_page) & (F.col("chunk_index") < config.to_page))
    if kind == "table":
        return Tb.table_chunks(some, "doc_id", "text")
    return P.text_chunks(some, "text", config.chunk_token_num, config.delimiter).select("doc_id", "chunk_index", "content")


def file_texts(files: DataFrame, from_page: int = 0, to_page: int = 100_000) -> DataFrame:
    """``doc_id`` (of the path), ``docnm_kwd``, ``text`` and ``error`` of files (``path``, ``name``, ``kind``, ``content``), and of what is
    attached to mails, under the mail's path; a broken file, or one that nothing here can read, gives an error, not a failure."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    files = files.withColumn("error", F.when(F.col("content").isNull(), F.coalesce(error, F.lit("no content"))))
    ok = files.where("error is null").drop("error")
    office = r"(?i)\.(docx|pptx|xlsx)$"
    mail = P.parse_mail(ok.where("kind = 'email'").select("path", "name", "content"), "content")
    texts = [_plain_texts(ok, office, from_page, to_page), mail.select("path", "name", F.concat_ws("\n", "headers", "body").alias("text"), "error")]
    # one level of attachments; a mail within a mail is read as text
    inner = mail.select("path", F.explode("attachments").alias("a")).select(F.concat_ws("/", "path", "a.name").alias("path"), "a.name", "a.content").withColumn("kind", T.file_kind(F.col("name")))
    inner = inner.withColumn("kind", F.when(F.col("kind") == "email", "text").otherwise(F.col("kind")))
    texts.append(_plain_texts(inner, office, from_page, to_page))
    known = F.col("kind").isin("text", "markdown", "html", "json", "sheet", "pdf", "email") & ~F.col("name").rlike(r"(?i)\.xls$") | F.col("name").rlike(office)
    for df in (ok, inner):
        texts.append(df.where(~known).select("path", "name", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no parser for "), T.extension(F.col("name"))).alias("error")))
    texts.append(files.where("error is not null").select("path", "name", F.lit(None).cast("string").alias("text"), "error"))
    out = texts[0]
    for t in texts[1:]:
        out = out.unionByName(t)
    return out.select(F.md5("path").alias("doc_id"), F.col("name").alias("docnm_kwd"), "text", "error")


def _plain_texts(files: DataFrame, office: str, from_page: int, to_page: int) -> DataFrame:
    """``path``, ``name``, ``text`` and ``error`` of texts, office files and PDF files."""
    text = files.where(F.col("kind").isin("text", "markdown", "html", "json", "sheet") & ~F.col("name").rlike(r"(?i)\.xlsx?$")).select("path", "name", "kind", P.decoded("content").alias("raw"))
    plain = text.select("path", "name", F.when(F.col("kind") == "html", P.html_text(F.col("raw"))).otherwise(F.col("raw")).alias("text"), F.lit(None).cast("string").alias("error"))
    parts = P.parse_office(files.where(F.col("name").rlike(office)).select("path", "name", "content"), "content", from_page, to_page)
    parts = parts.select("path", "name", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "error")
    pdf = parse_pdf(files.where("kind = 'pdf'").select("path", "name", "content"), "content", from_page, to_page)
    pdf = pdf.select("path", "name", F.array_join(F.transform("pages", lambda p: p["text"]), "\f").alias("text"), "error")
    return plain.unionByName(parts).unionByName(pdf)


def chunk_files(files: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Files to normalised chunks with their tokens and positions; files with an error give none (``file_texts`` lists them)."""
    texts = file_texts(files, config.from_page, config.to_page).where("error is null")
    chunks = chunk_texts(texts, config).join(texts.select("doc_id", "docnm_kwd"), "doc_id")
    return I.normalise(C.chunk_fields(chunks.withColumnRenamed("content", "content_with_weight")))
