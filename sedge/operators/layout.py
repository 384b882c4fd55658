"""Text boxes of pages: joins with regions, rows, tables, overlaps. A page is the unit of all groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .groups import per_group

_BOX = ("x0", "x1", "top", "bottom")


def _struct(prefix: str = ""):
    return F.struct(*[F.col(prefix + c).cast("double").alias(c) for c in _BOX])


def best_region(boxes: DataFrame, regions: DataFrame, page: list[str], box_id: str, least: float = 0.0) -> DataFrame:
    """Each box with the region of its page that covers most of it (``region_id`` null below ``least``)."""
    r = regions.select(*page, "region_id", _struct().alias("_r"))
    pairs = boxes.join(r, page).withColumn("_o", G.overlap(_struct(), F.col("_r"))).where((F.col("_o") > 0) & (F.col("_o") >= least))
    best = pairs.groupBy(*page, box_id).agg(F.max_by(F.struct("region_id", F.col("_o").alias("covered")), F.struct(F.col("_o"), -F.col("region_id"))).alias("b"))
    return boxes.join(best, [*page, box_id], "left").select(*boxes.columns, F.col("b.region_id").alias("region_id"), F.col("b.covered").alias("covered"))


def suppress(boxes: DataFrame, page: list[str], box_id: str, least: float = 0.45) -> DataFrame:
    """Boxes without those that a better one of the page and label overlaps (greedy, by score)."""

    def kept(rows: list[tuple]) -> list[int]:
        out: list[int] = []
        for i, a in enumerate(rows):  # the best first
            for j in out:
                b = rows[j]
                w, h = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
                if w > 0 and h > 0 and w * h > least * ((a[1] - a[0]) * (a[3] - a[2]) + (b[1] - b[0]) * (b[3] - b[2]) - w * h):
                    break
            else:
                out.append(i)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf, last in _with_last(batches):
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.ones(len(pdf), bool)
            for k, c in enumerate(page):
                same = (pdf[c] == pdf[c].shift()).to_numpy()
                new[1:] = ~same[1:] if k == 0 else new[1:] | ~same[1:]
            edges = [*np.flatnonzero(new), len(pdf)]
            upto = len(edges) - 1 if last else len(edges) - 2
            boxes_ = list(zip(*(pdf[c].astype(float).tolist() for c in _BOX), strict=True))
            at = [x + i for x, y in zip(edges[:upto], edges[1 : upto + 1], strict=True) for i in (kept(boxes_[x:y]) if y - x > 1 else (0,))]
            rest = pdf.iloc[edges[upto] :]
            yield pdf.iloc[at]

    return boxes.repartition(*page).sortWithinPartitions(*page, F.desc("score"), box_id).mapInPandas(run, boxes.schema)


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether it is the last."""
    held = None
    for x in items:
        if held is not None:
            yield held, False
        held = x
    if held is not None:
        yield held, True


def text_rows(boxes: DataFrame, page: list[str], height: str = "mean_height") -> DataFrame:
    """``row_no`` of boxes on a page: a new row begins where the gap to the box before exceeds half the mean height."""
    w = Window.partitionBy(*page).orderBy("top", "x0")
    mean = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*page))
    new = F.coalesce(F.col("top") - F.lag("top").over(w) > mean / 2, F.lit(True)).cast("int")
    return boxes.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(rows: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """The text of each row of boxes, left to right."""
    both = rows.groupBy(*page, "row_no").agg(F.array_sort(F.collect_list(F.struct("x0", text))).alias("r"), F.min("top").alias("top"))
    return both.select(*page, "row_no", "top", F.array_join(F.transform("r", lambda x: x[text]), " ").alias("line"))


#: What a line that goes on ends with, and what a line that goes on with another begins with; what a finished line ends with
#: (fixed values).
GOES_ON, GOES_ON_BEFORE, CONTINUES, ENDS, ENDS_ENGLISH = ",;:'\"，、‘“；：-", ",;:'\"，‘“、；：", "。；？！?”）),，、：", "。？！?", ".!?"


def merge_downward(boxes: DataFrame, doc: str, english: bool = False) -> DataFrame:
    """Boxes of a document joined downwards, from page to page: ``doc``, ``block`` from 0, ``page``, ``x0``, ``x1``, ``top``, ``bottom``, ``text``.

    ``boxes`` has ``page``, ``layout`` and a box with its ``text``. Two in a row are joined unless one lies beside the other, or the
    first ends a sentence, they are of different layouts or far apart, and neither shows that the text goes on. Blank boxes, and
    page numbers at the end of a page, are dropped."""
    w = Window.partitionBy(doc, "page")
    sized = boxes.withColumn("_h", F.avg(F.col("bottom") - F.col("top")).over(w)).withColumn("_w", F.avg((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))).over(w))

    def apart(a, b) -> bool:
        if a["x1"] < b["x0"] or a["x0"] > b["x1"]:
            return True
        text, following = a["text"].strip(), b["text"].strip()
        if text[-1] in GOES_ON or len(text) > 1 and text[-2] in GOES_ON_BEFORE or following and following[0] in CONTINUES:
            return False
        same = a["page"] == b["page"]
        far = b["top"] - a["bottom"] > 1.5 * a["_h"] if same else abs(a["x0"] - b["x0"]) > 4 * a["_w"]
        return a["layout"] != b["layout"] or text[-1] in ENDS or english and text[-1] in ENDS_ENGLISH or far

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_row=(pdf["top"] / (pdf["_h"].median() / 3 or 1)).round()).sort_values(["page", "_row", "x0"], kind="stable")
        rows, out = pdf.to_dict("records"), []
        for i, b in enumerate(rows):
            text, more = b["text"] or "", i + 1 < len(rows)
            if not text.strip() or more and b["page"] < rows[i + 1]["page"] and all(c in "0123456789 •一—-" for c in text):
                continue
            b["text"] = text
            if out and not apart(out[-1], b):
                last = out[-1]
                last |= {"bottom": b["bottom"], "text": last["text"] + text, "x0": min(last["x0"], b["x0"]), "x1": max(last["x1"], b["x1"])}
            else:
                out.append(dict(b))
        return pd.DataFrame([(pdf[doc].iloc[0], k, b["page"], b["x0"], b["x1"], b["top"], b["bottom"], b["text"]) for k, b in enumerate(out)], columns=[doc, "block", "page", "x0", "x1", "top", "bottom", "text"])

    kind = boxes.schema[doc].dataType.simpleString()
    return per_group(sized.select(doc, "page", "layout", *[F.col(c).cast("double").alias(c) for c in _BOX], "text", "_h", "_w"), [doc], run, f"`{doc}` {kind}, block int, page int, x0 double, x1 double, top double, bottom double, text string")


def merge_same_bullet(boxes: DataFrame, doc: str) -> DataFrame:
    """Boxes of a document (in the order ``i``) with those joined that begin with the same sign, no Latin letter or Chinese character:
    ``doc``, ``block`` from 0, ``x0``, ``x1``, ``top``, ``bottom``, ``text``. Blank boxes are dropped; a box above the one before it isn't joined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for b in pdf.sort_values("i").to_dict("records"):
            text = (b["text"] or "").strip()
            if not text:
                continue
            last = out[-1] if out else None
            sign = text[0]
            if last and last["text"].strip()[0] == sign and not sign.lower() in "abcdefghijklmnopqrstuvwxyz" and not "一" <= sign <= "鿿" and last["top"] <= b["bottom"]:
                last |= {"text": last["text"] + "\n" + b["text"], "x0": min(last["x0"], b["x0"]), "x1": max(last["x1"], b["x1"]), "bottom": b["bottom"]}
            else:
                out.append(dict(b))
        return pd.DataFrame([(pdf[doc].iloc[0], k, b["x0"], b["x1"], b["top"], b["bottom"], b["text"]) for k, b in enumerate(out)], columns=[doc, "block", "x0", "x1", "top", "bottom", "text"])

    kind = boxes.schema[doc].dataType.simpleString()
    return per_group(boxes.select(doc, "i", *[F.col(c).cast("double").alias(c) for c in _BOX], "text"), [doc], run, f"`{doc}` {kind}, block int, x0 double, x1 double, top double, bottom double, text string")


def page_offsets(pages: DataFrame, doc: str, page: str, height: str) -> DataFrame:
    """The height of all pages before each page."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(height).over(w), F.lit(0)))


def drop_leader_pages(lines: DataFrame, page: list[str], text: str = "line") -> DataFrame:
    """Lines without pages of contents: those with more than three lines of leading dots."""
    dots = F.sum(F.col(text).rlike(r"(\.|·){4,}").cast("int")).over(Window.partitionBy(*page))
    return lines.withColumn("_d", dots).where("_d <= 3").drop("_d")


def drop_repeated(lines: DataFrame, doc: str, text: str, garbage=None) -> DataFrame:
    """Lines without those garbage lines (``garbage``, a condition) whose text occurs more than once in the document."""
    own = lines.where(garbage) if garbage is not None else lines
    repeated = own.groupBy(doc, text).agg(F.count("*").alias("n")).where("n > 1").select(doc, text)
    return lines.join(repeated, [doc, text], "left_anti")


def table_cells(boxes: DataFrame, table: list[str]) -> DataFrame:
    """``r`` and ``c`` of the cells of a table, from gaps between their centres, and the class of each cell."""

    def places(a: str, b: str, name: str, df: DataFrame) -> DataFrame:
        mid = (F.col(a) + F.col(b)) / 2
        w = Window.partitionBy(*table).orderBy("_m")
        size = F.avg(F.col(b) - F.col(a)).over(Window.partitionBy(*table))
        df = df.withColumn("_m", mid)
        df = df.withColumn("_new", F.coalesce(F.col("_m") - F.lag("_m").over(w) > size / 2, F.lit(False)).cast("int"))
        return df.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_m")

    return places("x0", "x1", "c", places("top", "bottom", "r", boxes)).withColumn("kind", T.cell_type(F.col("text")))


def header_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """Rows whose cells' commonest class isn't that of the table: headers, if the table is mostly numbers."""
    kinds = cells.groupBy(*table, "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*table).orderBy(F.desc("n"), "kind")
    most = kinds.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*table, F.col("kind").alias("table_kind"))
    rows = cells.groupBy(*table, "r").agg(F.count("*").alias("cells"), F.count_if(F.col("kind") == "Nu").alias("numbers"))
    return rows.join(most, table).withColumn("header", (F.col("table_kind") == "Nu") & (F.col("numbers") * 2 < F.col("cells")))


def table_html(cells: DataFrame, headers: DataFrame, table: list[str]) -> DataFrame:
    """An HTML table of each table's cells."""
    c = cells.groupBy(*table, "r", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]), " ").alias("_text"))
    h = c.join(headers.select(*table, "r", "header"), [*table, "r"])
    tag = F.when(F.col("header"), "th").otherwise("td")
    rows = h.groupBy(*table, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.concat(F.lit("<"), tag, F.lit(">"), F.col("_text"), F.lit("</"), tag, F.lit(">")).alias("x")))).alias("l"))
    rows = rows.select(*table, "r", F.concat(F.lit("<tr>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</tr>")).alias("x"))
    both = rows.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("l"))
    return both.select(*table, F.concat(F.lit("<table>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</table>")).alias("html"))


def position_tags(c):
    """Positions ``@@page\\tx0\\tx1\\ttop\\tbottom##`` of a text as an array of structs."""
    tags = F.regexp_extract_all(c, F.lit(r"@@([0-9-]+\t[0-9.\t]+)##"), 1)

    def one(t):
        p = F.split(t, "\t")
        return F.struct(F.split(p[0], "-")[0].try_cast("int").alias("page"), *[p[i + 1].try_cast("double").alias(n) for i, n in enumerate(("left", "right", "top", "bottom"))])

    return F.transform(tags, one)


def strip_position_tags(c):
    return F.regexp_replace(c, r"@@[\t0-9.-]+?##", "")
