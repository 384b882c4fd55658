"""Typed columns and row texts of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Order of the types where votes are equal, and their name suffixes.
TYPES = ["int", "float", "text", "datetime", "bool"]
SUFFIX = {"int": "_long", "float": "_flt", "text": "_tks", "datetime": "_dt", "bool": "_kwd"}
# fixed values: patterns whose results must match
_INT, _FLOAT, _BOOL = r"^[+-]?[0-9]{0,19}(\.0+)?$", r"^[+-]?[0-9.]{0,19}$", r"(?i)^(true|yes|是|\*|✓|✔|☑|✅|√|false|no|否|⍻|×)$"


def cell_kind(c: Column) -> Column:
    """The type that a cell votes for; blanks vote for int, null for none."""
    return (
        F.when(c.isNull(), None).when(c.rlike(_INT), "int").when(c.rlike(_FLOAT), "float").when(c.rlike(_BOOL), "bool").when(T.loose_timestamp(c).isNotNull(), "datetime").otherwise("text")
    )


def table_chunks(texts: DataFrame, id_col: str, text_col: str, delimiter: str = "\t") -> DataFrame:
    """A chunk per row of tables in texts: the first line has the columns' names, and a row counts if it has as many cells.

    Cells take their column's type by vote, those that fail or are empty are left out: ``id_col``, ``chunk_index``, ``content``
    (``name:value; ...``, without columns named id), ``fields`` (``name_suffix`` to value)."""
    rows = texts.where(F.col(text_col).isNotNull()).select(id_col, F.split(text_col, "\n").alias("_l"))
    rows = rows.select(id_col, F.split(F.get("_l", F.lit(0)), delimiter).alias("_h"), F.posexplode(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))).alias("i", "_r"))
    rows = rows.withColumn("_c", F.split("_r", delimiter)).where((F.size("_c") == F.size("_h")) & (F.trim("_r") != ""))
    cells = rows.select(id_col, "i", F.posexplode(F.arrays_zip(F.col("_h").alias("name"), F.col("_c").alias("cell"))).alias("j", "x")).select(id_col, "i", "j", "x.name", "x.cell")
    cells = cells.withColumn("kind", cell_kind(F.col("cell")))
    votes = cells.groupBy(id_col, "j").agg(*[F.count_if(F.col("kind") == t).alias(t) for t in TYPES])
    most, kind = F.greatest(*TYPES), F.lit("text")
    for t in reversed(TYPES):
        kind = F.when(F.col(t) == most, t).otherwise(kind)
    both = cells.join(votes.select(id_col, "j", kind.alias("type")), [id_col, "j"])
    cell = F.col("cell")
    value = (
        F.when(F.col("type") == "int", cell.try_cast("double").cast("long").cast("string")).when(F.col("type") == "float", cell.try_cast("double").cast("string"))
        .when(F.col("type") == "datetime", F.date_format(T.loose_timestamp(cell), "yyyy-MM-dd HH:mm:ss")).when(F.col("type") == "bool", T.yes_no(cell)).otherwise(cell)
    )
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"(/.*|（[^（）]+?）|\([^()]+?\))", ""), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""))
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), F.col("type"))
    both = both.where(~F.lower(F.trim("name")).isin("id", "_id", "index", "idx")).withColumn("value", value).where("value is not null and value <> ''").withColumn("field", F.concat(plain, suffix))
    out = both.groupBy(id_col, "i").agg(F.array_sort(F.collect_list(F.struct("j", "name", "value", "field"))).alias("r"))
    fields = F.aggregate("r", F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["field"]), m).otherwise(F.map_concat(m, F.create_map(x["field"], x["value"]))))
    return out.select(id_col, F.col("i").alias("chunk_index"), F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.lit(":"), x["value"])), "; ").alias("content"), fields.alias("fields"))


def column_types(df: DataFrame) -> DataFrame:
    """``column_name``, ``column_type`` and the votes, for all columns as text, in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("cell")) for c in df.columns])
    kinds = df.select(F.explode(each).alias("r")).select("r.column_name", cell_kind(F.col("r.cell")).alias("kind"))
    rows = kinds.groupBy("column_name", "kind").agg(F.count("*").alias("n"))  # a class per cell is told once, and counted before the shuffle
    rows = rows.groupBy("column_name").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}") for t in TYPES])
    most = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    kind = F.lit("text")
    for t in reversed(TYPES):
        kind = F.when(F.col(f"n_{t}") == most, t).otherwise(kind)
    return rows.withColumn("column_type", kind)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their types; what fails is null."""
    make = {
        "int": lambda c: c.try_cast("long"), "float": lambda c: c.try_cast("double"), "text": lambda c: c,
        "datetime": lambda c: F.date_format(T.loose_timestamp(c), "yyyy-MM-dd HH:mm:ss"), "bool": T.yes_no,
    }
    return df.select(*[make[types.get(c, "text")](F.col(c).cast("string")).alias(c) for c in df.columns])


def column_name(header: str, kind: str) -> str:
    """A header without alternatives in brackets or after a slash, with its type's suffix."""
    plain = re.sub(r"(/.*|（[^（）]+?）|\([^()]+?\))", "", header).strip()
    return re.sub(r"[^\w]+", "_", plain).strip("_").lower() + SUFFIX[kind]


def row_text(df: DataFrame, skip: tuple[str, ...] = ("id", "_id", "index", "idx")) -> Column:
    """``col:val; col:val`` of a row; columns of the names in ``skip`` and null cells are left out."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in df.columns if c.lower() not in skip])


def html_table(df: DataFrame, columns: list[str], group: list[str], order: str, caption: str, size: int = 256) -> DataFrame:
    """HTML tables of ``size`` rows each, with repeated header and caption."""
    from pyspark.sql import Window

    head = f"<table><caption>{caption}</caption><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    rows = df.withColumn("block", F.floor(at / size)).withColumn("_h", cells).groupBy(*group, "block").agg(F.array_sort(F.collect_list(F.struct(order, "_h"))).alias("r"))
    return rows.select(*group, "block", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["_h"]), ""), F.lit("</table>")).alias("html"))


#: Suffixes of column names, with their types, in the order in which they are tried.
SUFFIX_TYPES = [
    (r"_int$", "int"), (r"_ulong$", "decimal(20,0)"), (r"_long$", "bigint"), (r"_short$", "smallint"), (r"_flt$", "double"), (r"(_tks|_ltks)$", "string"), (r"(_kwd|_id|_ids|_uid|_uids|uid)$", "string"),
    (r"(_dt|_time|_at)$", "timestamp"), (r"_nst$", "variant"), (r"_obj$", "variant"), (r"(_with_weight|_list)$", "string"), (r"_fea$", "double"), (r"_feas$", "map<string,double>"), (r"_\d+_vec$", "array<float>"), (r"_bin$", "binary"),
]


def suffix_type(name: str) -> str | None:
    """The type that a column's name tells, null if its suffix is unknown."""
    return next((t for p, t in SUFFIX_TYPES if re.search(p, name)), None)


def apply_suffixes(df: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Scalar columns cast to the types of their suffixes; columns of unknown suffix are dropped, or kept."""
    out = []
    for f in df.schema:
        t = suffix_type(f.name)
        if t is None and drop_unknown and f.name != "id":
            continue
        simple = f.dataType.simpleString() in ("string", "int", "bigint", "double", "float", "smallint") and t in ("int", "bigint", "smallint", "double", "timestamp", "string", "decimal(20,0)")
        out.append(F.col(f.name).try_cast(t).alias(f.name) if simple else F.col(f.name))
    return df.select(*out)
