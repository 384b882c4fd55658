"""Résumé-like records: flattening, dates, degrees, completeness. Lookup tables come from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Degrees by rank (fixed values), the highest last.
DEGREES = ["初中", "高中", "中专", "大专", "专科", "本科", "硕士", "博士"]


def flatten_groups(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """Fields of nested groups as columns ``group_field``; what doesn't parse is null."""
    df = df.withColumn("_j", F.from_json(json_col, schema))
    out = []
    for g in df.schema["_j"].dataType:
        if g.dataType.typeName() == "struct":
            out += [F.col(f"_j.{g.name}.{f.name}").alias(f"{g.name}_{f.name}") for f in g.dataType]
        else:
            out.append(F.col(f"_j.{g.name}").alias(g.name))
    return df.select(*[c for c in df.columns if c not in ("_j", json_col)], *out)


def highest_degree(names: Column) -> Column:
    """The highest of an array of degrees; null if none is known."""
    ranks = F.create_map(*[x for i, d in enumerate(DEGREES) for x in (F.lit(d), F.lit(i))])
    best = F.array_max(F.transform(names, lambda d: F.try_element_at(ranks, d)))
    return F.element_at(F.array(*[F.lit(d) for d in DEGREES]), best + 1)


def work_summary(jobs: Column) -> Column:
    """Years, jobs and first start of an array of (start, end) strings; an open end counts to ``now`` of the last known date."""
    days = F.transform(jobs, lambda j: F.greatest(F.lit(0), F.datediff(T.year_month_day(j["end"]), T.year_month_day(j["start"]))))
    total = F.aggregate(F.filter(days, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)
    return F.struct((total / 365.25).alias("years"), F.size(jobs).alias("jobs"), F.array_min(F.transform(jobs, lambda j: T.year_month_day(j["start"]))).alias("first_start"))


def latest_job(jobs: Column) -> Column:
    """The job that began last."""
    return F.array_max(F.transform(jobs, lambda j: F.struct(T.year_month_day(j["start"]).alias("from"), j.alias("job"))))["job"]


def completeness(df: DataFrame, penalties: dict[str, float]) -> Column:
    """The share of fields that aren't empty, times a penalty for each named field that is."""
    fields = [F.when(F.col(f.name).isNotNull() & (F.col(f.name).cast("string") != ""), 1.0).otherwise(0.0) for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    score = sum(fields[1:], fields[0]) / len(fields)
    for name, by in penalties.items():
        score = score * F.when(F.col(name).isNull() | (F.col(name).cast("string") == ""), by).otherwise(1.0)
    return score


def name_prefixes(pinyin: Column) -> Column:
    """All beginnings of a name in Latin letters."""
    return F.when(F.length(pinyin) > 0, F.transform(F.sequence(F.lit(1), F.length(pinyin)), lambda n: F.substring(pinyin, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def look_up(df: DataFrame, table: DataFrame, column: str, keys: list[str], value: str) -> DataFrame:
    """The least ``value`` of the table's rows one of whose key columns (strings or arrays) equals the column."""
    each = None
    for k in keys:
        c = F.explode(k) if table.schema[k].dataType.typeName() == "array" else F.col(k)
        part = table.select(c.alias(column), F.col(value))
        each = part if each is None else each.unionByName(part)
    return df.join(each.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(value).alias(value)), column, "left")


def company_norm(c: Column, regions: list[str] | None = None) -> Column:
    """A company's name without legal suffixes, brackets and region names."""
    c = F.regexp_replace(F.lower(T.half_width(c)), r"[（(][^（()）]*[)）]|\s+", " ")
    c = F.regexp_replace(c, r"(有限责任公司|股份有限公司|有限公司|集团公司|集团|公司|,? ?(inc|ltd|llc|gmbh|corp|co)\.?)$", "")
    if regions:
        c = F.regexp_replace(c, "^(?:" + "|".join(regions) + ")(?:省|市)?", "")
    return F.trim(c)
