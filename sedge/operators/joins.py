"""Joins by range, nearness and hierarchy, as equi-joins on cells with a condition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import per_group


def overlap_join(a: DataFrame, b: DataFrame, key: str, begin: str, end: str, width: float, suffix: str = "_r") -> DataFrame:
    """Rows of the same key whose intervals [begin, end] overlap, each pair once.

    Both sides go into cells of ``width``; a pair is kept only in the first cell that it shares."""
    cell = lambda c: F.floor(F.col(c) / width)
    x = a.where(F.col(begin) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(begin), cell(end))))
    y = b.where(F.col(begin) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(begin), cell(end))))
    y = y.select(key, "_cell", *[F.col(c).alias(c + suffix) for c in b.columns if c != key])
    first = F.greatest(cell(begin), F.floor(F.col(begin + suffix) / width))
    return x.join(y, [key, "_cell"]).where((F.col(begin) <= F.col(end + suffix)) & (F.col(begin + suffix) <= F.col(end)) & (F.col("_cell") == first)).drop("_cell")


def nearest_join(a: DataFrame, b: DataFrame, key: str, at: str, bid: str, b_at: str) -> DataFrame:
    """For each row of ``a`` the id and distance of the nearest row of ``b`` with the same key (the lower id of two), by two
    passes of a window over the union: no pair of rows is made."""
    x = a.select("*", F.lit(None).cast(b.schema[bid].dataType).alias("_bid"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"))
    y = b.select(key, F.col(bid).alias("_bid"), F.col(b_at).cast("double").alias("_at"), F.lit(0).alias("_side"))
    both = x.unionByName(y, allowMissingColumns=True)
    seen = F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("p"), F.col("_bid").alias("i")))
    before = Window.partitionBy(key).orderBy("_at", "_side", F.desc("_bid")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc("_at"), "_side", F.desc("_bid")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_l", F.last(seen, True).over(before)).withColumn("_n", F.last(seen, True).over(after)).where("_side = 1")
    d = lambda c: F.abs(F.col("_at") - F.col(c)["p"])
    left = F.col("_n").isNull() | (F.col("_l").isNotNull() & ((d("_l") < d("_n")) | ((d("_l") == d("_n")) & (F.col("_l")["i"] <= F.col("_n")["i"]))))
    return both.withColumn("nearest", F.when(left, F.col("_l")["i"]).otherwise(F.col("_n")["i"])).withColumn("distance", F.when(left, d("_l")).otherwise(d("_n"))).drop("_bid", "_at", "_side", "_l", "_n")


def as_of_join(a: DataFrame, b: DataFrame, key: str, at: str, value: str, b_at: str) -> DataFrame:
    """For each row of ``a`` the value of the last row of ``b`` at or before it, with the same key."""
    x = a.withColumn("_v", F.lit(None).cast(b.schema[value].dataType)).withColumn("_at", F.col(at)).withColumn("_side", F.lit(1))
    y = b.select(key, F.col(value).alias("_v"), F.col(b_at).alias("_at"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return x.unionByName(y, allowMissingColumns=True).withColumn(value, F.last(F.when(F.col("_side") == 0, F.col("_v")), True).over(w)).where("_side = 1").drop("_v", "_at", "_side")


def name_candidates(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts ``a`` of ``x`` and ``b`` of ``y`` that may share more than ``threshold`` of the grams of the one that has more, by
    their distinct grams ``ga`` and ``gb``.

    Prefix filter: grams are ordered from rare to common (a total order), and a pair above the threshold shares one among
    the first ``n - ceil(threshold * n) + 1``, so frequent grams never bring texts together. A gram's texts are
    compared within a task, by their sizes, 128 bits of each (texts differ in as many grams as bits at least) and the places of the
    gram, so that only pairs which pass become rows."""
    counts = y.select(F.explode("gb").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def bits(g: str, at: int) -> Column:
        bit = lambda h: F.when((h >= at) & (h < at + 64), F.call_function("shiftleft", F.lit(1).cast("long"), (h - at).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(g, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(bit(F.pmod(F.xxhash64(w), F.lit(128).cast("long")))))

    def prefix(df: DataFrame, name: str, g: str, side: int) -> DataFrame:
        of = df.select(name, F.size(g).alias("m"), bits(g, 0).alias("s"), bits(g, 64).alias("t"), g)
        each = of.select(name, "m", "s", "t", F.explode(g).alias("g")).join(counts, "g", "left")
        r = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "g"))
        some = each.withColumn("r", r).where(F.col("r") <= F.col("m") - F.ceil(threshold * F.col("m")) + 1)
        return some.select("g", F.lit(side).alias("side"), F.col(name).alias("name"), "m", "s", "t", "r")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["side"] == k].sort_values("m", kind="stable") for k in (0, 1))
        (xm, xs, xt, xr), (ym, ys, yt, yr) = ([d[c].to_numpy(np.int64) for c in ("m", "s", "t", "r")] for d in (x, y))
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for m in np.unique(xm):
            least = threshold * np.maximum(m, ym) - 1e-9
            own, near = np.flatnonzero(xm == m), np.flatnonzero(np.minimum(m, ym) >= least)
            most, step = np.floor(m + ym[near] - 2 * least[near]).astype(np.int16), max(1, 1_000_000 // max(1, len(near)))
            for at in range(0, len(own), step):
                i = own[at : at + step]
                differ = np.bitwise_count((xs[i, None] ^ ys[near]).view(np.uint64)) + np.bitwise_count((xt[i, None] ^ yt[near]).view(np.uint64))
                p, q = np.nonzero(differ <= most)
                p, q = i[p], near[q]
                some = np.minimum(xr[p], yr[q]) + np.minimum(m - xr[p], ym[q] - yr[q]) >= least[q]
                found.append((p[some], q[some]))
        p, q = (np.concatenate(f) for f in zip(*found, strict=True))
        return pd.DataFrame({"a": x["name"].to_numpy(object)[p], "b": y["name"].to_numpy(object)[q]})

    both = prefix(x, "a", "ga", 0).unionByName(prefix(y, "b", "gb", 1))
    return per_group(both, ["g"], run, "a string, b string").distinct()


def similar_names(a: DataFrame, b: DataFrame, text_a: str, text_b: str, grams: Column, grams_b: Column, threshold: float) -> DataFrame:
    """Pairs of distinct texts that share more than ``threshold`` of the grams of the one that has more."""
    x = a.select(F.col(text_a).alias("a")).distinct().withColumn("ga", grams)
    y = b.select(F.col(text_b).alias("b")).distinct().withColumn("gb", grams_b)
    both = name_candidates(x, y, threshold).withColumn("ga", grams).withColumn("gb", grams_b)
    share = F.size(F.array_intersect("ga", "gb")) / F.greatest(F.size("ga"), F.size("gb"), F.lit(1))
    return both.select("a", "b", share.alias("similarity")).where(F.col("similarity") > threshold)


def walk_up(children: DataFrame, parents: DataFrame, child: str, parent: str, name: str, depth: int = 10) -> DataFrame:
    """``path`` of the names of all ancestors of each row, nearest first; ``parents`` has id, name and parent id (null at the root)."""
    out = children.withColumn("_p", F.col(parent)).withColumn("path", F.array().cast("array<string>"))
    p = parents.select(F.col("id").alias("_id"), F.col(name).alias("_name"), F.col("parent").alias("_up"))
    for _ in range(depth):
        out = out.join(p, F.col("_p") == F.col("_id"), "left")
        out = out.withColumn("path", F.when(F.col("_name").isNotNull(), F.concat("path", F.array("_name"))).otherwise(F.col("path"))).withColumn("_p", F.col("_up")).drop("_id", "_name", "_up")
    return out.drop("_p")
