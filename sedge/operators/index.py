"""A chunk table with upsert and delete, and the side tables that full-text search needs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Fields of the full-text index with their boosts (fixed values).
FIELD_BOOSTS = {"title_tks": 10.0, "title_sm_tks": 5.0, "important_kwd": 30.0, "important_tks": 20.0, "question_tks": 20.0, "content_ltks": 2.0, "content_sm_ltks": 1.0}


def postings(df: DataFrame, id_col: str, text_col: str, keep_empty: bool = False) -> DataFrame:
    """``id``, ``term``, ``tf`` and the text's ``length`` in tokens. Where ``df`` is partitioned by id, as after removing
    repeated ids, counting needs no further shuffle. ``keep_empty``: texts without tokens have a row with a null term."""
    tokens = T.tokens(F.col(text_col))
    df = df.select(id_col, F.coalesce(tokens, F.array().cast("array<string>")).alias("_t")).withColumn("length", F.size("_t").cast("long"))
    term = F.explode_outer("_t") if keep_empty else F.explode("_t")
    return df.select(id_col, "length", term.alias("term")).groupBy(id_col, "term").agg(F.count("term").alias("tf"), F.first("length").alias("length"))


def postings_stats(p: DataFrame, id_col: str) -> DataFrame:
    """``n`` texts and their average length from postings that keep empty texts; one row."""
    n = F.countDistinct(id_col)
    return p.agg(n.alias("n"), (F.sum("tf") / n).alias("avgdl"))


def document_frequency(p: DataFrame) -> DataFrame:
    return p.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def collection_stats(df: DataFrame, text_col: str) -> DataFrame:
    """``n`` rows and their average length; one row."""
    return df.agg(F.count("*").alias("n"), F.avg(F.size(F.coalesce(T.tokens(F.col(text_col)), F.array().cast("array<string>")))).alias("avgdl"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; of equal ones the greatest in all other columns."""
    rest = [c for c in df.columns if c not in (key, *order) and not df.schema[c].dataType.simpleString().startswith("map")]
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in (*order, *rest)])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows put in: a row replaces the one of its key; of several new ones the last counts (by ``seq`` if there is one)."""
    new = latest(rows.withColumn("_seq", F.col("seq") if "seq" in rows.columns else F.lit(0)), key, "_seq").drop("_seq")
    return table.join(new.select(key), key, "left_anti").unionByName(new.drop("seq") if "seq" not in table.columns else new, allowMissingColumns=True)


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows for which the condition is true (null isn't)."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def conditions(values: dict) -> Column:
    """All of the conditions: a list means one of its values; nulls don't restrict."""
    out = F.lit(True)
    for k, v in values.items():
        if v is not None:
            out = out & (F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v)
    return out


def normalise(df: DataFrame, kb_id: str | None = None) -> DataFrame:
    """Chunks with ids, defaults and lists: the id is a hash of file and place, so that a second run gives the same."""
    have = set(df.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    df = df.withColumn("id", col("id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("doc_id", "chunk_index") if c in have]))))
    df = df.withColumn("available_int", col("available_int", F.lit(1))).withColumn("kb_id", col("kb_id", F.lit(kb_id)))
    for c in ("important_kwd", "question_kwd"):
        kind = df.schema[c].dataType.simpleString() if c in have else ""
        value = F.array(F.col(c)) if kind == "string" else F.col(c) if kind else F.array().cast("array<string>")
        df = df.withColumn(c, F.coalesce(F.filter(value, lambda x: x.isNotNull()), F.array().cast("array<string>")))
    return df.withColumn("content_with_weight", col("content_with_weight", F.lit("")))


def validate(df: DataFrame, required: str = "content_with_weight") -> DataFrame:
    """``errors`` and ``warnings`` of each chunk: required text, one vector column at least, not empty, no nulls in it."""
    vectors = [c for c in df.columns if c.endswith("_vec")]
    errors = [F.when(F.col(required).isNull(), F.lit(f"missing {required}"))] if required in df.columns else [F.lit(f"missing {required}")]
    errors.append(F.when(F.lit(not vectors) if not vectors else F.coalesce(*[F.col(v).cast("array<double>") for v in vectors]).isNull(), F.lit("no vector")))
    errors += [F.when(F.size(v) == 0, F.lit(f"{v} is empty")) for v in vectors]
    errors += [F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(f"{v} isn't numeric")) for v in vectors]
    warnings = [F.when(F.trim(required) == "", F.lit("blank content"))] if required in df.columns else []
    if len(vectors) > 1:
        warnings.append(F.lit("several vectors"))
    return df.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>"))


class Store:
    """Tables of chunks below a folder, in buckets by the hash of the id.

    A write puts files for the buckets it changes beside the others and then adds a manifest, which names the files of every
    bucket; readers go by the last manifest, so they never see half of a write. Of two writers that started from the same manifest
    the second one fails and may try again. ``vacuum`` deletes what no manifest in use names."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = "id"):
        self.spark, self.root, self.buckets, self.key = spark, root.rstrip("/"), buckets, key

    # -- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts), self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n) for n in self._names(name, "manifests") if n.isdigit())

    def _read(self, name: str, version: int) -> dict | None:
        """A version's manifest; null while it is being written."""
        stream = self._fs().open(self._path(name, "manifests", str(version)))
        try:
            return {**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")), "version": version}
        except ValueError:
            return None
        finally:
            stream.close()

    def _manifest(self, name: str) -> dict:
        """``buckets`` and ``files`` (the write of each bucket that has rows) of the last version."""
        for version in reversed(self._versions(name)):
            if found := self._read(name, version):
                return found
        return {"version": -1, "buckets": self.buckets, "files": {}, "schema": None}

    def _commit(self, name: str, old: dict, files: dict, schema) -> None:
        text = json.dumps({"buckets": old["buckets"], "files": files, "schema": json.loads(schema.json())})
        try:  # creates the file or fails, so that one of two writers gets the next version
            stream = self._fs().create(self._path(name, "manifests", str(old["version"] + 1)), False)
        except Exception as e:
            raise RuntimeError(f"{name} was written by another in the meantime") from e
        stream.write(bytearray(text.encode()))
        stream.close()

    def _bucket(self, old: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(old["buckets"])).cast("int")

    def _frame(self, name: str, manifest: dict, some: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else StructType()
        paths = [f"{self.root}/{name}/data/{write}/_bucket={b}" for b, write in manifest["files"].items() if some is None or int(b) in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, name: str, old: dict, rows: DataFrame, changed: set[int] | None) -> None:
        """Writes the rows of the changed buckets (all, if none are named) and keeps the others."""
        write, schema = uuid.uuid4().hex, rows.schema
        rows.withColumn("_bucket", self._bucket(old)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/data/{write}")
        kept = {} if changed is None else {b: w for b, w in old["files"].items() if int(b) not in changed}
        fresh = {n.split("=")[1]: write for n in self._names(name, "data", write) if n.startswith("_bucket=")}
        self._commit(name, old, {**kept, **fresh}, schema)

    # -- tables

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, *names: str) -> DataFrame:
        """One or several tables as one, columns by name."""
        frames = [self._frame(n, self._manifest(n)) for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def write(self, name: str, df: DataFrame) -> None:
        """The rows as the whole table."""
        self._put(name, self._manifest(name), df, None)

    def create(self, name: str, schema) -> None:
        """An empty table, unless there is one."""
        if not self.exists(name):
            self._commit(name, self._manifest(name), {}, self.spark.createDataFrame([], schema).schema)

    def drop(self, name: str) -> bool:
        """Whether the table is gone, which it also is if there was none."""
        self._fs().delete(self._path(name), True)
        return True

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Puts the rows in by id; only the buckets of their ids are read and written."""
        old, new = self._manifest(name), latest(rows.withColumn("_seq", F.col("seq") if "seq" in rows.columns else F.lit(0)), self.key, "_seq").drop("_seq")
        changed = {r[0] for r in new.select(self._bucket(old)).distinct().collect()}  # buckets are a fixed number
        if old["version"] >= 0:
            own = self._frame(name, old, changed)
            new = own.join(new.select(self.key), self.key, "left_anti").unionByName(new if "seq" in own.columns else new.drop("seq"), allowMissingColumns=True)
        self._put(name, old, new, changed)

    def delete(self, name: str, values: dict) -> int:
        """Deletes the rows that meet all conditions; how many. Only buckets with such rows are written."""
        old = self._manifest(name)
        hit = self._frame(name, old).where(conditions(values)).groupBy(self._bucket(old).alias("b")).agg(F.count("*").alias("n")).collect()
        changed = {r["b"] for r in hit}
        if changed:
            self._put(name, old, delete(self._frame(name, old, changed), conditions(values)), changed)
        return sum(r["n"] for r in hit)

    def get(self, name: str, key: str) -> DataFrame:
        """The row of an id, from its bucket."""
        old = self._manifest(name)
        bucket = self.spark.createDataFrame([(key,)], f"`{self.key}` string").select(self._bucket(old)).first()[0]
        return self._frame(name, old, {bucket}).where(F.col(self.key) == key)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` manifests and the files that only they name; how many writes went."""
        versions = self._versions(name)
        for v in versions[: max(0, len(versions) - keep)]:
            self._fs().delete(self._path(name, "manifests", str(v)), False)
        used = {w for v in versions[-keep:] for w in (self._read(name, v) or {"files": {}})["files"].values()}
        gone = [w for w in self._names(name, "data") if w not in used]
        for w in gone:
            self._fs().delete(self._path(name, "data", w), True)
        return len(gone)

    def sample(self, name: str, rows: int = 5) -> dict:
        """A few rows (those of the least ids) and the fields with their types, as a report of what a table holds."""
        df = self.read(name)
        return {"mapping": {f.name: f.dataType.simpleString() for f in df.schema}, "rows": [r.asDict(True) for r in df.orderBy(self.key).limit(rows).collect()]}

