import pytest
from pyspark.sql import functions as F

from sedge.operators import index as I
from sedge.operators import tables as Tb
from sedge.streaming import ingest as S


def test_store(spark, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/store")
    assert not store.exists("t")
    store.create("t", "id string, v int")
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "id string, v int, seq int")
    store.upsert("t", rows)
    store.upsert("t", rows)
    assert sorted(map(tuple, store.read("t").select("id", "v").collect())) == [("a", 2), ("b", 3)]
    assert store.get("t", "b").first()["v"] == 3
    assert store.delete("t", {"id": ["a", "x"]}) == 1
    store.upsert("u", spark.createDataFrame([("z", "w")], "id string, other string"))
    assert store.read("t", "u").count() == 2
    assert store.drop("t") and not store.exists("t") and store.drop("t")


def test_a_write_changes_its_buckets_only(spark, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/store", buckets=8)
    store.upsert("t", spark.range(100).selectExpr("cast(id as string) id", "id v"))
    before = store._manifest("t")["files"]
    store.upsert("t", spark.createDataFrame([("7", -1, "new")], "id string, v long, w string"))
    after = store._manifest("t")["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    got = {r["id"]: (r["v"], r["w"]) for r in store.read("t").collect()}
    assert len(got) == 100 and got["7"] == (-1, "new") and got["8"] == (8, None)
    assert store.get("t", "7").count() == 1 and store.get("t", "no").count() == 0
    assert store.delete("t", {"v": 8}) == 1 and store.delete("t", {"v": 8}) == 0 and store.read("t").count() == 99
    assert store.vacuum("t") == 0 or store.read("t").count() == 99
    assert store._versions("t") == [2] and len(store._names("t", "data")) == len(set(store._manifest("t")["files"].values()))
    assert store.sample("t", 2) == {"mapping": {"id": "string", "v": "bigint", "w": "string"}, "rows": [{"id": "0", "v": 0, "w": None}, {"id": "1", "v": 1, "w": None}]}


def test_of_two_writers_one_fails(spark, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    store.upsert("t", rows)
    old = store._manifest("t")
    store.upsert("t", rows.withColumn("v", F.lit(2)))
    with pytest.raises(RuntimeError, match="another"):
        store._put("t", old, rows, None)
    assert store.read("t").first()["v"] == 2


def test_staged_tables_are_released(spark):
    from sedge import session

    session.release_staged(spark)
    df = session.staged(spark.range(3), "x")
    assert df.count() == 3 and session.release_staged(spark) == 1 and session.release_staged(spark) == 0


def test_streamed_ingest_is_the_batch(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 20).cast("string").alias("id"), F.col("id").alias("v"))
    for k in range(5):
        rows.where(F.col("v") % 5 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = I.Store(spark, f"file://{tmp_path}/store")
    q = S.ingest(S.watch(spark, f"{tmp_path}/in", rows.schema, 1), store, "t", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert store.read("t").select("id").distinct().count() == store.read("t").count() == 20


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01' + make_interval(0,0,0,0,0,m) ts, m % 3 k, cast(m as double) value from (select explode(sequence(0, 400, 7)) m)")
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = S.tumbling(S.watch(spark, f"{tmp_path}/e", events.schema, 1), "ts", "1 hour", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, S.tumbling(events, "ts", "1 hour", "k").collect()))


def test_delete_keeps_what_is_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 1)], "k string, v int")
    assert I.delete(df, F.col("k") == "a").count() == 1


def test_validation(spark):
    df = spark.createDataFrame([("x", [1.0]), (" ", [1.0]), (None, None), ("y", [])], "content_with_weight string, q_1_vec array<double>")
    got = [(r["errors"], r["warnings"]) for r in I.validate(df).collect()]
    assert got == [([], []), ([], ["blank content"]), (["missing content_with_weight", "no vector"], []), (["q_1_vec is empty"], [])]


def test_normalised_ids_are_stable(spark):
    df = spark.createDataFrame([("d", 0, None), ("d", 1, "x")], "doc_id string, chunk_index int, content_with_weight string")
    a, b = (sorted(r["id"] for r in I.normalise(df.repartition(n)).collect()) for n in (1, 3))
    assert a == b and len(set(a)) == 2


def test_column_types(spark):
    df = spark.createDataFrame([("1", "2.5", "", "yes", "2024-01-02", "x"), ("3.0", "7", None, "no", "2024/1/3", "y")], "i string, f string, e string, b string, d string, t string")
    types = {r["column_name"]: r["column_type"] for r in Tb.column_types(df).collect()}
    assert types == {"i": "int", "f": "int", "e": "int", "b": "bool", "d": "datetime", "t": "text"}
    first = Tb.typed(df, types | {"f": "float"}).collect()
    assert first[0]["i"] == 1 and first[1]["f"] == 7.0 and first[0]["b"] == "yes" and first[0]["d"] == "2024-01-02 00:00:00" and first[0]["e"] is None


def test_names_and_suffixes(spark):
    assert Tb.column_name("supplier/vendor", "text") == "supplier_tks" and Tb.column_name("color(yellow, red)", "int") == "color_long"
    assert Tb.suffix_type("q_768_vec") == "array<float>" and Tb.suffix_type("name") is None
    df = spark.createDataFrame([("1", "x", "y")], "a_int string, b_kwd string, other string")
    assert Tb.apply_suffixes(df).dtypes == [("a_int", "int"), ("b_kwd", "string")]


def test_html_table(spark):
    df = spark.range(5).select(F.lit(0).alias("g"), "id")
    got = [r["html"] for r in Tb.html_table(df, ["id"], ["g"], "id", "c", 3).orderBy("block").collect()]
    assert len(got) == 2 and got[1] == "<table><caption>c</caption><tr><th>id</th></tr><tr><td>3</td></tr><tr><td>4</td></tr></table>"
