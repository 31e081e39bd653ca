import random

import pytest
from pyspark.sql import functions as F

from grocerlake.operators import marts
from grocerlake.streaming import jobs as st


CACHE = "barcode string, name string, cached_at timestamp"


def drain(spark, folder, df, make, mode="complete"):
    path, name = str(folder / "in"), f"drained_{make.__name__}"
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination(40)
    q.stop()
    return spark.table(name)


def test_daily_mart_of_a_stream_is_the_batch_one(spark, tmp_path):
    df = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 700).alias("created_at"), (F.col("id") % 3).cast("string").alias("route"), (F.col("id") % 7 == 0).alias("abstained"), (F.col("id") % 4).cast("int").alias("citation_count"), F.col("id").cast("int").alias("latency_ms")
    )
    got = drain(spark, tmp_path, df, st.stream_fct_rag_daily)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, marts.fct_rag_daily(df).select(*got.columns).collect()))


def test_throttle_of_a_stream(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("event_id"), F.lit("chat").alias("request_class"), (F.col("id") % 2).cast("string").alias("identity"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = drain(spark, tmp_path, df, st.stream_throttle, "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.throttle(df).collect()))


def test_upserts_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "barcode string, name string")
    df.coalesce(1).write.parquet(path)
    q = st.stream_upsert_products(spark.readStream.schema(df.schema).parquet(path), str(tmp_path / "cache"), str(tmp_path / "c"), F.lit("2024-01-01").cast("timestamp"))
    q.awaitTermination(120)
    assert {r.barcode: r.name for r in st.read_cache(spark, str(tmp_path / "cache"), CACHE).collect()} == {"1": "a", "2": "b"}


def test_throttle_walks_in_batches(spark, capsys):
    df = spark.range(400).select(F.col("id").alias("event_id"), F.lit("chat").alias("request_class"), F.when(F.col("id") % 3 > 0, "big").alias("identity"), F.timestamp_seconds(F.col("id") * 5 % 997).alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: r.accepted for r in st.throttle(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for who in ("big", None):
        rows = sorted((r.ts.timestamp(), r.event_id) for r in df.collect() if r.identity == who)
        want |= dict(zip((k for _, k in rows), st.admit([t for t, _ in rows], [], *st.LIMITS["chat"])[0]))
    assert got == want and not all(got.values())
    st.throttle(df).explain()
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out


@pytest.mark.parametrize("pieces", ["1", "9"])
def test_throttle_hands_over_between_ranges(spark, pieces):
    """An identity that never pauses lies in all ranges; others pause, tie, lack a name or a time."""
    rng = random.Random(int(pieces))
    limits = {"chat": (3, 10), "scan": (2, 5)}
    rows = [(i, "chat", "hot", i * 1.25) for i in range(400)]
    rows += [(1000 + i, rng.choice(["chat", "scan", "other"]), rng.choice(["a", "b", None]), float(rng.randint(0, 900))) for i in range(300)]
    rows += [(5000, "chat", "hot", None), (5001, "scan", None, None)]
    df = spark.createDataFrame(rows, "event_id long, request_class string, identity string, t double").withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        got = {r.event_id: r.accepted for r in st.throttle(df, limits).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: True for i, name, _, t in rows if t is None}
    for name, who in {(r[1], r[2]) for r in rows if r[1] in limits}:
        own = sorted((t, i) for i, n, w, t in rows if (n, w) == (name, who) and t is not None)
        want |= dict(zip((i for _, i in own), st.admit([t for t, _ in own], [], *limits[name])[0]))
    assert got == want and 100 < sum(want.values()) < len(want) - 100


def test_scans_of_a_stream_have_exact_distinct_counts(spark, tmp_path):
    df = spark.range(3000).select(
        F.timestamp_seconds(F.col("id") * 97).alias("created_at"), F.when(F.col("id") % 11 > 0, F.col("id") % 700).alias("user_id"), (F.col("id") % 453).cast("string").alias("barcode"), F.when(F.col("id") % 5 > 0, F.col("id") % 100).cast("int").alias("score")
    )
    end = spark.createDataFrame([(9_000_000,)], "t long").select(F.timestamp_seconds("t").alias("created_at"), *(F.lit(None).cast(t).alias(n) for n, t in df.dtypes[1:]))
    got = drain(spark, tmp_path, df.unionByName(end), st.stream_fct_scan_daily, "append")
    want = marts.fct_scan_daily(df).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_versions_of_a_cache(spark, tmp_path):
    path, day = str(tmp_path / "cache"), lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    rows = lambda *r: spark.createDataFrame(r, "barcode string, name string")
    whole = lambda: {r.barcode: (r.name, r.cached_at.day) for r in st.read_cache(spark, path, CACHE).collect()}
    assert whole() == {}
    st.upsert_version(rows(*((str(i), "a") for i in range(50))), 0, path, day(1), buckets=8)
    touched = st.upsert_version(rows(("7", "b"), ("new", "b"), ("7", "b")), 1, path, day(2), buckets=8)
    assert 1 <= len(touched) <= 2
    # only the buckets of the batch are written, and a batch that runs again changes nothing
    written = lambda v: {p.name for p in (tmp_path / f"cache/data/v={v:08d}").iterdir() if p.name.startswith("bucket=")}
    assert written(1) == {f"bucket={b}" for b in touched}
    once = whole()
    assert once == {**{str(i): ("a", 1) for i in range(50)}, "7": ("b", 2), "new": ("b", 2)}
    assert st.upsert_version(rows(("7", "b"), ("new", "b"), ("7", "b")), 1, path, day(2), buckets=8) == touched and whole() == once
    for v in (2, 3):
        assert len(st.upsert_version(rows(("7", f"c{v}")), v, path, day(v), buckets=8)) == 1
    assert whole() == {**once, "7": ("c3", 3)}
    # what no manifest that is kept names is gone, and the version before can still be read
    assert st.cache_manifests(spark, path) == [2, 3]
    seven = st._manifest(spark, path, 3)
    gone = [b for b, v in seven.items() if v == 3]
    assert len(gone) == 1 and f"bucket={gone[0]}" not in written(0) and f"bucket={gone[0]}" not in written(1)
    assert {r.name for r in st.read_cache(spark, path, CACHE, 2).where("barcode = '7'").collect()} == {"c2"}
    # an empty batch makes a version of its own without a bucket
    assert st.upsert_version(rows(("x", "y")).limit(0), 4, path, day(4), buckets=8) == [] and whole() == {**once, "7": ("c3", 3)}


def test_state_of_daily_scans_is_a_row_a_slot(spark, tmp_path):
    """3000 users and products of a day do not make a row of state each."""
    rows = spark.range(3000).selectExpr("timestamp'2024-01-01 00:00:00' as created_at", "id as user_id", "cast(id as string) as barcode", "cast(id % 3 as int) as score")
    rows.union(spark.sql("select timestamp'2024-02-01 00:00:00', null, null, null")).write.parquet(str(tmp_path / "in"))
    stream = st.stream_fct_scan_daily(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    out = []
    query = stream.writeStream.outputMode("append").foreachBatch(lambda batch, n: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r[1:] for r in out] == [(3000, 3000, 3000, 1.0)]
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 2 * st.SLOTS + 2
