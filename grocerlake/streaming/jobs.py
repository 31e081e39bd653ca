"""Streams: daily marts, product upserts, throttling, running counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from grocerlake.operators.marts import pipeline_aggregates, rag_daily_aggregates
from grocerlake.operators.products import upsert_products
from grocerlake.sources.tables import store

# Requests of a class allowed in so many seconds.
LIMITS = {"auth": (12, 60), "scan": (20, 60), "label_ocr": (4, 60), "chat": (10, 60), "admin_mutation": (30, 60)}
#: Rows of state that a day's users lie in, and its products.
SLOTS = 32
#: Hash buckets of a cache.
CACHE_BUCKETS = 64
THROTTLED = "event_id long, request_class string, identity string, ts timestamp, accepted boolean"


def _daily(stream: DataFrame, time: str, watermark: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    windowed = stream.withWatermark(time, watermark).groupBy(F.window(time, "1 day"), *keys).agg(*aggregates)
    return windowed.select(F.to_date("window.start").alias("day"), *keys, *[c for c in windowed.columns if c not in ("window", *keys)])


def stream_fct_rag_daily(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The daily answer mart of a stream; rows later than the watermark are dropped."""
    return _daily(stream, "created_at", watermark, ["route"], rag_daily_aggregates())


def stream_fct_scan_daily(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The daily scan mart with exact distinct counts, for append mode: a day comes when the watermark has passed its end.

    Two stateful steps: first the sets of users and of products of a day, each in SLOTS rows by hash, however many scans they have; then their sizes are
    added up.  State is a row for each slot of the days that are open, with every user or product of it once; a key that is no row of its own takes a few bytes.
    """
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot"), key.alias("key"))
    keys = F.array(pair("user", F.col("user_id").cast("string")), pair("product", F.col("barcode").cast("string")))
    keyed = stream.withWatermark("created_at", watermark).select("created_at", "score", F.explode(keys).alias("k"))
    once = keyed.groupBy(F.window("created_at", "1 day"), "k.kind", "k.slot").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("scored"), F.size(F.collect_set("k.key")).alias("distinct"))
    of_user = F.col("kind") == "user"
    days = once.groupBy(F.window("window", "1 day")).agg(
        F.sum(F.when(of_user, F.col("n"))).alias("scan_count"), F.coalesce(F.sum(F.when(of_user, F.col("distinct"))), F.lit(0)).alias("active_users"), F.coalesce(F.sum(F.when(~of_user, F.col("distinct"))), F.lit(0)).alias("unique_products"),
        F.round(F.sum(F.when(of_user, F.col("s"))) / F.sum(F.when(of_user, F.col("scored"))), 2).alias("mean_score"),
    )
    return days.select(F.to_date("window.start").alias("day"), "scan_count", "active_users", "unique_products", "mean_score")


def stream_fct_pipeline_daily(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    return _daily(stream, "started_at", watermark, ["pipeline"], pipeline_aggregates())


def stream_http_metrics(stream: DataFrame) -> DataFrame:
    """Running request counts, for update mode."""
    from grocerlake.functions.text import normalize_path

    return stream.groupBy("method", normalize_path(F.col("path")).alias("route"), "status").agg(F.count(F.lit(1)).alias("requests"), F.sum("latency_ms").alias("latency_sum"))


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cache_manifests(spark: SparkSession, path: str) -> list[int]:
    """Versions of a cache that are complete, ascending."""
    files, where = _folder(spark, f"{path}/manifest")
    if not files.exists(where):
        return []
    names = [f.getPath() for f in files.listStatus(where)]
    done = [n for n in names if files.exists(_folder(spark, f"{n.toString()}/_SUCCESS")[1])]
    return sorted(int(n.getName().removeprefix("v=")) for n in done if n.getName().startswith("v="))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Version of each bucket: as many rows as buckets."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{path}/manifest/v={version:08d}").collect()}


def _bucket_path(path: str, version: int, bucket: int) -> str:
    return f"{path}/data/v={version:08d}/bucket={bucket}"


def read_cache(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The newest complete version of a cache written by ``upsert_version``, or the one asked for."""
    known = cache_manifests(spark, path)
    buckets = _manifest(spark, path, known[-1] if version is None else version) if known else {}
    paths = [_bucket_path(path, v, b) for b, v in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_version(batch: DataFrame, version: int, path: str, as_of: Column, buckets: int = CACHE_BUCKETS, keep: int = 2) -> list[int]:
    """Write a batch into the cache as ``version``; returns the buckets that it touched.

    Rows lie in hash buckets of their barcode.  Only buckets with incoming rows are read and written anew, below a folder of the version; then a manifest that names
    the version of each bucket makes it the current one.  A version that runs again starts from the one before and
    writes the same again.  Buckets that none of the last ``keep`` manifests names are removed.
    """
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64("barcode"), F.lit(buckets)).cast("int")
    older = [v for v in cache_manifests(spark, path) if v < version]
    before = _manifest(spark, path, older[-1]) if older else {}
    incoming = store(batch)
    touched = sorted(r[0] for r in incoming.select(place).distinct().collect())  # at most one a bucket
    schema = StructType([f for f in batch.schema if f.name != "cached_at"]).add("cached_at", "timestamp")
    held = [_bucket_path(path, before[b], b) for b in touched if b in before]
    cache = spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
    after = upsert_products(cache, incoming, as_of).withColumn("bucket", place)
    after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version:08d}")
    now = {**before, **dict.fromkeys(touched, version)}
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v={version:08d}")
    known = cache_manifests(spark, path)
    used = {(v, b) for m in known[-keep:] for b, v in _manifest(spark, path, m).items()}
    for m in known[:-keep]:
        for b, v in _manifest(spark, path, m).items():
            if (v, b) not in used:
                files, where = _folder(spark, _bucket_path(path, v, b))
                files.delete(where, True)
        files, where = _folder(spark, f"{path}/manifest/v={m:08d}")
        files.delete(where, True)
    return touched


def stream_upsert_products(stream: DataFrame, cache_path: str, checkpoint: str, as_of: Column | None = None, buckets: int = CACHE_BUCKETS):
    """Upsert each micro-batch into the cache (``upsert_version``, ``read_cache``); returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_version(batch, batch_id, cache_path, as_of if as_of is not None else F.current_timestamp(), buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_request(method: Column, path: Column) -> Column:
    """The throttled class of a request; null for others."""
    post = F.upper(method) == "POST"
    return (
        F.when(post & F.startswith(path, F.lit("/api/auth/")), "auth")
        .when(post & (path == "/api/products/scan"), "scan")
        .when(post & (path == "/api/products/label-extractions"), "label_ocr")
        .when(post & (path == "/api/chat/stream"), "chat")
        .when(F.upper(method).isin("POST", "PUT", "PATCH", "DELETE") & F.startswith(path, F.lit("/api/admin")), "admin_mutation")
    )


def admit(times: list, recent: list, limit: int, window) -> tuple[list[bool], list]:
    """Which events, in order of time, are accepted; and the accepted ones that still count.

    Only accepted ones count; one exactly as old as the window still does.
    """
    out, held = [], deque(recent)
    for t in times:
        while held and not t - held[0] <= window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, list(held)


def _admit_rows(rows: pd.DataFrame, recent: list[float], limits: dict) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["ts", "event_id"], kind="stable")
    limit, window = limits[rows["request_class"].iloc[0]]
    seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
    rows["accepted"], recent = admit(seconds.tolist(), recent, limit, window)
    return rows[["event_id", "request_class", "identity", "ts", "accepted"]], recent


_WALKED = "piece int, session long, at long, event_id long, request_class string, identity string, ts timestamp, accepted boolean, recent array<long>"


def throttle(events: DataFrame, limits: dict | None = None) -> DataFrame:
    """Events (event_id, request_class, identity, ts) with ``accepted``, by a sliding log of each class and identity; without a time, accepted.

    After a pause longer than the window nothing counts any more, so events fall into sessions that are judged apart; one of no more events than the limit
    is accepted whole.  Rows are dealt by ranges of (class, identity, time), so that one identity lies in many tasks.  A session that
    goes on in the next range hands over the times that still count, at most the limit, in rounds: as many as a session has ranges.
    """
    used = limits or LIMITS
    table = lambda i, scale: F.create_map(*[F.lit(x) for name, pair in used.items() for x in (name, int(pair[i] * scale))])[F.col("request_class")]
    rows = events.where(F.col("request_class").isin(*used)).select("event_id", "request_class", "identity", F.col("ts").cast("timestamp").alias("ts"))
    order = [F.col("request_class"), F.asc_nulls_first("identity"), F.col("ts"), F.col("event_id")]
    dealt = rows.where("ts is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = store(dealt.withColumns({"piece": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))

    # where sessions begin: after another identity, or a pause; a range's first row follows the last one of the range before
    seen = F.struct("request_class", "identity", F.unix_micros("ts").alias("us"))
    ends = placed.groupBy("piece").agg(F.max_by(seen, "at").alias("last"))
    ends = ends.select(F.lead("piece").over(Window.orderBy("piece")).alias("piece"), "last").where("piece is not null")  # a row a range
    within = Window.partitionBy("piece").orderBy("at")
    before = F.coalesce(F.lag(seen).over(within), F.col("last"))
    cut = placed.join(F.broadcast(ends), "piece", "left").withColumn("_b", before)
    same = (F.col("_b.request_class") == F.col("request_class")) & F.col("_b.identity").eqNullSafe(F.col("identity")) & (F.unix_micros("ts") - F.col("_b.us") <= table(1, 1_000_000))
    cut = store(cut.withColumn("session", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(within)).drop("last", "_b"))
    sessions = cut.groupBy("piece", "session").agg(F.count(F.lit(1)).alias("n"), F.first(table(0, 1)).alias("_limit"))
    pieces = sessions.groupBy("piece").agg(F.max("session").alias("last"), F.min("session").alias("first"))
    following = pieces.select("piece", "last", *(F.lead(c).over(Window.orderBy("piece")).alias(f"_{c}") for c in ("piece", "first")))  # a row a range
    goes_on = store(following.where("_first = 0").select("piece", F.col("last").alias("session"), F.col("_piece").alias("next")))
    sessions = sessions.join(F.broadcast(goes_on), ["piece", "session"], "left")
    easy = F.col("next").isNull() & (F.col("n") <= F.col("_limit")) & (F.col("session") > 0)
    judged = cut.join(sessions.select("piece", "session", easy.alias("easy")), ["piece", "session"])
    none = F.lit(None).cast("array<long>")
    accepted = store(judged.where("easy").select("event_id", "request_class", "identity", "ts", F.lit(True).alias("accepted")))
    hard = store(judged.where("not easy").drop("easy"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with ``accepted``, and after a session a row of nulls with the times that still count."""
        key, recent = None, []

        def ended(like: pa.Schema) -> pa.RecordBatch:
            given = {"piece": key[0], "session": key[1], "recent": recent}
            return pa.record_batch([pa.array([given.get(f.name)], f.type) for f in like], schema=like)

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            out, ends = [], []
            shape = pa.schema([pa.field(f.name, f.type) for f in batch.schema if f.name != "recent"] + [pa.field("accepted", pa.bool_()), pa.field("recent", pa.list_(pa.int64()))])
            rows = zip(columns["piece"].to_pylist(), columns["session"].to_pylist(), columns["request_class"].to_pylist(), columns["ts"].cast(pa.int64()).to_pylist())
            for i, (piece, session, kind, t) in enumerate(rows):
                if (piece, session) != key:
                    if key is not None:
                        ends.append(ended(shape))
                    key, recent = (piece, session), columns["recent"][i].as_py() or []
                one, recent = admit([t], recent, used[kind][0], used[kind][1] * 1_000_000)
                out += one
            held = [columns[n] for n in shape.names[:-2]]
            yield pa.record_batch([*held, pa.array(out, pa.bool_()), pa.nulls(len(out), pa.list_(pa.int64()))], schema=shape)
            yield from ends
        if key is not None:
            yield ended(shape)

    def walked(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("piece", "session").sortWithinPartitions("piece", "session", "at")
        return store(ordered.select("piece", "session", "at", "event_id", "request_class", "identity", "ts", "recent").mapInArrow(walk, _WALKED))

    now = walked(hard.where("session > 0").withColumn("recent", none))
    while True:
        accepted = accepted.unionByName(now.where("at is not null").select(*accepted.columns))
        state = now.where("at is null").join(F.broadcast(goes_on), ["piece", "session"]).select(F.col("next").alias("piece"), "recent")  # a row a range
        if state.isEmpty():
            break
        now = walked(hard.where("session = 0").join(F.broadcast(state), "piece"))
    return accepted.unionByName(rows.where("ts is null").withColumn("accepted", F.lit(True)))


def stream_throttle(events: DataFrame, limits: dict | None = None) -> DataFrame:
    """The same over a stream: state of a key is its accepted times within the window, at most the limit.

    Rows are ordered within a batch; a row older than what an earlier batch held is judged when it comes.  Idle keys are forgotten.
    """
    used = limits or LIMITS

    def batch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        out, recent = _admit_rows(rows, list(state.get[0]) if state.exists else [], used)
        state.update((recent,))
        state.setTimeoutDuration(2000 * used[key[0]][1])
        yield out

    keyed = events.where(F.col("request_class").isin(*used)).groupBy("request_class", "identity")
    return keyed.applyInPandasWithState(batch, THROTTLED, "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
