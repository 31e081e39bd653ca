"""What the operators of this folder share: scratch tables, table reads, word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

_own_scratch: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in this process alone (``local``), a temporary folder of
    it takes its place; on a cluster its absence is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_scratch:
            _own_scratch.append(tempfile.mkdtemp(prefix="grocerlake-"))
        base = _own_scratch[0]
    return f"{base}/grocerlake-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Batches for Python of at most BATCH_ROWS rows: whole texts make the usual 10,000 some
    ten megabytes, which lie in the memory of both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it ran, and what
    follows reads files instead of repeating the work above.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> "F.Column":
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key) -> "F.Column":
    """A number in (0, 1) that only depends on the string ``key``: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def head64(digest) -> "F.Column":
    """The first eight bytes of a binary column as a signed big-endian number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _give_back() -> None:
    """Return freed memory to the system, which allocators otherwise keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work):
    """``work`` on a task's batches; the worker, which waits for the next task, gives back what it freed."""

    def run(batches):
        yield from work(batches)
        _give_back()

    return run


_held: dict = {}


def held(key, make=None):
    """``make()`` for ``key``, kept by the Python worker until another key is asked for.

    Workers outlive stages; so one holds the tables of one operator at a time.  Without ``make``, and with a key that
    nobody has, only what is held is let go.
    """
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            _give_back()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]
