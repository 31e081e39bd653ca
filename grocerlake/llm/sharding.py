"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every key scores every shard and goes to its best one, so the place of a record
depends on nothing but its key, the shards and their weights.  A further shard
takes over only records it scores best for; nothing moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unit_hash

#: Parts of a shard whose rows are numbered apart; bounds one sorting task.
SLOT_PARTS = 256


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard), one for each shard; the smallest wins.

    The score is an exponential variate of the shard's rate, ``-ln(u) / w``, so
    a shard gets its weight's share.  Equal scores go to the smaller number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    rates = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(
            (-F.log(unit_hash(F.concat(key, F.lit(":"), s.cast("string")))) / F.element_at(rates, s + 1)).alias("score"),
            s.alias("shard"),
        ),
    )


def rendezvous_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add ``shard``, gapless ``slot`` in it and, on request, ``grown_shard``.

    ``grown_shard`` is where a row would go with one more shard of
    ``grown_weight``.  Slots are numbered in order of the hashed part of a key and the
    key: rows of a shard are counted by part, and each part numbers its own rows after
    the rows of the parts before it, so that no task holds a whole shard.

    Null keys count as one key, the empty string.  Rows with equal keys share
    a shard and get slots of their own, in any order.  Columns of ``df`` named
    like the new ones are replaced.  An empty table gives an empty table.
    """
    all_weights = [*weights, *([grown_weight] if grown_weight is not None else [])]
    df = df.drop("shard", "slot", "grown_shard")
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scored = df.withColumn("_scores", shard_scores(text_key, all_weights)).withColumn(
        "shard", F.array_min(F.slice("_scores", 1, len(weights)))["shard"]
    )
    if grown_weight is not None:
        scored = scored.withColumn("grown_shard", F.array_min("_scores")["shard"])
    scored = scored.drop("_scores").withColumn("_part", F.floor(unit_hash(text_key) * SLOT_PARTS).cast("int"))
    # at most shards x SLOT_PARTS rows
    sizes = scored.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_part").orderBy(key)
    numbered = scored.withColumn("_own", F.row_number().over(own))
    return numbered.join(F.broadcast(starts), ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_own") - 1).drop("_part", "_own", "_start")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents with size, checksum, shard, slot and the shard after growth by one.

    A null text has no bytes: size 8, checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rendezvous_shards(keyed, "doc_id", [1.0] * shards, 1.0)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The checksum: a byte at a time over the table of the reflected polynomial 0xEDB88320.
OP8_SQL = """
WITH RECURSIVE step(b, k, v) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc(t) AS (SELECT list(v ORDER BY b) FROM step WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), sized AS (
  SELECT r, doc_id, octet_length(encode(text))::BIGINT + 8 AS size, hex(encode(text)) AS h FROM d
), sums AS (
  SELECT r, doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, (length(h) // 2)::BIGINT),
      lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a & 255, b) + 1)::BIGINT])), 4294967295) AS text_crc32
  FROM sized, crc
), scores AS (
  SELECT r, s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT AS v
  FROM d, range(25) g(s)
), best AS (
  SELECT r, arg_max(s, v) FILTER (WHERE s < 24)::INTEGER AS shard, arg_max(s, v)::INTEGER AS grown_shard FROM scores GROUP BY r
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    floor((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * 256), doc_id) - 1 AS slot,
  grown_shard
FROM sums JOIN best USING (r)
"""
