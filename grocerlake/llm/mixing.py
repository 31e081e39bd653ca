"""Mixing sources to target weights by systematic sampling.

Each document expects ``target / source_size`` copies.  The expected copies are
summed up within a source, one random offset is added, and a document is
emitted once for each integer that the running sum crosses at it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unit_hash, word_count

#: Parts by hash of the document, within a source and class of size.
PARTS = 256


def source_targets(sizes: DataFrame, cycle: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with the ``target`` of each source.

    Sources in code point order, null last, weigh as ``cycle`` repeats.  They
    share ``share`` of all sizes by weight; a target stops at ``cap`` times its
    source's size and the excess is shared anew by weight among the others.
    That ends at a level L with target = min(cap * size, L * weight), which is
    read off the sources sorted by cap * size / weight.  The table has one row for
    each source; its order needs one task.
    """
    if share > cap or min(cycle) <= 0:
        raise ValueError("share must not exceed cap; weights must be positive")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(weights, ((F.col("_rank") - 1) % len(cycle) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("_one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_one", F.lit(1))
        .withColumn("_total", F.sum("source_size").over(whole) * float(share))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    )
    # the first source, in this order, that stays below its cap sets the level for all
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(whole)["_level"]
    return levels.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).select("source", "source_size", "target")


def _size_class(size: Column) -> tuple[Column, Column]:
    """Number of bits of a size and its three leading bits: classes of like sizes."""
    bits = F.length(F.bin(size))
    return bits, F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")


def mix_sources(docs: DataFrame, cycle: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """Add size, source_size, target, copies and taken to each document.

    Size is the number of words (null text: 0).  ``taken`` is copies * size;
    copies never exceed ``cap`` rounded up.  Documents of a source are taken in order of
    size class, hash of the id, size and id, so each class of sizes gets its share.
    All documents of a source expect the same copies, so the running sum at a
    document is its place times that rate; places come from counts of small
    parts, added up by source, and from the order within a part.

    The null source is a source.  Sources without words get no copies.  Rows with equal ids are
    sampled apart; which of two equal rows is taken twice is open, their sum
    is not.  Input columns named like the new ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", word_count(F.col("text")))
    bits, lead = _size_class(F.col("size"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = (
        sized.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .withColumn("_bits", bits)
        .withColumn("_lead", lead)
        .withColumn("_part", F.conv(F.substring(F.md5(id_text), 1, 2), 16, 10).cast("int"))
    )
    keys = ["_source", "_bits", "_lead", "_part"]
    parts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.first("source", ignorenulls=True).alias("source"))
    sources = parts.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    targets = source_targets(sources.select("source", "source_size"), cycle, share, cap)
    targets = targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    before = Window.partitionBy("_source").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(targets, "_source").select(*keys, "_start", "source_size", "target")
    own = Window.partitionBy(*keys).orderBy("size", "doc_id")
    place = F.col("_start") + F.col("_own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.col("_source")))
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return (
        placed.withColumn("_own", F.row_number().over(own))
        .join(starts, keys)
        .withColumn("copies", crossed.cast("int"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .drop(*keys, "_own", "_start")
    )


def emit_mix(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # size is counted once, before the rows are counted and ordered
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w, 2.0 * source_size AS cap FROM s
), l AS (
  SELECT *, ((SELECT 1.5 * sum(source_size) FROM s)::DOUBLE
    - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.w < a.cap / a.w), 0)::DOUBLE)
    / (SELECT sum(b.w) FROM w b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM w a
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS rate,
    (('0x' || substr(md5('mix-1:' || coalesce('s' || d.source, 'n')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), size >> greatest(length(bin(size)) - 3, 0)::INTEGER,
      substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  coalesce((floor(place * rate + u) - floor((place - 1) * rate + u)) * size, 0)::BIGINT AS taken
FROM p
"""
