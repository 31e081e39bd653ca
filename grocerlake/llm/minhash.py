"""MinHash near-dedup: minima, bands, verified signatures, full sets, alternating stars.

A document is its set of distinct 5-word shingles; equal sets are one all along.  Of each set the minima under MINIMA universal hash functions are kept.
Sets with equal minima in a band share a bucket.  Every set of a bucket is held against the bucket's first one; a pair
of which enough minima agree is confirmed on full sets.  What is not joined with its bucket's first set in this way is
then held against the bucket's other sets, in blocks, and buckets too large for that are cut by a second band, as pairs
that are similar share many.  Sets that agree there in several buckets are confirmed in one group of what hangs together.  A linked pair is missed when no band agrees, or too few minima: below one in 10^9.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import head64, held, materialize, table, tidy
from .components import connected_components
from .ngram_jaccard import MEMBER_BLOCK, N, OP2_SQL, QUERY_BLOCK, _bits, _compare, _is_marked, _texts, set_id, shingle_sets, short

PERCENT = 85
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Chance that a pair that links has fewer equal minima than are asked for.
MISSED = 1e-9
#: Groups with more than this share of all rows in groups are dealt over several tasks.
HOT_SHARE = 1e-3
#: Buckets with more comparisons than this are cut by a second band.
SPLIT_PAIRS = 1 << 24
#: Shingles hashed at a time.
BLOCK = 1 << 17
_RNG = np.random.default_rng(13)
_A = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def least_agreement(percent: int = PERCENT, missed: float = MISSED) -> int:
    """Minima that must agree: with a similarity of ``percent`` fewer do with a chance below ``missed``."""
    p, tail = percent / 100, 0.0
    for m in range(MINIMA + 1):
        tail += comb(MINIMA, m) * p**m * (1 - p) ** (MINIMA - m)
        if tail > missed:
            return m
    return MINIMA


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (row a set, none empty) under multiply-shift hashing: the upper 32 bits of a * x + b."""
    out = np.full((len(sets), MINIMA), 0xFFFFFFFF, np.uint32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(flat), BLOCK):
        part, of = flat[lo : lo + BLOCK], owner[lo : lo + BLOCK]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for i in range(MINIMA):
            low = np.minimum.reduceat((part * _A[i] + _B[i]) >> np.uint64(32), first).astype(np.uint32)
            out[of[first], i] = np.minimum(out[of[first], i], low)
    return out


def _describe(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, name, size, minima) of each row; minima of the first row of a set in a task, null for others."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        told = set()
        for batch in batches:
            ids = batch.column(0)
            for lo, texts in _texts(batch, 1):
                names, sizes, fresh, sets = [], [], [], []
                for i, s in enumerate(shingle_sets(texts, n)):
                    name = set_id(s) if len(s) else None
                    names.append(name)
                    sizes.append(len(s))
                    if name is not None and name not in told:
                        told.add(name)
                        fresh.append(i)
                        sets.append(s)
                found = iter(signatures(sets).view(np.int32)) if sets else iter(())
                fresh = set(fresh)
                minima = [next(found) if i in fresh else None for i in range(len(texts))]
                yield pa.record_batch([ids[lo : lo + len(texts)], pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(minima, pa.list_(pa.int32()))], names=["doc_id", "name", "size", "minima"])

    return materialize(rows.mapInArrow(tidy(describe), "doc_id long, name binary, size long, minima array<int>"))


def band_keys(minima: Column) -> Column:
    """One 64-bit key a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(minima, b * ROWS + 1, ROWS)))


def agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _hot(groups: DataFrame) -> DataFrame:
    """(g, salts) of those of the groups (g, n) that have so many rows that they are dealt: at most 1 / HOT_SHARE."""
    least = max(float(MEMBER_BLOCK), (groups.agg(F.sum("n")).head()[0] or 0) * HOT_SHARE)
    return materialize(groups.where(F.col("n") > least).select("g", F.ceil(F.col("n") / least).cast("int").alias("salts")))


def _dealer(groups: DataFrame) -> Callable:
    """A join of rows (g, sid, ...) with rows of one per g, where the rows of groups that are hot in (g, n) are dealt by set."""
    hot = _hot(groups)

    def join(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
        few, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))
        dealt = rows.join(few, "g", "left").withColumn("_s", F.pmod(F.xxhash64("sid"), salts).cast("int")).drop("salts")
        copies = others.join(few, "g", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return dealt.join(copies, ["g", "_s"], how).drop("_s")

    return join


def _shared(entries: DataFrame) -> DataFrame:
    """Entries (g, band, sid) of buckets with several sets, with the first set of the bucket."""
    buckets = entries.groupBy("g").agg(F.min("sid").alias("rep"), F.max("sid").alias("last"), F.count(F.lit(1)).alias("n"))
    buckets = materialize(buckets.where("rep <> last").drop("last"))
    return materialize(_dealer(buckets)(entries, buckets.drop("n")))


def _unlike(shared: DataFrame, part_of: DataFrame) -> DataFrame:
    """Entries (g, band, sid, part) of buckets that lie in several parts, with the part that most are in as ``main`` and whether the bucket is ``large``."""
    known = shared.join(part_of, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    known = materialize(known.select("g", "band", "sid", "part"))
    by_part = known.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"))
    buckets = by_part.groupBy("g").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("n"))
    rest = F.col("n") - F.col("m.c")
    buckets = materialize(buckets.where(rest > 0).select("g", "n", F.col("m.part").alias("main"), (rest * F.col("n") > SPLIT_PAIRS).alias("large")))
    return materialize(_dealer(buckets)(known, buckets.drop("n")))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Cells of rows sorted by (g, i, j): g, and arrays of query, sid, part and minima."""
    pieces, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        minima = batch.column(6).flatten().to_numpy().reshape(len(key), MINIMA)
        columns = [batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), batch.column(5).to_numpy(), minima]
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            now = tuple(key[lo])
            if pieces and now != last:
                yield last[0], *(np.concatenate(c) for c in zip(*pieces))
                pieces = []
            pieces.append([c[lo:hi] for c in columns])
            last = now
    if pieces:
        yield last[0], *(np.concatenate(c) for c in zip(*pieces))


def cell_parts(query: np.ndarray, part: np.ndarray, minima: np.ndarray, least: int) -> np.ndarray:
    """For rows of a cell that have one of the other kind, in another part, of which ``least`` minima agree, a row that they hang together with through such pairs; -1 for others."""
    label, open_ = np.arange(len(query)), np.zeros(len(query), bool)
    asking, offered = np.flatnonzero(query), np.flatnonzero(~query)
    step = max(1, 4096 // max(1, len(offered)))
    for lo in range(0, len(asking) if len(offered) else 0, step):
        q = asking[lo : lo + step]
        alike = (minima[q][:, None, :] == minima[offered][None, :, :]).sum(axis=2) >= least
        alike &= part[q][:, None] != part[offered][None, :]
        for i in np.flatnonzero(alike.any(axis=1)).tolist():
            found = np.append(offered[alike[i]], q[i])
            open_[found] = True
            joined = np.unique(label[found])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return np.where(open_, label, -1)


def cell_agreement(query: np.ndarray, part: np.ndarray, minima: np.ndarray, least: int) -> np.ndarray:
    """Which rows of a cell have one of the other kind, in another part, of which ``least`` minima agree."""
    return cell_parts(query, part, minima, least) >= 0


def _agreeing(unlike: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(g, query, sid, near) of the sets of buckets of which enough minima agree with those of a set in another part.

    Queries are sets outside the bucket's main part; they meet all sets of it, in cells of a block of each.  No pair is put out: ``near`` is one set for all that hang
    together in a cell through such pairs.
    """
    queries, members = unlike.where("part <> main"), unlike
    count = lambda df, size, name: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    both = materialize(count(queries, QUERY_BLOCK, "nq").join(count(members, MEMBER_BLOCK, "nm"), "g"))
    join = _dealer(both.select("g", F.col("n_nm").alias("n")))
    place = lambda k: F.pmod(F.xxhash64("sid", "g"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asked = join(queries, both).select("g", place("nq").alias("i"), every("nm").alias("j"), F.lit(True).alias("query"), "sid", "part")
    offered = join(members, both).select("g", every("nq").alias("i"), place("nm").alias("j"), F.lit(False).alias("query"), "sid", "part")
    cells = asked.unionByName(offered).join(sets.select("sid", "minima"), "sid").select("g", "i", "j", "query", "sid", "part", "minima")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, query, sid, part, minima in _whole_cells(batches):
            found = cell_parts(query, part, minima, least)
            open_ = found >= 0
            if open_.any():
                yield pa.record_batch([pa.array(np.full(open_.sum(), g)), pa.array(query[open_]), pa.array(sid[open_]), pa.array(sid[found[open_]])], names=["g", "query", "sid", "near"])

    ordered = cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return materialize(ordered.mapInArrow(tidy(look), "g long, query boolean, sid long, near long"))


def _once(open_: DataFrame) -> DataFrame:
    """(g, query, sid) of the rows (g, query, sid, near), where what hangs together is one group in place of its many buckets, so that a set is spelt once and not once a bucket.

    Such a group holds every pair that its buckets held.  More than MEMBER_BLOCK sets that hang together stay in their buckets.
    """
    whole = connected_components(open_.select(F.col("sid").alias("a"), F.col("near").alias("b")))
    small = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MEMBER_BLOCK).select("component")
    group_of = whole.join(small, "component").select(F.col("node").alias("sid"), F.xxhash64(F.lit("near"), "component").alias("own"))
    return materialize(open_.join(group_of, "sid", "left").select(F.coalesce("own", "g").alias("g"), "query", "sid").distinct())


def _spell(rows: DataFrame, taking_part: DataFrame, n: int) -> DataFrame:
    """(sid, name, shingles) of the sets (sid, least_id) that take part, from one text each; by chance of a few more."""
    bits = rows.sparkSession.sparkContext.broadcast(_bits(taking_part.select("sid", F.col("least_id").alias("doc_id"))))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in _texts(batch, 1):
                found = []
                for i, s in enumerate(shingle_sets(texts, n)):
                    name = set_id(s) if len(s) else None
                    if name is not None and name not in told and _is_marked(bits.value, short(name), ids[lo + i]):
                        told.add(name)
                        found.append((short(name), name, s.tobytes()))
                columns = zip(*found) if found else [[]] * 3
                yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["sid", "name", "shingles"])

    return materialize(rows.mapInArrow(tidy(spell), "sid long, name binary, shingles binary"))


def _confirm(rows: DataFrame, sets: DataFrame, queries: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between names of sets, of queries with members (g, sid) of their group, on full sets."""
    about = sets.select("sid", "size", "least_id")
    queries, members = materialize(queries.join(about, "sid")), materialize(members.join(about, "sid"))
    both = queries.unionByName(members)
    spelt = _spell(rows, both.select("sid", "least_id").distinct(), n)
    join = _dealer(materialize(both.groupBy("g").agg(F.count(F.lit(1)).alias("n"))))
    return materialize(_compare(queries.select("g", "sid", "size"), members.select("g", "sid", "size"), spelt, percent, join))


def minhash_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets; the component is the least doc_id
    reachable by links, the row's own included (null ids count for nothing).  ``kept`` is whether that is the row's own; of rows with equal ids all are, and of rows
    without ids those in whose component no row has one.  Null, empty and blank texts have no shingles and link with nothing.
    Every row, repeated ones too, is in the result once; other columns are ignored.
    """
    least = least_agreement(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = _describe(rows, n)
    sets = described.where("name is not null").groupBy("name").agg(F.first("size").alias("size"), F.min("doc_id").alias("least_id"), F.first("minima", ignorenulls=True).alias("minima"))
    sets = materialize(sets.withColumn("sid", head64(F.col("name"))))
    shared = _shared(sets.select(F.posexplode(band_keys(F.col("minima"))).alias("band", "g"), "sid"))

    # each set with the first one of its buckets
    pairs = materialize(shared.where("sid <> rep").select(F.col("rep").alias("g"), "sid").distinct())
    join = _dealer(materialize(pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))))
    first_ones = pairs.select("g").distinct()
    its = first_ones.join(sets.select(F.col("sid").alias("g"), F.col("minima").alias("its")), "g")
    verified = join(pairs.join(sets.select("sid", "minima"), "sid"), its).where(agreement(F.col("minima"), F.col("its")) >= least)
    verified = materialize(verified.select("g", "sid"))
    links = _confirm(rows, sets, verified, verified.select("g", F.col("g").alias("sid")).distinct(), n, percent)

    # of each bucket what is in another part than most of it
    unlike = _unlike(shared, _parts(links))
    large = unlike.where("large")
    if not large.isEmpty():
        again = large.join(sets.select("sid", "minima"), "sid").select("sid", F.col("g").alias("_g"), F.col("band").alias("_band"), F.posexplode(band_keys(F.col("minima"))).alias("band", "key"))
        again = _shared(again.where("band <> _band").select(F.xxhash64("_g", "band", "key").alias("g"), "band", "sid"))
        unlike = unlike.where("not large").unionByName(_unlike(again, _parts(links)))
    open_ = _agreeing(unlike, sets, least)
    if not open_.isEmpty():
        groups = _once(open_)
        ask = lambda query: groups.where(F.col("query") == query).select("g", "sid")
        links = materialize(links.unionByName(_confirm(rows, sets, ask(True), ask(False), n, percent)))

    parts = connected_components(links)
    in_part = sets.select("name", "least_id").join(parts.withColumnRenamed("node", "name"), "name", "left").withColumn("part", F.coalesce("component", "name"))
    least_ids = in_part.groupBy("part").agg(F.min("least_id").alias("component_id"))
    of_set = materialize(in_part.join(least_ids, "part").select("name", "component_id"))
    linked = described.where("name is not null").join(of_set, "name").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    empty = described.where("name is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _parts(links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return materialize(parts.select(head64(F.col("node")).alias("sid"), head64(F.col("component")).alias("part")).distinct())


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


OP13_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP2_SQL.replace('>= 80 *', f'>= {PERCENT} *')})"
