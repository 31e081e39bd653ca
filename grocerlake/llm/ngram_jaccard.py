"""Exact n-gram Jaccard join by a token-group matrix.

A document is its set of distinct 5-word shingles.  Sets are read in a common order, rare
shingles first.  Of similar sets at most a fifth of the shingles are missing, so
among the first ones, that many and k more, they share k.  Sets are grouped by such a
shingle; the matrix tells which groups hold which shingles, and thus which groups a set can be similar to at all.
A group is opened by those sets only of which enough shingles are in the union of its members'.

Candidates are sought by short names of sets (the first 64 bits of the 128 that name one); sets whose short names are
equal by chance are told apart where sets are compared.  Equal sets are one set all along.  Links are reported as a spanning forest:
pairs that are connected already are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import CHUNK, LOWER, SPACE, chunks, mix, runs, span_hashes
from .common import head64, held, materialize, table, tidy
from .components import connected_components

N, PERCENT = 5, 80
#: Shingles put last in the order, as they occur often: the first ones by count.
#: The list only orders; shingles that it lacks are found all the same.
FREQUENT = 100_000
#: A shingle can be frequent if so many sets of a sample-free count block of this many shingles have it.
COUNT_BLOCK, COUNT_LEAST = 2_000_000, 4
#: Bits, as a power of two, of the table of sets to be compared: 8 MB at any size of data.
BIT_SLOTS = 26
#: Sets of a group that are compared in one cell, as queries and as members, and shingles of them (of a block of several sets, on average).
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024
QUERY_SHINGLES, MEMBER_SHINGLES = 1 << 20, 1 << 22
#: Groups with more than this share of all places in groups are dealt over several tasks.
HOT_SHARE = 1e-3
#: Groups of more sets are first linked through so many of them.
PIVOTS = 16


def shingle_sets(texts: list[bytes], n: int = N) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text.

    A-Z count as a-z; words are runs without ASCII white space.  Fewer words: one shingle
    of all of them; none: empty.
    """
    for _, group in chunks(texts):
        data = LOWER[np.frombuffer(b"\n".join(group), np.uint8)]
        begins = np.cumsum([0, *(len(g) + 1 for g in group)])
        starts, ends = runs(~SPACE[data])
        words = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        first = np.searchsorted(starts, begins)
        rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
        if len(words) >= n:
            rolled = words[: len(rolled)].copy()
            for k in range(1, n):
                rolled = mix(rolled) + words[k : k + len(rolled)]
            rolled = mix(rolled)
        for lo, hi in zip(first.tolist(), first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(rolled[lo : hi - n + 1])
            elif hi > lo:
                few = np.array([hi - lo], np.uint64)
                for k in range(lo, hi):
                    few = mix(few) + words[k : k + 1]
                yield mix(few)
            else:
                yield words[:0]


def set_id(s: np.ndarray) -> bytes:
    """One name for equal sets: 128 bits of two sums of spread hashes; never of the empty set."""
    one = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(s))
    two = np.add.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))))
    return mix(np.array([one, two], np.uint64)).astype(">u8").tobytes()


def short(name: bytes) -> int:
    return int.from_bytes(name[:8], "big", signed=True)


def least_overlap(size, percent: int = PERCENT):
    """Shingles that a similar set must share with one of ``size``."""
    return -(-percent * size // 100)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Half a megabyte of texts at a time, with the row of the first."""
    column = batch.column(at).cast(pa.large_binary())
    lo, size, out = 0, 0, []
    for i in range(len(column)):
        t = column[i].as_py() or b""
        if out and size + len(t) > CHUNK:
            yield lo, out
            lo, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield lo, out


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """Each row's set id and size, and counts of shingles that are frequent in some block of the table.

    Rows of documents have a null shingle.  Counts are of distinct texts of a task.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        kept, size, seen = [], 0, set()
        names = ["doc_id", "name", "size", "shingle"]

        def often():
            kinds, n_sets = np.unique(np.concatenate(kept), return_counts=True)
            keep = n_sets >= COUNT_LEAST
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.record_batch([none, pa.nulls(len(none), pa.binary()), pa.array(n_sets[keep].astype(np.int64)), pa.array(kinds[keep].view(np.int64))], names=names)

        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, texts in _texts(batch, 1):
                sids, sizes = [], []
                for s in shingle_sets(texts, n):
                    key = set_id(s) if len(s) else None
                    sids.append(key)
                    sizes.append(len(s))
                    if key is not None and key not in seen:
                        seen.add(key)
                        kept.append(s)
                        size += len(s)
                k = len(texts)
                yield pa.record_batch([ids[lo : lo + k], pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int64())], names=names)
                if size > COUNT_BLOCK:
                    yield often()
                    kept, size, seen = [], 0, set()
        if kept:
            yield often()

    return materialize(docs.mapInArrow(tidy(describe), "doc_id long, name binary, size long, shingle long"))


def _bits(rows: DataFrame) -> np.ndarray:
    """Bit table, of one size for all data, of (sid, doc_id); a bit set by chance costs time, not truth."""
    slot = F.col("sid").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(F.lit((1 << BIT_SLOTS) - 1))
    marked = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BIT_SLOTS - 6), np.int64)
    out[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    return out


def _is_marked(bits: np.ndarray, sid: int, doc_id: int | None) -> bool:
    slot = (sid ^ (doc_id or 0)) & ((1 << BIT_SLOTS) - 1)
    return bool(int(bits[slot >> 6]) >> (slot & 63) & 1)


def spare(size):
    """How many shingles more than one a set must share within the first ones, by size: every twentieth."""
    return size // 20


class _Order:
    """The common order: rare shingles by hash, then the frequent ones."""

    def __init__(self, frequent: np.ndarray):
        by_hash = np.argsort(frequent)
        self._sorted, self._rank = frequent[by_hash], by_hash
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, length: int) -> np.ndarray:
        if not len(self._sorted):
            return s[:length]
        maybe = np.flatnonzero(self._maybe[(s >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self._sorted, s[maybe]), len(self._sorted) - 1)
        found = self._sorted[at] == s[maybe]
        if not found.any():
            return s[:length]
        last, rank = maybe[found], self._rank[at[found]]
        rare = np.delete(s, last)
        return rare[:length] if len(rare) >= length else np.concatenate((rare, s[last[np.argsort(rank)]]))[:length]


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets; the component is the
    least doc_id reachable by links, the row's own included (null ids count for nothing).  Null, empty and
    blank texts have no shingles and link with nothing.  Every row, repeated
    ones too, is in the result once; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = _describe(rows, n)
    sets = described.where("shingle is null").select("doc_id", "name", "size")
    counted = described.where("shingle is not null").groupBy("shingle").agg(F.sum("size").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()  # at most FREQUENT numbers
    order = spark.sparkContext.broadcast(top["shingle"].to_numpy()[::-1].copy().view(np.uint64))

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, told = _Order(order.value), set()
        for batch in batches:
            for _, texts in _texts(batch, 0):
                firsts, owners = [], []
                for s in shingle_sets(texts, n):
                    name = set_id(s) if len(s) else None
                    if name is not None and name not in told:
                        told.add(name)
                        firsts.append(rank.prefix(s, len(s) - least_overlap(len(s), percent) + 1 + spare(len(s))))
                        owners.append(np.full(len(firsts[-1]), short(name), np.int64))
                if owners:
                    yield pa.record_batch([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.concatenate(owners))], names=["shingle", "sid"])

    def of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by shingle and set those whose shingle has another set; repeated rows once."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:  # the row before may belong to this batch's first shingle
                shingle, sid = np.append(last[0], shingle), np.append(last[1], sid)
            fresh = np.ones(len(shingle), bool)
            fresh[1:] = (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1])
            shingle, sid = shingle[fresh], sid[fresh]
            like_next = np.append(shingle[1:] == shingle[:-1], False)
            like_last = np.append(False, shingle[1:] == shingle[:-1])
            if last is not None:
                like_last[0] = last[2]
            keep = like_next | like_last
            last = (shingle[-1:], sid[-1:], bool(like_last[-1]))
            keep[-1] = False  # told with the next batch
            yield pa.record_batch([pa.array(shingle[keep]), pa.array(sid[keep])], names=["shingle", "sid"])
        if last is not None and last[2]:
            yield pa.record_batch([pa.array(last[0]), pa.array(last[1])], names=["shingle", "sid"])

    firsts = rows.select("text").mapInArrow(tidy(first_ones), "shingle long, sid long")
    together = firsts.repartition("shingle").sortWithinPartitions("shingle", "sid")
    shared = materialize(together.mapInArrow(tidy(of_several), "shingle long, sid long"))

    # groups: by the shingle that most other sets have in common with this one
    named = sets.where("name is not null").groupBy("name").agg(F.first("size").alias("size"), F.min("doc_id").alias("least_id"))
    sizes = named.withColumn("sid", head64(F.col("name")))
    counts = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    group_of = shared.join(counts, "shingle").groupBy("sid").agg(F.max(F.struct("c", "shingle"))["shingle"].alias("own")).join(sizes.select("sid", "size"), "sid")
    group_of = materialize(group_of)
    reach = group_of.groupBy("own").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).withColumnRenamed("own", "g")
    placed = materialize(shared.join(group_of, "sid"))
    matrix = placed.groupBy("shingle", F.col("own").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    # a set itself does not count in its own group's row
    meets = placed.join(matrix, "shingle").where((F.col("own") != F.col("g")) | (F.col("m") > 1))
    met = meets.groupBy("sid", "g", "size", "own").agg(F.count(F.lit(1)).alias("c")).join(reach, "g")
    least = F.ceil(F.col("size") * percent / 100)
    asks = met.where((F.col("c") > F.floor(least / 20)) & (least <= F.col("hi")) & (F.col("lo") * percent <= F.col("size") * 100))
    asks = materialize(asks.select("sid", "g", "own", "size"))
    # of two groups the one with the smaller number asks; who asks nowhere is linked with none
    members = group_of.join(asks.select("sid").distinct(), "sid").select("sid", F.col("own").alias("g"), "size")
    queries = asks.where("own <= g").select("sid", "g", "size")
    in_groups = materialize(queries.unionByName(members).groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    least_hot = max(float(MEMBER_BLOCK), (in_groups.agg(F.sum("n")).head()[0] or 0) * HOT_SHARE)
    hot = materialize(in_groups.where(F.col("n") > least_hot).select("g", F.ceil(F.col("n") / least_hot).cast("int").alias("salts")))

    def by_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
        """Join rows (g, sid, ...) with rows of one per g; of hot groups, at most 1 / HOT_SHARE, the rows are dealt by set."""
        few, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))
        dealt = rows.join(few, "g", "left").withColumn("_s", F.pmod(F.xxhash64("sid"), salts).cast("int")).drop("salts")
        copies = groups.join(few, "g", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return dealt.join(copies, ["g", "_s"], how).drop("_s")

    members = materialize(by_group(members, queries.select("g").distinct()).select("sid", "g", "size"))

    # the sets that take part, from one text of each
    # (texts that the table holds for others by chance go no further than the join with the cells)
    takes_part = queries.select("sid").unionByName(members.select("sid")).distinct()
    bits = spark.sparkContext.broadcast(_bits(takes_part.join(sizes, "sid").select("sid", F.col("least_id").alias("doc_id"))))

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

    spelt = materialize(rows.mapInArrow(tidy(spell), "sid long, name binary, shingles binary"))

    # large groups: link their sets with a few of them, then ask only for what is not in the main part
    everyone = queries.unionByName(members).distinct()
    big = materialize(everyone.groupBy("g").count().where(F.col("count") > MEMBER_BLOCK).select("g"))
    links = None
    if not big.isEmpty():
        in_big = by_group(everyone, big)
        # a pivot of each hash slot, so that no task orders a group
        slot = F.pmod(F.xxhash64("sid"), F.lit(PIVOTS)).alias("_slot")
        pivots = by_group(members, big).groupBy("g", slot).agg(F.min(F.struct(F.xxhash64(F.lit(1), "sid").alias("h"), "sid", "size")).alias("p")).select("p.sid", "g", "p.size")
        links = materialize(_compare(in_big, materialize(pivots), spelt, percent, by_group))
        parts = connected_components(links)
        part_of = parts.select(head64(F.col("node")).alias("sid"), head64(F.col("component")).alias("part")).distinct()
        known = materialize(in_big.join(part_of, "sid", "left").withColumn("part", F.coalesce("part", "sid")))
        main = known.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "part"))["part"].alias("main"))
        left = by_group(known, main).where("part <> main").select("sid", "g", "size")
        queries = by_group(queries, big, "left_anti").unionByName(left)
        members = by_group(members, big, "left_anti").unionByName(in_big.select("sid", "g", "size"))
    found = _compare(queries, members, spelt, percent, by_group)
    links = materialize(found if links is None else found.unionByName(links))

    parts = connected_components(links)
    in_part = named.select("name", "least_id").join(parts.withColumnRenamed("node", "name"), "name", "left").withColumn("part", F.coalesce("component", "name"))
    least = in_part.groupBy("part").agg(F.min("least_id").alias("component_id"))
    of_set = in_part.join(least, "part").select("name", "component_id")
    linked = sets.where("name is not null").join(of_set, "name").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    empty = sets.where("name is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def _compare(queries: DataFrame, members: DataFrame, spelt: DataFrame, percent: int, by_group: Callable) -> DataFrame:
    """Links (a, b) between the queries and the members (sid, g, size) of each group, as forests of cells.

    A cell is a block of a group's queries and a block of its members; a row goes
    to each cell of its block, so no cell holds more than two blocks.  Blocks are bounded in sets and in shingles.
    """

    def blocks(df: DataFrame, sets: int, shingles: int, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / sets), F.ceil(F.sum("size") / shingles)).cast("int")
        return df.groupBy("g").agg(n.alias(name))

    both = materialize(blocks(queries, QUERY_BLOCK, QUERY_SHINGLES, "nq").join(blocks(members, MEMBER_BLOCK, MEMBER_SHINGLES, "nm"), "g"))
    part = lambda k: F.pmod(F.xxhash64("sid", "g"), F.col(k)).cast("int")
    asked = by_group(queries, both).select("g", "sid", F.lit(True).alias("query"), part("nq").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"))
    offered = by_group(members, both).select("g", "sid", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"), part("nm").alias("j"))
    cells = asked.unionByName(offered).join(spelt, "sid").select(F.xxhash64("g", "i", "j").alias("cell"), "g", "i", "j", "query", "name", "shingles")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out(found):
            return pa.record_batch([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            keys = list(zip(*(columns[k].to_pylist() for k in (1, 2, 3))))
            for i, k in enumerate(keys):
                if k != key:
                    if found := cell_links(rows, percent):
                        yield out(found)
                    key, rows = k, []
                rows.append((columns[4][i].as_py(), columns[5][i].as_py(), np.frombuffer(columns[6][i].as_buffer(), np.uint64)))
        if found := cell_links(rows, percent):
            yield out(found)

    ordered = cells.repartition("cell").sortWithinPartitions("cell", "g", "i", "j", "query", "name")
    return ordered.mapInArrow(tidy(links_of), "a binary, b binary")


def cell_links(rows: list[tuple[bool, bytes, np.ndarray]], percent: int = PERCENT) -> list[tuple[bytes, bytes]]:
    """Exact links of a cell's queries with its members, without those that others imply."""
    members = [(sid, s) for is_query, sid, s in rows if not is_query]
    asking = [(sid, s) for is_query, sid, s in rows if is_query]
    if not members or not asking or (len(members) == len(asking) == 1 and members[0][0] == asking[0][0]):
        return []
    sizes = np.array([len(s) for _, s in members], np.int64)
    flat, owner = np.concatenate([s for _, s in members]), np.repeat(np.arange(len(members)), sizes)
    by_shingle = np.argsort(flat, kind="stable")
    owner = owner[by_shingle]
    union, first = np.unique(flat[by_shingle], return_index=True)
    count = np.diff(np.append(first, len(flat)))
    place = {sid: k for k, sid in enumerate(dict.fromkeys([sid for sid, _ in members] + [sid for sid, _ in asking]))}
    label = np.arange(len(place))
    of_member = np.array([place[sid] for sid, _ in members])
    found = []
    for sid, s in asking:
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        # the union bounds the overlap with every member
        if len(at) < least_overlap(len(s), percent):
            continue
        open_to = label[of_member] != label[place[sid]]
        if not open_to.any():
            continue
        n = count[at]
        upto = np.cumsum(n)
        hits = owner[np.repeat(first[at] - (upto - n), n) + np.arange(upto[-1])]
        overlap = np.bincount(hits, minlength=len(members))
        for k in np.flatnonzero(open_to & (100 * overlap >= percent * (len(s) + sizes - overlap))):
            a, b = label[place[sid]], label[of_member[k]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                found.append((sid, members[k][0]))
    return found


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: hash(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])))
    WHEN len(words) > 0 THEN [hash(words)] ELSE [] END AS set FROM w
), t AS MATERIALIZED (SELECT doc_id, unnest(set) AS g FROM s),
few AS MATERIALIZED (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
u AS MATERIALIZED (FROM t SEMI JOIN few USING (g)),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
h AS MATERIALIZED (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.set) + len(b.set) - n)),
l AS MATERIALIZED (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""
