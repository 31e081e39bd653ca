"""A Merkle manifest of a dataset, level by level with self-joins of siblings.

Rows become leaves, ordered in their group; every run of ``fanout`` nodes has one parent.  A level is built by an equijoin of nodes with the
computed indices of their siblings (index XOR 1 in a binary tree, slots shifted by 1, 2, ... otherwise), which gives each node its siblings;
the rows of slot zero emit the parents.  The same siblings are the steps of the proofs, handed down from the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "array<struct<slot:int,siblings:binary>>"


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hexadecimal sha256 of the values, concatenated."""
    return F.sha2(F.concat(*values), 256)


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def sibling_indices(idx: Column, size: Column, fanout: int) -> Column:
    """Array of the indices of a node's siblings among ``size`` nodes of its level."""
    if fanout == 2:
        shifted = F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = F.pmod(idx, F.lit(fanout))
        shifted = F.array(*[idx - slot + F.pmod(slot + offset, F.lit(fanout)) for offset in range(1, fanout)])
    return F.filter(shifted, lambda i: i < size)


def number_rows(df: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """Add ``idx`` (from 0 in each group), ``size`` (rows of the group) and ``g`` (number of the group, from 0), null and empty first.

    Groups ascend by their value, rows by ``order``, nulls first.  Rows are dealt by ranges of that order, those that tie in any way, so that neither a large group
    nor equal rows share a task; counts of a range and a group, which are as many as ranges and groups, give what lies before.
    """
    keys = [F.asc_nulls_first(name) for name in ([group] if group else []) + order] + [F.col("_tie")]
    dealt = df.withColumn("_tie", F.rand(0)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_group", field(F.col(group)) if group else F.lit("")))
    part = F.shiftright("_at", 33).alias("_part")
    name = F.first(group) if group else F.lit("")
    runs = placed.groupBy("_group", part).agg(name.alias("_name"), F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row a range in each of these windows
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_group", "_part", "_name", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    if group:
        runs = materialize(runs)
        ranks = number_rows(runs.select("_group", "_name").distinct().withColumnRenamed("_group", "_key"), ["_name"])
        runs = runs.join(ranks.select(F.col("_key").alias("_group"), F.col("idx").alias("g")), "_group")
    else:
        runs = runs.withColumn("g", F.lit(0).cast("long"))
    numbered = placed.withColumn("_part", part).join(runs.drop("_name"), ["_group", "_part"])
    return numbered.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_part", "_group")


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Build the trees of (g, idx, size, node), ``node`` a binary digest, one tree for each g.

    Returns the levels (g, idx, siblings), from the leaves up, and (g, node, height) of the tops; a lone node is its own top, of height 0.
    """
    tops, levels, height = nodes.where("size = 1").select("g", "node", F.lit(0).alias("height")), [], 0
    nodes = nodes.where("size > 1")
    while not nodes.isEmpty():
        asked = nodes.select("g", "idx", "size", "node", F.explode_outer(sibling_indices(F.col("idx"), F.col("size"), fanout)).alias("sibling"))
        there = nodes.select("g", F.col("idx").alias("sibling"), F.col("node").alias("its"))
        found = F.array_sort(F.collect_list(F.when(F.col("its").isNotNull(), F.struct("sibling", "its"))))
        met = asked.join(there, ["g", "sibling"], "left").groupBy("g", "idx").agg(F.first("size").alias("size"), F.first("node").alias("node"), F.array_join(F.transform(found, lambda s: F.hex(s["its"])), "").alias("siblings"))
        level = materialize(met.select("g", "idx", "size", "node", F.unhex("siblings").alias("siblings")))
        levels.append(level.select("g", "idx", "siblings"))
        height += 1
        # slot zero is the left end of its run
        parents = level.where(F.pmod("idx", F.lit(fanout)) == 0).select(
            "g", F.expr(f"idx div {fanout}").alias("idx"), F.ceil(F.col("size") / fanout).cast("long").alias("size"), F.unhex(digest(hexed(F.col("node")), hexed(F.col("siblings")))).alias("node")
        )
        tops = tops.unionByName(parents.where("size = 1").select("g", "node", F.lit(height).alias("height")))
        nodes = parents.where("size > 1")
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Hand (g, height, top, path) down to the leaves: (g, idx, top, path), the path from the leaf up, then the one given."""
    at = lambda h: tops.where(F.col("height") == h).select("g", F.lit(0).cast("long").alias("idx"), "top", "path")
    out = at(len(levels))
    for h in range(len(levels) - 1, -1, -1):
        above = out.withColumnRenamed("idx", "_above")
        slot = F.pmod("idx", F.lit(fanout)).cast("int").alias("slot")
        below = levels[h].withColumn("_above", F.expr(f"idx div {fanout}")).join(above, ["g", "_above"])
        below = below.select("g", "idx", "top", F.concat(F.array(F.struct(slot, F.col("siblings"))), F.col("path")).alias("path"))
        out = below.unionByName(at(h))
    return out


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and its path give."""

    def up(node: Column, step: Column) -> Column:
        text = hexed(step["siblings"])
        return digest(F.substr(text, F.lit(1), step["slot"] * 64), node, F.substr(text, step["slot"] * 64 + 1))

    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: hexed(s["siblings"])), ""))


def manifest(leaves: DataFrame, group: str, order: str, fanout: int = FANOUT) -> DataFrame:
    """Rows of ``leaves``, which has ``leaf`` (binary) and may have more columns, with ``subroot`` and ``root`` (hexadecimal) and ``path``.

    Leaves of a group ascend by ``order``, nulls first, equal ones by leaf; the tops of the groups, in the order of the group's value with null first, are the leaves of one
    tree more.  Strings are compared by bytes.  An empty table gives no rows.  The columns are carried as one, so their names may clash with those in use here.
    """
    rows = leaves.select(F.col(group).alias("_of"), F.col(order).alias("_by"), F.col("leaf").alias("_node"), F.struct("*").alias("_row"))
    numbered = materialize(number_rows(rows, ["_by", "_node"], "_of").drop("_of", "_by"))
    levels, tops = climb(numbered.select("g", "idx", "size", F.col("_node").alias("node")), fanout)
    tops = materialize(tops)
    groups = F.lit(tops.count()).cast("long")
    upper_levels, root = climb(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), groups.alias("size"), "node"), fanout)
    ends = descend(upper_levels, root.select("g", "height", F.col("node").alias("top"), F.array().cast(_NO_PATH).alias("path")), fanout)
    ends = ends.select(F.col("idx").alias("g"), F.col("top").alias("root"), "path")
    tops = materialize(tops.join(ends, "g").select("g", "height", F.struct(F.col("node").alias("subroot"), "root").alias("top"), "path"))
    # the leaves' own level: the runs' parents hand down, a lone leaf has the path of its top
    lone = tops.where("height = 0").select("g", F.lit(0).cast("long").alias("_above"), "top", "path")
    above = descend(levels[1:], tops.where("height > 0").withColumn("height", F.col("height") - 1), fanout).withColumnRenamed("idx", "_above")
    low = numbered.join(levels[0], ["g", "idx"], "left") if levels else numbered.withColumn("siblings", F.lit(None).cast("binary"))
    out = low.withColumn("_above", F.expr(f"idx div {fanout}")).join(above.unionByName(lone), ["g", "_above"])
    slot = F.pmod("idx", F.lit(fanout)).cast("int").alias("slot")
    step = F.when(F.col("siblings").isNotNull(), F.array(F.struct(slot, "siblings"))).otherwise(F.array().cast(_NO_PATH))
    out = out.select("_row", hexed(F.col("top.subroot")).alias("_subroot"), hexed(F.col("top.root")).alias("_root"), F.concat(step, "path").alias("_path"))
    own = [F.col("_row")[name].alias(name) for name in leaves.columns if name not in ("subroot", "root", "path")]
    return out.select(*own, F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by lang, and what the proofs say of rows of which every third had its text lower-cased.

    A row without a doc_id has no remainder and is left as it is.  Repeated rows are leaves of their own.
    """
    docs = table(spark, sf_dir, "documents")
    values = {name: field(F.col(name)) for name in FIELDS}
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    lowered = field(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    leaf = digest(*values.values())
    changed = F.when(tampered, digest(*{**values, "text": lowered}.values()))
    leaves = materialize(docs.select("doc_id", "lang", F.unhex(leaf).alias("leaf"), F.unhex(changed).alias("changed")))
    found = manifest(leaves, "lang", "doc_id")
    out = found.select("doc_id", hexed(F.col("leaf")).alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(hexed(F.coalesce("changed", "leaf")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode(%s))::VARCHAR || ':' || %s, '-')"
_LEAF = " || ".join(_FIELD % (x, x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _climb_sql(name: str, source: str) -> str:
    """Nodes by level, and of each node the siblings before and after it."""
    return f"""
{name}(h, g, idx, size, node) AS (
  SELECT 0, g, idx, size, node FROM {source}
  UNION ALL SELECT h + 1, g, idx // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM {name} WHERE size > 1 GROUP BY h, g, idx // 8, size
), {name}_steps AS (
  SELECT a.h, a.g, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.h = b.h AND a.g = b.g AND a.idx // 8 = b.idx // 8 WHERE a.size > 1 GROUP BY a.h, a.g, a.idx
)"""


OP12_SQL = f"""
WITH RECURSIVE step(b, k, v) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc(t) AS (SELECT list(v ORDER BY b) FROM step WHERE k = 8),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256({_LEAF} || {_FIELD % ('text', 'text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a & 255, b) + 1)::BIGINT])), 4294967295) % 3 = 0 THEN sha256({_LEAF} || {_FIELD % (_LOWER, _LOWER)}) END AS changed
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM leaves
), low_nodes AS (SELECT g, idx, size, leaf AS node FROM placed), {_climb_sql('low', 'low_nodes')},
tops AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS size, node FROM low WHERE size = 1), {_climb_sql('high', 'tops')},
folded(doc_id, g, idx, h, leaf, node, proof) AS (
  SELECT doc_id, g, idx, 0, leaf, coalesce(changed, leaf), '' FROM placed
  UNION ALL SELECT f.doc_id, f.g, f.idx // 8, f.h + 1, f.leaf, sha256(l || f.node || r), f.proof || l || r FROM folded f JOIN low_steps s ON s.h = f.h AND s.g = f.g AND s.idx = f.idx
), ended AS (SELECT f.* FROM folded f ANTI JOIN low_steps s ON s.h = f.h AND s.g = f.g AND s.idx = f.idx),
folded_high(doc_id, g, idx, h, leaf, node, proof) AS (
  SELECT doc_id, g, g, 0, leaf, node, proof FROM ended
  UNION ALL SELECT f.doc_id, f.g, f.idx // 8, f.h + 1, f.leaf, sha256(l || f.node || r), f.proof || l || r FROM folded_high f JOIN high_steps s ON s.h = f.h AND s.idx = f.idx
), ended_high AS (SELECT f.* FROM folded_high f ANTI JOIN high_steps s ON s.h = f.h AND s.idx = f.idx)
SELECT e.doc_id, e.leaf, t.node AS subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = r.node AS verified
FROM ended_high e JOIN tops t ON t.idx = e.g, (SELECT node FROM high WHERE size = 1) r
"""
