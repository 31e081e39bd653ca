"""Exact integer k-means by a LAESA table of pivot distances.

The distances of every vector to a few fixed pivots are computed and stored once.  In each round the centroids
are measured against the same pivots; by the triangle inequality the difference of two pivot distances bounds the
distance of vector and centroid from below, whichever pivot says most.  A vector is measured exactly
against the centroid of least bound, and then only against those whose bound does not exceed what it has.

All arithmetic is on integers, so neither order nor partitioning changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Pivots of the table, picked far from each other among the first vectors by hash; they decide what is saved, not what is found.
PIVOTS, PIVOT_SAMPLE = 8, 256
#: Integers of a component at most: with 64 of them squared distances stay below 2**63.
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, vec_id: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of vectors that have ``dimensions`` of them, all finite.

    Other vectors, and nulls, are left out.  An integer beyond LARGEST is an error: squared distances would not fit a long.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) == dimensions)
    # not null, not NaN, not infinite: x - x is 0 for these alone
    finite = F.forall(vector, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0.0, F.lit(False)))
    kept = df.where(whole).where(finite).select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    return kept.select("vec_id", F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST // scale}"))).alias("v"))


def _hash_order(vec_id: str = "vec_id", seed: int = 3) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)


def integer_root(d: np.ndarray) -> np.ndarray:
    """floor(sqrt(d)) of non-negative 64-bit integers, exactly."""
    r = np.floor(np.sqrt(d.astype(float))).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample in turn farthest from all picked before; the first one starts."""
    if not len(sample):
        return sample
    picked, near = [0], squared(sample, sample[0])
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(sample, sample[picked[-1]]))
    return sample[picked]


def nearest(v: np.ndarray, roots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance to it, and how many distances were computed.

    ``roots`` are the whole parts of the distances of v to the pivots.  With whole parts r and s, two distances differ by more than |r - s| - 1.
    """
    own = integer_root(squared(centroids[:, None, :], pivots[None, :, :]))
    bound = np.zeros((len(v), len(centroids)), np.int64)
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(roots[:, p : p + 1] - own[None, :, p]) - 1, out=bound)
    bound *= bound
    cluster = bound.argmin(axis=1)
    best, measured = squared(v, centroids[cluster]), len(v)
    for k in range(len(centroids)):
        open_ = np.flatnonzero((bound[:, k] <= best) & (cluster != k))
        d = squared(v[open_], centroids[k])
        measured += len(open_)
        nearer = (d < best[open_]) | ((d == best[open_]) & (k < cluster[open_]))
        cluster[open_[nearer]], best[open_[nearer]] = k, d[nearer]
    return cluster, best, measured


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], list[int]]:
    """((vec_id, cluster, distance) of each kept vector, the final centroids, distances computed in each pass).

    Centroids start as the k vectors of least sha256 of ``3:<vec_id>`` (a null id: no digits; equal ids by components).  With fewer
    vectors there are as many centroids; equal ones keep their numbers, and the smaller takes all.  Each
    round assigns every vector and replaces centroids that have vectors by their floored means; then vectors are assigned once
    more.  Repeated rows count each.  An empty table gives no rows and no centroids.

    What reaches the driver: k centroids, PIVOT_SAMPLE vectors, and k sums a round.
    """
    vectors = materialize(integer_vectors(df, vec_id, vector, dimensions, scale))
    # at most PIVOT_SAMPLE or k rows
    first = vectors.orderBy(_hash_order(), "v").limit(max(k, PIVOT_SAMPLE)).toArrow()
    if not first.num_rows:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    sample = _matrix(first["v"].combine_chunks())
    pivots, centroids = pick_pivots(sample), sample[:k].copy()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                roots = integer_root(squared(v[:, None, :], pivots[None, :, :]))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(roots.ravel()), len(pivots)).cast(pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "roots"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    stored = materialize(vectors.mapInArrow(tidy(measure), f"vec_id {kind}, v array<int>, roots array<bigint>"))
    computed = []
    for _ in range(rounds):
        sums = _sums(stored, centroids, pivots)
        computed.append(sum(r["measured"] for r in sums if r["cluster"] < 0))
        for r in sums:
            if r["cluster"] >= 0:
                centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, best, _ = nearest(_matrix(batch.column(1)), _matrix(batch.column(2)), centroids, pivots)
                yield pa.record_batch([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return materialize(stored.mapInArrow(tidy(assign), f"vec_id {kind}, cluster int, distance long")), centroids.tolist(), computed


def _sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """Count and component sums of each cluster that has vectors, and, as cluster -1, the distances computed.

    A task makes a row a cluster of its own.
    """
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, measured = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                cluster, _, done = nearest(v, _matrix(batch.column(1)), centroids, pivots)
                measured += done
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0)
        at = np.repeat(np.arange(k, dtype=np.int32), width)
        place = np.tile(np.arange(width, dtype=np.int32), k)
        seen = n[at] > 0
        columns = (np.append(at[seen], -1), np.append(place[seen], 0), np.append(n[at][seen], measured), np.append(total.ravel()[seen], 0))
        yield pa.record_batch([pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])], names=["cluster", "place", "n", "s"])

    parts = stored.select("v", "roots").mapInArrow(tidy(add), "cluster int, place int, n long, s long")
    by_place = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_cluster = by_place.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"]).alias("sums"))
    # at most k + 1 rows
    return [{"cluster": r["cluster"], "n": r["n"], "sums": r["sums"], "measured": r["n"]} for r in by_cluster.collect()]


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids, _ = cluster_vectors(table(spark, sf_dir, "embeddings"))
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = inertias.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(centroids)], "cluster int, components string")
    # at most one row a centroid
    about = named.join(inertias, "cluster").crossJoin(whole).select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    d = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT"
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, v, n AS cluster, d AS distance FROM (SELECT v.r, v.vec_id, v.v, c.n, {d} AS d FROM v, c{r} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, n) = 1)")
        if r < rounds:
            out.append(
                f"m{r} AS MATERIALIZED (SELECT cluster, list(q ORDER BY i) AS v FROM (SELECT cluster, i, (s - ((s % k) + k) % k) // k AS q FROM (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS k FROM a{r}, range(1, 65) t(i) GROUP BY ALL)) GROUP BY cluster), "
                f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.n)"
            )
    return ", ".join(out)


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS n, v FROM v QUALIFY n < 8
), {_rounds_sql(ROUNDS)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.n = cluster
"""
