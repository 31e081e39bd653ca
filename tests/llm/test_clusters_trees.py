"""Centroid clusters, Merkle manifests and MinHash near-dedup against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from grocerlake.llm import centroids as ct
from grocerlake.llm import merkle as mk
from grocerlake.llm import minhash as mh
from grocerlake.llm.ngram_jaccard import shingle_sets

# -- centroids


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(float(np.float64(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in by_hash[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centers[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((-1 if i is None else i), near(v)[1], near(v)[0]) for i, v in kept), centers


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, roots int")


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 0.4))) for _ in range(6)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[9][1]), (None, None), (901, []), (902, rows[3][1][:5]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [None] + [0.0] * 5)]
    got, centers, computed = ct.cluster_vectors(vector_table(spark, rows).repartition(5), k=8, rounds=10, dimensions=6)
    want, plain_centers = plain_clusters(rows, 8, 10, 6, 1024)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    assert centers == plain_centers
    # pivots save most distances where there are clusters
    assert sum(computed) < 0.7 * 10 * 8 * len(want)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [0.5, -0.5]) for i in range(n)]
    got, centers, _ = ct.cluster_vectors(vector_table(spark, rows), k=8, dimensions=2)
    assert [(r.cluster, r.distance) for r in got.collect()] == [(0, 0)] * n
    assert centers == [[512, -512]] * n


def test_vectors_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        ct.cluster_vectors(vector_table(spark, [(1, [1e30, 0.0])]), dimensions=2)


def test_integer_roots():
    d = np.array([0, 1, 2, 3, 4, (1 << 60) - 1, 1 << 60, (1 << 31) ** 2 - 1, 3037000499**2 - 1], np.int64)
    assert ct.integer_root(d).tolist() == [math.isqrt(x) for x in d.tolist()]


# -- trees


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    """Root, and of each leaf the list of (siblings before, siblings after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i - i % fanout
            paths[k].append((level[lo:i], level[i + 1 : lo + fanout]))
        at = [i // fanout for i in at]
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(leaves, fanout):
    """(group, order, leaf) to rows of (leaf, subroot, root, path)."""
    low = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = sorted({g for g, _, _ in leaves}, key=low)
    trees = {}
    for g in groups:
        own = sorted((r for r in leaves if r[0] == g), key=lambda r: (low(r[1]), r[2]))
        trees[g] = ([r[2] for r in own], *plain_tree([r[2] for r in own], fanout))
    root, upper = plain_tree([trees[g][1] for g in groups], fanout)
    return [(leaf, trees[g][1], root, path + up) for g, up in zip(groups, upper) for leaf, path in zip(trees[g][0], trees[g][2])]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_equals_plain_one(spark, fanout):
    rng = random.Random(fanout)
    leaves = [(rng.choice(["en", "en", "en", "", "Ö", None, "zz"]), rng.choice([None, *range(60)]), h(str(rng.randint(0, 300)))) for _ in range(230)] + [("one", 1, h("x"))] + [("en", 5, h("same"))] * 40
    # columns of names in use stay the caller's
    df = spark.createDataFrame([(g, i, bytes.fromhex(x), "mine") for g, i, x in leaves], "lang string, doc_id long, leaf binary, idx string").repartition(7)
    got = mk.manifest(df, "lang", "doc_id", fanout).withColumn("folded", mk.fold(mk.hexed(mk.F.col("leaf")), mk.F.col("path"))).withColumn("proof", mk.proof_digest(mk.F.col("path"))).collect()
    want = plain_manifest(leaves, fanout)
    assert sorted((r.leaf.hex(), r.subroot, r.root, r.proof, r.folded) for r in got) == sorted((a, b, c, h(*(x for l, r in p for x in l + r)), c) for a, b, c, p in want)
    assert {r.idx for r in got} == {"mine"}


def test_manifest_query_of_odd_documents(spark, tmp_path):
    rows = [(i, "Text Ä " * (i % 4), "en" if i % 3 else None, None if i % 5 == 0 else "s", i) for i in range(30)]
    rows += [(None, None, None, None, None), (3, "", "de", "", 0), (3, "", "de", "", 0), (4, "Long Word " * 40_000, "fr", "s", 400_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = mk.op12_merkle_manifest(spark, str(tmp_path)).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, la, s, n: h(enc(i), enc(s), enc(la), enc(n), enc(t))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {}
    for i, t, la, s, n in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None:
            changed[leaf(i, t, la, s, n)] = leaf(i, t.translate(lower), la, s, n)
    want = []
    for own, sub, root, path in plain_manifest([(la, i, leaf(i, t, la, s, n)) for i, t, la, s, n in rows], 8):
        node = changed.get(own, own)
        for before, after in path:
            node = h(*before, node, *after)
        want.append((own, sub, root, h(*(x for l, r in path for x in l + r)), node, node == root))
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(want)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert mk.op12_merkle_manifest(spark, str(tmp_path)).count() == 0


# -- near copies


def near_copies(seed, groups=12, copies=14):
    """Texts whose similarity with others of their group lies around the threshold."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 4, 5, 9, 60, 200]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) if rng.random() < 0.7 else "\t".join(own).upper())
    return [*texts, None, "", "  \n", None, "x", "X", "long words " * 90_000, "Long words " * 90_000 + "end"]


def plain_components(rows, percent):
    sets = [set(next(iter(shingle_sets([(t or "").encode()]))).tolist()) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    least = {}
    for p, (i, _) in zip(part, rows):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return [(i, len(s), least.get(p) if s else i) for p, (i, _), s in zip(part, rows, sets)]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_copies_equal_plain_ones(spark, monkeypatch, small_blocks):
    if small_blocks:
        # every bucket that is not in one part is cut and dealt
        monkeypatch.setattr(mh, "SPLIT_PAIRS", 3)
        monkeypatch.setattr(mh, "QUERY_BLOCK", 2)
        monkeypatch.setattr(mh, "MEMBER_BLOCK", 3)
    texts = near_copies(3)
    rows = [(None if k % 29 == 28 else k // 2 * 2 if k % 31 == 30 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, name string, size int").repartition(5)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = mh.minhash_components(docs).collect()
    assert sorted(map(key, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, plain_components(rows, 85)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_no_rows(spark):
    assert mh.minhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_are_minima_and_agree_as_sets_do():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 400_000, dtype=np.uint64)
    a, b = common[:380_000], common[20_000:]
    low = mh.signatures([np.unique(a), np.unique(b), common[:1]])
    assert low[2].tolist() == [((int(common[0]) * int(x) + int(y)) % 2**64) >> 32 for x, y in zip(mh._A, mh._B)]
    agree = (low[0] == low[1]).sum()
    assert agree >= mh.least_agreement() and abs(agree / mh.MINIMA - 0.9) < 0.12


def test_cells_show_who_has_a_partner():
    rng = np.random.default_rng(2)
    minima = rng.integers(0, 3, (40, mh.MINIMA)).astype(np.int32)
    minima[5], minima[30] = minima[20], minima[10]
    query, part = np.arange(40) < 12, np.arange(40) % 7
    part[30] = part[10]
    want = np.zeros(40, bool)
    want[[5, 20]] = True
    assert (mh.cell_agreement(query, part, minima, 84) == want).all()


def test_sets_that_agree_in_many_buckets_are_confirmed_once(spark, monkeypatch):
    asked, confirm = [], mh._confirm

    def counted(rows, sets, queries, members, n, percent):
        asked.append([(df.count(), df.select("sid").distinct().count()) for df in (queries, members)])
        return confirm(rows, sets, queries, members, n, percent)

    monkeypatch.setattr(mh, "_confirm", counted)
    docs = spark.createDataFrame(list(enumerate(near_copies(3))), "doc_id long, text string")
    mh.minhash_components(docs).count()
    assert len(asked) == 2 and all(rows == sids > 0 for rows, sids in asked[1])


def test_cells_show_who_hangs_together():
    minima = np.arange(6)[:, None].repeat(mh.MINIMA, 1)
    minima[[2, 4]] = minima[0]
    query, part = np.arange(6) < 2, np.arange(6)
    assert mh.cell_parts(query, part, minima, 84).tolist() == [0, -1, 0, -1, 0, -1]
