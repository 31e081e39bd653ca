"""The Jaccard join and the pipeline against plain versions."""

import random
import re
from collections import defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from grocerlake.llm import ngram_jaccard as nj
from grocerlake.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows))


def texts_with_copies(seed, n=60, most=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 4, 5, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, most])):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 22))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(copy))
    out += ["", "   ", None, out[0].upper(), out[0], "passage " * 40 + out[3]]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("blocks", [None, (4, 8, 2, 300, 500)])
def test_components_are_exact(spark, monkeypatch, blocks):
    if blocks:
        for name, v in zip(("QUERY_BLOCK", "MEMBER_BLOCK", "PIVOTS", "QUERY_SHINGLES", "MEMBER_SHINGLES"), blocks):
            monkeypatch.setattr(nj, name, v)
    rows = texts_with_copies(11 if blocks else 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = sorted(tuple(r) for r in nj.jaccard_components(df.repartition(3)).collect())
    assert got == plain_components(rows)


def test_equal_short_names_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(nj, "short", lambda name: name[0] % 8)
    monkeypatch.setattr(nj, "head64", lambda name: F.conv(F.hex(F.substring(name, 1, 1)), 16, 10).cast("long") % 8)
    rows = texts_with_copies(13, 20, 3)
    got = sorted(tuple(r) for r in nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    plain = plain_components(rows)
    # only links between sets of one short name that no other set shares a shingle with could be missed
    assert [r[:2] for r in got] == [r[:2] for r in plain] and sum(a != b for a, b in zip(got, plain)) < len(rows) // 4


def test_components_edges(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "A\tb"), (3, "A\tb"), (None, "a b"), (None, None), (9, None)], "doc_id long, text string")
    got = [tuple(r) for r in nj.jaccard_components(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, 3), (None, 0, None), (9, 0, 9)], key=str)
    assert nj.jaccard_components(df.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 50), 100 + rng.randint(0, 50)) for _ in range(30)] + [(7, 7), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for k, v in got.items():
        seen, todo = {k}, [k]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert v == min(seen)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    odd = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "", None, "x", 0), (10**6 + 2, "123", "en", "src0", 3)], docs.schema)
    first = cp.materialize(by_name["language ID"](spark, docs.unionByName(odd), SF))
    assert first.columns == docs.columns and 0.97 * docs.count() < first.count() <= docs.count()
    second = cp.materialize(by_name["n-gram Jaccard join"](spark, first, SF))
    expected = {k for k, n, m in plain_components([(r.doc_id, r.text) for r in first.collect()]) if k == m or not n}
    assert sorted(r.doc_id for r in second.collect()) == sorted(expected)
    third = cp.materialize(by_name["benchmark decontamination"](spark, second, SF))
    items = [re.findall(r"[^\W\d_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = [r.doc_id for r in second.collect() if any(" ".join(i) in " ".join(re.findall(r"[^\W\d_]+", r.text.lower())) for i in items)]
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - set(held)
    fourth = cp.materialize(by_name["mixing sources to target weights"](spark, third, SF))
    assert fourth.columns == docs.columns and abs(fourth.selectExpr("sum(size(split(text, ' ')))").first()[0] / third.selectExpr("sum(size(split(text, ' ')))").first()[0] - 1.5) < 0.1
    last = by_name["token-ID / binary output"](spark, fourth, SF)
    assert last.count() == fourth.count() and set(last.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_whole_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 150 and out.agg(F.min("start")).first()[0] == 0
