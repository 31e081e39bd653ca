"""Sharding, mixing and decontamination against plain versions."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from grocerlake.llm import decontamination as dc
from grocerlake.llm.mixing import emit_mix, mix_sources
from grocerlake.llm.sharding import rendezvous_shards, shard_documents

DOCS = "doc_id long, text string, source string"


def unit(key):
    return (int(md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def best(key, weights):
    return min((-math.log(unit(f"{key}:{s}")) / w, s) for s, w in enumerate(weights))[1]


def test_shards(spark):
    rows = [(i, "é" * (i % 5), "s") for i in range(400)] + [(None, None, "s"), (None, "x", None), (7, "again", "s")]
    got = shard_documents(spark.createDataFrame(rows, DOCS), 5).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (best(key, [1] * 5), best(key, [1] * 6)) and (r.grown_shard in (r.shard, 5))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)


def test_shards_follow_weights_and_replace_columns(spark):
    df = spark.range(3000).select("id", F.lit(9).alias("shard"), F.lit(1).alias("slot"))
    share = Counter(r.shard for r in rendezvous_shards(df, "id", [3.0, 1.0]).collect())
    assert 0.7 < share[0] / 3000 < 0.8
    assert rendezvous_shards(df.limit(0), "id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        rendezvous_shards(df, "id", [])


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), f"s{i % 4}") for i in range(600)] + [(1000 + i, "a b c", "s0") for i in range(900)]
    rows += [(None, "null id", None), (5000, None, None), (5001, "", "none"), (1, "a b", "s1"), (1, "a b", "s1")]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mix_sources(df).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # share out again and again, as said
    target, open_, rest = dict.fromkeys(size, 0.0), set(size), 1.5 * sum(size.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        give = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= 2 * size[s]:
                rest += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - target[s]) <= max(60, 0.03 * target[s])
    again = {(r.doc_id, r.size, r.taken) for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    mixed = mix_sources(df)
    assert emit_mix(mixed, ["doc_id"]).count() == sum(r.copies for r in got)
    assert mix_sources(df.limit(0)).count() == 0


ITEMS = [
    (1, "A train leaves Boston at 60 km for 3 hours and then returns to Boston at 60 km of speed over the same old track."),
    (2, "plain words without any number that go on for a while until they end here now"),
    (3, "too short"),
    (None, None),
]


def test_decontamination(spark):
    filler = "some other words in front of it. "
    docs = [
        (1, filler + ITEMS[0][1] + " tail"),
        (2, filler + ITEMS[0][1].replace("Boston", "Hanoi").replace("60", "75").replace("3", "4.5")),
        (3, filler + ITEMS[0][1].replace("60 km for", "75 km for").replace("Boston at 60 km of", "Hanoi at 80 km of")),
        (4, "PLAIN words, without any number that go on for a while until they end here now"),
        (5, "plain words without any number; but then something else altogether follows"),
        (6, None),
        (7, ""),
        (8, "9 " * 5000),
        (1, filler + ITEMS[0][1] + " tail"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("windows", F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find_contamination(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert got[1, 1].changed == 0 and got[2, 1].changed > 0 and got[2, 1].consistency == 1.0
    assert {r.doc_id for r in dc.drop_contaminated(df, bench).collect()} == {3, 5, 6, 7, 8}
    assert dc.find_contamination(df.limit(0), bench).count() == 0
    assert dc.find_contamination(df, bench.limit(0)).count() == 0


NATALIA = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. Natalia gave 12 of them away and kept the rest for later. How many clips did Natalia sell altogether in both months?"


def test_names_that_begin_sentences_and_short_items(spark):
    bench = spark.createDataFrame([(1, NATALIA), (2, "What is the capital of France?"), (3, "Weng earns 12 dollars an hour for babysitting her neighbour")], "item_id long, text string")
    docs = [
        (1, "filler words. " + NATALIA.replace("Natalia", "Ruth").replace("48", "36").replace("12", "9")),
        (2, "the quiz said What is the capital of France? and went on"),
        (3, "Paris is the capital of France and it is large."),
        (4, NATALIA.replace("Natalia then", "Ruth then").replace("Natalia gave", "Olga gave").replace("did Natalia", "did Anna").replace("48", "36")),
        (5, "filler Weng earns 12 dollars an hour for babysitting her neighbour"),
        (6, "A day. Olga earns 15 dollars an hour for babysitting her neighbour"),
        (7, "what is the capital of Spain"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find_contamination(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 3), (6, 3), (7, 2)}
    assert got[1, 1].consistency == 1.0 and got[1, 1].changed > 0 and got[1, 1].matched == got[1, 1].windows
    assert got[2, 2].matched == got[2, 2].windows == 2
    assert {r.doc_id for r in dc.drop_contaminated(df, bench).collect()} == {3, 4}


def test_items_without_a_countable_window_are_found_word_by_word(spark, tmp_path):
    # those of one or two words as well: no copied question is too short
    import duckdb

    items = [(1, "Name the capital"), (2, "12 + 13 + 14 + 15 + 16 + 17"), (3, "one two"), (4, "Name the largest planet"), (5, ""), (6, None), (1, "Name the capital"), (7, "Explain photosynthesis"), (8, "Paris")]
    docs = [(1, "The task: name the Capital of Peru"), (2, "name a capital"), (3, "we know 12, 13; 14 15 16 - 17!"), (4, "12 13 14 15 16 18"), (5, "one two"), (6, "say: NAME THE LARGEST PLANET and name the capital"), (7, None), (6, "say: NAME THE LARGEST PLANET and name the capital"), (8, "Please explain photosynthesis to me"), (9, "explain the photosynthesis"), (10, "paris!"), (11, "Paris is large"), (12, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(dc.find_contamination(df, bench).drop("row_key").collect())
    assert [(r.doc_id, r.item_id, r.windows, r.matched) for r in got] == [(1, 1, 1, 1), (3, 2, 2, 2), (5, 3, 1, 1), (6, 1, 1, 1), (6, 4, 1, 1), (8, 7, 1, 1), (10, 8, 1, 1)]
    assert {r.doc_id for r in dc.drop_contaminated(df, bench).collect()} == {2, 4, 7, 9, 11, 12}
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.execute(dc.OP6_SQL).fetchall()) == [tuple(r) for r in got]
