"""Registered queries against their SQL, and independence of the number of partitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from grocerlake.operators import knowledge as kn
from grocerlake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = """
tokenize redact_sensitive fold_accents normalize_product_code score_products tdee refresh_products top_warnings fct_scan_daily data_quality_report chunk_documents
manifest_hash rollback_release bm25 answer_questions vector_topk search_passages case_metrics aggregate_metrics field_metrics parse_nutrition reconcile_words eligible_meals ocr_dashboard
bm25_topk hybrid_search_stored candidates_stored plan_meals nested_ingredients throttle_weeks stream_scan_daily stream_upserts embed_with_history embedding_strategies ocr_case_metrics
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(plans.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cursor.fetchall()) and got


@pytest.mark.parametrize("name", ["answer_context", "hybrid_search", "top_warnings"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, plans.QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_embeddings_are_made_once_and_counted_by_chunk(spark):
    chunks = spark.createDataFrame([("a", "one fish"), ("b", "two fish"), ("b", "two fish")], "content_hash string, content string")
    history = spark.createDataFrame([("a", kn.model_name(), [1.0]), ("b", "other", [2.0])], "content_hash string, embedding_model string, embedding array<double>")
    out, counts = kn.embed_with_reuse(chunks, history, kn.model_name())
    assert tuple(counts.first()) == (1, 2)
    assert sorted((r.content_hash, r.reused, len(r.embedding)) for r in out.collect()) == [("a", True, 1), ("b", False, 256), ("b", False, 256)]


def test_history_stays_where_it_lies(spark, capsys):
    """Only the new chunks are shuffled: above the scan of the bucketed history there is no exchange."""
    model = kn.model_name()
    past = spark.range(200).select(F.lit("1").alias("release_id"), F.lit("f").alias("source_filename"), F.col("id").alias("chunk_index"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(model).alias("embedding_model"), F.array(F.col("id").cast("double")).alias("embedding"))
    chunks = spark.range(150, 260).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id").cast("string").alias("content"))
    kn.store_history(past, "history_of_tests", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, counts = kn.embed_with_reuse(chunks, spark.table("history_of_tests"), model)
        assert tuple(counts.first()) == (50, 60)
        assert sorted(r.embedding[0] for r in out.where("reused").collect()) == [float(i) for i in range(150, 200)]
        capsys.readouterr()
        counts.explain()
        lines = capsys.readouterr().out.splitlines()
        scan = next(i for i, line in enumerate(lines) if "history_of_tests" in line)
        depth = lines[scan].index("FileScan")
        above, at = [], depth
        for line in reversed(lines[:scan]):
            own = len(line) - len(line.lstrip(" :+-"))
            if own < at:
                above.append(line.strip(" :+-"))
                at = own
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join]) and any("Exchange hashpartitioning(content_hash" in line for line in lines)
        kn.append_history(past.unionByName(past.withColumn("content_hash", F.concat("content_hash", F.lit("x")))), "history_of_tests", 8)
        assert spark.table("history_of_tests").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE history_of_tests")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "content string")
    kn.export_release(df, df, df, "v1", str(tmp_path))
    assert spark.read.json(str(tmp_path / "bronze/chunks")).select("content", F.col("knowledge_release")).first() == ("x", "v1")


def test_hybrid_answers_follow_words_and_vectors(spark):
    import numpy as np

    from grocerlake.operators import retrieval as rt

    def read(name):
        return plans.load(spark, SF, name)

    chunks, questions = plans._chunks(read), read("questions")
    detail = {r.chunk_id: r for r in kn.feature_hash_embed(chunks).collect()}
    asked = {r.query_id: np.array(r.embedding) for r in kn.feature_hash_embed(questions, text="question").collect()}
    by_query = {}
    for r in rt.bm25(questions, chunks).where("lexical_score > 0").collect():
        by_query.setdefault(r.query_id, []).append((r.chunk_id, r.lexical_score, float(sum(a * b for a, b in zip(asked[r.query_id], detail[r.chunk_id].embedding)))))
    want, floored = {}, 0
    for q, hits in by_query.items():
        place = lambda h: (detail[h[0]].source_filename, detail[h[0]].chunk_index)
        lexical = {h[0]: k for k, h in enumerate(sorted(hits, key=lambda h: (-h[1], place(h))), 1)}
        semantic = {h[0]: k for k, h in enumerate(sorted(hits, key=lambda h: (-h[2], place(h))), 1)}
        fused = {h[0]: 1.0 / (60 + lexical[h[0]]) + (0.8 / (60 + semantic[h[0]]) if h[2] > 0 else 0.0) for h in hits}
        ranked = sorted(hits, key=lambda h: (-fused[h[0]], -h[1], -h[2], place(h)))[:18]
        kept = [h[0] for h in ranked if fused[h[0]] >= 0.72 * fused[ranked[0][0]]]
        floored += len(kept) < len(ranked)
        first = {detail[k].source_filename for k in kept[:3]}
        want[q] = [k for i, k in enumerate(kept[:6]) if i < 3 or detail[k].source_filename in first][:4]
    got = {}
    for r in sorted(plans.QUERIES["answer_context_hybrid"](spark, SF).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want and floored
    cited = {r.query_id: r.sources for r in plans.QUERIES["answer_questions_hybrid"](spark, SF).where("not abstained").collect()}
    assert cited and all(s == [detail[k].source_filename for k in want[q]] for q, s in cited.items())
