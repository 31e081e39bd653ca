"""Daily marts, quality report, observability and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The metrics on offer.
CATALOG = [
    ("fct_rag_daily", "day, route", "Answers, latency, abstention and citation coverage", "knowledge", "5 minutes"),
    ("fct_scan_daily", "day", "Scans, active users, products and mean score", "product", "5 minutes"),
    ("fct_pipeline_daily", "day, pipeline", "Runs, successes, failures and output rows", "data", "15 minutes"),
    ("mart_product_quality", "all products", "Completeness and missing grades of the product cache", "product", "1 hour"),
]


def _share(condition: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 4), F.lit(0.0))


def rag_daily_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("answer_count"), F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("latency_mean_ms"),
        _share(F.col("abstained")).alias("abstention_rate"), _share(F.col("citation_count") > 0).alias("citation_coverage"),
    ]


def pipeline_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("run_count"), F.count_if(F.col("status") == "succeeded").alias("succeeded_count"),
        F.count_if(F.col("status").isin("failed", "blocked")).alias("failed_count"), F.sum("output_count").alias("output_count"),
    ]


def fct_rag_daily(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("created_at").alias("day"), "route").agg(*rag_daily_aggregates())


def fct_scan_daily(scans: DataFrame, approx: bool = False) -> DataFrame:
    """By day: scans, distinct users and products, mean score.

    Exact counts first make the day's users and products distinct, so no row is
    multiplied; ``approx`` takes sketches in one pass.
    """
    dated = scans.withColumn("day", F.to_date("created_at"))
    plain = [F.count(F.lit(1)).alias("scan_count"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("mean_score")]
    if approx:
        return dated.groupBy("day").agg(*plain, F.approx_count_distinct("user_id").alias("active_users"), F.approx_count_distinct("barcode").alias("unique_products"))
    out = dated.groupBy("day").agg(*plain)
    for column, name in (("user_id", "active_users"), ("barcode", "unique_products")):
        counted = dated.groupBy("day", column).agg(F.lit(1)).groupBy("day").agg(F.count(column).alias(name))
        # scans without a time have a day of their own, null
        out = out.join(counted.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day"))).drop("_day")
    return out


def fct_pipeline_daily(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("started_at").alias("day"), "pipeline").agg(*pipeline_aggregates())


def mart_product_quality(products: DataFrame, threshold: float = 0.8) -> DataFrame:
    return products.agg(
        F.count("barcode").alias("product_count"), F.coalesce(F.round(F.avg("completeness_score"), 4), F.lit(0.0)).alias("mean_completeness"),
        F.count_if(F.col("completeness_score") >= threshold).alias("high_completeness_count"), F.count_if(F.col("nutriscore").isNull()).alias("missing_nutriscore_count"),
    )


def semantic_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "name string, grain string, meaning string, owner string, freshness string")


def pipeline_success_rate(daily: DataFrame) -> DataFrame:
    """Succeeded over completed runs; null where none completed."""
    done = F.col("succeeded_count") + F.col("failed_count")
    return daily.withColumn("success_rate", F.when(done > 0, F.round(F.col("succeeded_count") / done, 4)))


def data_quality_report(products: DataFrame, releases: DataFrame, chunks: DataFrame, runs: DataFrame, as_of: Column, ttl_hours: int = 168) -> DataFrame:
    """One row: one aggregate pass over each table."""
    age = as_of.cast("double") - F.coalesce("cached_at", "updated_at").cast("timestamp").cast("double")
    fields = ["name", "brand", "ingredients_text", "nutriscore", "image_url"]
    p = products.agg(
        F.count(F.lit(1)).alias("product_count"), F.coalesce(F.round(F.avg(F.coalesce("completeness_score", F.lit(0.0))), 2), F.lit(0.0)).alias("average_completeness"),
        F.count_if(F.coalesce(age > ttl_hours * 3600, F.lit(True))).alias("stale_count"),
        *[_share(F.coalesce(F.length(f), F.lit(0)) == 0).alias(f"missing_{f}") for f in fields],
    )
    r = releases.agg(F.count(F.lit(1)).alias("release_count"), F.max(F.when(F.col("status") == "published", F.col("version"))).alias("published_release"))
    per = chunks.groupBy("release_id", "content_hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).alias("empty")
    )
    c = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_chunk_hashes"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_embeddings"), F.coalesce(F.round(F.sum("tokens") / F.sum("n"), 2), F.lit(0.0)).alias("average_chunk_tokens"),
    )
    u = runs.agg(
        F.count(F.lit(1)).alias("run_count"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max(F.struct("started_at", "id"))["id"].alias("latest_run_id"),
    )
    return p.crossJoin(r).crossJoin(c).crossJoin(u)  # four tables of one row


def observability_snapshot(audit: DataFrame, runs: DataFrame, releases: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row: answers, pipelines, the active release, the latest evaluation."""
    a = audit.agg(*rag_daily_aggregates())
    p = runs.agg(*[x for x in pipeline_aggregates()][:3])
    r = releases.agg(F.max(F.when(F.col("status") == "published", F.col("version"))).alias("active_release"))
    e = evaluations.agg(F.max_by("metrics", F.struct("created_at", "id")).alias("latest_evaluation"))
    return a.crossJoin(p).crossJoin(r).crossJoin(e)  # four tables of one row


def http_metrics(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by method, path and status; latency sums and counts by method and path)."""
    from grocerlake.functions.text import normalize_path

    shown = requests.withColumn("route", normalize_path(F.col("path")))
    counts = shown.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("requests"))
    return counts, shown.groupBy("method", "route").agg(F.sum("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_count"))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("r")).select("r.*")
