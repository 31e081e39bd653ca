"""Histories, pantries, favourites and dashboards of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_history_view(scans: DataFrame, products: DataFrame) -> DataFrame:
    """Scans with the product's name and brand; scans of unknown products stay."""
    return scans.join(products.select("barcode", "name", "brand"), "barcode", "left")


def expiry_status(expiry: Column, as_of: Column) -> Column:
    """unknown, expired, urgent (under 3 days), soon (under 7) or ok."""
    days = F.datediff(expiry, as_of)
    return F.when(expiry.isNull(), "unknown").when(days < 0, "expired").when(days < 3, "urgent").when(days < 7, "soon").otherwise("ok")


def pantry_view(pantry: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    return pantry.join(products.select("barcode", "name"), "barcode", "left").withColumn("status", expiry_status(F.col("expiry_date"), as_of))


def favorites_view(favorites: DataFrame, products: DataFrame) -> DataFrame:
    """Favourites of known products, newest first."""
    return favorites.join(products.select("barcode", "name"), "barcode").orderBy(F.desc("created_at"), "user_id", "barcode")


def add_favorites(favorites: DataFrame, new: DataFrame) -> DataFrame:
    """Favourites with the new ones that were not there; adding twice changes nothing."""
    once = new.groupBy("user_id", "barcode").agg(F.min("created_at").alias("created_at"))
    return favorites.unionByName(once.join(favorites, ["user_id", "barcode"], "left_anti"))


def latest_per_user(df: DataFrame, n: int, least: int = 1, most: int = 100, tie: str = "id") -> DataFrame:
    """The newest rows of each user, n of them within bounds; ``rank`` numbers them.  Rows without a user are left out.

    Rows of one time and ``tie`` are ordered by their other columns, so that reruns agree.
    """
    rest = [F.asc(f.name) for f in df.schema if f.name not in ("user_id", "created_at", tie) and not f.dataType.simpleString().startswith(("map", "variant"))]
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc(tie), *rest)
    return df.where("user_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(least, min(most, n)))


def recent(df: DataFrame, order: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


def dashboard_counts(scans: DataFrame, pantry: DataFrame, plans: DataFrame, favorites: DataFrame) -> DataFrame:
    """Rows of each user in four tables; 0 where there is none."""
    named = {"scans": scans, "pantry_items": pantry, "meal_plans": plans, "favorites": favorites}
    # counted apart and added up: one shuffle of small rows, and no chain of outer joins
    parts = [df.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in named.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in named])


def mean_score(scans: DataFrame) -> DataFrame:
    return scans.groupBy("user_id").agg(F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("mean_score"))


def expiring_count(pantry: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Items of each user that expire from ``as_of`` on, within ``days``, the last day included."""
    return pantry.groupBy("user_id").agg(F.count_if(F.datediff("expiry_date", as_of).between(0, days)).alias("expiring"))


def risk_distribution(scans: DataFrame, n: int = 100) -> DataFrame:
    """Of each user's last scans those of low, medium and high risk."""
    s = F.col("score")
    return latest_per_user(scans, n).groupBy("user_id").agg(F.count_if(s >= 75).alias("low"), F.count_if((s >= 45) & (s < 75)).alias("medium"), F.count_if(s < 45).alias("high"))


def top_warnings(scans: DataFrame, n: int = 100, k: int = 5) -> DataFrame:
    """The k most frequent warnings of each user's last scans; of equal ones that seen first, from the newest scan on."""
    seen = latest_per_user(scans, n).select("user_id", "rank", F.posexplode("warnings").alias("place", "warning"))
    counts = seen.groupBy("user_id", "warning").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "place")).alias("first"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("first")
