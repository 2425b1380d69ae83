"""Row choice per key.

``row_number() <= n`` filters are planned with a partial limit ahead of the
shuffle, so each task sends at most n rows of a key and a hot key never
gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """First n rows per key.  ``order`` must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def keep_latest_reviews(reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """Latest version of a review; the longer text wins a tie, then a hash of
    the whole row makes the choice repeatable."""
    size = F.length(F.coalesce(F.col("title"), F.lit(""))) + F.length(
        F.coalesce(F.col("review_text"), F.lit("")))
    order = [F.col("review_ts").desc_nulls_last(), size.desc(), F.xxhash64(*reviews.columns)]
    return keep_first(reviews, [key], order)


def dedup_metadata(metadata: DataFrame) -> DataFrame:
    """One row per product: the highest price, nulls last."""
    return keep_first(metadata, ["asin"], [
        F.col("price").desc_nulls_last(), F.col("title").asc_nulls_last(),
        F.xxhash64("asin", "title", "brand", "price")])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
