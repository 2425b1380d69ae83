"""Metrics layer: named dimensions, facts, metrics and filters over the marts.

A query names a table and what it wants of it; the result is an ordinary
DataFrame plan.  Nothing is parsed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


@dataclass(frozen=True)
class Table:
    """One mart: dimension and fact names map to its columns, metrics to
    aggregate builders, filters to conditions."""
    mart: str
    dimensions: dict[str, str]
    facts: dict[str, str]
    metrics: dict[str, object] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)


def _sum(name: str):
    return lambda: F.sum(name)


def _weighted(value: str, weight: str = "review_count"):
    return lambda: ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def _over(top: str, bottom: str):
    return lambda: ratio(F.sum(top), F.sum(bottom))


# fixed values: names and meaning of the published metrics
TABLES: dict[str, Table] = {
    "category_sentiment": Table(
        "category_summary", {"derived_category": "derived_category"},
        {n: n for n in ("review_count", "avg_rating", "avg_sentiment", "median_sentiment",
                        "negative_review_count", "positive_review_count", "negative_rate",
                        "verified_count", "avg_helpful_votes")},
        {"total_reviews_all_categories": _sum("review_count"),
         "overall_avg_rating": _weighted("avg_rating"),
         "overall_negative_rate": _over("negative_review_count", "review_count")},
        {"high_negative_categories": "negative_rate > 0.15"}),
    "monthly_trends": Table(
        "monthly_trends", {"derived_category": "derived_category", "review_month": "review_month"},
        {"monthly_review_count": "review_count", "monthly_avg_rating": "avg_rating",
         "monthly_avg_sentiment": "avg_sentiment", "monthly_negative_count": "negative_review_count",
         "monthly_negative_rate": "negative_rate"},
        {"total_monthly_reviews": _sum("review_count"), "avg_monthly_rating": _weighted("avg_rating")}),
    "theme_analysis": Table(
        "theme_category", {"derived_category": "derived_category", "review_theme": "review_theme"},
        {"theme_review_count": "review_count", "theme_avg_rating": "avg_rating",
         "theme_avg_sentiment": "avg_sentiment", "theme_negative_count": "negative_review_count",
         "theme_negative_rate": "negative_rate", "negative_avg_sentiment": "negative_avg_sentiment"},
        {"total_theme_reviews": _sum("review_count")}),
    "complaints": Table(
        "complaint_analysis", {"derived_category": "derived_category", "review_theme": "review_theme"},
        {"complaint_count": "complaint_count", "complaint_avg_sentiment": "avg_sentiment",
         "complaint_avg_helpful_votes": "avg_helpful_votes",
         "high_quality_complaints": "high_quality_complaints", "high_quality_rate": "high_quality_rate"},
        {"total_complaints": _sum("complaint_count"),
         "total_high_quality_complaints": _sum("high_quality_complaints")}),
}
RELATIONSHIPS = {("monthly_trends", "category_sentiment"): "derived_category",
                 ("theme_analysis", "category_sentiment"): "derived_category",
                 ("complaints", "category_sentiment"): "derived_category"}
SYNONYMS = {
    "product category": "derived_category", "category name": "derived_category",
    "product type": "derived_category", "category": "derived_category",
    "month": "review_month", "date": "review_month", "time period": "review_month",
    "theme": "review_theme", "topic": "review_theme", "aspect": "review_theme",
    "complaint topic": "review_theme", "issue type": "review_theme",
    "total reviews": "total_reviews_all_categories", "average rating": "overall_avg_rating",
    "problematic categories": "high_negative_categories", "complaint count": "total_complaints",
}


def resolve(name: str) -> str:
    key = name.strip().lower()
    return SYNONYMS.get(key, key)


def _order(names: list[str]) -> list[Column]:
    """``-name`` sorts descending; NULLs always come last."""
    return [F.col(resolve(n[1:])).desc_nulls_last() if n.startswith("-") else F.col(resolve(n)).asc_nulls_last()
            for n in names]


def metric_query(marts: dict[str, DataFrame], table: str, select: list[str], *,
                 where: list[str | Column] = (), order: list[str] = (), limit: int | None = None,
                 join: str | None = None) -> DataFrame:
    """Select dimensions, facts and metrics of one table (plus, through a
    declared relationship, facts of a second one).  With a metric among the
    names the result is grouped by the dimensions named."""
    t = TABLES[resolve(table)]
    df = marts[t.mart]
    names = [resolve(n) for n in select]
    columns = t.dimensions | t.facts
    if join is not None:
        other = TABLES[join]
        key = RELATIONSHIPS[(resolve(table), join)]
        renamed = marts[other.mart].select(key, *[F.col(c).alias(f"{join}.{n}") for n, c in other.facts.items()])
        df = df.join(renamed, key, "left")
        columns = columns | {f"{join}.{n}": f"`{join}.{n}`" for n in other.facts}
    for condition in where:
        if isinstance(condition, str):
            condition = F.expr(t.filters.get(resolve(condition), condition))
        df = df.where(condition)
    unknown = [n for n in names if n not in columns and n not in t.metrics]
    if unknown:
        raise KeyError(f"{table} has no {', '.join(unknown)}")
    chosen = [n for n in names if n in t.metrics]
    if chosen:
        keys = [F.col(t.dimensions[n]).alias(n) for n in names if n in t.dimensions]
        out = df.groupBy(*keys).agg(*[t.metrics[n]().alias(n) for n in chosen])
    else:
        out = df.select(*[F.col(columns[n]).alias(n) for n in names])
    if order:
        out = out.orderBy(*_order(order))
    return out if limit is None else out.limit(limit)


# fixed values: the five verified questions
VERIFIED = {
    "worst_categories": dict(table="category_sentiment", order=["-negative_rate"], select=[
        "derived_category", "review_count", "avg_rating", "negative_rate"]),
    "top_complaints_by_category": dict(
        table="complaints", order=["-complaint_count", "derived_category", "review_theme"], limit=20,
        select=["derived_category", "review_theme", "complaint_count", "complaint_avg_sentiment"]),
    "sentiment_trend": dict(table="monthly_trends", order=["review_month", "derived_category"], select=[
        "derived_category", "review_month", "monthly_review_count", "monthly_avg_sentiment", "monthly_negative_rate"]),
    "best_rated_categories": dict(table="category_sentiment", order=["-avg_rating"], select=[
        "derived_category", "review_count", "avg_rating", "avg_sentiment"]),
    "high_quality_complaints": dict(
        table="complaints", order=["-complaint_avg_helpful_votes", "derived_category", "review_theme"], limit=15,
        select=["derived_category", "review_theme", "complaint_count", "complaint_avg_helpful_votes", "high_quality_rate"]),
}


def verified(marts: dict[str, DataFrame], name: str) -> DataFrame:
    return metric_query(marts, **VERIFIED[name])


# ------------------------------------------------- question families over marts

def extreme(mart: DataFrame, metric: str, keys: list[str], k: int = 1, highest: bool = True,
            also: list[str] = ()) -> DataFrame:
    """Top or bottom k by a metric; ties by the keys."""
    by = F.col(metric).desc_nulls_last() if highest else F.col(metric).asc_nulls_last()
    return mart.select(*keys, metric, *also).orderBy(by, *keys).limit(k)


def ranking(mart: DataFrame, metric: str, keys: list[str], highest: bool = True) -> DataFrame:
    """Every row of the mart in the order of a metric."""
    by = F.col(metric).desc_nulls_last() if highest else F.col(metric).asc_nulls_last()
    return mart.select(*keys, metric).orderBy(by, *keys)


def point_value(mart: DataFrame, metric: str, **where) -> DataFrame:
    for column, value in where.items():
        mart = mart.where(F.col(column) == value)
    return mart.select(metric)


def pair_values(mart: DataFrame, metric: str, key: str, values: list) -> DataFrame:
    return mart.where(F.col(key).isin(values)).select(key, metric)


def threshold(mart: DataFrame, condition: str, select: list[str]) -> DataFrame:
    return mart.where(condition).select(*select)


def threshold_count(mart: DataFrame, condition: str) -> DataFrame:
    return mart.where(condition).agg(F.count(F.lit(1)).alias("n"))


def grand_total(mart: DataFrame, metric: str) -> DataFrame:
    return mart.agg(F.sum(metric).alias(f"total_{metric}"))


def series(mart: DataFrame, metric: str, category: str, n: int | None = None) -> DataFrame:
    """A category's months in order, or its n latest."""
    rows = mart.where(F.col("derived_category") == category).select("review_month", metric)
    return rows.orderBy("review_month") if n is None else rows.orderBy(F.col("review_month").desc()).limit(n)


def versus_mean(mart: DataFrame, metric: str, category: str) -> DataFrame:
    from ..functions.numeric import mean_of
    overall = mart.agg(mean_of(F.col(metric), 6).alias("avg_all"))
    return point_value(mart, metric, derived_category=category).crossJoin(F.broadcast(overall))


def regroup(mart: DataFrame, key: str, metric: str, how: str = "avg") -> DataFrame:
    """Mart rows grouped again: mean or sum of a metric per key."""
    from ..functions.numeric import mean_of
    value = mean_of(F.col(metric), 6) if how == "avg" else F.sum(metric)
    return mart.groupBy(key).agg(value.alias(f"{how}_{metric}"))


def count_by(mart: DataFrame, key: str) -> DataFrame:
    return mart.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- mart lookups, X5

def category_lookup(marts: dict[str, DataFrame], category: str) -> DataFrame:
    return marts["category_summary"].where(F.col("derived_category") == category)


def product_lookup(marts: dict[str, DataFrame], asin) -> DataFrame:
    return marts["product_summary"].where(F.col("asin") == asin)


def theme_breakdown(marts: dict[str, DataFrame], category: str) -> DataFrame:
    return marts["theme_category"].where(F.col("derived_category") == category).orderBy(F.col("review_count").desc(), "review_theme")


def complaint_data(marts: dict[str, DataFrame], category: str) -> DataFrame:
    return marts["complaint_analysis"].where(F.col("derived_category") == category).orderBy(
        F.col("complaint_count").desc(), "review_theme")


def monthly_trends(marts: dict[str, DataFrame], category: str) -> DataFrame:
    return marts["monthly_trends"].where(F.col("derived_category") == category).orderBy("review_month")
