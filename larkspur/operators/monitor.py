"""Anomaly, product, emerging-theme and cross-category detectors.

All detectors read marts (a few rows per category and month), so their windows
are small; the only one that reads the fact table first reduces it to counts
per category, theme and month.  Comparisons leave a tolerance of 1e-9 so that
an exact tie is never decided by binary noise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import TIE, mean_of, ratio, steady_round
from ..session import stash
from .marts import month_of

ANOMALY_COLUMNS = {
    "anomaly_type": "string", "derived_category": "string", "review_theme": "string",
    "detection_period": "date", "current_value": "double", "baseline_value": "double",
    "deviation_score": "double", "affected_reviews": "bigint",
    "current_negative_rate": "double", "baseline_negative_rate": "double", "severity": "string",
}
PRODUCT_COLUMNS = {
    "anomaly_type": "string", "asin": None, "product_name": "string", "brand": "string",
    "derived_category": "string", "detection_period": "date", "current_value": "double",
    "baseline_value": "double", "deviation_score": "double", "affected_reviews": "bigint",
    "severity": "string",
}


def shape(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """Exactly these columns; a missing one is NULL."""
    out = []
    for name, kind in columns.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        out.append((c if kind is None else c.cast(kind)).alias(name))
    return df.select(*out)


def below(a: Column, b: Column) -> Column:
    return a < b - TIE


def latest_month(monthly: DataFrame) -> DataFrame:
    return F.broadcast(monthly.agg(F.max("review_month").alias("latest_month")))


def in_baseline(months: int) -> Column:
    """The ``months`` calendar months before the latest one."""
    return ((F.col("review_month") >= F.add_months("latest_month", -months))
            & (F.col("review_month") < F.col("latest_month")))


def trend_baseline(trends: DataFrame, months: int = 4) -> DataFrame:
    return (trends.crossJoin(latest_month(trends)).where(in_baseline(months))
            .groupBy("derived_category").agg(
                *[f for m in ("avg_rating", "avg_sentiment", "negative_rate")
                  for f in (F.avg(m).alias(f"base_{m}"), F.stddev_samp(m).alias(f"sd_{m}"))]))


def judged_trends(trends: DataFrame, months: int = 4) -> DataFrame:
    """Rows of the latest month with their category's baseline."""
    latest = trends.crossJoin(latest_month(trends)).where(F.col("review_month") == F.col("latest_month"))
    return latest.join(trend_baseline(trends, months), "derived_category")


def metric_drop(trends: DataFrame, metric: str, kind: str, floor: float, months: int = 4,
                trigger: float = 0.5, min_reviews: int = 10, judged: DataFrame | None = None) -> DataFrame:
    """Latest month below its baseline by more than ``trigger`` deviations; a
    category without a deviation (one baseline month) is left out.  ``judged`` passes
    ``judged_trends`` that several detectors share."""
    base, sd = F.col(f"base_{metric}"), F.col(f"sd_{metric}")
    spread = F.when(sd.isNotNull(), F.greatest(sd, F.lit(floor)))
    now = F.col(metric)
    judged = judged_trends(trends, months) if judged is None else judged
    hit = judged.where((F.col("review_count") >= min_reviews) & below(now, base - trigger * spread))
    severity = (F.when(below(now, base - 2 * spread), "HIGH")
                .when(below(now, base - 1 * spread), "MEDIUM").otherwise("LOW"))
    return shape(hit.select(
        F.lit(kind).alias("anomaly_type"), "derived_category",
        F.col("review_month").alias("detection_period"), now.alias("current_value"),
        base.alias("baseline_value"), steady_round((base - now) / spread, 2).alias("deviation_score"),
        F.col("review_count").alias("affected_reviews"),
        F.col("negative_rate").alias("current_negative_rate"),
        F.col("base_negative_rate").alias("baseline_negative_rate"),
        severity.alias("severity")), ANOMALY_COLUMNS)


def rating_drops(trends: DataFrame, **kw) -> DataFrame:
    return metric_drop(trends, "avg_rating", "RATING_DROP", 0.1, **kw)


def sentiment_shifts(trends: DataFrame, **kw) -> DataFrame:
    return metric_drop(trends, "avg_sentiment", "SENTIMENT_SHIFT", 0.05, **kw)


def complaint_spikes(complaints: DataFrame, floor: float = 3, trigger: float = 0.5) -> DataFrame:
    """Category x theme complaint counts against the theme's mean over categories."""
    base = complaints.groupBy("review_theme").agg(
        F.avg("complaint_count").alias("_avg"), F.stddev_samp("complaint_count").alias("_sd"))
    spread = F.when(F.col("_sd").isNotNull(), F.greatest(F.col("_sd"), F.lit(float(floor))))
    n, avg = F.col("complaint_count"), F.col("_avg")
    hit = complaints.join(base, "review_theme").where(below(avg + trigger * spread, n.cast("double")))
    severity = (F.when(below(avg + 2 * spread, n.cast("double")), "HIGH")
                .when(below(avg + spread, n.cast("double")), "MEDIUM").otherwise("LOW"))
    return shape(hit.select(
        F.lit("COMPLAINT_SPIKE").alias("anomaly_type"), "derived_category", "review_theme",
        n.alias("current_value"), avg.alias("baseline_value"),
        steady_round((n - avg) / spread, 2).alias("deviation_score"),
        n.alias("affected_reviews"), severity.alias("severity")), ANOMALY_COLUMNS)


def monthly_changes(trends: DataFrame, min_reviews: int = 10) -> DataFrame:
    """Each month with the previous month's rating and sentiment."""
    w = Window.partitionBy("derived_category").orderBy("review_month")
    return (trends.where(F.col("review_count") >= min_reviews)
            .withColumn("prev_rating", F.lag("avg_rating").over(w))
            .withColumn("prev_sentiment", F.lag("avg_sentiment").over(w)))


def declining_streaks(trends: DataFrame, min_months: int = 3, min_reviews: int = 10) -> DataFrame:
    """Runs of consecutive available months with a falling rating."""
    w = (Window.partitionBy("derived_category").orderBy("review_month")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fell = F.col("avg_rating") < F.col("prev_rating")
    marked = (monthly_changes(trends, min_reviews).where(F.col("prev_rating").isNotNull())
              .withColumn("_fell", fell).withColumn("_streak", F.sum(F.when(fell, 0).otherwise(1)).over(w)))
    return (marked.where("_fell").groupBy("derived_category", "_streak").agg(
        F.max("review_month").alias("last_month"), F.min("avg_rating").alias("lowest_rating"),
        F.count(F.lit(1)).alias("consecutive_months"))
        .where(F.col("consecutive_months") >= min_months).drop("_streak"))


def declining_trends(trends: DataFrame, min_months: int = 3, months: int = 4) -> DataFrame:
    n = F.col("consecutive_months")
    severity = F.when(n >= 5, "HIGH").when(n >= 4, "MEDIUM").otherwise("LOW")
    return shape(declining_streaks(trends, min_months)
                 .join(trend_baseline(trends, months), "derived_category").select(
        F.lit("DECLINING_TREND").alias("anomaly_type"), "derived_category",
        F.col("last_month").alias("detection_period"), F.col("lowest_rating").alias("current_value"),
        F.col("base_avg_rating").alias("baseline_value"), n.alias("deviation_score"),
        severity.alias("severity")), ANOMALY_COLUMNS)


def rank_drops(trends: DataFrame, places: int = 3, months: int = 4, min_reviews: int = 10) -> DataFrame:
    """Categories that lost places in the rating order.  The ranks run over one
    row per category."""
    sized = trends.where(F.col("review_count") >= min_reviews).crossJoin(latest_month(trends))
    now = (sized.where(F.col("review_month") == F.col("latest_month"))
           .withColumn("current_rank", F.rank().over(Window.orderBy(F.col("avg_rating").desc()))))
    base = (sized.where(in_baseline(months)).groupBy("derived_category")
            .agg(steady_round(F.avg("avg_rating"), 8).alias("_avg"))
            .withColumn("baseline_rank", F.rank().over(Window.orderBy(F.col("_avg").desc()))))
    lost = F.col("current_rank") - F.col("baseline_rank")
    return shape(now.join(base, "derived_category").where(lost >= places).select(
        F.lit("RANK_DROP").alias("anomaly_type"), "derived_category",
        F.col("latest_month").alias("detection_period"), F.col("current_rank").alias("current_value"),
        F.col("baseline_rank").alias("baseline_value"), lost.alias("deviation_score"),
        F.when(lost >= 5, "HIGH").when(lost >= 3, "MEDIUM").otherwise("LOW").alias("severity")),
        ANOMALY_COLUMNS)


def review_anomalies(trends: DataFrame, complaints: DataFrame) -> DataFrame:
    """All five category detectors.  Pass materialised marts: each is read
    several times.  The latest month and the baselines are worked out once."""
    judged = stash(judged_trends(trends), "judged-trends")
    parts = [rating_drops(trends, judged=judged), sentiment_shifts(trends, judged=judged),
             complaint_spikes(complaints), declining_trends(trends), rank_drops(trends)]
    return reduce(DataFrame.unionByName, parts)


def product_months(fact: DataFrame, min_reviews: int = 100, min_month: int = 5) -> DataFrame:
    """Monthly stats of products with enough reviews, and the latest month of
    the whole fact table.  The gate and the month come from the monthly counts,
    so the fact table is read once."""
    monthly = fact.groupBy("asin", month_of().alias("review_month")).agg(
        F.count(F.lit(1)).alias("review_count"), mean_of(F.col("rating"), 2).alias("avg_rating"),
        mean_of(F.col("sentiment_score"), 4).alias("avg_sentiment"))
    w = Window.partitionBy("asin")
    return (monthly.withColumn("_total", F.sum("review_count").over(w))
            .crossJoin(latest_month(monthly))
            .where((F.col("_total") >= min_reviews) & (F.col("review_count") >= min_month))
            .drop("_total"))


def product_baseline(monthly: DataFrame, months: int = 4) -> DataFrame:
    return monthly.where(in_baseline(months)).groupBy("asin").agg(
        F.avg("avg_rating").alias("_base"), F.stddev_samp("avg_rating").alias("_sd"))


def product_rating_drops(monthly: DataFrame, lookup: DataFrame, drop: float = 0.3,
                         score_floor: float = 0.1, severity_floor: float = 0.2) -> DataFrame:
    now, base, sd = F.col("avg_rating"), F.col("_base"), F.col("_sd")

    def spread(floor: float) -> Column:
        return F.when(sd.isNotNull(), F.greatest(sd, F.lit(floor)))

    hit = (monthly.where(F.col("review_month") == F.col("latest_month"))
           .join(product_baseline(monthly), "asin").where(below(now, base - drop)))
    severity = (F.when(below(now, base - 2 * spread(severity_floor)), "HIGH")
                .when(below(now, base - spread(severity_floor)), "MEDIUM").otherwise("LOW"))
    return _product_alert(hit, lookup, "PRODUCT_RATING_DROP", base,
                          steady_round((base - now) / spread(score_floor), 2), severity)


def product_worst_months(monthly: DataFrame, lookup: DataFrame, margin: float = 0.1) -> DataFrame:
    now, base = F.col("avg_rating"), F.col("_base")
    lowest = monthly.groupBy("asin").agg(F.min("avg_rating").alias("_low"))
    hit = (monthly.where(F.col("review_month") == F.col("latest_month"))
           .join(lowest, "asin").join(product_baseline(monthly), "asin")
           .where((now <= F.col("_low")) & below(now, base - margin)))
    return _product_alert(hit, lookup, "PRODUCT_WORST_MONTH", base,
                          steady_round(base - now, 2), F.lit("HIGH"))


def _product_alert(hit: DataFrame, lookup: DataFrame, kind: str, base: Column, score: Column,
                   severity: Column) -> DataFrame:
    named = hit.withColumns({
        "anomaly_type": F.lit(kind), "detection_period": F.col("review_month"),
        "current_value": F.col("avg_rating"), "baseline_value": base, "deviation_score": score,
        "affected_reviews": F.col("review_count"), "severity": severity})
    names = lookup.select("asin", "product_name", "brand", "derived_category")
    return shape(named.join(names, "asin", "left"), PRODUCT_COLUMNS)


def product_anomalies(monthly: DataFrame, lookup: DataFrame) -> DataFrame:
    return product_rating_drops(monthly, lookup).unionByName(product_worst_months(monthly, lookup))


def emerging_themes(fact: DataFrame, recent_months: int = 3, history_months: int = 12,
                    min_recent: int = 5, min_growth: float = 1.5, min_share: float = 5,
                    min_trend: int = 5, include_new: bool = False) -> DataFrame:
    """Themes whose share of a category grew.  Recent means the latest trend
    month and the ``recent_months`` before it.  A theme without history has no
    growth factor and is reported only with ``include_new``."""
    monthly = (fact.where(F.col("derived_category").isNotNull())
               .groupBy("derived_category", "review_theme", month_of().alias("review_month"))
               .agg(F.count(F.lit(1)).alias("_n")))
    trend = (monthly.groupBy("derived_category", "review_month").agg(F.sum("_n").alias("_all"))
             .where(F.col("_all") >= min_trend))
    recent = F.col("review_month") >= F.add_months("latest_month", -recent_months)
    history = ((F.col("review_month") >= F.add_months("latest_month", -recent_months - history_months))
               & ~recent)
    w = Window.partitionBy("derived_category")
    counts = (monthly.where(F.col("review_theme").isNotNull()).crossJoin(latest_month(trend))
              .groupBy("derived_category", "review_theme").agg(
                  F.sum(F.when(recent, F.col("_n")).otherwise(0)).alias("recent_review_count"),
                  F.sum(F.when(history, F.col("_n")).otherwise(0)).alias("historical_review_count"))
              .withColumn("_recent", F.sum("recent_review_count").over(w))
              .withColumn("_history", F.sum("historical_review_count").over(w)))
    now = ratio(F.col("recent_review_count") * 100, F.col("_recent"))
    before = ratio(F.col("historical_review_count") * 100, F.col("_history"))
    growth = F.col("growth_factor")
    keep = growth >= min_growth
    if include_new:
        keep = keep | growth.isNull()
    return (counts.where(F.col("recent_review_count") >= min_recent)
            .withColumn("recent_share", steady_round(now, 2))
            .withColumn("historical_share", steady_round(before, 2))
            .withColumn("growth_factor", ratio(now, before, 2))
            .where(keep & (F.col("recent_share") >= min_share))
            .withColumn("severity", F.when(growth >= 3, "HIGH").when(growth >= 2, "MEDIUM")
                        .otherwise("LOW"))
            .drop("_recent", "_history"))


def cross_category_alerts(anomalies: DataFrame, min_categories: int = 3) -> DataFrame:
    """Complaint themes spiking in several categories at once.  The highest
    severity is by order HIGH > MEDIUM > LOW, not by text."""
    worst = F.min_by("severity", rules.severity_rank(F.col("severity")))
    return (anomalies.where((F.col("anomaly_type") == "COMPLAINT_SPIKE")
                            & F.col("review_theme").isNotNull())
            .groupBy("review_theme").agg(
                F.countDistinct("derived_category").alias("affected_categories"),
                F.sort_array(F.collect_set("derived_category")).alias("category_list"),
                steady_round(F.avg("deviation_score"), 2).alias("avg_deviation"),
                worst.alias("max_severity"),
                F.sum("affected_reviews").alias("total_affected_reviews"))
            .where(F.col("affected_categories") >= min_categories))
