"""Metrics-layer queries: verified questions, families, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import steady_round
from ..session import stash
from ..sources import fixtures as fx
from . import metrics as mx
from .registry import query, rnd, sql
from .warehouse import build_marts


def marts_of(spark, d):
    return build_marts(stash(fx.reviews(spark, d), "fact"))


_M = "CAST(review_month AS VARCHAR) AS review_month"
_VERIFIED_SQL = {
    "worst_categories": ("SELECT derived_category, review_count, avg_rating, negative_rate FROM summary", "summary"),
    "top_complaints_by_category": ("""SELECT derived_category, review_theme, complaint_count, avg_sentiment AS complaint_avg_sentiment
      FROM complaints ORDER BY complaint_count DESC, derived_category, review_theme LIMIT 20""", "complaints"),
    "sentiment_trend": (f"""SELECT derived_category, {_M}, review_count AS monthly_review_count, avg_sentiment AS monthly_avg_sentiment,
      negative_rate AS monthly_negative_rate FROM trends""", "trends"),
    "best_rated_categories": ("SELECT derived_category, review_count, avg_rating, avg_sentiment FROM summary", "summary"),
    "high_quality_complaints": ("""SELECT derived_category, review_theme, complaint_count, avg_helpful_votes AS complaint_avg_helpful_votes,
      high_quality_rate FROM complaints ORDER BY avg_helpful_votes DESC, derived_category, review_theme LIMIT 15""", "complaints"),
}
for _name, (_text, _cte) in _VERIFIED_SQL.items():
    @query(f"x3_{_name}", sql(_text, _cte))
    def _(spark, d, _n=_name):
        return mx.verified(marts_of(spark, d), _n)


@query("x1_metric_query", sql(f"""SELECT derived_category, CAST(sum(review_count) AS BIGINT) AS total_monthly_reviews,
  {rnd('sum(avg_rating * review_count) / nullif(sum(review_count), 0)', 6)} AS avg_monthly_rating FROM trends
  WHERE review_month >= DATE '2000-01-01' GROUP BY derived_category""", "trends"))
def _(spark, d):
    q = mx.metric_query(marts_of(spark, d), "monthly_trends", ["Category", "total_monthly_reviews", "avg_monthly_rating"],
                        where=["review_month >= DATE '2000-01-01'"], order=["-total_monthly_reviews", "category"])
    return q.withColumn("avg_monthly_rating", steady_round(F.col("avg_monthly_rating"), 6))


@query("x2_synonyms_and_filter", sql(f"""SELECT CAST(sum(review_count) AS BIGINT) AS total_reviews_all_categories,
  {rnd('sum(negative_review_count) * 1.0::DOUBLE / nullif(sum(review_count), 0)', 6)} AS overall_negative_rate
  FROM summary WHERE negative_rate > 0.15""", "summary"))
def _(spark, d):
    q = mx.metric_query(marts_of(spark, d), "category_sentiment", ["total reviews", "overall_negative_rate"],
                        where=["problematic categories"])
    return q.withColumn("overall_negative_rate", steady_round(F.col("overall_negative_rate"), 6))


@query("j15_metric_join", sql("""SELECT c.derived_category, c.review_theme, c.complaint_count, s.review_count AS "category_sentiment.review_count"
  FROM complaints c LEFT JOIN summary s ON c.derived_category = s.derived_category""", "complaints", "summary"))
def _(spark, d):
    return mx.metric_query(marts_of(spark, d), "complaints",
                           ["category", "theme", "complaint_count", "category_sentiment.review_count"],
                           join="category_sentiment")


# one query per question family; the mart is the whole table each time
_FAMILIES = {
    "x4_top1": (lambda m: mx.extreme(m["category_summary"], "avg_rating", ["derived_category"]),
                "SELECT derived_category, avg_rating FROM summary ORDER BY avg_rating DESC, derived_category LIMIT 1", "summary"),
    "x4_bottom1": (lambda m: mx.extreme(m["category_summary"], "negative_rate", ["derived_category"], highest=False),
                   "SELECT derived_category, negative_rate FROM summary ORDER BY negative_rate, derived_category LIMIT 1", "summary"),
    "x4_point_value": (lambda m: mx.point_value(m["category_summary"], "median_sentiment", derived_category="SMALL"),
                       "SELECT median_sentiment FROM summary WHERE derived_category = 'SMALL'", "summary"),
    "x4_pairwise": (lambda m: mx.pair_values(m["category_summary"], "avg_sentiment", "derived_category", ["SMALL", "LARGE"]),
                    "SELECT derived_category, avg_sentiment FROM summary WHERE derived_category IN ('SMALL', 'LARGE')", "summary"),
    "x4_threshold": (lambda m: mx.threshold(m["category_summary"], "review_count > 7500", ["derived_category", "review_count"]),
                     "SELECT derived_category, review_count FROM summary WHERE review_count > 7500", "summary"),
    "x4_threshold_count": (lambda m: mx.threshold_count(m["product_summary"], "review_count > 25"),
                           "SELECT count(*) AS n FROM products WHERE review_count > 25", "products"),
    "x4_grand_total": (lambda m: mx.grand_total(m["category_summary"], "review_count"),
                       "SELECT CAST(sum(review_count) AS BIGINT) AS total_review_count FROM summary", "summary"),
    "x4_full_ranking": (lambda m: mx.ranking(m["product_summary"], "avg_sentiment", ["asin"], False),
                        "SELECT asin, avg_sentiment FROM products", "products"),
    "x4_recent_series": (lambda m: mx.series(m["monthly_trends"], "avg_sentiment", "PROMO", 12),
                         f"SELECT {_M}, avg_sentiment FROM trends t WHERE derived_category = 'PROMO' ORDER BY t.review_month DESC LIMIT 12", "trends"),
    "x4_peak_month": (lambda m: mx.extreme(m["monthly_trends"].where("derived_category = 'SMALL'"), "review_count", ["review_month"]),
                      f"SELECT {_M}, review_count FROM trends t WHERE derived_category = 'SMALL' ORDER BY review_count DESC, t.review_month LIMIT 1", "trends"),
    "x4_versus_mean": (lambda m: mx.versus_mean(m["category_summary"], "avg_sentiment", "LARGE"),
                       f"SELECT avg_sentiment, (SELECT {rnd('avg(avg_sentiment)', 6)} FROM summary) AS avg_all FROM summary WHERE derived_category = 'LARGE'", "summary"),
    "x4_theme_average": (lambda m: mx.regroup(m["theme_category"], "review_theme", "avg_sentiment"),
                         f"SELECT review_theme, {rnd('avg(avg_sentiment)', 6)} AS avg_avg_sentiment FROM themes GROUP BY review_theme", "themes"),
    "x4_theme_sum": (lambda m: mx.regroup(m["complaint_analysis"], "review_theme", "complaint_count", "sum"),
                     "SELECT review_theme, CAST(sum(complaint_count) AS BIGINT) AS sum_complaint_count FROM complaints GROUP BY review_theme", "complaints"),
    "x4_count_by_group": (lambda m: mx.count_by(m["product_summary"], "derived_category"),
                          "SELECT derived_category, count(*) AS n FROM products GROUP BY derived_category", "products"),
    "x5_category_lookup": (lambda m: mx.category_lookup(m, "PROMO"), "SELECT * FROM summary WHERE derived_category = 'PROMO'", "summary"),
    "x5_product_lookup": (lambda m: mx.product_lookup(m, 7), "SELECT * FROM products WHERE asin = 7", "products"),
    "x5_theme_breakdown": (lambda m: mx.theme_breakdown(m, "PROMO"), "SELECT * FROM themes WHERE derived_category = 'PROMO'", "themes"),
    "x5_complaint_data": (lambda m: mx.complaint_data(m, "PROMO"), "SELECT * FROM complaints WHERE derived_category = 'PROMO'", "complaints"),
    "x5_monthly_trends": (lambda m: mx.monthly_trends(m, "PROMO"),
                          f"SELECT * REPLACE (CAST(review_month AS VARCHAR) AS review_month) FROM trends WHERE derived_category = 'PROMO'", "trends"),
}
for _name, (_fn, _text, _cte) in _FAMILIES.items():
    @query(_name, sql(_text, _cte))
    def _(spark, d, _f=_fn):
        return _f(marts_of(spark, d))
