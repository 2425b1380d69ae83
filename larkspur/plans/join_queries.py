"""Join shapes and the running streak, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import marts, monitor, profiles, skew
from ..session import stash
from ..sources import fixtures as fx
from ..sources import landing, sinks
from . import analytics_queries, monitor_queries, source_queries  # noqa: F401  (define the CTEs)
from .analytics_queries import fact_of
from .registry import query, sql
from .source_queries import _PICK, _old_and_all, _order


@query("j4_latest_month_cross", sql("""SELECT derived_category, CAST(lm AS VARCHAR) AS latest_month, review_count
  FROM trends, latest WHERE review_month = lm""", "latest"))
def _(spark, d):
    t = monitor_queries.trends(spark, d)
    return t.crossJoin(monitor.latest_month(t)).where("review_month = latest_month").select(
        "derived_category", "latest_month", "review_count")


@query("j6_anti_join", sql(f"SELECT {', '.join(_PICK)} FROM new_rows", "new_rows"))
def _(spark, d):
    old, everything = _old_and_all(spark, d)
    return sinks.new_rows(everything, old, "review_id", _order()).select(*_PICK)


@query("j7_id_membership", sql("""SELECT review_id, asin, rating FROM reviews
  WHERE asin IN (SELECT asin FROM metadata WHERE price >= 990)""", "reviews", "metadata"))
def _(spark, d):
    ids = fx.metadata(spark, d).where("price >= 990").select("asin")
    return skew.spread_join(fact_of(spark, d).select("review_id", "asin", "rating"), ids, "asin", "left_semi")


@query("j8_exclusion_second_pass", sql("""SELECT DISTINCT e.source_asin, e.asin FROM (
  SELECT m.asin AS source_asin, l.derived_category AS cat, unnest(m.also_buy[1:20]) AS asin FROM metadata m LEFT JOIN lookup l ON m.asin = l.asin) e
  JOIN lookup t ON e.asin = t.asin WHERE e.cat IS NULL OR t.derived_category <> e.cat""", "metadata", "lookup"))
def _(spark, d):
    fact = fact_of(spark, d)
    best = profiles.similar_products(fx.metadata(spark, d), fx.lookup(spark, d, fact), marts.product_summary(fact), limit=20)
    return best.where("related_category").select("source_asin", "asin")


@query("j9_scalar_cross_join", sql("""SELECT r.n AS reviews, p.n AS products FROM (SELECT count(*) AS n FROM reviews) r,
  (SELECT count(*) AS n FROM metadata) p""", "reviews", "metadata"))
def _(spark, d):
    return fx.reviews(spark, d).agg(F.count(F.lit(1)).alias("reviews")).crossJoin(
        fx.metadata(spark, d).agg(F.count(F.lit(1)).alias("products")))


@query("j10_scalar_subqueries", sql("""SELECT (SELECT count(*) FROM raw_reviews) AS before_count,
  (SELECT count(DISTINCT review_id) FROM raw_reviews) AS after_count""", "raw_reviews"))
def _(spark, d):
    raw = fx.reviews_with_duplicates(spark, d)
    return landing.count_check(raw, raw.select("review_id").distinct())


@query("w5_running_streak", sql("""SELECT derived_category, CAST(review_month AS VARCHAR) AS review_month,
  CAST(sum(CASE WHEN avg_rating < prev_rating THEN 0 ELSE 1 END) OVER (PARTITION BY derived_category ORDER BY review_month) AS BIGINT) AS streak
  FROM changes WHERE prev_rating IS NOT NULL""", "changes"))
def _(spark, d):
    changes = stash(monitor.monthly_changes(marts.monthly_trends(fx.reviews(spark, d))), "changes")
    w = (Window.partitionBy("derived_category").orderBy("review_month")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fell = F.col("avg_rating") < F.col("prev_rating")
    return changes.where("prev_rating IS NOT NULL").select(
        "derived_category", "review_month", F.sum(F.when(fell, 0).otherwise(1)).over(w).alias("streak"))
