"""Marts, windows, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import mean_of
from ..operators import dedup, marts
from ..sources import fixtures as fx
from .registry import mean, pct, query, rnd, sql


@query("g1_category_summary", sql("SELECT * FROM summary", "summary"))
def _(spark, d):
    return marts.category_summary(fx.reviews(spark, d))


@query("g2_monthly_trends", sql("SELECT * REPLACE (CAST(review_month AS VARCHAR) AS review_month) FROM trends", "trends"))
def _(spark, d):
    return marts.monthly_trends(fx.reviews(spark, d))


@query("g3_product_summary", sql("SELECT * FROM products", "products"))
def _(spark, d):
    return marts.product_summary(fx.reviews(spark, d))


@query("g4_theme_category", sql("SELECT * FROM themes", "themes"))
def _(spark, d):
    return marts.theme_category(fx.reviews(spark, d))


@query("g5_complaint_analysis", sql("SELECT * FROM complaints", "complaints"))
def _(spark, d):
    return marts.complaint_analysis(fx.reviews(spark, d))


# ------------------------------------------------------------------ aggregates

@query("g6_label_summary_topk", sql(f"""SELECT asin, count(*) AS total_reviews, {mean('rating', 2)} AS avg_rating,
  count(*) FILTER (WHERE rating >= 4) AS positive_reviews, {pct('rating >= 4', 2)} AS positive_pct,
  count(*) FILTER (WHERE rating = 3) AS neutral_reviews, {pct('rating = 3', 2)} AS neutral_pct,
  count(*) FILTER (WHERE rating < 3) AS negative_reviews, {pct('rating < 3', 2)} AS negative_pct
  FROM reviews GROUP BY asin HAVING count(*) >= 20
  ORDER BY negative_pct DESC, total_reviews DESC, asin LIMIT 20""", "reviews"))
def _(spark, d):
    s = marts.label_summary(fx.reviews(spark, d), ["asin"]).where("total_reviews >= 20")
    return s.orderBy(F.col("negative_pct").desc(), F.col("total_reviews").desc(), F.col("asin")).limit(20)


@query("g7_duplicate_keys", sql("""SELECT review_id, count(*) AS cnt FROM raw_reviews
  GROUP BY review_id HAVING count(*) > 1""", "raw_reviews"))
def _(spark, d):
    return dedup.duplicate_keys(fx.reviews_with_duplicates(spark, d), ["review_id"])


@query("g10_distinct_counts", sql("""SELECT count(DISTINCT asin) AS products, count(DISTINCT user_id) AS users,
  count(DISTINCT derived_category) AS categories, count(DISTINCT source_category) AS sources FROM reviews_c""", "reviews_c"))
def _(spark, d):
    return fx.reviews(spark, d, customers=True).agg(
        F.countDistinct("asin").alias("products"), F.countDistinct("user_id").alias("users"),
        F.countDistinct("derived_category").alias("categories"),
        F.countDistinct("source_category").alias("sources"))


@query("g12_distinct_array", sql("""SELECT review_theme, string_agg(DISTINCT derived_category, ',' ORDER BY derived_category)
  AS category_list FROM reviews GROUP BY review_theme""", "reviews"))
def _(spark, d):
    return fx.reviews(spark, d).groupBy("review_theme").agg(
        F.sort_array(F.collect_set("derived_category")).alias("category_list"))


@query("g15_weighted_means", sql(f"""SELECT {rnd('sum(avg_rating * review_count) / nullif(sum(review_count), 0)', 4)} AS overall_avg_rating,
  {rnd('sum(negative_review_count) * 1.0::DOUBLE / nullif(sum(review_count), 0)', 4)} AS overall_negative_rate
  FROM summary""", "summary"))
def _(spark, d):
    s = marts.category_summary(fx.reviews(spark, d))
    from ..functions.numeric import ratio
    return s.agg(ratio(F.sum(F.col("avg_rating") * F.col("review_count")), F.sum("review_count"), 4)
                 .alias("overall_avg_rating"),
                 ratio(F.sum("negative_review_count"), F.sum("review_count"), 4).alias("overall_negative_rate"))


@query("g21_product_digest", sql(f"""
SELECT s.*, c.t AS complaint_texts, p.t AS strength_texts, a.t AS all_texts FROM (
  SELECT asin, count(*) AS total_reviews, {mean('rating', 2)} AS avg_rating,
  count(*) FILTER (WHERE rating >= 4) AS positive_reviews, {pct('rating >= 4', 2)} AS positive_pct,
  count(*) FILTER (WHERE rating = 3) AS neutral_reviews, {pct('rating = 3', 2)} AS neutral_pct,
  count(*) FILTER (WHERE rating < 3) AS negative_reviews, {pct('rating < 3', 2)} AS negative_pct
  FROM r GROUP BY asin) s
LEFT JOIN (SELECT asin, string_agg(review_text, ' ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY asin
  ORDER BY helpful_vote DESC, review_ts DESC, review_id) AS rn FROM r WHERE rating < 3) WHERE rn <= 30 GROUP BY asin) c ON s.asin = c.asin
LEFT JOIN (SELECT asin, string_agg(review_text, ' ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY asin
  ORDER BY helpful_vote DESC, review_ts DESC, review_id) AS rn FROM r WHERE rating >= 4) WHERE rn <= 30 GROUP BY asin) p ON s.asin = p.asin
LEFT JOIN (SELECT asin, string_agg(review_text, ' ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY asin
  ORDER BY helpful_vote DESC, review_ts DESC, review_id) AS rn FROM r) WHERE rn <= 40 GROUP BY asin) a ON s.asin = a.asin
""".replace("FROM r ", "FROM (SELECT *, length(review_text) % 7 AS helpful_vote, review_id % 30 AS review_ts FROM docs) ").replace(
    "FROM r)", "FROM (SELECT *, length(review_text) % 7 AS helpful_vote, review_id % 30 AS review_ts FROM docs))"), "docs"))
def _(spark, d):
    docs = fx.documents(spark, d).withColumns({
        "helpful_vote": F.length("review_text") % 7, "review_ts": F.col("review_id") % 30})
    return marts.product_digest(docs, "review_text")


# --------------------------------------------------------------------- windows

@query("w1_keep_latest", sql("""SELECT review_id, asin, supplier, rating, helpful_vote, verified_purchase, text_len,
  derived_category, sentiment_score::DOUBLE AS sentiment_score, review_theme FROM reviews""", "reviews"))
def _(spark, d):
    return fx.reviews(spark, d).select(
        "review_id", "asin", "supplier", "rating", "helpful_vote", "verified_purchase", "text_len",
        "derived_category", "sentiment_score", "review_theme")


@query("w1_before_after", sql("""SELECT (SELECT count(*) FROM raw_reviews) AS before_count,
  (SELECT count(*) FROM reviews) AS after_count""", "raw_reviews", "reviews"))
def _(spark, d):
    from ..sources.landing import count_check
    return count_check(fx.reviews_with_duplicates(spark, d), fx.reviews(spark, d))


@query("w2_metadata_dedup", sql("""SELECT asin, title, brand, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (
  PARTITION BY asin ORDER BY price DESC NULLS LAST, title) AS rn FROM metadata_dup) WHERE rn = 1""", "metadata_dup"))
def _(spark, d):
    return dedup.dedup_metadata(fx.metadata(spark, d, duplicates=True)).select("asin", "title", "brand", "price")


@query("w7_rating_rank", sql("""SELECT derived_category, avg_rating, rank() OVER (ORDER BY avg_rating DESC) AS rating_rank
  FROM summary""", "summary"))
def _(spark, d):
    s = marts.category_summary(fx.reviews(spark, d)).select("derived_category", "avg_rating")
    return s.withColumn("rating_rank", F.rank().over(Window.orderBy(F.col("avg_rating").desc())))


@query("k1_top_products", sql(f"""SELECT asin, count(*) AS total_reviews, {mean('rating', 2)} AS avg_rating FROM reviews
  GROUP BY asin HAVING count(*) >= 20 ORDER BY total_reviews DESC, asin LIMIT 20""", "reviews"))
def _(spark, d):
    return (fx.reviews(spark, d).groupBy("asin").agg(F.count(F.lit(1)).alias("total_reviews"),
                                                     mean_of(F.col("rating"), 2).alias("avg_rating"))
            .where("total_reviews >= 20").orderBy(F.col("total_reviews").desc(), "asin").limit(20))


@query("k2_most_helpful", sql("""SELECT asin, review_id, rating, helpful_vote, CAST(review_ts AS VARCHAR) AS review_ts, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY asin ORDER BY helpful_vote DESC NULLS LAST, review_ts DESC, review_id) AS rn
  FROM reviews WHERE rating <= 2) WHERE rn <= 15""", "reviews"))
def _(spark, d):
    neg = fx.reviews(spark, d).where("rating <= 2").select("asin", "review_id", "rating", "helpful_vote", "review_ts")
    return dedup.top_n(neg, ["asin"], [F.col("helpful_vote").desc_nulls_last(), F.col("review_ts").desc(),
                                       F.col("review_id")], 15, "rn")


@query("k5_recent_months", sql("""SELECT * REPLACE (CAST(review_month AS VARCHAR) AS review_month) FROM (SELECT *, row_number() OVER (
  PARTITION BY derived_category ORDER BY review_month DESC) AS recency FROM trends) WHERE recency <= 6""", "trends"))
def _(spark, d):
    from ..operators.profiles import recent_months
    return recent_months(marts.monthly_trends(fx.reviews(spark, d)))


@query("k7_top_mentions", sql("""SELECT asin, count(*) AS mention_count FROM docs WHERE regexp_matches(lower(review_text), '\\bthe\\b|\\bdie\\b')
  GROUP BY asin ORDER BY mention_count DESC, asin LIMIT 5""", "docs"))
def _(spark, d):
    from ..operators.search import top_mentions
    hits = fx.documents(spark, d).where(F.lower("review_text").rlike(r"(?<![a-z0-9_])(the|die)(?![a-z0-9_])"))
    return top_mentions(hits)


@query("u4_value_overlap", sql("""SELECT b.brand, count(*) AS shared FROM (SELECT DISTINCT lower(p_brand) AS brand, p_type FROM part) b
  JOIN (SELECT DISTINCT p_type FROM part) t ON b.p_type = t.p_type GROUP BY b.brand""", ))
def _(spark, d):
    from ..operators.evalruns import value_overlap
    p = fx.table(spark, d, "part")
    left = p.select(F.lower("p_brand").alias("brand"), F.col("p_type").alias("value"))
    return value_overlap(left, p.select(F.col("p_type").alias("value")), "brand")


# ----------------------------------------------------------------------- rules

@query("b7_quality_tier", sql("""SELECT review_quality, count(*) AS n, min(text_len) AS shortest, max(text_len) AS longest
  FROM docs GROUP BY review_quality""", "docs"))
def _(spark, d):
    return fx.documents(spark, d).groupBy("review_quality").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_len").alias("shortest"), F.max("text_len").alias("longest"))


@query("b8_rating_label", sql("""SELECT CASE WHEN rating >= 4 THEN 'Positive' WHEN rating = 3 THEN 'Neutral' ELSE 'Negative' END
  AS label, count(*) AS n FROM reviews GROUP BY 1""", "reviews"))
def _(spark, d):
    return fx.reviews(spark, d).groupBy(rules.rating_label(F.col("rating")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b15_confidence_tier", sql("""SELECT derivation_confidence, count(*) AS products FROM lookup GROUP BY 1""", "lookup"))
def _(spark, d):
    n = fx.reviews(spark, d).groupBy("asin").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return n.groupBy(rules.confidence_tier(F.col("n")).alias("derivation_confidence")).agg(
        F.count(F.lit(1)).alias("products"))
