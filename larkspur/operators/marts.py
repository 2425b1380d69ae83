"""Gold tables: the fact table and the aggregates built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import mean_of, percent_of, ratio, share_of, steady_round
from .dedup import dedup_metadata, top_n
from .skew import spread_join


def negative() -> Column:
    return F.col("rating") <= 2


def positive() -> Column:
    return F.col("rating") >= 4


def month_of(ts: str = "review_ts") -> Column:
    return F.trunc(F.col(ts).cast("date"), "MM")


def product_lookup(categories: DataFrame, names: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per categorised product; metadata wins over derived names."""
    brand, product = rules.clean_name(F.col("raw_product_name"))
    parsed = names.select("asin", brand.alias("_brand"), product.alias("_product"))
    meta = dedup_metadata(metadata).select(
        "asin", F.col("title").alias("metadata_title"), F.col("brand").alias("metadata_brand"),
        F.col("price").alias("metadata_price"), F.col("features_text").alias("metadata_features"),
        F.col("category_path").alias("metadata_category_path"), F.lit(True).alias("_has"))
    return (categories.join(parsed, "asin", "left").join(meta, "asin", "left")
            .select("asin", rules.canonical_category(F.col("derived_category"))
                    .alias("derived_category"),
                    "review_count", "derivation_confidence",
                    F.coalesce("metadata_brand", "_brand").alias("brand"),
                    F.coalesce("metadata_title", "_product").alias("product_name"),
                    "metadata_title", "metadata_brand", "metadata_price", "metadata_features",
                    "metadata_category_path",
                    F.coalesce("_has", F.lit(False)).alias("has_metadata")))


def fact_reviews(enriched: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every enriched review with its product's category, tier and name."""
    product = lookup.select("asin", "derived_category", "derivation_confidence", "brand",
                            "product_name")
    return spread_join(enriched, product, "asin", "left")


# A mart is made in two steps: mergeable sums and counts per group (a state), and
# the mart from the state.  States of several runs add up, so a mart is refreshed
# from the states of new rows without another look at the fact table.

CATEGORY_KEYS = ["derived_category", "sentiment_score"]
MONTH_KEYS = ["derived_category", "review_month"]
PRODUCT_KEYS = ["asin", "derived_category", "review_theme"]
THEME_KEYS = ["derived_category", "review_theme"]
THEME_MEASURES = ["n", "rated", "stars", "scored", "score", "neg", "neg_scored", "neg_score"]
COMPLAINT_MEASURES = ["n", "neg", "neg_scored", "neg_score", "neg_voted", "neg_votes", "neg_high"]
#: keys and measures of each state
STATES = {
    "category": (CATEGORY_KEYS, ["n", "rated", "stars", "neg", "pos", "ver", "voted", "votes"]),
    "month": (MONTH_KEYS, ["n", "rated", "stars", "scored", "score", "neg"]),
    "product": (PRODUCT_KEYS, ["n", "rated", "stars", "scored", "score", "neg", "ver", "voted", "votes"]),
    "theme": (THEME_KEYS, list(dict.fromkeys(THEME_MEASURES + COMPLAINT_MEASURES))),
}


def group_state(fact: DataFrame, keys: list[str], measures: list[str], sign: str | None = None) -> DataFrame:
    """The given counts and sums per group.  Rows with -1 in the column ``sign`` are taken
    away: the state of rows that a run corrects."""
    one = F.lit(1) if sign is None else F.col(sign)

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, one)), F.lit(0))

    def total(value: Column, condition: Column | None = None) -> Column:
        signed = value if sign is None else F.when(F.col(sign) < 0, -value).otherwise(value)
        return F.sum(signed if condition is None else F.when(condition, signed))

    score, votes, rating = F.col("sentiment_score"), F.col("helpful_vote"), F.col("rating")
    known = {
        "n": lambda: F.sum(one), "rated": lambda: count(rating.isNotNull()), "stars": lambda: total(rating),
        "scored": lambda: count(score.isNotNull()), "score": lambda: total(score),
        "neg": lambda: count(negative()), "pos": lambda: count(positive()),
        "ver": lambda: count(F.col("verified_purchase")),
        "voted": lambda: count(votes.isNotNull()), "votes": lambda: total(votes),
        "neg_scored": lambda: count(negative() & score.isNotNull()), "neg_score": lambda: total(score, negative()),
        "neg_voted": lambda: count(negative() & votes.isNotNull()), "neg_votes": lambda: total(votes, negative()),
        "neg_high": lambda: count(negative() & (F.col("review_quality") == "high"))}
    rows = fact.withColumn("review_month", month_of()) if "review_month" in keys else fact
    return rows.groupBy(*keys).agg(*[known[m]().alias(m) for m in measures])


def merge_states(states: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Adds up the states of several runs; groups left without rows go."""
    return states.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).where(F.col("n") > 0)


def category_from_state(state: DataFrame) -> DataFrame:
    """Groups per distinct score (a score has four digits, so at most 20,001 of
    them) keep the exact median small."""
    score, n = F.col("sentiment_score"), F.col("n")
    return (state.where(F.col("derived_category").isNotNull()).groupBy("derived_category").agg(
        F.sum(n).alias("review_count"),
        ratio(F.sum("stars"), F.sum("rated"), 2).alias("avg_rating"),
        ratio(F.sum(score * n), F.sum(F.when(score.isNotNull(), n)), 4).alias("avg_sentiment"),
        steady_round(F.expr("percentile(cast(sentiment_score as double), 0.5, n)"), 4).alias("median_sentiment"),
        F.sum("neg").alias("negative_review_count"), F.sum("pos").alias("positive_review_count"),
        ratio(F.sum("neg"), F.sum(n), 4).alias("negative_rate"), F.sum("ver").alias("verified_count"),
        ratio(F.sum("votes"), F.sum("voted"), 2).alias("avg_helpful_votes")))


def months_from_state(state: DataFrame, min_reviews: int = 5) -> DataFrame:
    return state.where(F.col("derived_category").isNotNull() & (F.col("n") >= min_reviews)).select(
        "derived_category", "review_month", F.col("n").alias("review_count"),
        ratio(F.col("stars"), F.col("rated"), 2).alias("avg_rating"),
        ratio(F.col("score"), F.col("scored"), 4).alias("avg_sentiment"),
        F.col("neg").alias("negative_review_count"),
        ratio(F.col("neg"), F.col("n"), 4).alias("negative_rate"))


def products_from_state(state: DataFrame, min_reviews: int = 20) -> DataFrame:
    """With the most frequent theme, the first label on a tie."""
    # smallest (-count, label) = highest count, then first label
    top = F.min(F.when(F.col("review_theme").isNotNull(),
                       F.struct((-F.col("n")).alias("n"), F.col("review_theme").alias("label"))))
    return (state.groupBy("asin", "derived_category").agg(
        F.sum("n").alias("review_count"),
        ratio(F.sum("stars"), F.sum("rated"), 2).alias("avg_rating"),
        ratio(F.sum("score"), F.sum("scored"), 4).alias("avg_sentiment"),
        F.sum("neg").alias("negative_review_count"),
        ratio(F.sum("neg"), F.sum("n"), 4).alias("negative_rate"),
        F.sum("ver").alias("verified_count"),
        ratio(F.sum("votes"), F.sum("voted"), 2).alias("avg_helpful_votes"),
        top["label"].alias("top_theme")).where(F.col("review_count") >= min_reviews))


def themes_from_state(state: DataFrame, min_reviews: int = 10) -> DataFrame:
    known = F.col("derived_category").isNotNull() & F.col("review_theme").isNotNull()
    return state.where(known & (F.col("n") >= min_reviews)).select(
        *THEME_KEYS, F.col("n").alias("review_count"),
        ratio(F.col("stars"), F.col("rated"), 2).alias("avg_rating"),
        ratio(F.col("score"), F.col("scored"), 4).alias("avg_sentiment"),
        F.col("neg").alias("negative_review_count"),
        ratio(F.col("neg"), F.col("n"), 4).alias("negative_rate"),
        ratio(F.col("neg_score"), F.col("neg_scored"), 4).alias("negative_avg_sentiment"))


def complaints_from_state(state: DataFrame, min_reviews: int = 5) -> DataFrame:
    return state.where(F.col("derived_category").isNotNull() & (F.col("neg") >= min_reviews)).select(
        *THEME_KEYS, F.col("neg").alias("complaint_count"),
        ratio(F.col("neg_score"), F.col("neg_scored"), 4).alias("avg_sentiment"),
        ratio(F.col("neg_votes"), F.col("neg_voted"), 2).alias("avg_helpful_votes"),
        F.col("neg_high").alias("high_quality_complaints"),
        ratio(F.col("neg_high"), F.col("neg"), 4).alias("high_quality_rate"))


def category_summary(fact: DataFrame) -> DataFrame:
    return category_from_state(group_state(fact, *STATES["category"]))


def monthly_trends(fact: DataFrame, min_reviews: int = 5) -> DataFrame:
    return months_from_state(group_state(fact, *STATES["month"]), min_reviews)


def product_summary(fact: DataFrame, min_reviews: int = 20) -> DataFrame:
    return products_from_state(group_state(fact, *STATES["product"]), min_reviews)


def theme_category(fact: DataFrame, min_reviews: int = 10) -> DataFrame:
    return themes_from_state(group_state(fact, THEME_KEYS, THEME_MEASURES), min_reviews)


def complaint_analysis(fact: DataFrame, min_reviews: int = 5) -> DataFrame:
    return complaints_from_state(group_state(fact, THEME_KEYS, COMPLAINT_MEASURES), min_reviews)


def marts_from_states(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five gold marts from merged states by the names of ``STATES``."""
    return {"category_summary": category_from_state(states["category"]),
            "monthly_trends": months_from_state(states["month"]),
            "product_summary": products_from_state(states["product"]),
            "theme_category": themes_from_state(states["theme"]),
            "complaint_analysis": complaints_from_state(states["theme"])}


def label_summary(fact: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Positive / neutral / negative counts and percentages per key."""
    label = rules.rating_label(F.col("rating"))
    out = [F.count(F.lit(1)).alias("total_reviews"), mean_of(F.col("rating"), 2).alias("avg_rating")]
    for name in ("Positive", "Neutral", "Negative"):
        out.append(F.count_if(label == name).alias(f"{name.lower()}_reviews"))
        out.append(percent_of(label == name, digits).alias(f"{name.lower()}_pct"))
    return fact.groupBy(*keys).agg(*out)


def worst_products(fact: DataFrame, min_reviews: int = 100, k: int = 10) -> DataFrame:
    return (fact.groupBy("asin").agg(
        F.count(F.lit(1)).alias("total_reviews"), mean_of(F.col("rating"), 2).alias("avg_rating"),
        percent_of(negative(), 1).alias("negative_pct"))
        .where(F.col("total_reviews") >= min_reviews)
        .orderBy(F.col("negative_pct").desc(), F.col("asin")).limit(k))


def theme_stats(fact: DataFrame) -> DataFrame:
    """Per product and theme: size, means, shares beyond +/-0.2 sentiment."""
    s = F.col("sentiment_score")
    return fact.groupBy("asin", "review_theme").agg(
        F.count(F.lit(1)).alias("total_reviews"), mean_of(s, 3).alias("avg_sentiment"),
        mean_of(F.col("rating"), 2).alias("avg_rating"),
        share_of(s > 0.2, 3).alias("positive_pct"), share_of(s < -0.2, 3).alias("negative_pct"))


def theme_breakdown(fact: DataFrame) -> DataFrame:
    return fact.groupBy("asin", "review_theme").agg(
        F.count(F.lit(1)).alias("review_count"), mean_of(F.col("sentiment_score"), 3)
        .alias("avg_sentiment"), mean_of(F.col("rating"), 2).alias("avg_rating"),
        F.count_if(negative()).alias("negative_count"))


def overall_means(summary: DataFrame) -> DataFrame:
    """Plain means over the categories of the summary mart (one row)."""
    return summary.agg(mean_of(F.col("avg_rating"), 2).alias("avg_rating"),
                       mean_of(F.col("avg_sentiment"), 4).alias("avg_sentiment"),
                       mean_of(F.col("negative_rate"), 4).alias("negative_rate"))


def executive_overview(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("total_categories"),
                       F.sum("review_count").alias("total_reviews"),
                       mean_of(F.col("avg_rating"), 2).alias("avg_rating"),
                       steady_round(F.avg("negative_rate") * 100, 1).alias("avg_negative_pct"))


def product_digest(fact: DataFrame, body: str, k: int = 30, k_all: int = 40) -> DataFrame:
    """Per product: label metrics and the texts a complaint, a strength and an
    improvement summary would be written from (most helpful first)."""
    order = [F.col("helpful_vote").desc_nulls_last(), F.col("review_ts").desc_nulls_last(),
             F.col("review_id")]
    label = rules.rating_label(F.col("rating"))

    def texts(rows: DataFrame, n: int, name: str) -> DataFrame:
        top = top_n(rows.select("asin", "helpful_vote", "review_ts", "review_id",
                                F.col(body).alias("_t")), ["asin"], order, n, "_rn")
        return top.groupBy("asin").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "_t"))), lambda x: x["_t"]), " ").alias(name))

    return (label_summary(fact, ["asin"])
            .join(texts(fact.where(label == "Negative"), k, "complaint_texts"), "asin", "left")
            .join(texts(fact.where(label == "Positive"), k, "strength_texts"), "asin", "left")
            .join(texts(fact, k_all, "all_texts"), "asin", "left"))
