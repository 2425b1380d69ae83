"""Product analytics over all products: profile, search, comparison, similar
products, brands, price brackets, reports.  A lookup for one product or brand
is a filter on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import rules, text
from ..functions.numeric import TIE, mean_of, ratio, share_of, steady_round
from ..session import stash
from .dedup import dedup_metadata, top_n
from .marts import negative, overall_means, theme_breakdown
from .search import evidence, report_queries
from .skew import spread_join


def sorted_structs(order: Column, *fields: Column) -> Column:
    """Rows of a group as an array of structs in ascending ``order``; use only
    where the group is bounded by a vocabulary, a calendar or a top-n."""
    packed = F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("v"))))
    return F.transform(packed, lambda x: x["v"])


def product_profile(lookup: DataFrame, products: DataFrame, categories: DataFrame,
                    fact: DataFrame) -> DataFrame:
    """Lookup, summary, category averages, deltas and theme breakdown (at most
    one entry per theme label) for every product."""
    stats = products.select("asin", "avg_rating", "avg_sentiment", "negative_rate", "top_theme")
    cat = categories.select(
        "derived_category", F.col("avg_rating").alias("category_avg_rating"),
        F.col("avg_sentiment").alias("category_avg_sentiment"),
        F.col("negative_rate").alias("category_avg_negative_rate"))
    themes = theme_breakdown(fact).groupBy("asin").agg(sorted_structs(
        F.struct(-F.col("review_count"), F.col("review_theme")),
        F.col("review_theme"), "review_count", "avg_sentiment", "avg_rating", "negative_count").alias("themes"))
    return (lookup.join(stats, "asin", "left").join(cat, "derived_category", "left")
            .join(themes, "asin", "left")
            .withColumn("rating_vs_category",
                        steady_round(F.col("avg_rating") - F.col("category_avg_rating"), 2))
            .withColumn("sentiment_vs_category",
                        steady_round(F.col("avg_sentiment") - F.col("category_avg_sentiment"), 4)))


SORTS = {
    "review_count": lambda: F.col("review_count").desc(),
    "avg_rating": lambda: F.col("avg_rating").desc_nulls_last(),
    "price": lambda: F.col("price").asc_nulls_last(),
    "avg_sentiment": lambda: F.col("avg_sentiment").desc_nulls_last(),
    "theme_sentiment": lambda: F.col("theme_avg_sentiment").desc_nulls_last(),
}


def sort_key(name: str, themed: bool) -> Column:
    """Ordering by name; unknown names fall back to the review count, and a
    themed search sorts by the theme's sentiment unless told otherwise."""
    if themed and name == "review_count":
        name = "theme_sentiment"
    if name == "theme_sentiment" and not themed:
        name = "avg_sentiment"
    return SORTS.get(name, SORTS["review_count"])()


def search_products(lookup: DataFrame, metadata: DataFrame, products: DataFrame,
                    fact: DataFrame | None = None, *, category: str | None = None,
                    brand: str | None = None, min_price: float | None = None,
                    max_price: float | None = None, features_contain: str | None = None,
                    min_rating: float | None = None, min_reviews: int = 5,
                    sort_by: str = "review_count", limit: int = 10,
                    review_theme: str | None = None) -> DataFrame:
    """Products meeting every given condition."""
    meta = dedup_metadata(metadata).select(
        "asin", "price", F.col("brand").alias("_brand"), F.col("features_text").alias("_features"))
    if brand is not None:
        meta = meta.where(F.lower("_brand").contains(brand.lower()))
    if min_price is not None:
        meta = meta.where(F.col("price") >= min_price)
    if max_price is not None:
        meta = meta.where(F.col("price") <= max_price)
    if features_contain is not None:
        meta = meta.where(F.lower("_features").contains(features_contain.lower()))
    needs_meta = any(v is not None for v in (brand, min_price, max_price, features_contain))
    base = lookup.where(F.col("review_count") >= min_reviews)
    if category is not None:
        base = base.where(F.col("derived_category") == category)
    stats = products.select("asin", "avg_rating", "avg_sentiment", "negative_rate", "top_theme")
    if min_rating is not None:
        stats = stats.where(F.col("avg_rating") >= min_rating)
    out = (base.select("asin", "product_name", "brand", "derived_category", "review_count")
           .join(meta.drop("_brand"), "asin", "inner" if needs_meta else "left")
           .join(stats, "asin", "inner" if min_rating is not None else "left"))
    columns = ["asin", "product_name", "brand", "price", "derived_category", "review_count",
               "avg_rating", "avg_sentiment", "negative_rate", "top_theme",
               F.col("_features").alias("features")]
    if review_theme is not None:
        liked = (fact.where((F.col("review_theme") == review_theme) & (F.col("sentiment_score") > 0))
                 .groupBy("asin").agg(F.count(F.lit(1)).alias("theme_review_count"),
                                      mean_of(F.col("sentiment_score"), 3).alias("theme_avg_sentiment"),
                                      mean_of(F.col("rating"), 2).alias("theme_avg_rating"))
                 .where(F.col("theme_review_count") >= 2))
        out = out.join(liked, "asin")
        columns += ["theme_review_count", "theme_avg_sentiment", "theme_avg_rating"]
    return out.orderBy(sort_key(sort_by, review_theme is not None), F.col("asin")).limit(limit).select(*columns)


PRODUCT_METRICS = {"avg_rating": True, "avg_sentiment": True, "negative_rate": False,
                   "review_count": True, "price": False}
BRAND_METRICS = {"avg_rating": True, "avg_sentiment": True, "negative_rate": False,
                 "total_reviews": True, "total_products": True}


def compare(rows: DataFrame, key: str, metrics: dict[str, bool]) -> DataFrame:
    """Long table (metric, key, value) of the compared rows with the best and
    worst key and the spread of each metric, wins per key and the winner.  A
    metric needs two values; ties go to the smaller key.  ``rows`` holds the
    handful of entities under comparison."""
    args = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = (rows.select(F.col(key), F.expr(f"stack({len(metrics)}, {args}) as (metric, value)"))
            .where(F.col("value").isNotNull()))
    higher = F.col("metric").isin(*[m for m, up in metrics.items() if up])
    signed = F.when(higher, -F.col("value")).otherwise(F.col("value"))
    per = Window.partitionBy("metric")
    best = F.row_number().over(per.orderBy(signed, F.col(key)))
    worst = F.row_number().over(per.orderBy(signed.desc(), F.col(key).desc()))
    ranked = (long.withColumn("_n", F.count(F.lit(1)).over(per)).where(F.col("_n") >= 2)
              .withColumn("_b", best).withColumn("_w", worst)
              .withColumn("best", F.max(F.when(F.col("_b") == 1, F.col(key))).over(per))
              .withColumn("worst", F.max(F.when(F.col("_w") == 1, F.col(key))).over(per))
              .withColumn("spread", steady_round(F.max("value").over(per) - F.min("value").over(per), 4)))
    wins = Window.partitionBy(key)
    won = ranked.withColumn("wins", F.sum(F.when(F.col("_b") == 1, 1).otherwise(0)).over(wins))
    winner = won.agg(F.min(F.struct(-F.col("wins"), F.col(key)))[key].alias("overall_winner"))
    return won.crossJoin(F.broadcast(winner)).drop("_n", "_b", "_w")


def compare_products(profiles: DataFrame, asins: list) -> DataFrame:
    return compare(profiles.where(F.col("asin").isin(asins)), "asin", PRODUCT_METRICS)


def top_product_themes(fact: DataFrame, asins: list | None = None, k: int = 3) -> DataFrame:
    rows = fact if asins is None else fact.where(F.col("asin").isin(asins))
    counts = rows.groupBy("asin", "review_theme").agg(F.count(F.lit(1)).alias("review_count"))
    return top_n(counts, ["asin"], [F.col("review_count").desc(), F.col("review_theme")], k, "theme_rank")


def brand_base(metadata: DataFrame, fact: DataFrame) -> DataFrame:
    """Review sums per product joined to the product's brand and price.  A
    product's reviews collapse to one row before the join."""
    per_product = fact.groupBy("asin").agg(
        F.count("review_id").alias("_n"), F.count("rating").alias("_rated"), F.sum("rating").alias("_stars"),
        F.count("sentiment_score").alias("_scored"), F.sum("sentiment_score").alias("_score"),
        F.count_if(negative()).alias("_neg"))
    meta = dedup_metadata(metadata).select(
        "asin", "title", "price", rules.normal_brand(F.col("brand")).alias("brand"))
    return meta.join(per_product, "asin", "left")


def _review_means() -> list[Column]:
    return [ratio(F.sum("_stars"), F.sum("_rated"), 2).alias("avg_rating"),
            ratio(F.sum("_score"), F.sum("_scored"), 4).alias("avg_sentiment"),
            ratio(F.sum("_neg"), F.sum("_n"), 4).alias("negative_rate")]


def brand_overview(metadata: DataFrame, fact: DataFrame) -> DataFrame:
    """Per brand.  ``avg_price`` weights a product by its reviews (one for a
    product without any); ``avg_product_price`` is the plain mean."""
    weight = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    priced = F.when(F.col("price").isNotNull(), weight)
    return brand_base(metadata, fact).where(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count(F.lit(1)).alias("total_products"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_reviews"),
        *_review_means(), ratio(F.sum(F.col("price") * weight), F.sum(priced), 2).alias("avg_price"),
        mean_of(F.col("price"), 2).alias("avg_product_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def brand_categories(metadata: DataFrame, lookup: DataFrame, fact: DataFrame) -> DataFrame:
    cat = lookup.where(F.col("derived_category").isNotNull()).select("asin", "derived_category")
    return (brand_base(metadata, fact).join(cat, "asin").groupBy("brand", "derived_category").agg(
        F.count(F.lit(1)).alias("products"), F.coalesce(F.sum("_n"), F.lit(0)).alias("reviews")))


def brand_top_products(metadata: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    meta = dedup_metadata(metadata).select(
        "asin", "title", rules.normal_brand(F.col("brand")).alias("brand"))
    j = meta.join(products.select("asin", "review_count", "avg_rating", "avg_sentiment"), "asin")
    return top_n(j, ["brand"], [F.col("review_count").desc(), F.col("asin")], k, "product_rank")


def brand_complaints(metadata: DataFrame, fact: DataFrame, k: int = 5) -> DataFrame:
    per = fact.where(negative()).groupBy("asin", "review_theme").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("sentiment_score").alias("_score"),
        F.count("sentiment_score").alias("_scored"))
    brand = dedup_metadata(metadata).select("asin", rules.normal_brand(F.col("brand")).alias("brand"))
    themes = per.join(brand, "asin").groupBy("brand", "review_theme").agg(
        F.sum("_n").alias("complaints"), ratio(F.sum("_score"), F.sum("_scored"), 3).alias("avg_sentiment"))
    return top_n(themes, ["brand"], [F.col("complaints").desc(), F.col("review_theme").asc_nulls_last()],
                 k, "theme_rank")


def compare_brands(overview: DataFrame, brands: list[str]) -> DataFrame:
    keys = [b.strip().lower() for b in brands]
    keys = [vocab.BRAND_ALIASES.get(k, k) for k in keys]
    return compare(overview.where(F.col("brand").isin(keys)), "brand", BRAND_METRICS)


def brand_reviews(fact: DataFrame, metadata: DataFrame, brand: str) -> DataFrame:
    """Reviews of products whose brand contains the text (any case)."""
    meta = dedup_metadata(metadata).where(F.lower("brand").contains(brand.lower()))
    return spread_join(fact, meta.select("asin", "title", "price"), "asin", "inner")


def compare_categories(summary: DataFrame, categories: list[str]) -> DataFrame:
    return summary.where(F.col("derived_category").isin(categories)).select(
        "derived_category", "review_count", "avg_rating", "avg_sentiment", "negative_rate",
        "avg_helpful_votes").orderBy("derived_category")


def similar_products(metadata: DataFrame, lookup: DataFrame, products: DataFrame, limit: int = 5,
                     edges: int | None = None) -> DataFrame:
    """Co-purchased products per source: same category first, then others, by
    review count.  Every edge counts unless ``edges`` says how many.  Metadata and
    the pairs are stored once; popular targets are spread over sub-keys in the join."""
    meta = stash(dedup_metadata(metadata).select("asin", "price", "also_buy"), "metadata")
    lookup = stash(lookup.select("asin", "product_name", "brand", "derived_category"), "lookup")
    source = meta.join(lookup.select("asin", F.col("derived_category").alias("source_category")), "asin", "left")
    bought = F.col("also_buy") if edges is None else F.slice("also_buy", 1, edges)
    pairs = stash(source.select(F.col("asin").alias("source_asin"), "source_category",
                                F.explode(F.array_distinct(bought)).alias("asin")), "pairs")
    target = (lookup
              .join(meta.select("asin", "price"), "asin", "left")
              .join(products.select("asin", "review_count", "avg_rating", "avg_sentiment"), "asin", "left"))
    related = F.col("source_category").isNotNull() & (F.col("derived_category") != F.col("source_category"))
    j = (spread_join(pairs, target, "asin", "inner", row_id="source_asin")
         # without a source category every target counts as cross-category
         .withColumn("related_category", F.col("source_category").isNull() | related))
    best = top_n(j, ["source_asin"], [F.col("related_category"), F.col("review_count").desc_nulls_last(),
                                      F.col("asin")], limit, "similar_rank").drop("source_category")
    return best.withColumn("full_title", F.col("product_name")).withColumn(
        "product_name", text.clean_title(F.col("product_name")))


def price_value(metadata: DataFrame, lookup: DataFrame, fact: DataFrame, cuts=tuple(vocab.PRICE_CUTS),
                labels=tuple(vocab.PRICE_LABELS)) -> DataFrame:
    """Price bracket against quality per category; the bracket with the highest
    rating is marked (the cheaper one on a tie)."""
    cat = lookup.where(F.col("derived_category").isNotNull()).select("asin", "derived_category")
    base = brand_base(metadata, fact).where((F.col("price") > 0) & (F.col("_n") > 0)).join(cat, "asin")
    out = (base.withColumn("price_bracket", rules.price_bracket(F.col("price"), cuts, labels))
           .groupBy("derived_category", "price_bracket").agg(
               F.count(F.lit(1)).alias("product_count"), F.sum("_n").alias("review_count"), *_review_means(),
               steady_round(F.min("price"), 2).alias("min_price"), steady_round(F.max("price"), 2).alias("max_price"),
               ratio(F.sum(F.col("price") * F.col("_n")), F.sum("_n"), 2).alias("avg_price")))
    w = Window.partitionBy("derived_category").orderBy(F.col("avg_rating").desc_nulls_last(), "avg_price")
    return out.withColumn("best_value", F.row_number().over(w) == 1)


def category_detail(summary: DataFrame, themes: DataFrame, complaints: DataFrame,
                    trends: DataFrame) -> DataFrame:
    """Summary with arrays of themes, complaints and months per category."""
    t = themes.groupBy("derived_category").agg(sorted_structs(
        F.struct(-F.col("review_count"), F.col("review_theme")),
        F.col("review_theme"), "review_count", "avg_rating", "avg_sentiment", "negative_rate").alias("themes"))
    c = complaints.groupBy("derived_category").agg(sorted_structs(
        F.struct(-F.col("complaint_count"), F.col("review_theme")),
        F.col("review_theme"), "complaint_count", "avg_sentiment", "avg_helpful_votes",
        "high_quality_complaints", "high_quality_rate").alias("complaints"))
    m = trends.groupBy("derived_category").agg(sorted_structs(
        F.col("review_month"), F.col("review_month"), "review_count", "avg_rating", "avg_sentiment",
        "negative_rate").alias("months"))
    return (summary.join(t, "derived_category", "left").join(c, "derived_category", "left")
            .join(m, "derived_category", "left"))


def recent_months(trends: DataFrame, n: int = 6) -> DataFrame:
    return top_n(trends, ["derived_category"], [F.col("review_month").desc()], n, "recency")


def category_report(summary: DataFrame, themes: DataFrame, complaints: DataFrame, trends: DataFrame,
                    evidence: DataFrame | None = None) -> DataFrame:
    """One row per category: stats, deltas to the plain mean of all categories,
    signal, themes, complaints, the last six months and evidence quotes."""
    mean = overall_means(summary).select(
        F.col("avg_rating").alias("overall_rating"), F.col("avg_sentiment").alias("overall_sentiment"),
        F.col("negative_rate").alias("overall_negative_rate"))
    out = (category_detail(summary, themes, complaints, recent_months(trends))
           .crossJoin(F.broadcast(mean))
           .withColumn("signal", rules.business_signal(F.col("avg_rating"), F.col("negative_rate")))
           .withColumn("rating_vs_overall", steady_round(F.col("avg_rating") - F.col("overall_rating"), 2))
           .withColumn("top_complaint", F.col("complaints")[0]["review_theme"]))
    if evidence is not None:
        quotes = evidence.groupBy("derived_category").agg(sorted_structs(
            F.struct("polarity", "evidence_rank"), F.col("polarity"), "rating", "quote").alias("evidence"))
        out = out.join(quotes, "derived_category", "left")
    return out


def product_report(products: DataFrame, lookup: DataFrame, summary: DataFrame, fact: DataFrame,
                   evidence: DataFrame | None = None) -> DataFrame:
    """One row per summarised product: stats, category comparison, signal,
    display name, themes and evidence quotes."""
    brand = F.coalesce(F.trim(F.replace("brand", F.lit("\n"), F.lit(""))), F.lit("Unknown"))
    name = F.coalesce(F.trim(F.replace("product_name", F.lit("\n"), F.lit(""))), F.col("asin").cast("string"))
    cat = summary.select("derived_category", F.col("avg_rating").alias("category_avg_rating"),
                         F.col("avg_sentiment").alias("category_avg_sentiment"),
                         F.col("negative_rate").alias("category_negative_rate"))
    themes = theme_breakdown(fact).groupBy("asin").agg(sorted_structs(
        F.struct(-F.col("review_count"), F.col("review_theme")),
        F.col("review_theme"), "review_count", "avg_sentiment", "negative_count").alias("themes"))
    out = (products.join(lookup.select("asin", "brand", "product_name"), "asin", "left")
           .withColumn("display_name", F.when(brand != "Unknown", F.concat(brand, F.lit(" - "), name))
                       .otherwise(name))
           .withColumn("signal", rules.business_signal(F.col("avg_rating"), F.col("negative_rate")))
           .join(cat, "derived_category", "left").join(themes, "asin", "left")
           .drop("brand", "product_name"))
    if evidence is not None:
        quotes = evidence.groupBy("asin").agg(sorted_structs(
            F.struct("polarity", "evidence_rank"), F.col("polarity"), "rating", "quote").alias("evidence"))
        out = out.join(quotes, "asin", "left")
    return out


def reports_with_evidence(summary: DataFrame, themes: DataFrame, complaints: DataFrame, trends: DataFrame,
                          products: DataFrame, lookup: DataFrame, fact: DataFrame,
                          body: str = "review_text") -> tuple[DataFrame, DataFrame]:
    """Category and product reports with quotes from the reviews of ``fact``: for a
    category about its most frequent complaint, for a product about its complaints
    in general, and in praise of both."""
    worst = top_n(complaints, ["derived_category"],
                  [F.col("complaint_count").desc(), F.col("review_theme").asc_nulls_last()], 1)
    about = summary.select("derived_category").join(worst.select("derived_category", "review_theme"),
                                                    "derived_category", "left")
    by_category = evidence(fact, report_queries(about, "derived_category", "review_theme"), "derived_category", body=body)
    by_product = evidence(fact, report_queries(products.select("asin").distinct(), "asin"), "asin", body=body)
    return (category_report(summary, themes, complaints, trends, by_category),
            product_report(products, lookup, summary, fact, by_product))


def product_signals(reviews: DataFrame, as_of: str, recent_months_: int = 6) -> DataFrame:
    """The extended signal per product, from one pass over the reviews."""
    from ..functions.numeric import percent_of

    recent = F.col("review_ts") >= F.add_months(F.lit(as_of).cast("date"), -recent_months_).cast("timestamp_ntz")
    stats = reviews.groupBy("asin").agg(
        mean_of(F.col("rating"), 2).alias("avg_rating"), percent_of(negative(), 1).alias("negative_pct"),
        F.count_if(negative() & recent).alias("recent_negative"), F.count_if(negative()).alias("total_negative"))
    return stats.withColumn("signal", rules.extended_signal(
        F.col("avg_rating"), F.col("negative_pct"), F.col("recent_negative"), F.col("total_negative")))


def claim_words(claims: DataFrame, reviews: DataFrame, words: Column, stop_share: float) -> DataFrame:
    """(asin, claim_no, word, weight) for the words of claims that tell something: those
    in at most ``stop_share`` of all reviews.  A word weighs the logarithm of reviews
    per review with it, in millionths, so that sums do not depend on their order."""
    each = stash(claims.select("asin", "claim_no", F.explode("words").alias("word")), "claim-words")
    total = reviews.count()
    seen = reviews.select(F.explode(words).alias("word")).join(
        each.select("word").distinct(), "word", "left_semi")
    rare = (seen.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
            .where(F.col("_df") <= stop_share * total)
            .select("word", F.round(F.ln(F.lit(total) / F.col("_df")) * 1000000).cast("bigint").alias("weight")))
    return spread_join(each, stash(rare, "rare-words"), "word", "inner", row_id="asin")


def verify_claims(metadata: DataFrame, reviews: DataFrame, body: str = "review_text",
                  evidence: int = 5, stop_share: float = 0.2, row_id: str = "review_id",
                  word_pattern: str = r"[^a-z0-9]+") -> DataFrame:
    """Feature claims against reviews of the same product.  Evidence is the
    ``evidence`` reviews whose words in common with the claim weigh most, rare words
    more than frequent ones; words of more than ``stop_share`` of all reviews count for
    nothing, so stop words alone are no evidence.  The reviews' mean rating gives the
    verdict.  A claim without evidence stays, as INSUFFICIENT_DATA."""
    claims = text.claims(F.col("features_text"))
    meta = dedup_metadata(metadata).select("asin", claims.alias("_claims")).where(F.size("_claims") > 0)
    numbered = F.transform("_claims", lambda c, i: F.struct(
        (i + 1).alias("claim_no"), c.alias("claim"),
        F.array_distinct(text.tokens(c, word_pattern)).alias("words")))
    every = stash(meta.select("asin", F.inline(numbered)), "claims")
    words = F.array_distinct(text.tokens(F.col(body), word_pattern))
    told = claim_words(every, reviews, words, stop_share)
    # one row per product with the telling words of its claims: joined, then unpacked
    packed = (told.groupBy("asin", "claim_no").agg(F.collect_list(F.struct("word", "weight")).alias("words"))
              .groupBy("asin").agg(F.collect_list(F.struct("claim_no", "words")).alias("_c")))
    rows = reviews.select("asin", F.col(row_id).alias("_id"), "rating", words.alias("_words"))
    shared = F.aggregate("words", F.lit(0).cast("bigint"), lambda t, x: t + F.when(
        F.array_contains("_words", x["word"]), x["weight"]).otherwise(0))
    scored = (spread_join(rows, stash(packed, "packed-claims"), "asin", "inner", row_id="_id")
              .select("asin", "_id", "rating", "_words", F.inline("_c"))
              .withColumn("_shared", shared).where(F.col("_shared") > 0).drop("_words", "words"))
    best = top_n(scored, ["asin", "claim_no"], [F.col("_shared").desc(), F.col("_id")], evidence)
    found = best.groupBy("asin", "claim_no").agg(
        F.count(F.lit(1)).alias("evidence_count"), mean_of(F.col("rating"), 2).alias("evidence_rating"))
    n = F.coalesce("evidence_count", F.lit(0))
    r = F.col("evidence_rating")
    return every.join(found, ["asin", "claim_no"], "left").select(
        "asin", "claim_no", "claim", n.alias("evidence_count"), "evidence_rating",
        F.when(n == 0, "INSUFFICIENT_DATA").when(r >= 3.5 - TIE, "CONFIRMED").when(r <= 2.5 + TIE, "DISPUTED")
        .otherwise("MIXED").alias("verdict"),
        steady_round(F.when(n == 0, F.lit(0.0)).otherwise(
            F.abs(r - 3) / 2 * n / evidence), 3).alias("confidence"))


def trust_scores(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return verdicts.groupBy("asin").agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(v == "CONFIRMED").alias("confirmed"),
        F.count_if(v == "DISPUTED").alias("disputed"), F.count_if(v == "MIXED").alias("mixed"),
        F.count_if(v == "INSUFFICIENT_DATA").alias("insufficient_data"),
        share_of(v == "CONFIRMED", 2).alias("trust_score"))
