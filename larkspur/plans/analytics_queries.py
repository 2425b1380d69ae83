"""Product, brand, category and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import steady_round
from ..operators import enrich, marts, profiles, skew
from ..session import stash
from ..sources import fixtures as fx
from .registry import define, mean, pct, query, rnd, share, sql

CUTS = (925, 950, 975)
LABELS = ("under 925", "925-950", "950-975", "975+")


def fact_of(spark, d) -> DataFrame:
    """The fact table, written once because each query reads it repeatedly."""
    return stash(fx.reviews(spark, d), "fact")


# --------------------------------------------------------------- profile, D1

define("theme_rows", ["reviews"], f"""SELECT asin, review_theme, count(*) AS review_count,
  {mean('sentiment_score', 3)} AS avg_sentiment, {mean('rating', 2)} AS avg_rating,
  count(*) FILTER (WHERE rating <= 2) AS negative_count FROM reviews GROUP BY asin, review_theme""")


def _lines(columns: list[str], order: str) -> str:
    """SQL for the rows of a group as text: fields by colons, numbers as ten-thousandths."""
    fields = ", ".join(f"CAST({c} AS VARCHAR)" if c in TEXTS else f"CAST(round({c} * 10000) AS BIGINT)" for c in columns)
    return f"string_agg(concat_ws(':', {fields}), ';' ORDER BY {order})"


TEXTS = ("review_theme", "review_month")
THEME_FIELDS = ["review_theme", "review_count", "avg_sentiment", "avg_rating", "negative_count"]
REPORT_THEME_FIELDS = ["review_theme", "review_count", "avg_sentiment", "negative_count"]
DETAIL_FIELDS = {
    "themes": ["review_theme", "review_count", "avg_rating", "avg_sentiment", "negative_rate"],
    "complaints": ["review_theme", "complaint_count", "avg_sentiment", "avg_helpful_votes",
                   "high_quality_complaints", "high_quality_rate"],
    "months": ["review_month", "review_count", "avg_rating", "avg_sentiment", "negative_rate"]}


def as_lines(column: str, fields: list[str]):
    """An array of structs in the text form of ``_lines``."""
    def line(x):
        return F.concat_ws(":", *[x[f].cast("string") if f in TEXTS else F.round(x[f] * 10000).cast("bigint").cast("string")
                                  for f in fields])
    return F.array_join(F.transform(column, line), ";")


@query("d1_product_profile", sql(f"""
SELECT l.asin, l.derived_category, l.review_count, l.derivation_confidence, l.brand, l.product_name,
  p.avg_rating, p.avg_sentiment, p.negative_rate, p.top_theme,
  s.avg_rating AS category_avg_rating, s.avg_sentiment AS category_avg_sentiment,
  s.negative_rate AS category_avg_negative_rate,
  {rnd('p.avg_rating - s.avg_rating', 2)} AS rating_vs_category,
  {rnd('p.avg_sentiment - s.avg_sentiment', 4)} AS sentiment_vs_category,
  t.themes
FROM lookup l LEFT JOIN products p ON l.asin = p.asin LEFT JOIN summary s ON l.derived_category = s.derived_category
LEFT JOIN (SELECT asin, {_lines(THEME_FIELDS, "review_count DESC, review_theme")} AS themes
  FROM theme_rows GROUP BY asin) t ON l.asin = t.asin""", "lookup", "products", "summary", "theme_rows"))
def _(spark, d):
    fact = fact_of(spark, d)
    p = profiles.product_profile(fx.lookup(spark, d, fact), marts.product_summary(fact),
                                 marts.category_summary(fact), fact)
    return p.withColumn("themes", as_lines("themes", THEME_FIELDS))


@query("g9_theme_breakdown", sql("SELECT * FROM theme_rows", "theme_rows"))
def _(spark, d):
    return marts.theme_breakdown(fx.reviews(spark, d))


@query("g8_theme_stats", sql(f"""SELECT asin, review_theme, count(*) AS total_reviews,
  {mean('sentiment_score', 3)} AS avg_sentiment, {mean('rating', 2)} AS avg_rating,
  {share('sentiment_score > 0.2', 3)} AS positive_pct, {share('sentiment_score < -0.2', 3)} AS negative_pct
  FROM reviews GROUP BY asin, review_theme""", "reviews"))
def _(spark, d):
    return marts.theme_stats(fx.reviews(spark, d))


# ---------------------------------------------------------------- search, D2

define("search_base", ["lookup", "products"], """SELECT l.asin, l.product_name, l.brand,
  CAST(l.price AS DOUBLE) AS price, l.derived_category, l.review_count, p.avg_rating, p.avg_sentiment,
  p.negative_rate, p.top_theme, l.features_text AS features
  FROM lookup l LEFT JOIN products p ON l.asin = p.asin""")


@query("d2_search_products", sql("""SELECT * FROM search_base WHERE derived_category = 'PROMO' AND price >= 910
  AND price <= 990 AND contains(lower(features), 'type promo') AND avg_rating >= 2.5 AND review_count >= 5
  ORDER BY avg_rating DESC NULLS LAST, asin LIMIT 10""", "search_base"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.search_products(
        fx.lookup(spark, d, fact), fx.metadata(spark, d), marts.product_summary(fact), fact,
        category="PROMO", min_price=910, max_price=990, features_contain="TYPE promo", min_rating=2.5,
        sort_by="avg_rating")


@query("d2_search_by_theme", sql(f"""SELECT b.*, theme_review_count, theme_avg_sentiment, theme_avg_rating
  FROM search_base b JOIN (SELECT asin, count(*) AS theme_review_count,
    {mean('sentiment_score', 3)} AS theme_avg_sentiment, {mean('rating', 2)} AS theme_avg_rating FROM reviews
    WHERE review_theme = 'comfort' AND sentiment_score > 0 GROUP BY asin HAVING count(*) >= 2) t ON b.asin = t.asin
  WHERE contains(lower(brand), 'brand#1') AND review_count >= 5
  ORDER BY theme_avg_sentiment DESC NULLS LAST, b.asin LIMIT 10""", "search_base", "reviews"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.search_products(
        fx.lookup(spark, d, fact), fx.metadata(spark, d), marts.product_summary(fact), fact,
        brand="brand#1", review_theme="comfort")


@query("k3_sort_by_price", sql("""SELECT * FROM search_base WHERE review_count >= 5
  ORDER BY price ASC NULLS LAST, asin LIMIT 25""", "search_base"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.search_products(fx.lookup(spark, d, fact), fx.metadata(spark, d, duplicates=False),
                                    marts.product_summary(fact), sort_by="price", limit=25)


# ------------------------------------------------------------- compare, D3-D7

def compare_sql(source: str, key: str, metrics: dict[str, bool], having: str) -> str:
    longs = " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {'TRUE' if up else 'FALSE'} AS up FROM {source}"
        for m, up in metrics.items())
    return f"""SELECT {key}, metric, value, best, worst, spread, wins, overall_winner FROM (
 SELECT *, first_value({key}) OVER (ORDER BY wins DESC, {key}) AS overall_winner FROM (
 SELECT *, sum(CASE WHEN b = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS wins FROM (
 SELECT *, max(CASE WHEN b = 1 THEN {key} END) OVER p AS best, max(CASE WHEN w = 1 THEN {key} END) OVER p AS worst,
   {rnd('max(value) OVER p - min(value) OVER p', 4)} AS spread FROM (
 SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN up THEN -value ELSE value END, {key}) AS b,
   row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN up THEN -value ELSE value END DESC, {key} DESC) AS w,
   count(*) OVER (PARTITION BY metric) AS n FROM ({longs}) WHERE value IS NOT NULL)
 WHERE n >= 2 WINDOW p AS (PARTITION BY metric))))"""


define("cmp_products", ["search_base"], "SELECT * FROM search_base WHERE asin IN (3, 8, 21, 34, 55)")


@query("d3_compare_products", sql(compare_sql("cmp_products", "asin", profiles.PRODUCT_METRICS, ""), "cmp_products"))
def _(spark, d):
    fact = fact_of(spark, d)
    price = fx.metadata(spark, d).select("asin", "price")
    stats = marts.product_summary(fact).drop("review_count", "derived_category")
    rows = fx.lookup(spark, d, fact).join(price, "asin", "left").join(stats, "asin", "left")
    return profiles.compare_products(rows, [3, 8, 21, 34, 55])


@query("d3_top_themes", sql("""SELECT asin, review_theme, review_count, theme_rank FROM (SELECT *, row_number() OVER (
  PARTITION BY asin ORDER BY review_count DESC, review_theme) AS theme_rank FROM theme_rows) WHERE theme_rank <= 3""",
                        "theme_rows"))
def _(spark, d):
    return profiles.top_product_themes(fx.reviews(spark, d))


define("brand_rows", ["metadata", "reviews"], """SELECT m.asin, m.title, lower(m.brand) AS brand,
  CAST(m.price AS DOUBLE) AS price, r.n, r.rated, r.stars, r.scored, r.score, r.neg FROM metadata m LEFT JOIN (
  SELECT asin, count(*) AS n, count(rating) AS rated, sum(rating) AS stars, count(sentiment_score) AS scored,
    CAST(sum(sentiment_score) AS DOUBLE) AS score, count(*) FILTER (WHERE rating <= 2) AS neg
  FROM reviews GROUP BY asin) r ON m.asin = r.asin""")
_MEANS = f"""{rnd('sum(stars) / nullif(sum(rated), 0)', 2)} AS avg_rating,
  {rnd('sum(score) / nullif(sum(scored), 0)', 4)} AS avg_sentiment,
  {rnd('sum(neg) / nullif(sum(n), 0)', 4)} AS negative_rate"""
define("brand_overview", ["brand_rows"], f"""SELECT brand, count(*) AS total_products,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total_reviews, {_MEANS},
  {rnd('sum(price * greatest(coalesce(n, 0), 1)) / sum(CASE WHEN price IS NOT NULL THEN greatest(coalesce(n, 0), 1) END)', 2)} AS avg_price,
  {rnd('avg(price)', 2)} AS avg_product_price, min(price) AS min_price, max(price) AS max_price
  FROM brand_rows GROUP BY brand""")


@query("d5_brand_overview", sql("SELECT * FROM brand_overview", "brand_overview"))
def _(spark, d):
    return profiles.brand_overview(fx.metadata(spark, d, duplicates=True), fx.reviews(spark, d))


@query("d5_brand_categories", sql("""SELECT b.brand, l.derived_category, count(*) AS products,
  CAST(coalesce(sum(b.n), 0) AS BIGINT) AS reviews FROM brand_rows b JOIN lookup l ON b.asin = l.asin
  GROUP BY b.brand, l.derived_category""", "brand_rows", "lookup"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.brand_categories(fx.metadata(spark, d), fx.lookup(spark, d, fact), fact)


@query("d5_brand_top_products", sql("""SELECT * FROM (SELECT p.asin, m.title AS title, lower(m.brand) AS brand,
  p.review_count, p.avg_rating, p.avg_sentiment, row_number() OVER (PARTITION BY m.brand
  ORDER BY p.review_count DESC, p.asin) AS product_rank FROM products p JOIN metadata m ON p.asin = m.asin)
  WHERE product_rank <= 5""", "products", "metadata"))
def _(spark, d):
    return profiles.brand_top_products(fx.metadata(spark, d), marts.product_summary(fx.reviews(spark, d)))


@query("d5_brand_complaints", sql(f"""SELECT brand, review_theme, complaints, avg_sentiment, theme_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY complaints DESC, review_theme NULLS LAST) AS theme_rank FROM (
  SELECT lower(m.brand) AS brand, review_theme, count(*) AS complaints, {mean('sentiment_score', 3)} AS avg_sentiment
  FROM reviews r JOIN metadata m ON r.asin = m.asin WHERE rating <= 2 GROUP BY lower(m.brand), review_theme))
  WHERE theme_rank <= 5""", "reviews", "metadata"))
def _(spark, d):
    return profiles.brand_complaints(fx.metadata(spark, d), fx.reviews(spark, d))


define("cmp_brands", ["brand_overview"],
       "SELECT * FROM brand_overview WHERE brand IN ('brand#1', 'brand#2', 'brand#7')")


@query("d6_compare_brands", sql(compare_sql("cmp_brands", "brand", profiles.BRAND_METRICS, ""), "cmp_brands"))
def _(spark, d):
    over = profiles.brand_overview(fx.metadata(spark, d), fx.reviews(spark, d))
    return profiles.compare_brands(stash(over, "brands"), ["Brand#1", " brand#2", "Brand#7"])


@query("d7_compare_categories", sql("""SELECT derived_category, review_count, avg_rating, avg_sentiment, negative_rate,
  avg_helpful_votes FROM summary WHERE derived_category IN ('PROMO', 'SMALL', 'LARGE')""", "summary"))
def _(spark, d):
    return profiles.compare_categories(marts.category_summary(fx.reviews(spark, d)), ["PROMO", "SMALL", "LARGE"])


@query("j13_brand_reviews", sql("""SELECT r.review_id, r.asin, r.rating, m.title, CAST(m.price AS DOUBLE) AS price
  FROM reviews r JOIN metadata m ON r.asin = m.asin WHERE contains(lower(m.brand), 'rand#2')""", "reviews", "metadata"))
def _(spark, d):
    return profiles.brand_reviews(fx.reviews(spark, d), fx.metadata(spark, d), "RAND#2").select(
        "review_id", "asin", "rating", "title", "price")


# ---------------------------------------------------------------- similar, D8

@query("d8_similar_products", sql("""
SELECT source_asin, asin, product_name AS full_title, product_name, brand, price, derived_category, review_count,
  avg_rating, avg_sentiment, related_category, similar_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY source_asin ORDER BY related_category, review_count DESC NULLS LAST, asin) AS similar_rank
 FROM (SELECT e.source_asin, t.asin, t.product_name, t.brand, CAST(t.price AS DOUBLE) AS price, t.derived_category,
    p.review_count, p.avg_rating, p.avg_sentiment,
    source_category IS NULL OR t.derived_category <> source_category AS related_category
  FROM (SELECT DISTINCT m.asin AS source_asin, l.derived_category AS source_category, unnest(m.also_buy) AS asin
        FROM metadata m LEFT JOIN lookup l ON m.asin = l.asin) e
  JOIN lookup t ON e.asin = t.asin LEFT JOIN products p ON t.asin = p.asin)) WHERE similar_rank <= 5""",
                            "metadata", "lookup", "products"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.similar_products(fx.metadata(spark, d), fx.lookup(spark, d, fact),
                                     marts.product_summary(fact))


# ------------------------------------------------------------------ price, D9

define("priced", ["brand_rows", "lookup"], f"""SELECT l.derived_category,
  CASE WHEN b.price < 925 THEN 'under 925' WHEN b.price < 950 THEN '925-950' WHEN b.price < 975 THEN '950-975'
    WHEN b.price >= 975 THEN '975+' END AS price_bracket, count(*) AS product_count,
  CAST(sum(n) AS BIGINT) AS review_count, {_MEANS}, {rnd('min(b.price)', 2)} AS min_price,
  {rnd('max(b.price)', 2)} AS max_price, {rnd('sum(b.price * n) / sum(n)', 2)} AS avg_price
  FROM brand_rows b JOIN lookup l ON b.asin = l.asin WHERE b.price > 0 AND n > 0 GROUP BY 1, 2""")


@query("d9_price_value", sql("""SELECT *, row_number() OVER (PARTITION BY derived_category
  ORDER BY avg_rating DESC NULLS LAST, avg_price) = 1 AS best_value FROM priced""", "priced"))
def _(spark, d):
    fact = fact_of(spark, d)
    return profiles.price_value(fx.metadata(spark, d), fx.lookup(spark, d, fact), fact, CUTS, LABELS)


@query("b18_price_bracket", sql("""SELECT bracket, count(*) AS products FROM (SELECT CASE WHEN price < 925 THEN 'under 925'
  WHEN price < 950 THEN '925-950' WHEN price < 975 THEN '950-975' WHEN price >= 975 THEN '975+' END AS bracket
  FROM metadata_dup) GROUP BY bracket""", "metadata_dup"))
def _(spark, d):
    m = fx.metadata(spark, d, duplicates=True)
    return m.groupBy(rules.price_bracket(F.col("price"), CUTS, LABELS).alias("bracket")).agg(
        F.count(F.lit(1)).alias("products"))


# --------------------------------------------------------------- reports, D10+

_SIGNAL = """CASE WHEN {r} < 3.5 OR {n} > 0.30 THEN 'RED' WHEN {r} < 4.0 OR {n} > 0.15 THEN 'YELLOW' ELSE 'GREEN' END"""
define("overall", ["summary"], f"""SELECT {rnd('avg(avg_rating)', 2)} AS overall_rating,
  {rnd('avg(avg_sentiment)', 4)} AS overall_sentiment, {rnd('avg(negative_rate)', 4)} AS overall_negative_rate FROM summary""")
define("recent6", ["trends"], """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY derived_category
  ORDER BY review_month DESC) AS recency FROM trends) WHERE recency <= 6""")


def _detail(months: str) -> str:
    f = DETAIL_FIELDS
    return f"""SELECT s.*, t.themes, c.complaints, m.months FROM summary s
  LEFT JOIN (SELECT derived_category, {_lines(f["themes"], "review_count DESC, review_theme")} AS themes
    FROM themes GROUP BY 1) t USING (derived_category)
  LEFT JOIN (SELECT derived_category, {_lines(f["complaints"], "complaint_count DESC, review_theme")} AS complaints
    FROM complaints GROUP BY 1) c USING (derived_category)
  LEFT JOIN (SELECT derived_category, {_lines(f["months"], "review_month")} AS months
    FROM {months} GROUP BY 1) m USING (derived_category)"""


define("detail_all", ["summary", "themes", "complaints", "trends"], _detail("trends"))
define("detail_recent", ["summary", "themes", "complaints", "recent6"], _detail("recent6"))


def _shrink(df: DataFrame) -> DataFrame:
    return df.withColumns({c: as_lines(c, fields) for c, fields in DETAIL_FIELDS.items()})


@query("d10_category_report", sql(f"""SELECT d.*, o.*, {_SIGNAL.format(r='avg_rating', n='negative_rate')} AS signal,
  (SELECT arg_min(review_theme, (-complaint_count, review_theme)) FROM complaints c
   WHERE c.derived_category = d.derived_category) AS top_complaint,
  {rnd('avg_rating - overall_rating', 2)} AS rating_vs_overall FROM detail_recent d, overall o""", "detail_recent", "overall", "complaints"))
def _(spark, d):
    fact = fact_of(spark, d)
    s = stash(marts.category_summary(fact), "summary")
    return _shrink(profiles.category_report(s, marts.theme_category(fact), marts.complaint_analysis(fact),
                                            marts.monthly_trends(fact)))


@query("d12_category_detail", sql("SELECT * FROM detail_all", "detail_all"))
def _(spark, d):
    fact = fact_of(spark, d)
    return _shrink(profiles.category_detail(marts.category_summary(fact), marts.theme_category(fact),
                                            marts.complaint_analysis(fact), marts.monthly_trends(fact)))


@query("d11_product_report", sql(f"""SELECT p.*, 
  CASE WHEN l.brand IS NOT NULL AND l.brand <> 'Unknown' THEN l.brand || ' - ' || l.product_name ELSE l.product_name END AS display_name,
  {_SIGNAL.format(r='p.avg_rating', n='p.negative_rate')} AS signal, s.avg_rating AS category_avg_rating,
  s.avg_sentiment AS category_avg_sentiment, s.negative_rate AS category_negative_rate, t.themes
  FROM products p LEFT JOIN lookup l ON p.asin = l.asin LEFT JOIN summary s ON p.derived_category = s.derived_category
  LEFT JOIN (SELECT asin, {_lines(REPORT_THEME_FIELDS, "review_count DESC, review_theme")} AS themes
    FROM theme_rows GROUP BY asin) t ON p.asin = t.asin""",
                           "products", "lookup", "summary", "theme_rows"))
def _(spark, d):
    fact = fact_of(spark, d)
    r = profiles.product_report(marts.product_summary(fact), fx.lookup(spark, d, fact),
                                marts.category_summary(fact), fact)
    return r.withColumn("themes", as_lines("themes", REPORT_THEME_FIELDS))


@query("d13_category_list", sql("""SELECT derived_category, review_count, avg_rating, avg_sentiment, negative_rate
  FROM summary""", "summary"))
def _(spark, d):
    return marts.category_summary(fx.reviews(spark, d)).orderBy(F.col("review_count").desc()).select(
        "derived_category", "review_count", "avg_rating", "avg_sentiment", "negative_rate")


@query("d14_product_label_stats", sql(f"""SELECT asin, count(*) AS total_reviews, {mean('rating', 2)} AS avg_rating,
  count(*) FILTER (WHERE rating >= 4) AS positive_reviews, {pct('rating >= 4', 1)} AS positive_pct,
  count(*) FILTER (WHERE rating = 3) AS neutral_reviews, {pct('rating = 3', 1)} AS neutral_pct,
  count(*) FILTER (WHERE rating < 3) AS negative_reviews, {pct('rating < 3', 1)} AS negative_pct
  FROM reviews GROUP BY asin""", "reviews"))
def _(spark, d):
    return marts.label_summary(fx.reviews(spark, d), ["asin"], digits=1)


@query("d15_worst_products", sql(f"""SELECT supplier AS asin, count(*) AS total_reviews, {mean('rating', 2)} AS avg_rating,
  {pct('rating <= 2', 1)} AS negative_pct FROM reviews GROUP BY supplier HAVING count(*) >= 100
  ORDER BY negative_pct DESC, asin LIMIT 10""", "reviews"))
def _(spark, d):
    return marts.worst_products(fx.reviews(spark, d).withColumn("asin", F.col("supplier")))


@query("b19_business_signal", sql(f"""SELECT asin, {_SIGNAL.format(r='avg_rating', n='negative_rate')} AS signal
  FROM products""", "products"))
def _(spark, d):
    return marts.product_summary(fx.reviews(spark, d)).select(
        "asin", rules.business_signal(F.col("avg_rating"), F.col("negative_rate")).alias("signal"))


@query("b20_extended_signal", sql(f"""SELECT *, CASE WHEN avg_rating < 3.5 OR negative_pct > 30 THEN 'RED'
  WHEN avg_rating BETWEEN 3.5 AND 4.0 OR negative_pct BETWEEN 15 AND 30 OR recent_negative > total_negative * 0.4
  THEN 'YELLOW' ELSE 'GREEN' END AS signal FROM (SELECT asin, {mean('rating', 2)} AS avg_rating,
  {pct('rating <= 2', 1)} AS negative_pct,
  count(*) FILTER (WHERE rating <= 2 AND review_ts >= DATE '2001-11-05' - INTERVAL 6 MONTH) AS recent_negative,
  count(*) FILTER (WHERE rating <= 2) AS total_negative FROM reviews GROUP BY asin)""", "reviews"))
def _(spark, d):
    return profiles.product_signals(fx.reviews(spark, d), "2001-11-05")


@query("g14_overall_means", sql("""SELECT overall_rating AS avg_rating, overall_sentiment AS avg_sentiment,
  overall_negative_rate AS negative_rate FROM overall""", "overall"))
def _(spark, d):
    return marts.overall_means(marts.category_summary(fx.reviews(spark, d)))


@query("g20_executive_overview", sql(f"""SELECT count(*) AS total_categories, CAST(sum(review_count) AS BIGINT) AS total_reviews,
  {rnd('avg(avg_rating)', 2)} AS avg_rating, {rnd('avg(negative_rate) * 100', 1)} AS avg_negative_pct FROM summary""", "summary"))
def _(spark, d):
    return marts.executive_overview(marts.category_summary(fx.reviews(spark, d)))


# -------------------------------------------------------------- row-level joins

@query("j1_fact_join", sql("""SELECT r.review_id, r.asin, r.rating, l.derived_category, l.derivation_confidence, l.brand, l.product_name
  FROM reviews r LEFT JOIN lookup l ON r.asin = l.asin""", "reviews", "lookup"))
def _(spark, d):
    fact = fact_of(spark, d)
    enriched = fact.select("review_id", "asin", "rating")
    return marts.fact_reviews(enriched, fx.lookup(spark, d, fact))


@query("j2_product_lookup", sql("""
SELECT c.asin, CASE WHEN contains(lower(m0.category_path), 'small') THEN 'wearables'
    WHEN contains(lower(m0.category_path), 'large') THEN 'computer_peripherals' ELSE 'other_electronics' END AS derived_category,
  c.review_count, c.derivation_confidence,
  coalesce(m.brand, CASE WHEN contains(c.nm, '-') THEN trim(split_part(c.nm, '-', 1)) ELSE 'Unknown' END) AS brand,
  coalesce(m.title, CASE WHEN contains(c.nm, '-') THEN trim(substr(c.nm, instr(c.nm, '-') + 1)) ELSE trim(c.nm) END) AS product_name,
  m.title AS metadata_title, m.brand AS metadata_brand, CAST(m.price AS DOUBLE) AS metadata_price,
  m.features_text AS metadata_features, m.category_path AS metadata_category_path, m.asin IS NOT NULL AS has_metadata
FROM (SELECT l.*, regexp_replace(regexp_replace(product_name, '^Brand\\s*-\\s*', ''), 'Product Name:\\s*', '') AS nm
      FROM (SELECT asin, review_count, derivation_confidence,
        CASE WHEN asin % 3 = 0 THEN 'Brand - Acme - ' || product_name ELSE 'Product Name: ' || product_name END AS product_name
        FROM lookup) l) c
JOIN metadata m0 ON c.asin = m0.asin
LEFT JOIN (SELECT * FROM metadata_dup WHERE NOT ends_with(title, '(old)')) m ON c.asin = m.asin""",
                        "lookup", "metadata", "metadata_dup"))
def _(spark, d):
    fact = fact_of(spark, d)
    look = fx.lookup(spark, d, fact)
    raw = F.lower("derived_category")
    label = (F.when(raw.contains("small"), '"Wearables"\n').when(raw.contains("large"), F.lit("a tablet stand"))
             .otherwise(raw))
    cats = look.select("asin", label.alias("derived_category"), "review_count", "derivation_confidence")
    names = look.select("asin", F.concat(
        F.when(F.col("asin") % 3 == 0, F.lit("Brand - Acme - ")).otherwise(F.lit("Product Name: ")),
        "product_name").alias("raw_product_name"))
    meta = fx.metadata(spark, d, duplicates=True).where("title NOT LIKE '%(old)'")
    return marts.product_lookup(cats, names, meta)


@query("j5_theme_baseline_join", sql(f"""SELECT t.derived_category, t.review_theme, t.review_count, c.complaint_count,
  s.review_count AS category_reviews, {rnd('t.review_count * 100.0::DOUBLE / s.review_count', 2)} AS theme_share
  FROM themes t LEFT JOIN complaints c ON t.derived_category = c.derived_category AND t.review_theme = c.review_theme
  LEFT JOIN summary s ON t.derived_category = s.derived_category""", "themes", "complaints", "summary"))
def _(spark, d):
    fact = fact_of(spark, d)
    c = marts.complaint_analysis(fact).select("derived_category", "review_theme", "complaint_count")
    s = marts.category_summary(fact).select("derived_category", F.col("review_count").alias("category_reviews"))
    return (marts.theme_category(fact).select("derived_category", "review_theme", "review_count")
            .join(c, ["derived_category", "review_theme"], "left").join(s, "derived_category", "left")
            .withColumn("theme_share", steady_round(F.col("review_count") * 100.0 / F.col("category_reviews"), 2)))


@query("j3_heavy_hitter_semi_join", sql("""SELECT review_id, asin, rating FROM reviews
  WHERE asin IN (SELECT asin FROM reviews GROUP BY asin HAVING count(*) >= 25)""", "reviews"))
def _(spark, d):
    fact = fact_of(spark, d)
    heavy = fact.groupBy("asin").agg(F.count(F.lit(1)).alias("n")).where("n >= 25").select("asin")
    return skew.spread_join(fact.select("review_id", "asin", "rating"), heavy, "asin", "left_semi")


# ------------------------------------------------------------ text by product

@query("w3_longest_reviews", sql("SELECT asin, review_id, text_len, rn FROM longest WHERE rn <= 3", "longest"))
def _(spark, d):
    from ..operators.dedup import top_n
    docs = fx.documents(spark, d).select("asin", "review_id", "text_len")
    return top_n(docs, ["asin"], [F.col("text_len").desc(), F.col("review_id")], 3, "rn")


@query("g11_longest_text_list", sql("""SELECT asin, n AS review_count, string_agg(review_text, ' | ' ORDER BY rn) AS sample_text
  FROM longest WHERE rn <= 3 AND n >= 3 GROUP BY asin, n""", "longest"))
def _(spark, d):
    return enrich.longest_texts(fx.documents(spark, d), F.col("review_text"), 3, 3)
