"""Monitoring, data quality and alert queries.

Marts that several detectors read are written once to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import steady_round
from ..operators import alerts, marts, monitor, quality
from ..session import stash
from ..sources import fixtures as fx
from .registry import define, query, rnd, sql

AS_OF = "2001-12-20"


def trends(spark, d) -> DataFrame:
    return stash(marts.monthly_trends(fx.reviews(spark, d)), "trends")


def complaints(spark, d) -> DataFrame:
    return stash(marts.complaint_analysis(fx.reviews(spark, d)), "complaints")


def full_fact(spark, d) -> DataFrame:
    return stash(fx.reviews(spark, d, customers=True), "fact")


def round6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: steady_round(F.col(c), 6) for c in cols})


def anomalies_of(spark, d, fact: DataFrame | None = None) -> DataFrame:
    fact = full_fact(spark, d) if fact is None else fact
    return monitor.review_anomalies(stash(marts.monthly_trends(fact), "trends"),
                                    stash(marts.complaint_analysis(fact), "complaints"))


# ---------------------------------------------------------------- detectors

define("latest", ["trends"], "SELECT max(review_month) AS lm FROM trends")
define("base", ["trends", "latest"], """SELECT derived_category,
  avg(avg_rating) AS b_rating, stddev_samp(avg_rating) AS sd_rating,
  avg(avg_sentiment) AS b_sentiment, stddev_samp(avg_sentiment) AS sd_sentiment,
  avg(negative_rate) AS b_neg FROM trends, latest
  WHERE review_month >= lm - INTERVAL 4 MONTH AND review_month < lm GROUP BY derived_category""")


def drop_sql(kind: str, metric: str, floor: float) -> str:
    return f"""SELECT '{kind}' AS anomaly_type, derived_category, CAST(NULL AS VARCHAR) AS review_theme,
  CAST(review_month AS VARCHAR) AS detection_period, x AS current_value,
  {rnd('b', 6)} AS baseline_value, {rnd('(b - x) / g', 2)} AS deviation_score,
  review_count AS affected_reviews, negative_rate AS current_negative_rate,
  {rnd('b_neg', 6)} AS baseline_negative_rate,
  CASE WHEN x < b - 2 * g - 1e-9 THEN 'HIGH' WHEN x < b - g - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT t.*, t.avg_{metric} AS x, b_{metric} AS b, greatest(sd_{metric}, {floor}::DOUBLE) AS g, b_neg
        FROM trends t JOIN base USING (derived_category), latest
        WHERE review_month = lm AND review_count >= 10 AND sd_{metric} IS NOT NULL)
  WHERE x < b - 0.5 * g - 1e-9"""


define("d1", ["base"], drop_sql("RATING_DROP", "rating", 0.1))
define("d2", ["base"], drop_sql("SENTIMENT_SHIFT", "sentiment", 0.05))
define("d3", ["complaints"], f"""SELECT 'COMPLAINT_SPIKE' AS anomaly_type, derived_category, review_theme,
  CAST(NULL AS VARCHAR) AS detection_period, CAST(n AS DOUBLE) AS current_value,
  {rnd('b', 6)} AS baseline_value, {rnd('(n - b) / g', 2)} AS deviation_score, n AS affected_reviews,
  CAST(NULL AS DOUBLE) AS current_negative_rate, CAST(NULL AS DOUBLE) AS baseline_negative_rate,
  CASE WHEN b + 2 * g < n - 1e-9 THEN 'HIGH' WHEN b + g < n - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT c.derived_category, review_theme, complaint_count AS n, b, greatest(sd, 3::DOUBLE) AS g
        FROM complaints c JOIN (SELECT review_theme, avg(complaint_count) AS b,
          stddev_samp(complaint_count) AS sd FROM complaints GROUP BY review_theme) USING (review_theme)
        WHERE sd IS NOT NULL)
  WHERE b + 0.5 * g < n - 1e-9""")
define("changes", ["trends"], """SELECT *, lag(avg_rating) OVER w AS prev_rating,
  lag(avg_sentiment) OVER w AS prev_sentiment FROM trends WHERE review_count >= 10
  WINDOW w AS (PARTITION BY derived_category ORDER BY review_month)""")
define("streaks", ["changes"], """SELECT derived_category, max(review_month) AS last_month,
  min(avg_rating) AS lowest_rating, count(*) AS consecutive_months FROM (
    SELECT *, avg_rating < prev_rating AS fell, sum(CASE WHEN avg_rating < prev_rating THEN 0 ELSE 1 END)
      OVER (PARTITION BY derived_category ORDER BY review_month) AS streak
    FROM changes WHERE prev_rating IS NOT NULL)
  WHERE fell GROUP BY derived_category, streak HAVING count(*) >= 3""")
define("d4", ["streaks", "base"], f"""SELECT 'DECLINING_TREND' AS anomaly_type, derived_category,
  CAST(NULL AS VARCHAR) AS review_theme, CAST(last_month AS VARCHAR) AS detection_period,
  lowest_rating AS current_value, {rnd('b_rating', 6)} AS baseline_value,
  CAST(consecutive_months AS DOUBLE) AS deviation_score, CAST(NULL AS BIGINT) AS affected_reviews,
  CAST(NULL AS DOUBLE) AS current_negative_rate, CAST(NULL AS DOUBLE) AS baseline_negative_rate,
  CASE WHEN consecutive_months >= 5 THEN 'HIGH' WHEN consecutive_months >= 4 THEN 'MEDIUM'
    ELSE 'LOW' END AS severity
  FROM streaks JOIN base USING (derived_category)""")
define("ranks", ["trends", "latest"], f"""SELECT c.derived_category, lm, current_rank, baseline_rank FROM
  (SELECT derived_category, lm, rank() OVER (ORDER BY avg_rating DESC) AS current_rank
   FROM trends, latest WHERE review_month = lm AND review_count >= 10) c
  JOIN (SELECT derived_category, rank() OVER (ORDER BY {rnd('avg(avg_rating)', 8)} DESC) AS baseline_rank
   FROM trends, latest WHERE review_month >= lm - INTERVAL 4 MONTH AND review_month < lm
     AND review_count >= 10 GROUP BY derived_category) b USING (derived_category)""")
define("d5", ["ranks"], """SELECT 'RANK_DROP' AS anomaly_type, derived_category,
  CAST(NULL AS VARCHAR) AS review_theme, CAST(lm AS VARCHAR) AS detection_period,
  CAST(current_rank AS DOUBLE) AS current_value, CAST(baseline_rank AS DOUBLE) AS baseline_value,
  CAST(current_rank - baseline_rank AS DOUBLE) AS deviation_score, CAST(NULL AS BIGINT) AS affected_reviews,
  CAST(NULL AS DOUBLE) AS current_negative_rate, CAST(NULL AS DOUBLE) AS baseline_negative_rate,
  CASE WHEN current_rank - baseline_rank >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM ranks WHERE current_rank - baseline_rank >= 3""")
define("anomalies", ["d1", "d2", "d3", "d4", "d5"],
       " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(1, 6)))

BASES = ("baseline_value", "baseline_negative_rate")


@query("m1_rating_drop", sql("SELECT * FROM d1", "d1"))
def _(spark, d):
    return round6(monitor.rating_drops(trends(spark, d)), *BASES)


@query("m2_sentiment_shift", sql("SELECT * FROM d2", "d2"))
def _(spark, d):
    return round6(monitor.sentiment_shifts(trends(spark, d)), *BASES)


@query("m3_complaint_spike", sql("SELECT * FROM d3", "d3"))
def _(spark, d):
    return round6(monitor.complaint_spikes(complaints(spark, d)), "baseline_value")


@query("m4_declining_trend", sql("SELECT * FROM d4", "d4"))
def _(spark, d):
    return round6(monitor.declining_trends(trends(spark, d)), "baseline_value")


@query("m5_rank_drop", sql("SELECT * FROM d5", "d5"))
def _(spark, d):
    return round6(monitor.rank_drops(trends(spark, d)), "baseline_value")


@query("u1_review_anomalies", sql("SELECT * FROM anomalies", "anomalies"))
def _(spark, d):
    return round6(anomalies_of(spark, d), *BASES)


@query("w4_monthly_changes", sql(
    "SELECT * REPLACE (CAST(review_month AS VARCHAR) AS review_month) FROM changes", "changes"))
def _(spark, d):
    return monitor.monthly_changes(marts.monthly_trends(fx.reviews(spark, d)))


@query("w6_declining_streaks", sql(
    "SELECT * REPLACE (CAST(last_month AS VARCHAR) AS last_month) FROM streaks", "streaks"))
def _(spark, d):
    return monitor.declining_streaks(marts.monthly_trends(fx.reviews(spark, d)))


@query("g13_trend_baseline", sql(f"""SELECT derived_category, {rnd('b_rating', 6)} AS base_avg_rating,
  {rnd('sd_rating', 6)} AS sd_avg_rating, {rnd('b_sentiment', 6)} AS base_avg_sentiment,
  {rnd('sd_sentiment', 6)} AS sd_avg_sentiment FROM base""", "base"))
def _(spark, d):
    b = monitor.trend_baseline(trends(spark, d)).drop("base_negative_rate", "sd_negative_rate")
    return round6(b, "base_avg_rating", "sd_avg_rating", "base_avg_sentiment", "sd_avg_sentiment")


# ----------------------------------------------------- product level, M6-M7

def supplier_reviews(spark, d, fact: DataFrame | None = None) -> DataFrame:
    """Suppliers stand in for products: they pass the 100-review gate."""
    fact = fx.reviews(spark, d) if fact is None else fact
    return fact.withColumn("asin", F.col("supplier"))


def supplier_lookup(spark, d) -> DataFrame:
    return fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("asin"), F.col("s_name").alias("product_name"),
        F.lit("supplier").alias("brand"), F.lit(None).cast("string").alias("derived_category"))


def product_alerts(spark, d, fact: DataFrame | None = None) -> DataFrame:
    months = stash(monitor.product_months(supplier_reviews(spark, d, fact), min_month=1), "product-months")
    return monitor.product_anomalies(months, supplier_lookup(spark, d))


define("pm_all", ["reviews"], f"""SELECT supplier AS asin, review_month, count(*) AS review_count,
  {rnd('CAST(sum(rating) AS DOUBLE) / count(rating)', 2)} AS avg_rating FROM reviews
  GROUP BY supplier, review_month""")
define("pm", ["pm_all"], """SELECT * FROM (SELECT *, sum(review_count) OVER (PARTITION BY asin) AS total,
  max(review_month) OVER () AS lm FROM pm_all) WHERE total >= 100 AND review_count >= 1""")
define("pbase", ["pm"], """SELECT asin, avg(avg_rating) AS b, stddev_samp(avg_rating) AS sd FROM pm
  WHERE review_month >= lm - INTERVAL 4 MONTH AND review_month < lm GROUP BY asin""")
_P = f"""asin, s_name AS product_name, 'supplier' AS brand, CAST(NULL AS VARCHAR) AS derived_category,
  CAST(review_month AS VARCHAR) AS detection_period, avg_rating AS current_value, {rnd('b', 6)} AS baseline_value"""
define("p6", ["pbase"], f"""SELECT 'PRODUCT_RATING_DROP' AS anomaly_type, {_P},
  {rnd('(b - avg_rating) / CASE WHEN sd IS NOT NULL THEN greatest(sd, 0.1::DOUBLE) END', 2)} AS deviation_score,
  review_count AS affected_reviews,
  CASE WHEN sd IS NOT NULL AND avg_rating < b - 2 * greatest(sd, 0.2::DOUBLE) - 1e-9 THEN 'HIGH'
       WHEN sd IS NOT NULL AND avg_rating < b - greatest(sd, 0.2::DOUBLE) - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM pm JOIN pbase USING (asin) LEFT JOIN supplier ON s_suppkey = asin
  WHERE review_month = lm AND avg_rating < b - 0.3 - 1e-9""")
define("p7", ["pbase"], f"""SELECT 'PRODUCT_WORST_MONTH' AS anomaly_type, {_P},
  {rnd('b - avg_rating', 2)} AS deviation_score, review_count AS affected_reviews, 'HIGH' AS severity
  FROM pm JOIN pbase USING (asin) JOIN (SELECT asin, min(avg_rating) AS low FROM pm GROUP BY asin) USING (asin)
  LEFT JOIN supplier ON s_suppkey = asin
  WHERE review_month = lm AND avg_rating <= low AND avg_rating < b - 0.1 - 1e-9""")
define("palerts", ["p6", "p7"], "SELECT * FROM p6 UNION ALL SELECT * FROM p7")


@query("m6_product_rating_drop", sql("SELECT * FROM p6", "p6"))
def _(spark, d):
    months = stash(monitor.product_months(supplier_reviews(spark, d), min_month=1), "product-months")
    return round6(monitor.product_rating_drops(months, supplier_lookup(spark, d)), "baseline_value")


@query("m7_product_worst_month", sql("SELECT * FROM p7", "p7"))
def _(spark, d):
    months = stash(monitor.product_months(supplier_reviews(spark, d), min_month=1), "product-months")
    return round6(monitor.product_worst_months(months, supplier_lookup(spark, d)), "baseline_value")


@query("u2_product_anomalies", sql("SELECT * FROM palerts", "palerts"))
def _(spark, d):
    return round6(product_alerts(spark, d), "baseline_value")


# ------------------------------------------------------------ emerging, M8-9

define("shares", ["reviews", "latest"], """SELECT derived_category, review_theme, r, h,
  sum(r) OVER (PARTITION BY derived_category) AS tr, sum(h) OVER (PARTITION BY derived_category) AS th
  FROM (SELECT derived_category, review_theme,
    count(*) FILTER (WHERE review_month >= lm - INTERVAL 3 MONTH) AS r,
    count(*) FILTER (WHERE review_month >= lm - INTERVAL 15 MONTH AND review_month < lm - INTERVAL 3 MONTH) AS h
    FROM reviews, latest WHERE derived_category IS NOT NULL AND review_theme IS NOT NULL
    GROUP BY derived_category, review_theme)""")
define("growth", ["shares"], f"""SELECT derived_category, review_theme, r AS recent_review_count,
  h AS historical_review_count, {rnd('r * 100.0::DOUBLE / nullif(tr, 0)', 2)} AS recent_share,
  {rnd('h * 100.0::DOUBLE / nullif(th, 0)', 2)} AS historical_share,
  {rnd('(r * 100.0::DOUBLE / nullif(tr, 0)) / nullif(h * 100.0::DOUBLE / nullif(th, 0), 0)', 2)} AS growth_factor
  FROM shares WHERE r >= 5""")
_SEV = "CASE WHEN growth_factor >= 3 THEN 'HIGH' WHEN growth_factor >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity"
define("emerging", ["growth"], f"SELECT *, {_SEV} FROM growth WHERE growth_factor >= 1.5 AND recent_share >= 5")
define("cross_cat", ["d3"], f"""SELECT review_theme, count(DISTINCT derived_category) AS affected_categories,
  string_agg(derived_category, ',' ORDER BY derived_category) AS category_list,
  {rnd('avg(deviation_score)', 2)} AS avg_deviation,
  CASE min(CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)
    WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_severity,
  CAST(sum(affected_reviews) AS BIGINT) AS total_affected_reviews
  FROM d3 WHERE review_theme IS NOT NULL GROUP BY review_theme HAVING count(DISTINCT derived_category) >= 3""")


@query("m8_emerging_themes", sql("SELECT * FROM emerging", "emerging"))
def _(spark, d):
    return monitor.emerging_themes(fx.reviews(spark, d))


@query("m8_emerging_with_new", sql(f"""SELECT *, {_SEV} FROM growth
  WHERE (growth_factor >= 1.5 OR growth_factor IS NULL) AND recent_share >= 5""", "growth"))
def _(spark, d):
    return monitor.emerging_themes(fx.reviews(spark, d), include_new=True)


@query("m9_cross_category", sql("SELECT * FROM cross_cat", "cross_cat"))
def _(spark, d):
    return monitor.cross_category_alerts(monitor.complaint_spikes(complaints(spark, d)))


# ------------------------------------------------------------- quality, Q1-8

def checks_of(spark, d, fact: DataFrame | None = None) -> DataFrame:
    landing = fx.reviews_with_duplicates(spark, d)
    fact = full_fact(spark, d) if fact is None else fact
    staged = landing.select("review_id").distinct()
    return quality.quality_checks(landing, staged, fx.reviews(spark, d), fact, marts.category_summary(fact), AS_OF)


define("qsrc", ["raw_reviews"], """SELECT max(review_ts) FILTER (WHERE year(review_ts) <= 2026) AS newest,
  count(*) AS landed FROM raw_reviews""")
define("qfact", ["reviews_c", "reviews", "raw_reviews", "summary"], """SELECT count(*) AS facts,
  count(*) FILTER (WHERE sentiment_score IS NULL) AS no_score,
  count(*) FILTER (WHERE review_theme IS NULL) AS no_theme, count(derived_category) AS covered,
  count(DISTINCT derived_category) AS cats, (SELECT count(DISTINCT review_id) FROM raw_reviews) AS staged,
  (SELECT count(*) FROM reviews) AS enriched, (SELECT count(*) FROM summary) AS summarised FROM reviews_c""")


def _q(name, table, value, expected, status, text):
    return (f"SELECT '{name}' AS check_name, '{table}' AS table_name, CAST({value} AS DOUBLE) AS current_value, "
            f"CAST({expected} AS DOUBLE) AS expected_value, {status} AS status, '{text}' AS description "
            "FROM qsrc, qfact")


_AGE = f"date_diff('day', CAST(newest AS DATE), DATE '{AS_OF}')"
_COV = "(covered * 100.0::DOUBLE / nullif(facts, 0))"


def _near(a, b):
    return (f"CASE WHEN {b} = 0 THEN 'FAIL' WHEN abs({a} - {b}) * 100.0::DOUBLE / nullif({b}, 0) > 1 "
            "THEN 'FAIL' ELSE 'PASS' END")


define("dq", ["qsrc", "qfact"], " UNION ALL ".join([
    _q("SOURCE_FRESHNESS", "landing", _AGE, 30, f"CASE WHEN newest > TIMESTAMP '{AS_OF}' THEN 'WARN' "
       f"WHEN {_AGE} > 90 THEN 'FAIL' WHEN {_AGE} > 30 THEN 'WARN' ELSE 'PASS' END", "Days since latest review"),
    _q("SOURCE_ROW_COUNT", "landing", "landed", 0, "CASE WHEN landed = 0 THEN 'FAIL' ELSE 'PASS' END",
       "Total reviews in source (should be > 0)"),
    _q("ENRICHMENT_ROW_COUNT", "enriched_reviews", "enriched", "staged", _near("enriched", "staged"),
       "Enriched vs staging row count (should match within 1%)"),
    _q("GOLD_ROW_COUNT", "fact_reviews", "facts", "enriched", _near("facts", "enriched"),
       "Gold vs enriched row count (should match within 1%)"),
    _q("SENTIMENT_NULL_RATE", "fact_reviews", "no_score", 0,
       "CASE WHEN no_score > 0 THEN 'FAIL' ELSE 'PASS' END", "NULL sentiment scores (should be 0)"),
    _q("THEME_NULL_RATE", "fact_reviews", "no_theme", 0,
       "CASE WHEN no_theme > 0 THEN 'FAIL' ELSE 'PASS' END", "NULL review themes (should be 0)"),
    _q("CATEGORY_COVERAGE", "fact_reviews", rnd(_COV, 1), 60,
       f"CASE WHEN {_COV} < 60 THEN 'WARN' ELSE 'PASS' END", "Pct reviews with derived category (>60%)"),
    _q("CATEGORY_CONSISTENCY", "category_summary", "summarised", "cats", "CASE WHEN summarised <> cats THEN 'WARN' ELSE 'PASS' END",
       "Category count in summary vs fact should match"),
    """SELECT 'PER_CATEGORY_HEALTH', source_category, CAST(count(*) AS DOUBLE), 0.0::DOUBLE, 'PASS',
       'Reviews per source category (should be > 0)' FROM reviews_c GROUP BY source_category"""]))


@query("u3_data_quality_checks", sql("SELECT * FROM dq", "dq"))
def _(spark, d):
    return checks_of(spark, d)


@query("q7_category_health", sql("SELECT * FROM dq WHERE check_name = 'PER_CATEGORY_HEALTH'", "dq"))
def _(spark, d):
    return quality.category_health(fx.reviews(spark, d, customers=True))


def _one(name: str) -> None:
    @query(name.split(":")[0], sql(f"SELECT * FROM dq WHERE check_name IN ({name.split(':')[1]})", "dq"))
    def _(spark, d, _names=name.split(":")[1]):
        return checks_of(spark, d).where(f"check_name IN ({_names})")


for _spec in ("q1_freshness:'SOURCE_FRESHNESS'", "q2_row_count:'SOURCE_ROW_COUNT'",
              "q3_reconciliation:'ENRICHMENT_ROW_COUNT','GOLD_ROW_COUNT'",
              "q4_null_counts:'SENTIMENT_NULL_RATE','THEME_NULL_RATE'",
              "q5_category_coverage:'CATEGORY_COVERAGE'", "q6_category_consistency:'CATEGORY_CONSISTENCY'"):
    _one(_spec)


@query("q8_expectations", sql("""
SELECT 'raw_reviews' AS table_name, 'review_id' AS column_name, 'not_null' AS test,
  count(*) FILTER (WHERE review_id IS NULL) AS failures FROM raw_reviews
UNION ALL SELECT 'raw_reviews', 'rating', 'accepted_values', count(*) FILTER (WHERE rating NOT IN (1,2,3,4,5)) FROM raw_reviews
UNION ALL SELECT 'raw_reviews', 'review_quality', 'accepted_values', count(*) FILTER (WHERE review_quality NOT IN ('high','medium')) FROM raw_reviews
UNION ALL SELECT 'raw_reviews', 'review_id', 'unique', (SELECT count(*) FROM (SELECT review_id FROM raw_reviews GROUP BY review_id HAVING count(*) > 1))
UNION ALL SELECT 'raw_reviews', 'derived_category', 'relationships', (SELECT count(*) FROM raw_reviews WHERE derived_category NOT IN (SELECT p_type FROM part WHERE p_size > 45 OR p_type <> 'SMALL'))
UNION ALL SELECT 'raw_reviews', 'asin', 'relationships', (SELECT count(*) FROM raw_reviews WHERE asin NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45))
""", "raw_reviews"))
def _(spark, d):
    r = fx.reviews_with_duplicates(spark, d)
    part = fx.table(spark, d, "part")
    return quality.expectations(
        r, "raw_reviews", not_null=["review_id"],
        accepted={"rating": [1, 2, 3, 4, 5], "review_quality": ["high", "medium"]}, unique=["review_id"],
        relationships={"derived_category": (part.where("p_size > 45 OR p_type <> 'SMALL'"), "p_type"),
                       "asin": (part.where("p_size <= 45"), "p_partkey")})


# ------------------------------------------------------------- alerts, M10-13

def alert_log(spark, d) -> DataFrame:
    fact = full_fact(spark, d)
    a = stash(anomalies_of(spark, d, fact), "anomalies")
    return alerts.build_alerts(a, monitor.cross_category_alerts(a), monitor.emerging_themes(fact),
                               product_alerts(spark, d, fact), checks_of(spark, d, fact))


_COLS = ["alert_source", "anomaly_type", "derived_category", "review_theme", "asin", "product_name",
         "detection_period", "current_value", "baseline_value", "deviation_score", "affected_reviews", "severity"]


def _alert(source: str, frm: str, where: str = "", **values: str) -> str:
    cols = {"alert_source": f"'{source}'"} | values
    kinds = {"current_value": "DOUBLE", "baseline_value": "DOUBLE", "deviation_score": "DOUBLE",
             "affected_reviews": "BIGINT"}
    body = ", ".join(f"CAST({cols.get(c, 'NULL')} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in _COLS)
    return f"SELECT {body} FROM {frm} {where}"


_same = {c: c for c in _COLS if c != "alert_source"}
define("alert_rows", ["anomalies", "cross_cat", "emerging", "palerts", "dq"], " UNION ALL ".join([
    _alert("anomaly", "anomalies", **{k: v for k, v in _same.items() if k not in ("asin", "product_name")}),
    _alert("cross_category", "cross_cat", anomaly_type="'CROSS_CATEGORY_SPIKE'",
           derived_category="'MULTIPLE (' || affected_categories || ' categories)'", review_theme="review_theme",
           current_value="total_affected_reviews", deviation_score="avg_deviation",
           affected_reviews="total_affected_reviews", severity="max_severity"),
    _alert("emerging_theme", "emerging", "WHERE severity IN ('HIGH', 'MEDIUM')",
           anomaly_type="'EMERGING_THEME'", derived_category="derived_category", review_theme="review_theme",
           current_value="recent_share", baseline_value="historical_share", deviation_score="growth_factor",
           affected_reviews="recent_review_count", severity="severity"),
    _alert("product", "palerts", **({k: v for k, v in _same.items() if k != "review_theme"}
           | {"product_name": "coalesce(brand, '') || ' - ' || coalesce(product_name, CAST(asin AS VARCHAR))"})),
    _alert("data_quality", "dq", "WHERE status IN ('WARN', 'FAIL')", anomaly_type="'DQ_' || check_name",
           derived_category="table_name", current_value="current_value", baseline_value="expected_value",
           severity="CASE WHEN status = 'FAIL' THEN 'HIGH' ELSE 'MEDIUM' END")]))


@query("m10_alert_log", sql("SELECT * FROM alert_rows", "alert_rows"))
def _(spark, d):
    return round6(alert_log(spark, d), "baseline_value").drop("alert_id", "ai_summary")


@query("b26_alert_text", sql("""SELECT alert_source, anomaly_type, derived_category, review_theme,
  'Theme: ' || review_theme || '. Affected categories: ' || affected_categories || '. Total reviews: '
  || total_affected_reviews || '. Avg deviation: ' || CAST(CAST(avg_deviation AS DECIMAL(18,4)) AS VARCHAR) || '.' AS ai_summary
  FROM (SELECT 'cross_category' AS alert_source, 'CROSS_CATEGORY_SPIKE' AS anomaly_type,
    'MULTIPLE (' || affected_categories || ' categories)' AS derived_category, * FROM cross_cat)""", "cross_cat"))
def _(spark, d):
    cross = monitor.cross_category_alerts(monitor.complaint_spikes(complaints(spark, d)))
    return alerts.from_cross_category(cross).select(
        "alert_source", "anomaly_type", "derived_category", "review_theme", "ai_summary")


@query("m11_read_alerts", sql("""SELECT * FROM alert_rows WHERE severity = 'HIGH' AND alert_source = 'anomaly'
  ORDER BY abs(coalesce(deviation_score, 0)) DESC, anomaly_type, derived_category, review_theme NULLS LAST""", "alert_rows"))
def _(spark, d):
    return round6(alerts.read_alerts(alert_log(spark, d), severity="high", source="anomaly"),
                  "baseline_value").drop("alert_id", "ai_summary")


@query("g16_severity_counts", sql("SELECT severity, count(*) AS n FROM alert_rows GROUP BY severity", "alert_rows"))
def _(spark, d):
    return alerts.severity_counts(alert_log(spark, d))


@query("k4_alert_order", sql("""SELECT anomaly_type, derived_category, review_theme, severity, deviation_score,
  CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_rank FROM anomalies""", "anomalies"))
def _(spark, d):
    a = alerts.from_anomalies(anomalies_of(spark, d)).withColumn("alert_id", alerts.alert_id())
    from ..functions.rules import severity_rank
    return a.orderBy(*alerts.alert_order()).select(
        "anomaly_type", "derived_category", "review_theme", "severity", "deviation_score",
        severity_rank(F.col("severity")).alias("severity_rank"))


@query("m12_scan_digest", sql("""
SELECT n AS high_anomalies, f AS failed_checks,
  concat_ws(chr(10), CASE WHEN n > 0 THEN 'HIGH SEVERITY ANOMALIES (' || n || '):' || chr(10) || a END,
    CASE WHEN f > 0 THEN 'FAILED DATA QUALITY CHECKS (' || f || '):' || chr(10) || q END) AS message
FROM (SELECT count(*) AS n FROM anomalies WHERE severity = 'HIGH'),
  (SELECT string_agg(l, chr(10) ORDER BY o DESC, l) AS a FROM (
    SELECT abs(coalesce(deviation_score, 0)) AS o, '  - ' || anomaly_type || ' in ' || derived_category || ': deviation '
      || coalesce(CAST(CAST(deviation_score AS DECIMAL(18,4)) AS VARCHAR), 'N/A') AS l
    FROM anomalies WHERE severity = 'HIGH' ORDER BY o DESC, l LIMIT 5)),
  (SELECT count(*) AS f, string_agg('  - ' || check_name || ': ' || description, chr(10)
    ORDER BY '  - ' || check_name || ': ' || description) AS q FROM dq WHERE status = 'FAIL')""", "anomalies", "dq"))
def _(spark, d):
    fact = full_fact(spark, d)
    return alerts.scan_digest(stash(anomalies_of(spark, d, fact), "anomalies"), checks_of(spark, d, fact))


@query("m13_acknowledged", sql("""SELECT anomaly_type, derived_category, review_theme, severity,
  severity = 'HIGH' AS acknowledged FROM anomalies""", "anomalies"))
def _(spark, d):
    log = stash(alerts.from_anomalies(anomalies_of(spark, d)).withColumn("alert_id", alerts.alert_id()), "alerts")
    high = log.where("severity = 'HIGH'").select("alert_id")
    acks = high.withColumn("acknowledged_at", F.lit("2001-12-01").cast("timestamp_ntz")).unionByName(
        high.withColumn("acknowledged_at", F.lit("2001-12-02").cast("timestamp_ntz")))
    return alerts.acknowledged_log(log, acks).select(
        "anomaly_type", "derived_category", "review_theme", "severity", "acknowledged")
