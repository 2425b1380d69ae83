"""Named queries over the test tables, each next to its ANSI SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: decimals as double, dates and timestamps
    as text, arrays of scalars joined by commas."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
                f.dataType.elementType, (T.StructType, T.ArrayType)):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: flat(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# ---------------------------------------------------------------- SQL pieces

def rnd(x: str, digits: int) -> str:
    """Rounding as in ``functions.numeric.steady_round``."""
    return f"round(CAST({x} AS DOUBLE) + sign(CAST({x} AS DOUBLE)) * 1e-9, {digits})"


def mean(x: str, digits: int) -> str:
    return rnd(f"(CAST(sum({x}) AS DOUBLE) / count({x}))", digits)


def share(cond: str, digits: int) -> str:
    return rnd(f"(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE) / count(*))", digits)


def pct(cond: str, digits: int) -> str:
    return rnd(f"(100.0::DOUBLE * count(*) FILTER (WHERE {cond}) / count(*))", digits)


def _typed(source: str, extra: str = "", join: str = "") -> str:
    themes = ("['battery_life','build_quality','sound_quality','connectivity','comfort',"
              "'value_for_money','customer_service','durability','ease_of_use','other']")
    forced = ("(CAST(l_shipdate AS DATE) >= DATE '2001-08-01' AND l_linenumber <= 2 "
              "AND p_type <> 'SMALL')")
    return f"""SELECT l_orderkey || '-' || l_linenumber AS review_id, l_partkey AS asin,
  l_suppkey AS supplier,
  CAST(greatest(1, 1 + CAST(floor((l_quantity - 1) / 10) AS INTEGER)
    - CASE WHEN p_type IN ('PROMO','LARGE') AND CAST(l_shipdate AS DATE) >= DATE '2001-09-01'
      THEN 1 ELSE 0 END) AS INTEGER) AS rating,
  CAST(l_linenumber - 1 AS BIGINT) AS helpful_vote, l_returnflag <> 'R' AS verified_purchase,
  l_shipdate AS review_ts, CAST(date_trunc('month', l_shipdate) AS DATE) AS review_month,
  text_len, CASE WHEN text_len >= 500 THEN 'high' WHEN text_len >= 150 THEN 'medium'
    ELSE 'low' END AS review_quality,
  p_type AS derived_category,
  CAST((CAST(round(l_discount * 100) AS INTEGER) - 5) * 0.2 AS DECIMAL(8,4)) AS sentiment_score,
  {themes}[CASE WHEN {forced} THEN 4 ELSE 1 + (l_orderkey + l_suppkey) % 10 END] AS review_theme
  {extra} FROM {source} JOIN part ON l_partkey = p_partkey {join}"""


_LINES = "SELECT *, CAST(floor(l_extendedprice / 100) AS INTEGER) AS text_len FROM lineitem"
_CUSTOMER = ", o_custkey AS user_id, o_orderpriority AS source_category"
_ORDERS = "JOIN orders ON l_orderkey = o_orderkey"

# name -> (needed CTEs, text)
CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], _LINES),
    "li": (["lines"], """SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, text_len DESC,
  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS rn
  FROM lines) WHERE rn = 1"""),
    "reviews": (["li"], _typed("li")),
    "reviews_c": (["li"], _typed("li", _CUSTOMER, _ORDERS)),
    "raw_reviews": (["lines"], _typed("lines")),
    "summary": (["reviews"], f"""SELECT derived_category, count(*) AS review_count,
  {mean('rating', 2)} AS avg_rating, {mean('sentiment_score', 4)} AS avg_sentiment,
  {rnd('median(CAST(sentiment_score AS DOUBLE))', 4)} AS median_sentiment,
  count(*) FILTER (WHERE rating <= 2) AS negative_review_count,
  count(*) FILTER (WHERE rating >= 4) AS positive_review_count,
  {share('rating <= 2', 4)} AS negative_rate,
  count(*) FILTER (WHERE verified_purchase) AS verified_count,
  {mean('helpful_vote', 2)} AS avg_helpful_votes
  FROM reviews WHERE derived_category IS NOT NULL GROUP BY derived_category"""),
    "trends": (["reviews"], f"""SELECT derived_category, review_month,
  count(*) AS review_count, {mean('rating', 2)} AS avg_rating,
  {mean('sentiment_score', 4)} AS avg_sentiment,
  count(*) FILTER (WHERE rating <= 2) AS negative_review_count,
  {share('rating <= 2', 4)} AS negative_rate
  FROM reviews WHERE derived_category IS NOT NULL
  GROUP BY derived_category, review_month HAVING count(*) >= 5"""),
    "theme_counts": (["reviews"], """SELECT asin, derived_category, review_theme, count(*) AS n
  FROM reviews WHERE review_theme IS NOT NULL GROUP BY ALL"""),
    "top_themes": (["theme_counts"], """SELECT asin, derived_category, review_theme AS top_theme
  FROM (SELECT *, row_number() OVER (PARTITION BY asin, derived_category
  ORDER BY n DESC, review_theme) AS rn FROM theme_counts) WHERE rn = 1"""),
    "products": (["reviews", "top_themes"], f"""SELECT p.*, t.top_theme FROM (
  SELECT asin, derived_category, count(*) AS review_count, {mean('rating', 2)} AS avg_rating,
  {mean('sentiment_score', 4)} AS avg_sentiment,
  count(*) FILTER (WHERE rating <= 2) AS negative_review_count,
  {share('rating <= 2', 4)} AS negative_rate,
  count(*) FILTER (WHERE verified_purchase) AS verified_count,
  {mean('helpful_vote', 2)} AS avg_helpful_votes
  FROM reviews GROUP BY asin, derived_category HAVING count(*) >= 20) p
  LEFT JOIN top_themes t ON p.asin = t.asin AND p.derived_category = t.derived_category"""),
    "themes": (["reviews"], f"""SELECT derived_category, review_theme, count(*) AS review_count,
  {mean('rating', 2)} AS avg_rating, {mean('sentiment_score', 4)} AS avg_sentiment,
  count(*) FILTER (WHERE rating <= 2) AS negative_review_count,
  {share('rating <= 2', 4)} AS negative_rate,
  {mean('CASE WHEN rating <= 2 THEN sentiment_score END', 4)} AS negative_avg_sentiment
  FROM reviews WHERE derived_category IS NOT NULL AND review_theme IS NOT NULL
  GROUP BY derived_category, review_theme HAVING count(*) >= 10"""),
    "complaints": (["reviews"], f"""SELECT derived_category, review_theme,
  count(*) AS complaint_count, {mean('sentiment_score', 4)} AS avg_sentiment,
  {mean('helpful_vote', 2)} AS avg_helpful_votes,
  count(*) FILTER (WHERE review_quality = 'high') AS high_quality_complaints,
  {share("review_quality = 'high'", 4)} AS high_quality_rate
  FROM reviews WHERE rating <= 2 AND derived_category IS NOT NULL
  GROUP BY derived_category, review_theme HAVING count(*) >= 5"""),
    "docs": ([], """SELECT doc_id AS review_id, doc_id % 50 AS asin,
  CAST(1 + doc_id % 5 AS INTEGER) AS rating, text AS review_text,
  CAST(length(text) AS INTEGER) AS text_len,
  CASE WHEN length(text) >= 500 THEN 'high' WHEN length(text) >= 150 THEN 'medium'
    ELSE 'low' END AS review_quality, lang, source FROM documents"""),
    "longest": (["docs"], """SELECT *, row_number() OVER (PARTITION BY asin ORDER BY text_len DESC, review_id) AS rn,
  count(*) OVER (PARTITION BY asin) AS n FROM docs"""),
    "metadata": ([], """SELECT p_partkey AS asin, p_name AS title, p_brand AS brand,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price,
  'type ' || p_type || '|size number ' || p_size || '|brand is ' || p_brand AS features_text,
  p_type AS category_path,
  [(p_partkey + 1) % n, (p_partkey + 7) % n, (p_partkey + 13) % n] AS also_buy
  FROM part, (SELECT count(*) AS n FROM part)"""),
    "metadata_dup": (["metadata"], """SELECT * FROM metadata UNION ALL
  SELECT asin, title || ' (old)', brand, CAST(CASE WHEN asin % 20 = 0 THEN NULL
    ELSE price - 1 END AS DECIMAL(10,2)), features_text, category_path, also_buy
  FROM metadata WHERE asin % 10 = 0"""),
    # lookup: three longest reviews decide nothing here, the category is p_type
    "lookup": (["reviews", "metadata"], """SELECT c.asin, c.derived_category, c.review_count,
  CASE WHEN c.review_count >= 50 THEN 'high' WHEN c.review_count >= 10 THEN 'medium'
    ELSE 'low' END AS derivation_confidence,
  m.brand, m.title AS product_name, m.price, m.features_text, m.category_path, m.also_buy
  FROM (SELECT asin, derived_category, count(*) AS review_count FROM reviews
        GROUP BY asin, derived_category HAVING count(*) >= 3) c
  LEFT JOIN metadata m ON c.asin = m.asin"""),
    "runs": ([], """SELECT event_id, 'run-1' AS run_id, event_type AS model, 'judge' AS judge_model,
  ['cat','prod','theme','misc'][1 + user_id % 4] || '_' || user_id AS question_id,
  ['structured','semantic','synthesis'][1 + user_id % 3] AS expected_intent,
  CASE WHEN event_id % 4 <> 0 THEN 'agent' ELSE 'semantic' END AS actual_intent,
  event_id % 4 <> 0 AS data_correct,
  CAST(1 + event_id % 5 AS INTEGER) AS judge_factuality,
  CAST(5 - event_id % 5 AS INTEGER) AS judge_completeness,
  CAST(1 + user_id % 5 AS INTEGER) AS judge_citation, 3 AS judge_context,
  1 + event_id % 5 < 3 AS is_hallucination, CAST(value AS DECIMAL(12,2)) AS latency_s,
  (['query_analyst','search_reviews','compare_products'])[1:1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 3]
    AS tools_used, event_id % 7 = 0 AS fallback_used, event_id % 2 = 0 AS has_reflection
  FROM events"""),
}


def define(name: str, needs: list[str], text: str) -> None:
    CTES[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """``WITH <needed CTEs in order> body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body
