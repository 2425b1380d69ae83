"""Landing, staging, sink and stream queries.  Files they need are written to
the shared folder first, from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import search
from ..session import new_path, stash
from ..sources import fixtures as fx
from ..sources import landing, sinks
from ..streaming import jobs
from . import eval_queries  # noqa: F401  (defines run_summary)
from .monitor_queries import anomalies_of
from .registry import define, query, sql
from .search_queries import _asked

# --------------------------------------------------------------- landing, A1-A5

_KEYS = "review_id asin user_id rating title text timestamp verified_purchase helpful_vote".split()


def raw_json(spark, d):
    """Documents as JSON lines in the older key spelling, with times as epoch
    seconds, epoch milliseconds or text and some values that do not cast."""
    i = F.col("doc_id")
    sec = F.lit(1600000000) + i * 3600
    ts = F.when(i % 3 == 0, sec.cast("string")).when(i % 3 == 1, (sec * 1000).cast("string")).otherwise(
        F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd HH:mm:ss"))
    rows = fx.table(spark, d, "documents").select(
        i.cast("string").alias("review_id"), (i % 50).cast("string").alias("asin"), F.col("source").alias("user_id"),
        F.when(F.col("lang") == "fr", "n/a").otherwise((1 + i % 5).cast("string")).alias("rating"),
        F.col("lang").alias("title"), F.col("text"), ts.alias("timestamp"),
        F.when(i % 2 == 0, "true").otherwise("maybe").alias("verified_purchase"),
        F.col("n_chars").cast("string").alias("helpful_vote"))
    return rows.select(F.to_json(F.struct(*_KEYS)).alias("value"), F.col("title").alias("lang"))


define("typed", [], """SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(doc_id % 50 AS VARCHAR) AS asin, source AS user_id,
  CASE WHEN lang = 'fr' THEN NULL ELSE CAST(1 + doc_id % 5 AS INTEGER) END AS rating, lang AS title, text AS review_text,
  CASE WHEN doc_id % 2 = 0 THEN TRUE END AS verified_purchase, n_chars AS helpful_vote,
  CAST(TIMESTAMP '2020-09-13 12:26:40' + INTERVAL (doc_id) HOUR AS VARCHAR) AS review_ts,
  CAST(length(trim(text, ' ')) AS INTEGER) AS text_len FROM documents""")


def land_files(spark, d):
    """One gz file set of valid lines and broken ones, read back as landing rows."""
    path = new_path(spark, "lines")
    bad = fx.table(spark, d, "pages").select(F.concat(F.lit("{broken "), "url").alias("value"))
    raw_json(spark, d).select("value").unionByName(bad).write.option("compression", "gzip").text(path)
    return path


@query("a1_category_ingest", sql("SELECT *, 'Docs' AS source_category FROM typed", "typed"))
def _(spark, d):
    return landing.typed_reviews(landing.read_json_lines(spark, land_files(spark, d), "Docs"))


@query("a2_parquet_scan", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return landing.read_landing(spark, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("a3_input_profile", "SELECT (SELECT count(*) FROM documents) AS valid_lines, (SELECT count(*) FROM pages) AS invalid_lines")
def _(spark, d):
    return landing.input_profile(spark.read.text(land_files(spark, d)))


@query("a4_metadata_prep", """SELECT p_partkey AS asin, p_name AS title, p_brand AS brand, p_retailprice AS price,
  CASE WHEN p_size > 10 THEN p_size END AS size, p_type AS nested_type, n.products, n.errors
  FROM part, (SELECT (SELECT count(*) FROM part) AS products, 4 * (SELECT count(*) FROM nation) AS errors) n""")
def _(spark, d):
    source, out = new_path(spark, "meta"), new_path(spark, "meta-clean")
    rows = fx.table(spark, d, "part").select(F.to_json(F.struct(
        F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"),
        F.struct(F.col("p_type").alias("type"), F.array(F.lit(None).cast("int"), F.lit(1)).alias("list")).alias("nested"),
        F.array(F.lit("a.jpg"), F.col("p_type")).alias("imageURL"), F.lit("<table/>").alias("similar_item")),
        {"ignoreNullFields": "false"}).alias("value"))
    # per nation a broken line, a list, a plain value and an object with a repeated key
    bad = fx.table(spark, d, "nation").select(F.explode(F.array(
        F.concat(F.lit("{broken "), "n_name"), F.concat(F.lit('["'), "n_name", F.lit('"]')),
        F.col("n_nationkey").cast("string"), F.lit('{"asin":1,"asin":2}'))).alias("value"))
    rows.unionByName(bad).write.text(source)
    counts = landing.prepare_metadata(spark, source, out)
    kept = spark.read.schema("asin bigint, title string, brand string, price double, size bigint, "
                             "nested struct<type:string>, imageURL string, similar_item string").json(out)
    return (kept.where("imageURL is null and similar_item is null").crossJoin(F.broadcast(counts))
            .withColumn("nested_type", F.col("nested.type")).drop("nested", "imageURL", "similar_item"))


@query("a5_pack_round_trip", sql("""SELECT source_category, count(*) AS n, CAST(sum(rating) AS BIGINT) AS stars, CAST(sum(text_len) AS BIGINT) AS chars,
  count(*) FILTER (WHERE verified_purchase) AS verified FROM reviews_c GROUP BY source_category""", "reviews_c"))
def _(spark, d):
    r = fx.reviews(spark, d, customers=True)
    packed = landing.pack_json(r, ["review_id", "asin", "user_id", "rating", "verified_purchase", "helpful_vote",
                                   "review_ts", "text_len"], F.col("source_category"))
    return landing.typed_reviews(packed).groupBy("source_category").agg(
        F.count("review_ts").alias("n"), F.sum("rating").alias("stars"), F.sum("text_len").alias("chars"),
        F.count_if("verified_purchase").alias("verified"))


@query("a13_ingestion_health", sql("""SELECT source_category, count(*) AS total_rows, CAST(min(review_ts) AS DATE)::VARCHAR AS first_loaded,
  CAST(max(review_ts) AS DATE)::VARCHAR AS last_loaded, count(DISTINCT asin) AS unique_asins, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT derived_category) AS source_files FROM reviews_c GROUP BY source_category""", "reviews_c"))
def _(spark, d):
    r = fx.reviews(spark, d, customers=True)
    packed = r.select(F.to_json(F.struct("asin", "user_id")).alias("v"), "source_category",
                      F.col("derived_category").alias("source_file"), F.col("review_ts").alias("loaded_at"))
    h = landing.ingestion_health(packed)
    return h.withColumns({c: F.col(c).cast("date") for c in ("first_loaded", "last_loaded")})


# ----------------------------------------------------------------- staging, B1-3

@query("b1_staged_reviews", sql("""SELECT review_id, asin, rating, review_ts, text_len,
  title || ' ' || review_text AS review_text_full,
  regexp_replace(regexp_replace(regexp_replace(title || ' ' || review_text, '<[^>]+>', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '\\s+', ' ', 'g') AS review_text_clean,
  CASE WHEN text_len >= 500 THEN 'high' WHEN text_len >= 150 THEN 'medium' ELSE 'low' END AS review_quality
  FROM typed WHERE rating IS NOT NULL AND text_len >= 20""", "typed"))
def _(spark, d):
    rows = raw_json(spark, d).select(F.col("value").alias("v"), F.col("lang").alias("source_category"))
    return landing.stage_reviews(rows).select(
        "review_id", "asin", "rating", "review_ts", "text_len", "review_text_full", "review_text_clean", "review_quality")


@query("b2_lenient_cast", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_id
  ELSE CAST(round(CAST(value AS DECIMAL(18,2)), 0) AS BIGINT) END AS n FROM events""")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(
        F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(
        F.col("value").cast("decimal(18,2)").cast("string"))
    return fx.table(spark, d, "events").select("event_id", rules.lenient_int(raw).alias("n"))


@query("b3_event_time", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(date_trunc('second', ts) AS VARCHAR) END AS at FROM events""")
def _(spark, d):
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    sec = F.unix_timestamp(ts)
    raw = (F.when(i % 4 == 0, sec.cast("string")).when(i % 4 == 1, (sec * 1000).cast("string"))
           .when(i % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon"))
    return fx.table(spark, d, "events").select("event_id", rules.event_time(raw).alias("at"))


@query("b11_raw_keys", """SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(doc_id % 50 AS VARCHAR) AS asin, source AS user_id,
  CASE WHEN lang = 'fr' THEN 'n/a' ELSE CAST(1 + doc_id % 5 AS VARCHAR) END AS rating_raw FROM documents""")
def _(spark, d):
    return landing.raw_keys(raw_json(spark, d).withColumnRenamed("value", "v")).drop("timestamp_raw")


@query("b11_negative_view", sql("SELECT review_id, asin, rating FROM reviews WHERE rating <= 2", "reviews"))
def _(spark, d):
    return landing.negative_reviews(fx.reviews(spark, d)).select("review_id", "asin", "rating")


@query("b13_name_cleaner", """SELECT p_partkey, CASE WHEN length(s) < 100 AND contains(s, '-') THEN trim(split_part(s, '-', 1)) ELSE 'Unknown' END AS brand,
  CASE WHEN length(s) >= 100 THEN NULL WHEN contains(s, '-') THEN trim(substr(s, instr(s, '-') + 1)) ELSE trim(s) END AS product FROM (
  SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(replace(n, chr(10), '')), '^Brand\\s*-\\s*', ''), 'Product Name:\\s*', '', 'g'), '^Based on.*$', '') AS s
  FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Brand - ' || p_brand || ' - ' || p_name WHEN 'LARGE' THEN 'Product Name: ' || p_name || chr(10)
   WHEN 'PROMO' THEN 'Based on the reviews ' || p_name WHEN 'MEDIUM' THEN repeat(p_name, 20) ELSE p_brand || '-' || p_name END AS n FROM part))""")
def _(spark, d):
    t = F.col("p_type")
    n = (F.when(t == "SMALL", F.concat(F.lit("Brand - "), "p_brand", F.lit(" - "), "p_name"))
         .when(t == "LARGE", F.concat(F.lit("Product Name: "), "p_name", F.lit("\n")))
         .when(t == "PROMO", F.concat(F.lit("Based on the reviews "), "p_name"))
         .when(t == "MEDIUM", F.repeat("p_name", F.lit(20))).otherwise(F.concat("p_brand", F.lit("-"), "p_name")))
    brand, product = rules.clean_name(n)
    return fx.table(spark, d, "part").select("p_partkey", brand.alias("brand"), product.alias("product"))


# ------------------------------------------------------------------- sinks, A6-8

_PICK = ["review_id", "asin", "supplier", "rating", "text_len", "review_theme"]


def _order():
    return [F.col("review_ts").desc(), F.col("text_len").desc(), F.col("asin"), F.col("supplier"), F.col("rating"),
            F.col("review_theme"), F.col("sentiment_score"), F.col("verified_purchase")]


_BEST = """row_number() OVER (PARTITION BY review_id ORDER BY review_ts DESC, text_len DESC, asin, supplier, rating,
  review_theme, sentiment_score, verified_purchase)"""
define("old_rows", ["raw_reviews"], f"""SELECT * FROM (SELECT *, {_BEST} AS rn FROM raw_reviews
  WHERE review_ts < TIMESTAMP '1999-01-01') WHERE rn = 1""")
define("new_rows", ["raw_reviews", "old_rows"], f"""SELECT * FROM (SELECT *, {_BEST} AS rn FROM raw_reviews
  WHERE review_id NOT IN (SELECT review_id FROM old_rows)) WHERE rn = 1""")
define("merged", ["old_rows", "new_rows"], "SELECT * FROM old_rows UNION ALL SELECT * FROM new_rows")


def _old_and_all(spark, d):
    everything = fx.reviews_with_duplicates(spark, d)
    old = everything.where(F.col("review_ts") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return old, everything


@query("a6_merge_insert", sql(f"SELECT {', '.join(_PICK)} FROM merged", "merged"))
def _(spark, d):
    old, everything = _old_and_all(spark, d)
    target = stash(sinks.new_rows(old, None, "review_id", _order()), "target")
    return sinks.merge_insert(everything, target, "review_id", _order()).select(*_PICK)


@query("a7_incremental_enrichment", sql("""SELECT 'old' AS origin, count(*) AS n, CAST(sum(text_len) AS BIGINT) AS chars FROM old_rows
  UNION ALL SELECT 'new', count(*), CAST(sum(text_len) AS BIGINT) FROM new_rows""", "old_rows", "new_rows"))
def _(spark, d):
    old, everything = _old_and_all(spark, d)
    target = stash(sinks.new_rows(old, None, "review_id", _order()).withColumn("origin", F.lit("old")), "target")
    clean = sinks.new_rows(everything, None, "review_id", _order())
    out = sinks.incremental(clean, target, "review_id", lambda s: s.withColumn("origin", F.lit("new")))
    return out.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("text_len").alias("chars"))


@query("a7_upsert", sql(f"""SELECT {', '.join(_PICK)} FROM (SELECT *, {_BEST} AS best FROM raw_reviews)
  WHERE best = 1""", "raw_reviews"))
def _(spark, d):
    old, everything = _old_and_all(spark, d)
    target = stash(sinks.new_rows(old, None, "review_id", _order()), "target")
    return sinks.upsert(target, everything, "review_id", _order()).select(*_PICK)


@query("a8_materialise", sql("SELECT derived_category, review_count, avg_rating FROM summary", "summary"))
def _(spark, d):
    from ..operators import marts
    table = sinks.materialise(marts.category_summary(fx.reviews(spark, d)), new_path(spark, "summary"))
    return table.select("derived_category", "review_count", "avg_rating")


@query("a12_json_summary", sql("SELECT model, evaluated, intent_accuracy, latency_p95, total_eval_cost FROM run_summary", "run_summary"))
def _(spark, d):
    from ..operators.evalruns import run_summary
    path = new_path(spark, "run-json")
    sinks.write_json(run_summary(fx.eval_runs(spark, d)), path)
    return spark.read.json(path).select("model", "evaluated", "intent_accuracy", "latency_p95", "total_eval_cost")


# ------------------------------------------------------------------ streams, S1-3

@query("s1_stream_ingest", sql(f"SELECT {', '.join(_PICK)} FROM merged", "merged"))
def _(spark, d):
    source, target, check = (new_path(spark, n) for n in ("in", "target", "check"))
    old, everything = _old_and_all(spark, d)
    for rows in (old, everything):
        rows.write.mode("append").parquet(source)
        jobs.ingest_reviews(spark, source, rows.schema, target, check, _order())
    return spark.read.parquet(target).select(*_PICK)


@query("s2_stream_alerts", sql("""SELECT anomaly_type, derived_category, review_theme, detection_period, current_value,
  deviation_score, affected_reviews, severity FROM anomalies""", "anomalies"))
def _(spark, d):
    source, log, check = (new_path(spark, n) for n in ("anomalies", "log", "check"))
    found = stash(anomalies_of(spark, d), "found")
    # the second round repeats the first one's rows: they must not log again
    for rows in (found.where("severity = 'HIGH'"), found):
        rows.write.mode("append").parquet(source)
        jobs.log_anomalies(spark, source, rows.schema, log, check)
    return spark.read.parquet(log).select("anomaly_type", "derived_category", "review_theme", "detection_period",
                                          "current_value", "deviation_score", "affected_reviews", "severity")


@query("s3_stream_index", sql("SELECT * FROM keyword WHERE rank <= 3", "keyword"))
def _(spark, d):
    source, index, check = (new_path(spark, n) for n in ("docs", "index", "check"))
    docs = fx.documents(spark, d).select("review_id", "review_text", "lang")
    for rows in (docs.where("lang = 'en'"), docs):
        rows.write.mode("append").parquet(source)
        jobs.refresh_index(spark, source, docs.schema, index, check)
    return jobs.search_index(spark, index, search.query_terms(_asked(spark), "query_id", "query"), 3)
