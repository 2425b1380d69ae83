"""Adapters: the driver's test tables read as reviews, metadata, documents,
turns and evaluation runs.  The operators themselves know none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import rules
from ..functions.numeric import SCORE
from ..operators.dedup import keep_first


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LATEST_LINE = ["l_shipdate desc nulls last", "text_len desc", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the review key and length; keys repeat on purpose."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate",
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("text_len"))


def _typed(lines: DataFrame, parts: DataFrame) -> DataFrame:
    j = lines.join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.col("l_shipdate").cast("date")
    drift = F.when(F.col("p_type").isin("PROMO", "LARGE") & (day >= F.lit("2001-09-01").cast("date")),
                   1).otherwise(0)
    stars = F.greatest(F.lit(1), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int") - drift)
    forced = ((day >= F.lit("2001-08-01").cast("date")) & (F.col("l_linenumber") <= 2)
              & (F.col("p_type") != "SMALL"))
    index = F.when(forced, 3).otherwise(
        F.pmod(F.col("l_orderkey") + F.col("l_suppkey"), F.lit(10)).cast("int"))
    themes = F.array(*[F.lit(t) for t in vocab.THEMES])
    steps = F.round(F.col("l_discount") * 100).cast("int") - 5
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.col("l_partkey").alias("asin"), F.col("l_suppkey").alias("supplier"),
        F.col("l_orderkey"), stars.cast("int").alias("rating"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.col("l_shipdate").alias("review_ts"), F.trunc(day, "MM").alias("review_month"),
        "text_len", rules.quality_tier(F.col("text_len")).alias("review_quality"),
        F.col("p_type").alias("derived_category"),
        (steps.cast("decimal(4,0)") * F.lit(0.2).cast("decimal(2,1)")).cast(SCORE)
        .alias("sentiment_score"),
        F.element_at(themes, index + 1).alias("review_theme"))


def reviews_with_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(raw_lines(spark, folder), table(spark, folder, "part"))


def reviews(spark: SparkSession, folder: str, customers: bool = False) -> DataFrame:
    """One row per review.  ``customers`` adds user_id and source_category
    (a join with orders that most operators do not need)."""
    latest = keep_first(raw_lines(spark, folder), ["l_orderkey", "l_linenumber"],
                        [F.expr(e.split(" ")[0]).desc_nulls_last() if " desc" in e
                         else F.col(e).asc() for e in LATEST_LINE])
    out = _typed(latest, table(spark, folder, "part"))
    if customers:
        orders = table(spark, folder, "orders").select(
            "o_orderkey", F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("source_category"))
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return out.drop("l_orderkey")


def metadata(spark: SparkSession, folder: str, duplicates: bool = False) -> DataFrame:
    """Product metadata; ``duplicates`` adds a cheaper second row for every
    tenth product and one without a price for every twentieth."""
    p = table(spark, folder, "part")
    n = p.agg(F.count(F.lit(1)).alias("_n"))
    base = p.crossJoin(F.broadcast(n)).select(
        F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.concat_ws("|", F.concat(F.lit("type "), F.col("p_type")),
                    F.concat(F.lit("size number "), F.col("p_size").cast("string")),
                    F.concat(F.lit("brand is "), F.col("p_brand"))).alias("features_text"),
        F.col("p_type").alias("category_path"),
        F.array(*[F.pmod(F.col("p_partkey") + s, F.col("_n")) for s in (1, 7, 13)]).alias("also_buy"))
    if not duplicates:
        return base
    again = base.where(F.col("asin") % 10 == 0).withColumn(
        "price", F.when(F.col("asin") % 20 == 0, F.lit(None)).otherwise(F.col("price") - 1)
        .cast("decimal(10,2)")).withColumn("title", F.concat("title", F.lit(" (old)")))
    return base.unionByName(again)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as reviews with text."""
    d = table(spark, folder, "documents")
    n = F.length("text").cast("int")
    return d.select(
        F.col("doc_id").alias("review_id"), (F.col("doc_id") % 50).alias("asin"),
        (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
        F.col("text").alias("review_text"), n.alias("text_len"),
        rules.quality_tier(n).alias("review_quality"), "lang", "source")


def eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as evaluation rows: one per (model, question) attempt."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tools = F.slice(F.array(F.lit("query_analyst"), F.lit("search_reviews"),
                            F.lit("compare_products")), 1, k % 3 + 1)
    kinds = F.array(F.lit("structured"), F.lit("semantic"), F.lit("synthesis"))
    prefix = F.element_at(F.array(F.lit("cat"), F.lit("prod"), F.lit("theme"), F.lit("misc")),
                          (F.col("user_id") % 4 + 1).cast("int"))
    score = (1 + F.col("event_id") % 5).cast("int")
    return e.select(
        F.col("event_id"), F.lit("run-1").alias("run_id"), F.col("event_type").alias("model"),
        F.lit("judge").alias("judge_model"),
        F.concat_ws("_", prefix, F.col("user_id").cast("string")).alias("question_id"),
        F.element_at(kinds, (F.col("user_id") % 3 + 1).cast("int")).alias("expected_intent"),
        F.when(F.col("event_id") % 4 != 0, F.lit("agent")).otherwise(F.lit("semantic"))
        .alias("actual_intent"),
        (F.col("event_id") % 4 != 0).alias("data_correct"),
        score.alias("judge_factuality"), (6 - score).alias("judge_completeness"),
        (1 + F.col("user_id") % 5).cast("int").alias("judge_citation"),
        F.lit(3).alias("judge_context"), (score < 3).alias("is_hallucination"),
        F.col("value").cast("decimal(12,2)").alias("latency_s"), tools.alias("tools_used"),
        (F.col("event_id") % 7 == 0).alias("fallback_used"),
        (F.col("event_id") % 2 == 0).alias("has_reflection"))


def lookup(spark: SparkSession, folder: str, fact: DataFrame) -> DataFrame:
    """Product lookup over the fixture, whose category comes from the part."""
    counts = fact.groupBy("asin", "derived_category").agg(
        F.count(F.lit(1)).alias("review_count")).where("review_count >= 3")
    meta = metadata(spark, folder).select("asin", "brand", F.col("title").alias("product_name"))
    return counts.withColumn("derivation_confidence", rules.confidence_tier(F.col("review_count"))).join(
        meta, "asin", "left")
