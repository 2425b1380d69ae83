"""Alert log: build, read, digest, acknowledge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import steady_round
from .monitor import shape

ALERT_COLUMNS = {
    "alert_source": "string", "anomaly_type": "string", "derived_category": "string",
    "review_theme": "string", "asin": "string", "product_name": "string",
    "detection_period": "date", "current_value": "double", "baseline_value": "double",
    "deviation_score": "double", "affected_reviews": "bigint", "severity": "string",
    "ai_summary": "string",
}
ID_COLUMNS = ["alert_source", "anomaly_type", "derived_category", "review_theme", "asin",
              "detection_period", "current_value", "severity"]


def num(value: Column) -> Column:
    return steady_round(value, 4).cast("decimal(18,4)").cast("string")


def sentence(*parts: tuple[str, Column]) -> Column:
    """``label: value. `` for every part whose value is not NULL."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{label}: "), value, F.lit(".")) for label, value in parts])


def alert_id() -> Column:
    """Same alert, same id: a hash of what identifies it."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ID_COLUMNS]
    return F.sha2(F.concat_ws("|", *cols), 256)


def from_anomalies(anomalies: DataFrame) -> DataFrame:
    text = sentence(("Anomaly", F.col("anomaly_type")), ("Category", F.col("derived_category")),
                    ("Theme", F.col("review_theme")), ("Current value", num(F.col("current_value"))),
                    ("Baseline", F.coalesce(num(F.col("baseline_value")), F.lit("N/A"))),
                    ("Deviation", F.coalesce(num(F.col("deviation_score")), F.lit("N/A"))),
                    ("Severity", F.col("severity")))
    return shape(anomalies.withColumns({"alert_source": F.lit("anomaly"), "ai_summary": text}),
                 ALERT_COLUMNS)


def from_cross_category(cross: DataFrame) -> DataFrame:
    n = F.col("affected_categories").cast("string")
    text = sentence(("Theme", F.col("review_theme")), ("Affected categories", n),
                    ("Total reviews", F.col("total_affected_reviews").cast("string")),
                    ("Avg deviation", num(F.col("avg_deviation"))))
    return shape(cross.withColumns({
        "alert_source": F.lit("cross_category"), "anomaly_type": F.lit("CROSS_CATEGORY_SPIKE"),
        "derived_category": F.concat(F.lit("MULTIPLE ("), n, F.lit(" categories)")),
        "current_value": F.col("total_affected_reviews"), "deviation_score": F.col("avg_deviation"),
        "affected_reviews": F.col("total_affected_reviews"), "severity": F.col("max_severity"),
        "ai_summary": text}), ALERT_COLUMNS)


def from_emerging(emerging: DataFrame) -> DataFrame:
    text = sentence(("Category", F.col("derived_category")), ("Theme", F.col("review_theme")),
                    ("Recent share", num(F.col("recent_share"))),
                    ("Historical share", num(F.col("historical_share"))),
                    ("Growth", num(F.col("growth_factor"))))
    rows = emerging.where(F.col("severity").isin("HIGH", "MEDIUM"))
    return shape(rows.withColumns({
        "alert_source": F.lit("emerging_theme"), "anomaly_type": F.lit("EMERGING_THEME"),
        "current_value": F.col("recent_share"), "baseline_value": F.col("historical_share"),
        "deviation_score": F.col("growth_factor"), "affected_reviews": F.col("recent_review_count"),
        "ai_summary": text}), ALERT_COLUMNS)


def from_products(products: DataFrame) -> DataFrame:
    asin = F.col("asin").cast("string")
    text = sentence(("Product", F.coalesce(F.col("product_name"), asin)), ("Id", asin),
                    ("Category", F.coalesce(F.col("derived_category"), F.lit("Unknown"))),
                    ("Type", F.col("anomaly_type")), ("Current rating", num(F.col("current_value"))),
                    ("Baseline", F.coalesce(num(F.col("baseline_value")), F.lit("N/A"))))
    name = F.concat(F.coalesce("brand", F.lit("")), F.lit(" - "), F.coalesce(F.col("product_name"), asin))
    return shape(products.withColumns({"alert_source": F.lit("product"), "ai_summary": text})
                 .withColumn("product_name", name), ALERT_COLUMNS)


def from_quality(checks: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Data quality check "), "check_name", F.lit(" on "), "table_name",
                    F.lit(": "), "status", F.lit(". Current: "), num(F.col("current_value")),
                    F.lit(", Expected: "), num(F.col("expected_value")), F.lit(". "), "description")
    rows = checks.where(F.col("status").isin("WARN", "FAIL"))
    return shape(rows.withColumns({
        "alert_source": F.lit("data_quality"), "ai_summary": text,
        "anomaly_type": F.concat(F.lit("DQ_"), "check_name"), "derived_category": F.col("table_name"),
        "baseline_value": F.col("expected_value"),
        "severity": F.when(F.col("status") == "FAIL", "HIGH").otherwise("MEDIUM")}), ALERT_COLUMNS)


def build_alerts(anomalies: DataFrame, cross: DataFrame, emerging: DataFrame, products: DataFrame,
                 checks: DataFrame) -> DataFrame:
    """Five sources in one schema, with a repeatable id."""
    parts = [from_anomalies(anomalies), from_cross_category(cross), from_emerging(emerging),
             from_products(products), from_quality(checks)]
    return reduce(DataFrame.unionByName, parts).withColumn("alert_id", alert_id())


def add_alerts(log: DataFrame | None, alerts: DataFrame) -> DataFrame:
    """Alerts the log does not hold yet."""
    return alerts if log is None else alerts.join(log.select("alert_id"), "alert_id", "left_anti")


def alert_order(created: str | None = None) -> list[Column]:
    order = [rules.severity_rank(F.col("severity")),
             F.abs(F.coalesce("deviation_score", F.lit(0.0))).desc()]
    if created:
        order.append(F.col(created).desc())
    return order + [F.col("alert_id")]


def read_alerts(log: DataFrame, severity: str | None = None, anomaly_type: str | None = None,
                source: str | None = None, acknowledged: bool | None = None,
                limit: int | None = None, created: str | None = None) -> DataFrame:
    out = log
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if anomaly_type:
        out = out.where(F.col("anomaly_type") == anomaly_type.upper())
    if source:
        out = out.where(F.col("alert_source") == source)
    if acknowledged is not None:
        out = out.where(F.col("acknowledged") == acknowledged)
    ordered = out.orderBy(*alert_order(created))
    return ordered if limit is None else ordered.limit(limit)


def severity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def severity_totals(log: DataFrame) -> DataFrame:
    s = F.col("severity")
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "HIGH").alias("high_count"),
                   F.count_if(s == "MEDIUM").alias("medium_count"), F.count_if(s == "LOW").alias("low_count"))


def scan_digest(anomalies: DataFrame, checks: DataFrame, first: int = 5) -> DataFrame:
    """One row: how many HIGH anomalies and failed checks, and a message with
    the ``first`` anomalies by deviation and all failed checks (the checks are
    a fixed list plus one per source category)."""
    high = anomalies.where(F.col("severity") == "HIGH")
    failed = checks.where(F.col("status") == "FAIL")
    line = F.concat(F.lit("  - "), "anomaly_type", F.lit(" in "), "derived_category",
                    F.lit(": deviation "), F.coalesce(num(F.col("deviation_score")), F.lit("N/A")))
    size = F.abs(F.coalesce("deviation_score", F.lit(0.0)))
    top = (high.withColumn("_line", line).orderBy(size.desc(), F.col("_line")).limit(first)
           .agg(F.array_sort(F.collect_list(F.struct((-size).alias("o"), F.col("_line").alias("l")))).alias("_top")))
    top = top.select(F.array_join(F.transform("_top", lambda x: x["l"]), "\n").alias("_anomalies"))
    bad = failed.agg(F.count(F.lit(1)).alias("failed_checks"),
                     F.array_join(F.sort_array(F.collect_list(
                         F.concat(F.lit("  - "), "check_name", F.lit(": "), "description"))), "\n")
                     .alias("_checks"))
    n = high.agg(F.count(F.lit(1)).alias("high_anomalies"))
    row = n.crossJoin(bad).crossJoin(top)
    return row.select("high_anomalies", "failed_checks", F.concat_ws(
        "\n", F.when(F.col("high_anomalies") > 0, F.concat(
            F.lit("HIGH SEVERITY ANOMALIES ("), F.col("high_anomalies").cast("string"), F.lit("):\n"), "_anomalies")),
        F.when(F.col("failed_checks") > 0, F.concat(
            F.lit("FAILED DATA QUALITY CHECKS ("), F.col("failed_checks").cast("string"), F.lit("):\n"), "_checks")))
        .alias("message"))


def acknowledged_log(log: DataFrame, acks: DataFrame) -> DataFrame:
    """Log with the first acknowledgement of each alert; ``acks`` holds
    (alert_id, acknowledged_at) events and is only ever appended to."""
    first = acks.groupBy("alert_id").agg(F.min("acknowledged_at").alias("acknowledged_at"))
    return log.join(first, "alert_id", "left").withColumn(
        "acknowledged", F.col("acknowledged_at").isNotNull())


def ack_result(log: DataFrame, acks: DataFrame) -> DataFrame:
    """Per acknowledgement: did the alert exist?"""
    known = log.select("alert_id").distinct().withColumn("_known", F.lit(True))
    return acks.join(known, "alert_id", "left").select(
        "alert_id", F.coalesce("_known", F.lit(False)).alias("found"))
