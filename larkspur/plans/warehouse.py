"""The whole batch job, layer by layer, on tables that grow by runs.

A run enriches reviews it has not seen, gives categories to products that have none,
and brings the gold marts up to date from the states of the rows it added.  Every
table is committed by its manifest, so a run that dies is simply started again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import alerts, enrich, marts, monitor, quality
from ..operators.dedup import keep_latest_reviews
from ..operators.skew import spread_join
from ..sources import runs
from ..sources.landing import ingestion_health, stage_reviews, typed_reviews


def build_marts(fact: DataFrame) -> dict[str, DataFrame]:
    """The five gold marts straight from a fact table (lazy)."""
    return {"category_summary": marts.category_summary(fact), "monthly_trends": marts.monthly_trends(fact),
            "product_summary": marts.product_summary(fact), "theme_category": marts.theme_category(fact),
            "complaint_analysis": marts.complaint_analysis(fact)}


def _labels(categories: DataFrame) -> DataFrame:
    return categories.select("asin", rules.canonical_category(F.col("derived_category")).alias("derived_category"))


def refresh_states(spark: SparkSession, out: str, full_refresh: bool = False) -> dict[str, DataFrame]:
    """Adds to the mart states what the enriched reviews and product categories have
    gained since the states were last written, and returns the merged states.

    New reviews come in with their category; older reviews of products that got a
    category only now leave without one and come back with it.  The states of all
    grains and the list of the runs they count are one run, committed at once, so
    a run cut short anywhere before is simply made up for by the next one.
    """
    table, reviews, products = (f"{out}/{n}" for n in ("mart_states", "enriched_reviews", "product_categories"))
    done = None if full_refresh else runs.read(spark, table)
    counted = set() if done is None else {
        r[0] for r in done.where("grain = 'run'").select("counted_run").collect()}  # one row per run
    review_runs, product_runs = runs.folders(spark, reviews), runs.folders(spark, products)
    fresh = [f for f in review_runs if f not in counted]
    late = [f for f in product_runs if f not in counted]
    if not fresh and not late and done is not None:
        return _merged(done)
    parts = []
    if fresh:
        new = runs.read(spark, reviews, fresh)
        parts.append(spread_join(new, _labels(runs.read(spark, products)), "asin", "left")
                     .withColumn("_sign", F.lit(1)))
    older = [f for f in review_runs if f in counted]
    if late and older:
        moved = spread_join(runs.read(spark, reviews, older), _labels(runs.read(spark, products, late)),
                            "asin", "inner")
        parts += [moved.withColumn("_sign", F.lit(1)), moved.withColumn("_sign", F.lit(-1))
                  .withColumn("derived_category", F.lit(None).cast("string"))]
    rows = spark.createDataFrame([("run", f) for f in fresh + late], "grain string, counted_run string")
    if parts:
        delta = reduce(DataFrame.unionByName, parts)
        for grain, (keys, measures) in marts.STATES.items():
            rows = rows.unionByName(marts.group_state(delta, keys, measures, "_sign").withColumn("grain", F.lit(grain)),
                                    allowMissingColumns=True)
    if done is None:
        runs.replace(rows, table, ["grain"])
    else:
        runs.append(rows, table, ["grain"])
    return _merged(runs.read(spark, table))


def _merged(states: DataFrame) -> dict[str, DataFrame]:
    return {grain: marts.merge_states(states.where(F.col("grain") == grain), keys, measures)
            for grain, (keys, measures) in marts.STATES.items()}


def build(landing: DataFrame, metadata: DataFrame, out: str, as_of: str, previous: DataFrame | None = None,
          full_refresh: bool = False, **scorers) -> dict[str, DataFrame]:
    """Landing rows and metadata -> every table of the warehouse under ``out``.
    Reviews and product categories that ``out`` already has are kept as they are
    unless ``full_refresh``.  ``previous`` may bring in an enriched table from
    elsewhere to start with."""
    spark = landing.sparkSession
    tables: dict[str, DataFrame] = {}

    def write(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        tables[name] = runs.replace(df, f"{out}/{name}", partition_by)
        return tables[name]

    reviews = f"{out}/enriched_reviews"
    if previous is not None and runs.read(spark, reviews) is None:
        runs.append(previous, reviews)
    year = int(as_of[:4])
    staged = keep_latest_reviews(stage_reviews(landing, year))
    enriched = tables["enriched_reviews"] = runs.grow(
        staged, reviews, "review_id", lambda s: enrich.enrich_reviews(s, **scorers), full_refresh)
    # only reviews of products without a category are looked at
    categories = tables["product_categories"] = runs.grow(
        enriched, f"{out}/product_categories", "asin", enrich.product_categories, full_refresh)
    names = write("product_names", enrich.product_names(enriched))
    lookup = write("product_lookup", marts.product_lookup(categories, names, metadata))
    fact = write("fact_reviews", marts.fact_reviews(enriched, lookup), ["source_category"])
    states = refresh_states(spark, out, full_refresh)
    for name, df in marts.marts_from_states(states).items():
        write(name, df)

    anomalies = write("review_anomalies", monitor.review_anomalies(
        tables["monthly_trends"], tables["complaint_analysis"]))
    cross = write("cross_category_alerts", monitor.cross_category_alerts(anomalies))
    emerging = write("emerging_themes", monitor.emerging_themes(fact))
    months = write("product_months", monitor.product_months(fact))
    products = write("product_anomalies", monitor.product_anomalies(months, lookup))
    # the staged count is the number of distinct keys; no text is read for it
    keys = stage_reviews(landing, year).select("review_id").distinct()
    checks = write("data_quality_checks", quality.quality_checks(
        typed_reviews(landing), keys, enriched, fact, tables["category_summary"], as_of, year))
    if "loaded_at" in landing.columns:
        write("ingestion_health", ingestion_health(landing))
    found = alerts.build_alerts(anomalies, cross, emerging, products, checks).withColumn(
        "created_at", F.lit(as_of).cast("timestamp_ntz"))
    log = f"{out}/alert_log"
    runs.append(alerts.add_alerts(runs.read(spark, log), found), log)
    tables["alert_log"] = runs.read(spark, log)
    return tables
