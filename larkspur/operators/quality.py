"""Data-quality checks: one row per check with PASS, WARN or FAIL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.numeric import ratio, steady_round


def _check(name: str, table: str, value: Column, expected: Column | float, status: Column,
           description: str) -> Column:
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    return F.struct(
        F.lit(name).alias("check_name"), F.lit(table).alias("table_name"),
        value.cast("double").alias("current_value"), expected.cast("double").alias("expected_value"),
        status.alias("status"), F.lit(description).alias("description"))


def _within(a: Column, b: Column, percent: float) -> Column:
    return (F.when(b == 0, "FAIL")
            .when(F.abs(a - b) * 100.0 / F.nullif(b, F.lit(0)) > percent, "FAIL").otherwise("PASS"))


def quality_checks(landing: DataFrame, staged: DataFrame, enriched: DataFrame, fact: DataFrame,
                   summary: DataFrame, as_of: str, max_year: int | None = None) -> DataFrame:
    """Eight pipeline checks and one row per source category.  Every table is
    read once; the checks are derived from one-row aggregates."""
    one = F.lit(1)
    plausible = F.col("review_ts") if max_year is None else F.when(
        F.year("review_ts") <= max_year, F.col("review_ts"))
    src = landing.agg(F.max(plausible).alias("newest"),
                      F.count(one).alias("landed"))
    st = staged.agg(F.count(one).alias("staged"))
    en = enriched.agg(F.count(one).alias("enriched"))
    su = summary.agg(F.count(one).alias("summarised"))
    fa = fact.agg(F.count(one).alias("facts"), F.count_if(F.col("sentiment_score").isNull()).alias("no_score"),
                  F.count_if(F.col("review_theme").isNull()).alias("no_theme"),
                  F.count("derived_category").alias("covered"),
                  F.countDistinct("derived_category").alias("categories"))
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [src, st, en, su, fa])
    now = F.lit(as_of).cast("timestamp_ntz")
    newest = F.col("newest").cast("timestamp_ntz")
    age = F.datediff(now.cast("date"), newest.cast("date"))
    coverage = ratio(F.col("covered") * 100, F.col("facts"))
    positive = lambda c: F.when(F.col(c) == 0, "FAIL").otherwise("PASS")
    zero = lambda c: F.when(F.col(c) > 0, "FAIL").otherwise("PASS")
    checks = [
        _check("SOURCE_FRESHNESS", "landing", age, 30,
               F.when(newest > now, "WARN").when(age > 90, "FAIL").when(age > 30, "WARN")
               .otherwise("PASS"), "Days since latest review"),
        _check("SOURCE_ROW_COUNT", "landing", F.col("landed"), 0, positive("landed"),
               "Total reviews in source (should be > 0)"),
        _check("ENRICHMENT_ROW_COUNT", "enriched_reviews", F.col("enriched"), F.col("staged"),
               _within(F.col("enriched"), F.col("staged"), 1),
               "Enriched vs staging row count (should match within 1%)"),
        _check("GOLD_ROW_COUNT", "fact_reviews", F.col("facts"), F.col("enriched"),
               _within(F.col("facts"), F.col("enriched"), 1),
               "Gold vs enriched row count (should match within 1%)"),
        _check("SENTIMENT_NULL_RATE", "fact_reviews", F.col("no_score"), 0, zero("no_score"),
               "NULL sentiment scores (should be 0)"),
        _check("THEME_NULL_RATE", "fact_reviews", F.col("no_theme"), 0, zero("no_theme"),
               "NULL review themes (should be 0)"),
        _check("CATEGORY_COVERAGE", "fact_reviews", steady_round(coverage, 1), 60,
               F.when(coverage < 60, "WARN").otherwise("PASS"),
               "Pct reviews with derived category (>60%)"),
        _check("CATEGORY_CONSISTENCY", "category_summary", F.col("summarised"), F.col("categories"),
               F.when(F.col("summarised") != F.col("categories"), "WARN").otherwise("PASS"),
               "Category count in summary vs fact should match"),
    ]
    fixed = row.select(F.inline(F.array(*checks)))
    return fixed.unionByName(category_health(fact))


def category_health(fact: DataFrame) -> DataFrame:
    return (fact.where(F.col("source_category").isNotNull()).groupBy("source_category")
            .agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit("PER_CATEGORY_HEALTH").alias("check_name"),
        F.col("source_category").alias("table_name"), F.col("_n").cast("double").alias("current_value"),
        F.lit(0.0).alias("expected_value"),
        F.when(F.col("_n") == 0, "FAIL").otherwise("PASS").alias("status"),
        F.lit("Reviews per source category (should be > 0)").alias("description")))


def expectations(df: DataFrame, table: str, not_null: list[str] = (),
                 accepted: dict[str, list] | None = None, unique: list[str] = (),
                 relationships: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Column tests as (table_name, column_name, test, failures).  Null and
    accepted-value tests share one pass; uniqueness counts the values that
    occur more than once; a relationship test ignores NULLs."""
    tests = [(c, "not_null", F.count_if(F.col(c).isNull())) for c in not_null]
    tests += [(c, "accepted_values", F.count_if(~F.col(c).isin(*values)))
              for c, values in (accepted or {}).items()]
    parts = []
    if tests:
        one = df.agg(*[t[2].alias(f"_{i}") for i, t in enumerate(tests)])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("test"),
                     F.col(f"_{i}").alias("failures")) for i, (c, kind, _) in enumerate(tests)]))))
    for c in unique:
        dup = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
               .agg(F.count_if(F.col("_n") > 1).alias("failures")))
        parts.append(dup.select(F.lit(c).alias("column_name"), F.lit("unique").alias("test"), "failures"))
    for c, (parent, field) in (relationships or {}).items():
        # values are reduced first, so a hot value crosses the join once
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_key")).agg(
            F.count(F.lit(1)).alias("_n"))
        keys = parent.select(F.col(field).alias("_key")).distinct()
        lost = values.join(keys, "_key", "left_anti").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("failures"))
        parts.append(lost.select(F.lit(c).alias("column_name"), F.lit("relationships").alias("test"),
                                 "failures"))
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(table).alias("table_name"), "column_name", "test", "failures")


def remnant_checks(docs: DataFrame, column: str, remnants: list[str] = vocab.REMNANTS) -> DataFrame:
    """Rows still holding a tag or reference after cleaning; should all be 0."""
    one = docs.agg(F.count(F.lit(1)).alias("_all"),
                   *[F.count_if(F.col(column).contains(r)).alias(f"_{i}")
                     for i, r in enumerate(remnants)])
    rows = [F.struct(F.lit("row_count").alias("check_name"), F.col("_all").alias("value"))]
    rows += [F.struct(F.lit(f"contains {r}").alias("check_name"), F.col(f"_{i}").alias("value"))
             for i, r in enumerate(remnants)]
    return one.select(F.inline(F.array(*rows)))
