"""Landing: semi-structured rows with their origin, and typed staging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import rules, text
from . import runs


def parsed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``v``: each line parsed once into VARIANT; NULL for lines that are not
    one JSON object (broken, a list or a single value, repeated keys, empty)."""
    # behind an outer generator: a filter on ``v`` would otherwise parse a second time
    one = F.transform(F.array(column), lambda x: F.when(x.rlike(r"^\s*\{"), F.try_parse_json(x)))
    return lines.select("*", F.explode_outer(one).alias("v"))


def read_json_lines(spark: SparkSession, path: str, category: str,
                    loaded_at: Column | None = None) -> DataFrame:
    """JSON lines (plain or gz) -> (v, source_category, source_file, loaded_at)
    with ``v`` as VARIANT.  Lines that are no JSON object are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    at = loaded_at if loaded_at is not None else F.current_timestamp()
    return (parsed_lines(lines).where(F.col("v").isNotNull())
            .select("v", F.lit(category).alias("source_category"), "source_file",
                    at.cast("timestamp_ntz").alias("loaded_at")))


def ingest_category(spark: SparkSession, path: str, category: str, target: str,
                    loaded_at: Column | None = None) -> dict[str, int]:
    """Appends the lines of one category to the landing table ``target`` as a run.
    One pass parses, counts and writes; returns rows written and lines skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    at = loaded_at if loaded_at is not None else F.current_timestamp()
    counted, seen = _counted(parsed_lines(lines))
    runs.append(counted.where(F.col("v").isNotNull()).select(
        "v", F.lit(category).alias("source_category"), "source_file",
        at.cast("timestamp_ntz").alias("loaded_at")), target)
    return {"rows": seen.get["good"], "skipped": seen.get["lines"] - seen.get["good"]}


def _counted(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation(f"lines-{uuid.uuid4().hex}")
    return parsed.observe(seen, F.count(F.lit(1)).alias("lines"), F.count("v").alias("good")), seen


def input_profile(lines: DataFrame, column: str = "value", by: list[str] | None = None) -> DataFrame:
    """Lines that are JSON objects and lines that are not, over the whole input."""
    return parsed_lines(lines, column).groupBy(*(by or [])).agg(
        F.count("v").alias("valid_lines"), (F.count(F.lit(1)) - F.count("v")).alias("invalid_lines"))


def read_landing(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def without_fields(v: Column, drop: tuple[str, ...]) -> Column:
    """JSON text of a VARIANT object without some of its top-level fields.  All
    other values keep their types, nested ones and nulls included."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*drop)))


def prepare_metadata(spark: SparkSession, path: str, out: str,
                     drop: tuple[str, ...] = tuple(vocab.METADATA_DROP)) -> DataFrame:
    """Rewrite metadata JSON lines without the bulky fields, gzip-compressed, in
    one pass.  Returns one row: products written and lines that are no object."""
    counted, seen = _counted(parsed_lines(spark.read.text(path)))
    clean = counted.where(F.col("v").isNotNull()).select(without_fields(F.col("v"), drop).alias("value"))
    clean.write.mode("overwrite").option("compression", "gzip").text(out)
    return spark.range(1).select(F.lit(seen.get["good"]).alias("products"),
                                 F.lit(seen.get["lines"] - seen.get["good"]).alias("errors"))


def json_fields(landing: DataFrame, names: list[str]) -> dict[str, Column]:
    """Top-level fields of ``v`` as text, whether it is VARIANT or JSON text."""
    if dict(landing.dtypes)["v"] == "variant":
        return {n: F.try_variant_get("v", f"$.{n}", "string") for n in names}
    return {n: F.get_json_object("v", f"$.{n}") for n in names}


def pack_json(df: DataFrame, columns: list[str], category: Column | str,
              loaded_at: Column | None = None) -> DataFrame:
    """Typed rows back to the landing shape."""
    cat = F.lit(category) if isinstance(category, str) else category
    at = loaded_at if loaded_at is not None else F.current_timestamp()
    return df.select(F.to_json(F.struct(*columns)).alias("v"), cat.alias("source_category"),
                     F.lit(None).cast("string").alias("source_file"),
                     at.cast("timestamp_ntz").alias("loaded_at"))


def count_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before and after row counts of a migration or a dedup, as one row."""
    return before.agg(F.count(F.lit(1)).alias("before_count")).crossJoin(
        after.agg(F.count(F.lit(1)).alias("after_count")))


def ingestion_health(landing: DataFrame) -> DataFrame:
    """Per category: rows, distinct products, users and files, load window."""
    f = json_fields(landing, ["asin", "user_id"])
    keyed = landing.select("source_category", "source_file", "loaded_at",
                           f["asin"].alias("asin"), f["user_id"].alias("user_id"))
    # several distinct counts in one scan: they are reduced per (category,
    # value) first, which also spreads a hot category
    return keyed.groupBy("source_category").agg(
        F.count(F.lit(1)).alias("total_rows"), F.countDistinct("asin").alias("unique_asins"),
        F.countDistinct("user_id").alias("unique_users"), F.min("loaded_at").alias("first_loaded"),
        F.max("loaded_at").alias("last_loaded"), F.countDistinct("source_file").alias("source_files"))


RAW_FIELDS = {
    "review_id": ["review_id"], "asin": ["asin"], "user_id": ["user_id"],
    "rating": ["rating"], "title": ["title"], "review_text": ["review_text", "text"],
    "verified_purchase": ["verified_purchase"], "helpful_vote": ["helpful_vote"],
    "review_ts": ["review_ts", "timestamp"], "text_len": ["text_len"],
}


def typed_reviews(landing: DataFrame) -> DataFrame:
    """Ten typed fields out of the JSON column; both key spellings are read and
    a value that does not cast becomes NULL."""
    keys = [k for names in RAW_FIELDS.values() for k in names]
    if dict(landing.dtypes)["v"] == "variant":
        j = F.struct(*[c.alias(k) for k, c in json_fields(landing, keys).items()])
    else:
        j = F.from_json("v", ", ".join(f"`{k}` string" for k in keys))
    parsed = landing.select("source_category", j.alias("j"))

    def field(name: str) -> Column:
        return F.coalesce(*[F.col("j").getField(k) for k in RAW_FIELDS[name]])

    body = field("review_text")
    return parsed.select(
        field("review_id").alias("review_id"), field("asin").alias("asin"),
        field("user_id").alias("user_id"),
        rules.lenient_int(field("rating")).try_cast("int").alias("rating"),
        field("title").alias("title"), body.alias("review_text"),
        field("verified_purchase").try_cast("boolean").alias("verified_purchase"),
        rules.lenient_int(field("helpful_vote")).alias("helpful_vote"),
        rules.event_time(field("review_ts")).alias("review_ts"),
        F.coalesce(rules.lenient_int(field("text_len")),
                   F.length(F.trim(body)).cast("bigint")).try_cast("int").alias("text_len"),
        "source_category")


def valid_reviews(reviews: DataFrame, max_year: int | None = None, min_chars: int = 20) -> DataFrame:
    """Reviews with a text, a rating and a time; ``max_year`` leaves out times that
    lie after it as mistyped."""
    ok = (F.col("review_text").isNotNull() & (F.length(F.trim("review_text")) >= min_chars)
          & F.col("rating").between(1, 5) & F.col("review_ts").isNotNull())
    return reviews.where(ok if max_year is None else ok & (F.year("review_ts") <= max_year))


def stage_reviews(landing: DataFrame, max_year: int | None = None) -> DataFrame:
    """Landing rows -> staged reviews: typed, filtered, cleaned, tiered."""
    r = valid_reviews(typed_reviews(landing), max_year)
    full = text.join_title(F.col("title"), F.col("review_text"), " ", always=True)
    return (r.withColumn("review_text_full", full)
            .withColumn("review_text_clean", text.clean_basic(F.col("review_text_full")))
            .withColumn("review_quality", rules.quality_tier(F.col("text_len"))))


def raw_keys(landing: DataFrame) -> DataFrame:
    f = json_fields(landing, ["review_id", "asin", "user_id", "rating", "timestamp", "review_ts"])
    return landing.select(
        f["review_id"].alias("review_id"), f["asin"].alias("asin"), f["user_id"].alias("user_id"),
        f["rating"].alias("rating_raw"), F.coalesce(f["timestamp"], f["review_ts"]).alias("timestamp_raw"))


def negative_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("rating") <= 2)


def latest_previews(reviews: DataFrame, body: str, n: int = 20, chars: int = 200) -> DataFrame:
    """The n most recent reviews with the head of their text."""
    return (reviews.withColumn("review_text_preview", text.preview(F.col(body), chars))
            .drop(body).orderBy(F.col("review_ts").desc_nulls_last(), "review_id").limit(n))
