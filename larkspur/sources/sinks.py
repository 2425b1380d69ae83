"""Writes: insert-only merge, upsert, materialisation, run summaries.

Nothing is updated in place.  The functions here say what a table holds after a
merge or an upsert; ``runs`` keeps tables on disk that grow by new rows only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import keep_first


def new_rows(source: DataFrame, target: DataFrame | None, key: str,
             order: list[Column]) -> DataFrame:
    """Source rows whose key the target lacks, one row per key."""
    fresh = source if target is None else source.join(
        target.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return keep_first(fresh, [key], order)


def merge_insert(source: DataFrame, target: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Target plus unmatched source rows (never updates)."""
    return target.unionByName(new_rows(source, target, key, order).select(*target.columns))


def incremental(source: DataFrame, target: DataFrame | None, key: str, transform,
                full_refresh: bool = False) -> DataFrame:
    """Run ``transform`` only on keys the target lacks, then add the result.
    ``full_refresh`` rebuilds everything."""
    if target is None or full_refresh:
        return transform(source)
    todo = source.join(target.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return target.unionByName(transform(todo).select(*target.columns))


def upsert(target: DataFrame, changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Changes win over the target; among changes the first by ``order`` wins."""
    latest = keep_first(changes, [key], order)
    return target.join(latest.select(key), key, "left_anti").unionByName(
        latest.select(*target.columns))


def _reads_from(df: DataFrame, path: str) -> bool:
    def bare(p: str) -> str:
        return re.sub(r"^[a-z0-9]+:/+", "/", p).rstrip("/")
    return any(bare(f).startswith(bare(path) + "/") for f in df.inputFiles())


def materialise(df: DataFrame, path: str | None = None, view: str | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
    """Layer policy: a view stays lazy, a table is written and read back.  A table
    that ``df`` itself reads cannot be overwritten in place: use ``runs.replace``."""
    if path is not None:
        if mode == "overwrite" and _reads_from(df, path):
            raise ValueError(f"{path} would be overwritten by rows read from it")
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        df = df.sparkSession.read.parquet(path)
    if view is not None:
        df.createOrReplaceTempView(view)
    return df


EVAL_TEXTS = ("question_text", "actual_intent", "judge_reasoning", "answer_preview", "match_detail")


def shape_eval_rows(rows: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Evaluation rows as stored: tools parsed to an array, missing texts empty,
    failed calls left out.  ``sizes`` cuts texts for a target with column sizes."""
    out = rows.where(F.col("api_error").isNull()) if "api_error" in rows.columns else rows
    if dict(out.dtypes).get("tools_used") == "string":
        out = out.withColumn("tools_used", F.from_json("tools_used", "array<string>"))
    for name in EVAL_TEXTS:
        if name in out.columns:
            out = out.withColumn(name, text.head(F.coalesce(F.col(name), F.lit("")), (sizes or {}).get(name)))
    return out.drop("api_error")


def append_eval_rows(rows: DataFrame, path: str) -> None:
    shape_eval_rows(rows).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sample_run(staged: DataFrame, transform, n: int = 100, key: str = "review_id") -> DataFrame:
    """The same transformation over the first n rows by key."""
    return transform(staged.orderBy(key).limit(n))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
