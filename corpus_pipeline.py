"""Training-text pipeline over ``documents``: each stage works on what the one
before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, jaccard, quality, secret_scan
from larkspur.llm.common import stash, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, 0.8)
    and one of repeated rows.  Documents without doc_id or without words stay."""
    found = jaccard.jaccard_components(docs, k=5, threshold=80)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    return (docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = stash(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all documents stay."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text they decode to."""
    return bpe.encode(docs)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each),
          ("benchmark decontamination", without_benchmark), ("secret scans", without_secrets),
          ("BPE encoding and decoding", encoded)]

#: SQL has neither the classifier nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
