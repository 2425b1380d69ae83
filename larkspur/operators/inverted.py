"""A stored full-text index: immutable segments of posting blocks, laid out by term.

A segment is one run of a run table (``sources.runs``) and holds, partitioned by kind
and by a bucket of a hash:

- ``postings``: blocks, one per term, slice and band.  A slice is about ``SLICE``
  documents by a hash of their keys; a band holds postings of like weight.  With each
  block go its largest term frequency and its least length per occurrence, which
  bound the score of every posting in it.
- ``keys``: the documents of the segment, by which a document is indexed only once.
- ``stats``: their number and words.

A search opens the buckets of its terms only.  It reads the figures of their blocks,
then the slices that could hold the best documents, whose scores give each query a
score that its k-th result must reach.  A block that cannot lift any document that
far, with all other terms at their best in its slice, is not read.  Results equal
those of a full scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash
from ..sources import runs
from . import search
from .dedup import keep_first, top_n

SLICE = 1024  # documents
BANDS = 4  # per unit of weight; a weight is below 2.2
PROBES = 4  # slices read to find the score to reach
BUCKETS = 64
TASK_WORDS = 1 << 21  # words of text whose postings a task lays out
PLACE = ["run", "slice", "band"]
SLACK = 2e-6  # parts of a score are rounded to millionths


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def impact(tf: Column, doc_len: Column, avg: Column | float) -> Column:
    """The part of a BM25 term score that depends on the document."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * doc_len / avg))


def most_impact(max_tf: Column, min_per_tf: Column, avg: Column | float) -> Column:
    """Bound of ``impact`` over postings, whatever the mean length has become: divided
    by tf, it falls with 1 / tf and with doc_len / tf only."""
    return (search.K1 + 1) / (1 + search.K1 * (1 - search.B) / max_tf + search.K1 * search.B * min_per_tf / avg)


def _blocks(postings: DataFrame, docs: int, words: int, slice_docs: int) -> DataFrame:
    """Blocks from (term, doc_id, tf, doc_len), dealt to tasks as they are to be
    stored.  A block holds a part of one slice, so none grows with the table, and a
    frequent term is spread over all slices.  Postings are shuffled once: a task gets
    parts of buckets, about ``TASK_WORDS`` words, and makes whole blocks of them."""
    weight = impact(F.col("tf"), F.col("doc_len"), max(1.0, words / docs))
    slices = F.pmod(F.xxhash64("doc_id"), F.lit(1 + docs // slice_docs))
    tasks = 1 + words // TASK_WORDS
    part = F.pmod(F.xxhash64("term", slices), F.lit(1 + 2 * tasks // BUCKETS)).cast("int")
    dealt = (postings.repartition(tasks, _bucket("term"), part)
             .select("*", _bucket("term").alias("bucket"), part.alias("part"), slices.alias("slice"),
                     F.floor(weight * BANDS).cast("int").alias("band")))
    return (dealt.groupBy("bucket", "part", "term", "slice", "band").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min(F.col("doc_len") / F.col("tf")).alias("min_per_tf"),
        F.collect_list(F.struct("doc_id", "tf", "doc_len")).alias("postings")).drop("part"))


def _write(blocks: DataFrame, keys: DataFrame, stats: DataFrame, index: str, whole: bool) -> None:
    keys = keys.select("doc_id", _bucket("doc_id").alias("bucket")).repartition("bucket")
    rows = (blocks.withColumn("kind", F.lit("postings"))
            .unionByName(keys.withColumn("kind", F.lit("keys")), allowMissingColumns=True)
            .unionByName(stats.select("docs", "words", F.lit(0).alias("bucket"), F.lit("stats").alias("kind")),
                         allowMissingColumns=True))
    laid = rows.sortWithinPartitions("kind", "bucket", "term", "slice")
    (runs.replace if whole else runs.append)(laid, index, ["kind", "bucket"])


def segment_rows(spark: SparkSession, index: str, kind: str) -> DataFrame | None:
    rows = runs.read(spark, index)
    return None if rows is None else rows.where(F.col("kind") == kind)


def unknown(docs: DataFrame, index: str, doc_id: str) -> DataFrame:
    """Documents the index does not hold; only the buckets of their keys are read."""
    known = segment_rows(docs.sparkSession, index, "keys")
    if known is None:
        return docs
    buckets = [r[0] for r in docs.select(_bucket(doc_id)).distinct().collect()]  # at most BUCKETS
    known = known.where(F.col("bucket").isin(buckets)).select(F.col("doc_id").alias(doc_id))
    return docs.join(known, doc_id, "left_anti")


def add(docs: DataFrame, index: str, doc_id: str, body: str, slice_docs: int = SLICE) -> None:
    """Indexes documents that are new, as one segment committed at once.  Of rows with
    one key the longest text counts (the first in text order on a tie)."""
    fresh = stash(unknown(docs.where(F.col(doc_id).isNotNull()).select(doc_id, body), index, doc_id), "fresh")
    if not fresh.groupBy(doc_id).count().where("count > 1").isEmpty():  # else no text is shuffled
        fresh = stash(keep_first(fresh, [doc_id], [F.length(body).desc_nulls_last(), F.col(body)]), "fresh")
    lengths = stash(search.doc_lengths(fresh, doc_id, body), "lengths")
    stats = search.corpus_stats(lengths).withColumn("words", F.coalesce("words", F.lit(0)).cast("long"))
    n, words = stats.first()
    if n == 0:
        return
    postings = search.build_postings(fresh, doc_id, body)
    _write(_blocks(postings, n, words, slice_docs), lengths, stats, index, False)


def compact(spark: SparkSession, index: str, slice_docs: int = SLICE) -> None:
    """All segments as one; the old ones stay readable until ``runs.sweep``."""
    rows = runs.read(spark, index)
    stats = stash(segment_rows(spark, index, "stats").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")), "stats")
    n, words = stats.first()
    postings = rows.where("kind = 'postings'").select("term", F.inline("postings"))
    _write(_blocks(postings, n, words, slice_docs), rows.where("kind = 'keys'").select("doc_id"), stats, index, True)


def _opened(spark: SparkSession, index: str, terms: DataFrame) -> DataFrame:
    """Posting blocks of the buckets the terms fall in, with the number of their run."""
    buckets = [r[0] for r in terms.select(_bucket("term")).distinct().collect()]  # at most BUCKETS
    rows = [spark.read.parquet(f"{index}/{name}").where((F.col("kind") == "postings") & F.col("bucket").isin(buckets))
            .withColumn("run", F.lit(i)) for i, name in enumerate(runs.folders(spark, index))]
    return reduce(DataFrame.unionByName, rows)


def candidate_blocks(spark: SparkSession, index: str, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of the query terms with bounds, those a search must read, their rows).
    ``terms`` is (query_id, term), stored."""
    docs, words = segment_rows(spark, index, "stats").agg(F.sum("docs"), F.sum("words")).first()
    avg = max(1.0, words / docs)
    opened = _opened(spark, index, terms)
    figures = stash(opened.select("term", *PLACE, "n", "max_tf", "min_per_tf")
                    .join(terms.select("term").distinct(), "term", "left_semi"), "block-figures")
    df = F.col("df")
    weight = figures.groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", F.ln(1 + (docs - df + 0.5) / (df + 0.5)).alias("idf"))
    bounds = stash(terms.join(weight, "term").join(figures, "term").withColumn(
        "bound", F.col("idf") * most_impact(F.col("max_tf"), F.col("min_per_tf"), avg) + SLACK)
        .withColumn("avg_len", F.lit(avg)), "bounds")
    # the most a document of a slice can reach, and what the other terms give of it
    best = bounds.groupBy("query_id", "run", "slice", "term").agg(F.max("bound").alias("best"))
    reach = best.groupBy("query_id", "run", "slice").agg(F.sum("best").alias("reach"))
    reach = stash(best.join(reach, ["query_id", "run", "slice"]), "reach")
    probed = top_n(reach.select("query_id", "run", "slice", "reach").distinct(), ["query_id"],
                   [F.col("reach").desc(), F.col("run"), F.col("slice")], PROBES)
    probes = bounds.join(probed, ["query_id", "run", "slice"], "left_semi")
    reached = top_n(_scores(opened, probes), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "rank")
    floor = reached.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    with_others = bounds.join(reach, ["query_id", "run", "slice", "term"]).join(floor, "query_id", "left")
    enough = F.col("bound") + F.col("reach") - F.col("best") >= F.col("floor") - SLACK
    needed = stash(with_others.where(F.coalesce(enough, F.lit(True))).select(*bounds.columns), "needed-blocks")
    return bounds, needed, opened


def _scores(opened: DataFrame, blocks: DataFrame) -> DataFrame:
    hits = opened.select("term", *PLACE, "postings").join(
        blocks.select("query_id", "term", *PLACE, "idf", "avg_len"), ["term", *PLACE])
    hits = hits.select("query_id", "idf", "avg_len", F.inline("postings"))
    part = F.col("idf") * impact(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    # whole millionths, so that the sum does not depend on task order
    return hits.groupBy("query_id", "doc_id").agg(
        (F.sum(F.round(part * 1000000).cast("bigint")) / 1000000.0).alias("score"))


def top_documents(spark: SparkSession, index: str, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents per query by BM25."""
    terms = stash(terms.select("query_id", "term").distinct(), "terms")
    _, needed, opened = candidate_blocks(spark, index, terms, k)
    return top_n(_scores(opened, needed), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "rank")
