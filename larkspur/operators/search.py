"""Retrieval: exact vector top-k, keyword ranking over a postings table, fused
ranking, filters, evidence for many groups at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from ..session import stash
from .dedup import top_n

DIGITS = 6
QUERY_BYTES = 32 * 2**20  # query vectors held by one task in one pass
QUERY_CHUNK = 512  # queries multiplied with a batch at a time
WORDS = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75
RRF = 60


# ------------------------------------------------------------------- vectors

def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long float lists as a row-normalised matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k highest scores, the smaller id first on a tie."""
    if len(scores) > k:
        # everything at or above the k-th score stays in, so ties are kept whole
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= floor)
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _vector_pass(corpus: DataFrame, query_rows: list, k: int, cid: str, vector: str,
                 exclude_self: bool) -> DataFrame:
    qids = np.array([r[0] for r in query_rows], dtype=np.int64)
    q = np.array([r[1] for r in query_rows], dtype=np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = q / np.where(norm == 0, 1.0, norm)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # running k best (scores, ids) per query over the batches of this task
        best_s = [np.empty(0) for _ in qids]
        best_i = [np.empty(0, dtype=np.int64) for _ in qids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = _matrix(batch.column(1))
            for start in range(0, len(qids), QUERY_CHUNK):
                sims = np.round(m @ q[start:start + QUERY_CHUNK].T, DIGITS)
                if exclude_self:
                    sims[ids[:, None] == qids[None, start:start + QUERY_CHUNK]] = -np.inf
                top = sims.max(axis=0)
                for c in range(sims.shape[1]):
                    j = start + c
                    if len(best_s[j]) == k and top[c] < best_s[j][-1]:
                        continue
                    s, i = np.concatenate([best_s[j], sims[:, c]]), np.concatenate([best_i[j], ids])
                    rows = _best_rows(s, i, k)
                    rows = rows[s[rows] > -np.inf]
                    best_s[j], best_i[j] = s[rows], i[rows]
        for start in range(0, len(qids), QUERY_CHUNK):
            part = range(start, min(start + QUERY_CHUNK, len(qids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(best_s[j]), qids[j]) for j in part])),
                 pa.array(np.concatenate([best_i[j] for j in part])),
                 pa.array(np.concatenate([best_s[j] for j in part]))], names=["query_id", cid, "similarity"])

    slim = corpus.where(F.col(vector).isNotNull()).select(F.col(cid).cast("bigint"), vector)
    local = slim.mapInArrow(score, f"query_id bigint, {cid} bigint, similarity double")
    return top_n(local, ["query_id"], [F.col("similarity").desc(), F.col(cid)], k, "rank")


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, cid: str = "vec_id",
                qid: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """Exact k nearest corpus rows per query by cosine similarity.

    Each task multiplies its Arrow batches with the query matrix and hands on
    only its own k best rows per query, so the pairs are never written out.  Query sets
    beyond ``QUERY_BYTES`` go through in several passes over the corpus.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(qid).cast("bigint").alias("_q"), F.col(vector).alias("_v"))
    size = q.agg(F.sum(F.size("_v")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size * 8 // QUERY_BYTES))
    out = None
    for i in range(passes):
        part = q if passes == 1 else q.where(F.pmod(F.xxhash64("_q"), F.lit(passes)) == i)
        rows = part.collect()  # at most about QUERY_BYTES, checked above
        if not rows:
            continue
        found = _vector_pass(corpus, rows, k, cid, vector, exclude_self)
        if passes > 1:
            found = stash(found, "topk")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return corpus.sparkSession.createDataFrame(
            [], f"query_id bigint, {cid} bigint, similarity double, rank int")
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, as one expression (for a single
    literal query vector)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_to(corpus: DataFrame, query: list[float], k: int = 5, cid: str = "vec_id",
               vector: str = "embedding") -> DataFrame:
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = corpus.withColumn("similarity", F.round(cosine(F.col(vector), literal), DIGITS))
    return scored.orderBy(F.col("similarity").desc(), F.col(cid)).limit(k).select(cid, "similarity")


# ------------------------------------------------------------------ keyword

def words_of(docs: DataFrame, doc_id: str, body: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word.  The length is fixed ahead of the explode, so no row
    carries the word array along; the outer form keeps the optimizer from
    adding a filter that would split every text a second time."""
    split = docs.select(F.col(doc_id).alias("doc_id"), *keep, text.tokens(F.col(body), WORDS).alias("_w"))
    sized = split.withColumn("doc_len", F.size("_w"))
    return sized.select("doc_id", *keep, "doc_len", F.explode_outer("_w").alias("term")).where(
        F.col("term").isNotNull())


def build_postings(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    """One row per (term, row of ``docs``): term frequency and document length.  The
    terms of a row are counted inside it, from its sorted words, so nothing is
    shuffled: a term occurs as often as the first places of it and of the next lie apart."""
    def counted(words: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (
            F.get(words, i) != F.get(words, i - 1)))
        return text.let(firsts, lambda at: F.transform(at, lambda start, j: F.struct(
            F.get(words, start).alias("term"),
            (F.coalesce(F.get(at, j + 1), F.size(words)) - start).cast("long").alias("tf"))))

    words = F.sort_array(text.tokens(F.col(body), WORDS))
    found = text.let(words, lambda w: F.when(F.size(w) > 0, F.struct(F.size(w).alias("doc_len"), counted(w).alias("terms"))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("_found"))
    return rows.select("doc_id", F.col("_found.doc_len").alias("doc_len"), F.inline("_found.terms")).select(
        "term", "doc_id", "doc_len", "tf")


def doc_lengths(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(text.tokens(F.col(body), WORDS)).alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_len").alias("words"))


def query_terms(queries: DataFrame, qid: str, body: str) -> DataFrame:
    return queries.select(F.col(qid).alias("query_id"), F.explode(F.array_distinct(
        text.tokens(F.col(body), WORDS))).alias("term"))


def rank_hits(hits: DataFrame, stats: DataFrame, terms: DataFrame, k: int,
              on: tuple[str, ...] = ("term",), allowed: DataFrame | None = None,
              rank: str = "rank") -> DataFrame:
    """BM25 score and top k per query.  ``hits`` is read twice: pass a stored
    table.  ``allowed`` (query_id, doc_id) restricts a query to some documents."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avg, tf = F.col("docs"), F.col("words") / F.col("docs"), F.col("tf")
    # stored: with its true size known, the hits meet it by broadcast, unshuffled
    weighted = stash(terms.join(df, "term").crossJoin(F.broadcast(stats)).select(
        "query_id", *on, F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        avg.alias("avg_len")), "weights")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    # whole millionths, so that the sum does not depend on task order
    scored = hits.join(weighted, list(on)).groupBy("query_id", "doc_id").agg(
        (F.sum(F.round(part * 1000000).cast("bigint")) / 1000000.0).alias("score"))
    if allowed is not None:
        scored = scored.join(allowed, ["query_id", "doc_id"], "left_semi")
    return top_n(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, rank)


def bm25(postings: DataFrame, stats: DataFrame, terms: DataFrame, k: int,
         allowed: DataFrame | None = None) -> DataFrame:
    """Top-k documents per query from a stored postings table."""
    hits = stash(postings.join(terms.select("term"), "term", "left_semi"), "hits")
    return rank_hits(hits, stats, terms, k, allowed=allowed)


def keyword_search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "review_id",
                   body: str = "review_text", qid: str = "query_id", query: str = "query") -> DataFrame:
    """BM25 straight from documents, without a stored index: one scan splits every
    text once, counts documents and words on the way and keeps the query terms."""
    terms = stash(query_terms(queries, qid, query), "terms")
    hits, stats = scan_for(docs, terms, doc_id, body)
    return rank_hits(hits, stats, terms, k)


def scan_for(docs: DataFrame, terms: DataFrame, doc_id: str, body: str,
             keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Stored postings of the wanted terms and the corpus figures, from one scan."""
    seen = Observation(f"corpus-{uuid.uuid4().hex}")
    split = docs.select(F.col(doc_id).alias("doc_id"), *keep, text.tokens(F.col(body), WORDS).alias("_w"))
    sized = split.withColumn("doc_len", F.size("_w")).observe(
        seen, F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words"))
    words = sized.select("doc_id", *keep, "doc_len", F.explode_outer("_w").alias("term")).where(
        F.col("term").isNotNull())
    hits = stash(words.join(terms.select("term").distinct(), "term", "left_semi")
                 .groupBy("term", "doc_id", "doc_len", *keep).agg(F.count(F.lit(1)).alias("tf")), "hits")
    return hits, docs.sparkSession.range(1).select(F.lit(seen.get["docs"]).alias("docs"),
                                                   F.lit(seen.get["words"]).alias("words"))


def fuse(left: DataFrame, right: DataFrame, k: int, key: str = "doc_id", constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per query."""
    part = 1.0 / (F.col("rank") + constant)
    both = left.select("query_id", key, part.alias("_p")).unionByName(right.select("query_id", key, part.alias("_p")))
    total = both.groupBy("query_id", key).agg(F.round(F.sum("_p"), 8).alias("score"))
    return top_n(total, ["query_id"], [F.col("score").desc(), F.col(key)], k, "rank")


def prefilter(reviews: DataFrame, asin=None, category: str | None = None, theme: str | None = None,
              min_rating: int | None = None, max_rating: int | None = None, verified_only: bool = False,
              quality: str | None = None) -> DataFrame:
    """Every given condition must hold; any rating bound counts."""
    out = reviews
    for column, value in (("asin", asin), ("derived_category", category), ("review_theme", theme),
                          ("review_quality", quality)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if min_rating is not None:
        out = out.where(F.col("rating") >= min_rating)
    if max_rating is not None:
        out = out.where(F.col("rating") <= max_rating)
    if verified_only:
        out = out.where(F.col("verified_purchase"))
    return out


def shape_results(hits: DataFrame, docs: DataFrame, lookup: DataFrame, chars: int | None = None,
                  doc_id: str = "review_id", body: str = "review_text") -> DataFrame:
    """Ranked ids to readable rows: text (cut only on request), attributes, names."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), "asin", "rating", text.head(F.col(body), chars).alias("text"))
    names = lookup.select("asin", "product_name", "brand")
    return stash(hits, "results").join(rows, "doc_id").join(names, "asin", "left")


def top_mentions(hits: DataFrame, k: int = 5) -> DataFrame:
    return (hits.where(F.col("asin").isNotNull()).groupBy("asin")
            .agg(F.count(F.lit(1)).alias("mention_count"))
            .orderBy(F.col("mention_count").desc(), F.col("asin")).limit(k))


def flatten_results(rows: DataFrame, column: str = "results") -> DataFrame:
    """Search responses stored as JSON to one row per hit."""
    schema = ("struct<results: array<struct<review_id:string, asin:string, rating:int, review_text:string, "
              "scores:struct<cosine_similarity:double, reranker_score:double>>>>")
    hit = rows.select(F.inline(F.from_json(column, schema)["results"]))
    return hit.select("review_id", "asin", "rating", "review_text", F.col("scores.cosine_similarity"),
                      F.col("scores.reranker_score"))


#: words that go with a polarity in a report's search, and quotes wanted
EVIDENCE = {"negative": ("problems complaints disappointed", 4), "positive": ("great excellent love recommend best", 3)}


def report_queries(groups: DataFrame, group: str, topic: str | None = None,
                   wanted: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """The searches behind a report, one per group and polarity: (group, polarity,
    query, k).  The query is the group's name, for complaints its ``topic`` (by
    default quality issues), and the words of the polarity."""
    name = F.replace(F.col(group).cast("string"), F.lit("_"), F.lit(" "))
    about = F.lit("quality issues") if topic is None else F.coalesce(
        F.replace(F.col(topic), F.lit("_"), F.lit(" ")), F.lit("quality issues"))
    rows = [F.struct(F.lit(polarity).alias("polarity"), F.concat_ws(
        " ", name, about if polarity == "negative" else F.lit(None).cast("string"), F.lit(words)).alias("query"),
        F.lit(k).alias("k")) for polarity, (words, k) in (wanted or EVIDENCE).items()]
    return groups.select(group, F.inline(F.array(*rows)))


def evidence(docs: DataFrame, queries: DataFrame, group: str, k: int | None = None, chars: int | None = None,
             doc_id: str = "review_id", body: str = "review_text") -> DataFrame:
    """Quotes per (group, polarity) from documents of the same group.  ``queries``
    holds (group, polarity, query) and, unless ``k`` is the same for all, k."""
    if k is not None:
        queries = queries.withColumn("k", F.lit(k))
    named = queries.withColumn("query_id", F.concat_ws("|", group, "polarity"))
    keys = named.select("query_id", group, "polarity", "k")
    most = queries.agg(F.max("k")).first()[0] or 0
    terms = stash(query_terms(named, "query_id", "query").join(keys.select("query_id", group), "query_id"), "terms")
    hits, stats = scan_for(docs, terms, doc_id, body, keep=(group,))
    best = stash(rank_hits(hits, stats, terms, most, on=("term", group), rank="evidence_rank"), "evidence")
    quotes = docs.select(F.col(doc_id).alias("doc_id"), "rating", text.head(F.col(body), chars).alias("quote"))
    return (best.join(keys, "query_id").where(F.col("evidence_rank") <= F.col("k"))
            .join(quotes, "doc_id").drop("query_id", "k"))
