"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import mean_of
from ..operators import inverted, marts, search, vector_index
from ..session import new_path, stash
from ..sources import fixtures as fx
from .registry import define, query, sql
from .text_queries import lit

# ------------------------------------------------------------------ vectors, R1

define("centroids", [], """SELECT label AS query_id, list(v ORDER BY pos) AS center FROM (SELECT label, pos, avg(v) AS v FROM (
  SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label""")
define("sims", ["centroids"], """SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 6) AS similarity,
  label = query_id AS same_label FROM embeddings, centroids""")


def _queries(spark, d):
    """One query vector per label: the mean of its vectors."""
    each = fx.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = each.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))),
                                                  lambda x: x["v"]).alias("embedding"))


@query("r1_cosine_topk", sql("""SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 5""", "sims"))
def _(spark, d):
    return search.cosine_topk(fx.table(spark, d, "embeddings"), _queries(spark, d), 5, qid="label")


@query("r1_clustered_topk", sql("""SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 5""", "sims"))
def _(spark, d):
    path = new_path(spark, "vectors")
    vector_index.build(fx.table(spark, d, "embeddings"), path)
    return vector_index.nearest(spark, path, _queries(spark, d), 5, qid="label")[0]


@query("r1_label_agreement", sql("""SELECT query_id, CAST(count(*) FILTER (WHERE same_label) AS BIGINT) AS agreeing FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 10 GROUP BY query_id""", "sims"))
def _(spark, d):
    e = fx.table(spark, d, "embeddings")
    top = search.cosine_topk(e, _queries(spark, d), 10, qid="label")
    return top.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id").agg(
        F.count_if(F.col("label") == F.col("query_id")).alias("agreeing"))


@query("r1_nearest_single", """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  CAST([((i * 7) % 11 - 5) / 10.0::DOUBLE FOR i IN range(64)] AS DOUBLE[])), 6) AS similarity FROM embeddings
  ORDER BY similarity DESC, vec_id LIMIT 5""")
def _(spark, d):
    vector = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]
    return search.nearest_to(fx.table(spark, d, "embeddings"), vector, 5)


# -------------------------------------------------------------- keyword, R2, R6

QUERIES = [("q1", "the threaning of that"), ("q2", "die und der schöne"), ("q3", "une elle des mention")]
define("qs", [], " UNION ALL ".join(f"SELECT {lit(i)} AS query_id, {lit(q)} AS query" for i, q in QUERIES))
define("qterms", ["qs"], """SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(string_split_regex(lower(query), '[^\\p{L}\\p{N}]+')) AS term
  FROM qs) WHERE term <> ''""")
define("words", ["docs"], """SELECT review_id AS doc_id, asin, len(w) AS doc_len, w FROM (SELECT review_id, asin,
  list_filter(string_split_regex(lower(review_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM docs)""")
define("stats", ["words"], "SELECT count(*) AS docs, sum(doc_len) AS words FROM words")
define("postings", ["words"], """SELECT term, doc_id, asin, doc_len, count(*) AS tf FROM (SELECT doc_id, asin, doc_len, unnest(w) AS term FROM words)
  GROUP BY term, doc_id, asin, doc_len""")
define("dfs", ["postings"], "SELECT term, count(*) AS df FROM postings GROUP BY term")
_BM25 = """CAST(sum(CAST(round(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
  / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / (CAST(words AS DOUBLE) / docs))) * 1000000) AS BIGINT)) AS DOUBLE) / 1000000"""
define("keyword", ["postings", "dfs", "stats", "qterms"], f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {_BM25} AS score
  FROM qterms JOIN postings USING (term) JOIN dfs USING (term), stats GROUP BY query_id, doc_id))""")


def _asked(spark):
    rows = [F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in QUERIES]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query("r2_keyword_search", sql("SELECT * FROM keyword WHERE rank <= 10", "keyword"))
def _(spark, d):
    return search.keyword_search(fx.documents(spark, d), _asked(spark), 10)


@query("r2_fused_search", sql("""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 8) AS score FROM (
   SELECT query_id, doc_id, rank FROM keyword WHERE rank <= 50
   UNION ALL SELECT query_id, doc_id, rank FROM (SELECT query_id, k.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
     FROM (SELECT 'q' || (query_id + 1) AS query_id, vec_id, vec_id AS doc_id, similarity FROM sims) k) WHERE rank <= 50)
  GROUP BY query_id, doc_id)) WHERE rank <= 10""", "keyword", "sims"))
def _(spark, d):
    words = search.keyword_search(fx.documents(spark, d), _asked(spark), 50)
    e = fx.table(spark, d, "embeddings")
    near = search.cosine_topk(e, _queries(spark, d), 50, qid="label").select(
        F.concat(F.lit("q"), (F.col("query_id") + 1).cast("string")).alias("query_id"),
        F.col("vec_id").alias("doc_id"), "rank")
    return search.fuse(words, near, 10)


@query("r6_index_search", sql("SELECT * FROM keyword WHERE rank <= 3", "keyword"))
def _(spark, d):
    index = new_path(spark, "index")
    inverted.add(fx.documents(spark, d), index, "review_id", "review_text")
    return inverted.top_documents(spark, index, search.query_terms(_asked(spark), "query_id", "query"), 3)


@query("r6_index_stats", sql("""SELECT (SELECT count(*) FROM postings) AS postings, (SELECT count(*) FROM dfs) AS terms,
  (SELECT max(df) FROM dfs) AS widest_term, CAST(words AS BIGINT) AS words FROM stats""", "postings", "dfs", "stats"))
def _(spark, d):
    index, docs = new_path(spark, "index"), fx.documents(spark, d)
    for part in (docs.where(F.col("lang") == "en"), docs):  # the second holds the first
        inverted.add(part, index, "review_id", "review_text")
    inverted.compact(spark, index)
    blocks = inverted.segment_rows(spark, index, "postings").withColumn(
        "_tf", F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, p: s + p["tf"]))
    per_term = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("_tf").alias("tf"))
    return per_term.agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("terms"),
                        F.max("df").alias("widest_term"), F.sum("tf").alias("words"))


# ------------------------------------------------------- filters and shape, R3-5

@query("r3_prefilter", sql("""SELECT review_id, asin, rating FROM reviews WHERE derived_category = 'PROMO' AND review_theme = 'comfort'
  AND rating >= 2 AND rating <= 4 AND verified_purchase AND review_quality = 'high'""", "reviews"))
def _(spark, d):
    return search.prefilter(fx.reviews(spark, d), category="PROMO", theme="comfort", min_rating=2, max_rating=4,
                            verified_only=True, quality="high").select("review_id", "asin", "rating")


@query("r4_shaped_results", sql("""SELECT k.query_id, k.rank, k.doc_id, k.score, d.asin, d.rating, d.review_text AS text, m.title AS product_name, m.brand
  FROM keyword k JOIN docs d ON k.doc_id = d.review_id LEFT JOIN metadata m ON d.asin = m.asin WHERE k.rank <= 5""", "keyword", "docs", "metadata"))
def _(spark, d):
    docs = fx.documents(spark, d)
    names = fx.metadata(spark, d).select("asin", F.col("title").alias("product_name"), "brand")
    return search.shape_results(search.keyword_search(docs, _asked(spark), 5), docs, names)


@query("r5_evidence", sql(f"""SELECT asin, polarity, score, evidence_rank, doc_id, d.rating, d.review_text AS quote FROM (
  SELECT *, row_number() OVER (PARTITION BY asin, polarity ORDER BY score DESC, doc_id) AS evidence_rank FROM (
  SELECT p.asin, q.polarity, p.doc_id, {_BM25} AS score FROM (SELECT 'negative' AS polarity, unnest(['the', 'of', 'die']) AS term
    UNION ALL SELECT 'positive', unnest(['une', 'with', 'from'])) q JOIN postings p ON q.term = p.term JOIN dfs ON dfs.term = p.term, stats
  GROUP BY p.asin, q.polarity, p.doc_id)) e JOIN docs d USING (asin) WHERE d.review_id = doc_id AND evidence_rank <= CASE WHEN polarity = 'x' THEN 0 ELSE 3 END""",
                         "postings", "dfs", "stats", "docs"))
def _(spark, d):
    docs = fx.documents(spark, d)
    asked = docs.select("asin").distinct().select("asin", F.explode(F.array(
        F.struct(F.lit("negative").alias("polarity"), F.lit("The of die").alias("query")),
        F.struct(F.lit("positive").alias("polarity"), F.lit("une with from").alias("query")))).alias("x")).select("asin", "x.*")
    return search.evidence(docs, stash(asked, "asked"), "asin", 3)


@query("j11_flatten_results", """SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS asin, CAST(1 + event_id % 5 AS INTEGER) AS rating,
  'text ' || event_id AS review_text, value AS cosine_similarity, CAST(NULL AS DOUBLE) AS reranker_score FROM events""")
def _(spark, d):
    e = fx.table(spark, d, "events")
    hit = F.struct(F.col("event_id").cast("string").alias("review_id"), F.col("event_type").alias("asin"),
                   (1 + F.col("event_id") % 5).alias("rating"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("review_text"),
                   F.struct(F.col("value").alias("cosine_similarity")).alias("scores"))
    return search.flatten_results(e.select(F.to_json(F.struct(F.array(hit).alias("results"))).alias("results")))


@query("j14_theme_join", sql("""SELECT p.asin, p.review_count, t.n FROM products p JOIN (SELECT asin, count(*) AS n FROM reviews
  WHERE review_theme = 'durability' GROUP BY asin) t ON p.asin = t.asin""", "products", "reviews"))
def _(spark, d):
    fact = stash(fx.reviews(spark, d), "fact")
    t = search.prefilter(fact, theme="durability").groupBy("asin").agg(F.count(F.lit(1)).alias("n"))
    return marts.product_summary(fact).select("asin", "review_count").join(t, "asin")


@query("j12_rollup_join", sql("""SELECT brand, count(DISTINCT l.asin) AS products, count(r.review_id) AS reviews FROM lookup l LEFT JOIN reviews r
  ON l.asin = r.asin GROUP BY brand""", "lookup", "reviews"))
def _(spark, d):
    fact = stash(fx.reviews(spark, d), "fact")
    per = fact.groupBy("asin").agg(F.count("review_id").alias("n"))
    return fx.lookup(spark, d, fact).join(per, "asin", "left").groupBy("brand").agg(
        F.count(F.lit(1)).alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"))


@query("j16_category_vs_mean", sql("""SELECT derived_category, avg_sentiment, round(avg_all + sign(avg_all) * 1e-9, 6) AS avg_all FROM summary,
  (SELECT avg(avg_sentiment) AS avg_all FROM summary) WHERE derived_category = 'SMALL'""", "summary"))
def _(spark, d):
    s = marts.category_summary(fx.reviews(spark, d)).select("derived_category", "avg_sentiment")
    s = stash(s, "summary")
    return s.where("derived_category = 'SMALL'").crossJoin(F.broadcast(s.agg(mean_of(F.col("avg_sentiment"), 6).alias("avg_all"))))
