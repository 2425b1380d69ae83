"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe, collocations, context_tree, decontaminate, jaccard, merkle, multiset_hash, pii,
               quality, quotes, secret_scan, token_store, warc)
from .common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_quality_nbsvm")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op2_secret_scan")
def op2(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAPH = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
OP3_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, w, least(13, len(w)) AS n,
  unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM p),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM q),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ','
  ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_GRAPH} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
  WHEN len(w) >= 3 THEN [array_to_string(w[k:k + 2], ' ') FOR k IN range(1, len(w) - 1)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents
  UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id AND r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.low) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY ALL"""


@query("op3_winnowing", OP3_SQL)
def op3(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"),
                                       table(spark, folder, "benchmark"))


@query("op4_bpe_codec")
def op4(spark, folder):
    return bpe.digests(table(spark, folder, "documents"))


@query("op5_ngram_jaccard", OP5_SQL)
def op5(spark, folder):
    return jaccard.jaccard_components(table(spark, folder, "documents"), 3, 90)


@query("op6_warc_index")
def op6(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query("op7_token_files")
def op7(spark, folder):
    return token_store.round_trip(table(spark, folder, "documents"))


@query("op8_pii_bootstrap")
def op8(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@query("op9_quote_links")
def op9(spark, folder):
    return quotes.conversations(table(spark, folder, "conversations"))


@query("op10_multiset_hash")
def op10(spark, folder):
    return multiset_hash.fingerprints(table(spark, folder, "documents"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_RUN = "list_aggregate(l[3 * {0} + 1:3 * {0} + 3], 'string_agg', '')"
OP11_SQL = f"""WITH RECURSIVE x AS (SELECT doc_id, source, text,
  -- crc32, bit by bit: a byte goes in by xor, then eight shifts (-1)
  xor(4294967295, list_reduce([4294967295] || flatten([
    [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
      ELSE c >> 1 END)) % 2 = 0 AS even, lang, n_chars FROM documents),
f AS (SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf("text")} AS leaf,
  CASE WHEN even THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now FROM x),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
t AS (SELECT g, 0 AS depth, list(leaf ORDER BY i) AS l FROM d GROUP BY g
  UNION ALL SELECT g, depth + 1, [sha256({_RUN.format("k")}) FOR k IN range((len(l) + 2) // 3)]
  FROM t WHERE len(l) > 1),
s AS (SELECT g, l[1] AS sub, row_number() OVER (ORDER BY g) - 1 AS i FROM t WHERE len(l) = 1),
u AS (SELECT 0 AS depth, list(sub ORDER BY i) AS l FROM s
  UNION ALL SELECT depth + 1, [sha256({_RUN.format("k")}) FOR k IN range((len(l) + 2) // 3)]
  FROM u WHERE len(l) > 1),
p AS (SELECT d.g, d.doc_id, d.leaf, d.i AS start, d.i AS pos, 0 AS depth, now AS h, '' AS proof FROM d
  UNION ALL SELECT p.g, doc_id, leaf, start, pos // 3, p.depth + 1,
    sha256(array_to_string(list_concat(l[pos - pos % 3 + 1:pos], [h], l[pos + 2:pos - pos % 3 + 3]), '')),
    proof || array_to_string(list_concat(l[pos - pos % 3 + 1:pos], l[pos + 2:pos - pos % 3 + 3]), '')
  FROM p JOIN t ON p.g = t.g AND p.depth = t.depth AND len(l) > 1),
m AS (SELECT p.g, doc_id, leaf, start, sub, s.i AS pos, h, proof FROM p
  JOIN t ON p.g = t.g AND p.depth = t.depth AND len(l) = 1 JOIN s ON s.g = p.g),
q AS (SELECT *, 0 AS depth FROM m
  UNION ALL SELECT g, doc_id, leaf, start, sub, pos // 3,
    sha256(array_to_string(list_concat(l[pos - pos % 3 + 1:pos], [h], l[pos + 2:pos - pos % 3 + 3]), '')),
    proof || array_to_string(list_concat(l[pos - pos % 3 + 1:pos], l[pos + 2:pos - pos % 3 + 3]), ''),
    q.depth + 1 FROM q JOIN u ON q.depth = u.depth AND len(l) > 1)
SELECT doc_id, leaf, sub AS subroot, l[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root,
  h = l[1] AS verified FROM q JOIN u ON q.depth = u.depth AND len(l) = 1"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"), 3, merkle.without_newlines())


@query("op12_context_tree")
def op12(spark, folder):
    return context_tree.score(table(spark, folder, "documents"))


OP13_SQL = """WITH w AS (SELECT coalesce(lang, 'und') AS lang, [x FOR x IN
    regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(""" + _LOWER + """, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS f, any_value(w[p:p + k - 1]) AS v
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, range(1, 6) t(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
i AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS b ON b.lang = c.lang AND b.k > c.k AND b.f >= c.f
  AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ')),
s AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, l.k AS cut,
  CAST(1000 * CAST(c.f AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c ANTI JOIN i ON i.lang = c.lang AND i.phrase = c.phrase JOIN n ON n.lang = c.lang
  JOIN g l ON l.lang = c.lang AND l.k < c.k AND l.v = c.v[1:l.k]
  JOIN g r ON r.lang = c.lang AND r.k = c.k - l.k AND r.v = c.v[l.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, score FROM b QUALIFY rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
