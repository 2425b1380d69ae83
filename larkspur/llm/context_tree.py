"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z in lower case and an end byte (0xFF, which UTF-8
never has).  Every byte is eight binary decisions.  A node is a context of 0 to
``depth`` preceding bytes (the end byte stands before the text) with the decisions
already made in the current byte; it holds how often 0 and 1 came next in the training
texts.  Krichevsky-Trofimov estimates of all depths are mixed with weights 1/2: with
Pe(s) the estimate of a node's own counts, Pw(s) = Pe(s) at full depth, else Pw(s) =
(Pe(s) + product of Pw over the contexts one byte longer) / 2.  A decision has the
probability w KT + (1 - w) times that of the longer context, w = Pe / (Pe + product);
a context never seen says 1/2.  The score of a text is the sum of log10 over its bytes
and the end, so ``-score / log10(2)`` is its code length in bits.

Spark counts, adds up and joins nodes as plain rows: one aggregation per depth going up,
one equijoin per depth going down, where a node has at most 256 children.  Texts are
dealt into lots by a hash of the row, and the distinct grams and words of a lot are
joined with the model, so a task holds one lot's share of it and never the whole.

The base score is an add-one unigram model over words with one end token per text.

Defined results: null and empty texts are just the end.  An empty table gives no rows;
without training rows every decision has 1/2 and every token count 0.  A null doc_id
trains.  Repeated rows are scored and counted one by one.  Very long texts are handled
whole, in pieces of about a megabyte for words and grams at a time.  Columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .words import LOWER, pieces, utf8

END = 0xFF
#: bytes of text in a lot
LOT_BYTES = 16 << 20
LOTS = "lot int, gram long, word binary, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out() -> Column:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return F.coalesce(rest == 2, F.lit(False))


def byte_grams(data: np.ndarray, limits: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``depth`` + 1 bytes ending at each byte and at the end of each text, and
    where the grams of each text begin."""
    length = np.diff(limits)
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    padded = np.full(begin[-1] + depth * len(length), END, np.uint8)
    shift = np.arange(len(length)) + depth * (np.arange(len(length)) + 1)
    padded[np.arange(len(data)) + np.repeat(shift, length)] = LOWER[data]
    every = np.zeros(max(len(padded) - depth, 0), np.int64)  # at each place, across texts too
    for i in range(depth + 1):
        every = (every << 8) | padded[i:i + len(every)]
    gram = every[np.arange(begin[-1]) + depth * np.repeat(np.arange(len(length)), length + 1)]
    return gram, begin


def lower_texts(data: np.ndarray, limits: np.ndarray) -> list[bytes]:
    """Texts between the limits, in lower case."""
    low, at = LOWER[data[limits[0]:limits[-1]]].tobytes(), (limits - limits[0]).tolist()
    return [low[a:b] for a, b in zip(at, at[1:])]


def _lot_rows(depth):
    def run(batches):
        lot, grams, held, seen = None, [], 0, Counter()

        def merged():
            g = np.concatenate([a for a, _ in grams]) if grams else np.zeros(0, np.int64)
            n = np.concatenate([b for _, b in grams]) if grams else np.zeros(0, np.int64)
            key, place = np.unique(g, return_inverse=True)
            return key, np.bincount(place, n, len(key)).astype(np.int64)

        def rows():
            key, n = merged()
            for i in range(0, len(key), 50_000):
                part = key[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), lot, np.int32)), pa.array(part),
                     pa.nulls(len(part), pa.binary()), pa.array(n[i:i + 50_000])],
                    ["lot", "gram", "word", "n"])
            words = list(seen.items())
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), lot, np.int32)), pa.nulls(len(part), pa.int64()),
                     pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part])],
                    ["lot", "gram", "word", "n"])

        for batch in batches:
            lots = batch.column("lot").to_numpy()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            data, limits = utf8(batch.column("text"))
            cuts = np.flatnonzero(np.diff(lots)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(lots)]):
                if a == b:
                    continue
                if lots[a] != lot:
                    if lot is not None:
                        yield from rows()
                    lot, grams, held, seen = int(lots[a]), [], 0, Counter()
                for s, e in pieces(limits[a:b + 1], 1 << 20):
                    s, e = s + a, e + a
                    part = data[limits[s]:limits[e]]
                    gram, begin = byte_grams(part, limits[s:e + 1] - limits[s], depth)
                    learns = np.repeat(train[s:e], np.diff(begin))
                    for some, weight in ((gram[learns], 1), (gram[~learns], 0)):
                        key, n = np.unique(some, return_counts=True)
                        grams.append((key, n * weight))
                        held += len(key)
                    if held > 4_000_000:
                        grams, held = [merged()], 0
                    # words of a text and its end, which is the empty word
                    texts = lower_texts(data, limits[s:e + 1])
                    seen.update(b" ".join([t for t, learn in zip(texts, train[s:e]) if learn]).split())
                    seen[b""] += int(train[s:e].sum())
                    for w in set(b" ".join([t for t, learn in zip(texts, train[s:e]) if not learn]).split()):
                        if w not in seen:
                            seen[w] = 0
        if lot is not None:
            yield from rows()
    return run


def _decisions(grams: DataFrame) -> DataFrame:
    """The eight (node, bit) of every gram."""
    wide = grams.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return (wide.withColumn("node", F.expr(
                "((gram >> 8) << 8) | cast(1 << i as bigint) | ((gram & 255) >> (8 - i))"))
            .withColumn("bit", F.expr("(gram >> (7 - i)) & 1")).drop("i"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5: Stirling's series seven steps further up."""
    steps = F.lit(0.0)
    for i in range(7):
        steps = steps + F.log(x + i)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def _weighted(nodes: DataFrame, deepest: bool) -> DataFrame:
    """Adds the node's own weight w, KT probability of 1 and ln Pw (l) to counts n0, n1
    and the sum ``kids`` of ln Pw over its longer contexts."""
    own = (log_gamma(F.col("n0") + 0.5) + log_gamma(F.col("n1") + 0.5)
           - log_gamma(F.col("n0") + F.col("n1") + 1.0) - float(np.log(np.pi)))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    out = nodes.withColumn("own", own).withColumn("one", one)
    if deepest:
        return out.withColumn("w", F.lit(1.0)).withColumn("l", F.col("own"))
    gap = F.col("kids") - F.col("own")
    low = F.greatest("own", "kids") + F.log1p(F.exp(-F.abs(gap))) - float(np.log(2))
    return (out.withColumn("w", 1 / (1 + F.exp(F.least(gap, F.lit(700.0))))).withColumn("l", low))


def fit(grams: DataFrame, depth: int) -> DataFrame:
    """(node, p1): probability of a 1 at every full-depth node, from (gram, n); grams
    seen only in texts to score come with n = 0."""
    nodes = _decisions(grams).groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = [stash(_weighted(nodes, True), "contexts")]
    for d in range(depth - 1, -1, -1):
        shorter = F.expr(f"node & {(1 << (8 * (d + 1))) - 1}")
        nodes = levels[-1].groupBy(shorter.alias("node")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("l").alias("kids"))
        levels.append(stash(_weighted(nodes, False), "contexts"))
    mixed = levels[-1].select("node", (F.col("w") * F.col("one")).alias("p1"),
                              (1 - F.col("w")).alias("rest"))
    for d in range(1, depth + 1):
        level = levels[depth - d]
        up = mixed.select(F.col("node").alias("_up"), F.col("p1").alias("_p1"), F.col("rest").alias("_rest"))
        mixed = stash(
            level.withColumn("_up", F.expr(f"node & {(1 << (8 * d)) - 1}")).join(up, "_up")
            .select("node", (F.col("_p1") + F.col("_rest") * F.col("w") * F.col("one")).alias("p1"),
                    (F.col("_rest") * (1 - F.col("w"))).alias("rest")), "mixed")
    return mixed.select("node", "p1")


def gram_scores(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, lp): log10 probability of the last byte of a gram after the others."""
    p = F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    return (_decisions(grams.select("gram")).join(model, "node")
            .groupBy("gram").agg(F.sum(F.log10(p)).alias("lp")))


def _score_lots(depth, total, kinds):
    names = [c.split()[0] for c in SCORES.split(", ")]

    def run(batches):
        lot, keys, lps, index, counts = None, [], [], None, {}
        for batch in batches:
            lots = batch.column("lot").to_numpy()
            cuts = np.flatnonzero(np.diff(lots)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(lots)]):
                if a == b:
                    continue
                if lots[a] != lot:
                    lot, keys, lps, index, counts = lots[a], [], [], None, {}
                part = batch.slice(a, b - a)
                kind = part.column("kind").to_numpy()
                of_gram = part.filter(pa.array(kind == 0))
                if len(of_gram):
                    keys.append(of_gram.column("gram").to_numpy())
                    lps.append(of_gram.column("lp").to_numpy())
                of_word = part.filter(pa.array(kind == 1))
                if len(of_word):
                    counts.update(zip(of_word.column("word").to_pylist(), of_word.column("n").to_pylist()))
                docs = part.filter(pa.array(kind == 2))
                if not len(docs):
                    continue
                if index is None:
                    index, lp = pd.Index(np.concatenate(keys)), np.concatenate(lps)
                data, limits = utf8(docs.column("text"))
                score, base = np.zeros(len(docs)), np.zeros(len(docs))
                n, known = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                for s, e in pieces(limits, 1 << 20):
                    gram, begin = byte_grams(data[limits[s]:limits[e]], limits[s:e + 1] - limits[s], depth)
                    score[s:e] = np.add.reduceat(lp[index.get_indexer(gram)], begin[:-1])
                    for r, t in enumerate(lower_texts(data, limits[s:e + 1]), s):
                        words = [*t.split(), b""]
                        c = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
                        n[r], known[r] = len(c), np.count_nonzero(c)
                        base[r] = np.log10((c + 1) / (total + kinds + 1)).sum()
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), docs.column("held_out"), pa.array(n), pa.array(known),
                     pa.array(base), pa.array(score)], names)
    return run


def score(docs: DataFrame, depth: int = 4, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Scores of every text under the model of the texts that are not held out.
    ``depth`` may be 0 to 6."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_lots = 1 + size // lot_bytes
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"),
                       F.expr(f"cast(pmod(xxhash64(doc_id, text), {n_lots}) as int)").alias("lot"))
    lots = stash(rows.repartition(int(n_lots), "lot").sortWithinPartitions("lot")
                 .mapInArrow(_lot_rows(depth), LOTS), "lots")
    grams = stash(lots.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = stash(lots.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    lps = stash(gram_scores(grams, fit(grams, depth)), "gram-scores")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (
        ("doc_id", "long"), ("held_out", "boolean"), ("text", "string"), ("gram", "long"),
        ("lp", "double"), ("word", "binary"), ("n", "long"))}

    def shaped(df, kind):
        return df.select("lot", F.lit(kind).alias("kind"),
                         *[F.col(c) if c in df.columns else none[c] for c in none])

    both = (shaped(lots.where("gram is not null").select("lot", "gram").join(lps, "gram"), 0)
            .unionByName(shaped(lots.where("word is not null").select("lot", "word").join(words, "word"), 1))
            .unionByName(shaped(rows, 2)))
    out = (both.repartition(int(n_lots), "lot").sortWithinPartitions("lot", "kind")
           .mapInArrow(_score_lots(depth, total, kinds), SCORES))
    return out.select("doc_id", "held_out", "n_tokens", "n_known",
                      F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
