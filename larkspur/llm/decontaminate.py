"""Benchmark decontamination by winnowing.

Texts are words of letters and digits.  A window is ``span`` consecutive words of
an item.  Of the hashes of all k-grams, the least of every ``span - k + 1``
consecutive ones is kept, so two texts that share a window always keep a common
k-gram inside it.  Fingerprints of documents meet those of the items in a join;
each hit carries the ``span - 1`` word hashes on either side, is extended both
ways and counts if at least ``span`` words agree.  An item shorter than ``span``
is one window of its own length and is looked up by its whole n-gram.

Defined results: null, empty and wordless texts have 0 words and no hits, and are
not contaminated.  Repeated items count once per item_id; an item without id marks
words but is not listed.  Repeated documents are reported row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bitmap, in_bitmap, stash

SPAN, K = 13, 7
SIDE = SPAN - 1
WIDTH = 2 * SIDE + K
BROADCAST_ROWS = 20_000  # of about 270 bytes


def _winnow(h, row):
    """Indices of the first words of the kept k-grams, and their hashes."""
    first, g = W.grams(h, row, K)
    w = SPAN - K + 1
    if len(g) < w:
        return first[:0], g[:0]
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    inside = row[first[:len(view)]] == row[first[w - 1:]]
    at = np.flatnonzero(inside)
    pick = np.unique(at + w - 1 - np.argmin(view[at][:, ::-1], axis=1))
    return first[pick], g[pick]


def _around(h, row, first, outside: int):
    """Hashes of the words from SIDE before to SIDE after a k-gram, by rows."""
    at = first[:, None] + np.arange(-SIDE, K + SIDE)
    clipped = np.clip(at, 0, max(0, len(h) - 1))
    good = (at >= 0) & (at < len(h)) & (row[clipped] == row[first][:, None])
    return np.where(good, h[clipped], W.U(outside))


def _pieces(column):
    data, limits = W.utf8(column)
    for a, b in W.pieces(limits):
        row, _, _, h = W.words(W.LOWER[data[limits[a]:limits[b]]], limits[a:b + 1] - limits[a],
                               W.ALNUM)
        yield a, b - a, row, h


def _found(h, row, lengths, count, whole: bool):
    """(first word, fingerprint, length) of winnowed k-grams and of short n-grams.
    whole: only n-grams that are all of their text, as items are."""
    first, g = _winnow(h, row)
    out = [(first, g, np.full(len(g), SPAN))]
    for n in lengths:
        first, g = W.grams(h, row, n)
        if whole:
            keep = count[row[first]] == n
            first, g = first[keep], g[keep]
        out.append((first, W.mix(g + W.U(n)), np.full(len(g), n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def item_prints(items: DataFrame) -> DataFrame:
    """Fingerprints of the items: item_id, fp, len, words around it."""
    def emit(batches):
        for batch in batches:
            for a, n, row, h in _pieces(batch.column(1)):
                count = np.bincount(row, minlength=n)
                first, g, size = _found(h, row, range(1, SPAN), count, True)
                ids = batch.column(0).slice(a, n).take(pa.array(row[first]))
                around = _around(h, row, first, 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(g.view(np.int64)), pa.array(size.astype(np.int32)),
                     W.binary_lists(around.ravel(), np.full(len(g), WIDTH))],
                    ["item_id", "fp", "len", "item_words"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        emit, "item_id string, fp long, len int, item_words binary").distinct()


def document_prints(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """A row per document (fp null) and a row per fingerprint that an item may have."""
    sc = docs.sparkSession.sparkContext
    bits = sc.broadcast(bitmap(prints, "fp"))
    lengths = [r[0] for r in prints.where(F.col("len") < SPAN).select("len").distinct().collect()]

    def emit(batches):
        task, seen = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for a, n, row, h in _pieces(batch.column(1)):
                uid = task + seen + np.arange(n)
                seen += n
                count = np.bincount(row, minlength=n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), batch.column(0).slice(a, n), pa.array(count), none,
                     none.cast(pa.int32()), none, pa.nulls(n, pa.binary())], NAMES)
                first, g, size = _found(h, row, lengths, count, False)
                keep = in_bitmap(bits.value, g)
                first, g, size = first[keep], g[keep], size[keep]
                begin = np.cumsum(count) - count
                none = pa.nulls(len(g), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[row[first]]), none, none, pa.array(g.view(np.int64)),
                     pa.array(size.astype(np.int32)), pa.array(first - begin[row[first]]),
                     W.binary_lists(_around(h, row, first, 0).ravel(), np.full(len(g), WIDTH))],
                    NAMES)

    return docs.select("doc_id", "text").mapInArrow(
        emit, "uid long, doc_id long, n_words long, fp long, len int, pos long, words binary")


NAMES = ["uid", "doc_id", "n_words", "fp", "len", "pos", "words"]


def _extend(batches):
    """Verified runs [first, last) of document words that agree with an item."""
    for b in batches:
        mine, theirs = (np.frombuffer(b"".join(x.as_py() for x in b.column(i)), W.U)
                        .reshape(-1, WIDTH) for i in (4, 5))
        same = mine == theirs
        pos, size = b.column(2).to_numpy(), b.column(3).to_numpy()
        left = np.cumprod(same[:, SIDE - 1::-1], 1).sum(1)
        right = np.cumprod(same[:, SIDE:], 1).sum(1)
        long = size == SPAN
        ok = np.where(long, (right >= K) & (left + right >= SPAN), right >= size)
        first, last = pos - np.where(long, left, 0), pos + np.where(long, right, size)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)),
             pa.array(first[ok]), pa.array(last[ok])], ["uid", "item_id", "a", "b"])


def contamination(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row;
    contaminated when ``n_hit > 0 and share * n_hit >= n_words``."""
    prints = stash(item_prints(items), "items")
    rows = stash(document_prints(docs, prints), "prints")
    small = prints.count() <= BROADCAST_ROWS
    hits = (rows.where("fp is not null").select("uid", "fp", "len", "pos", "words")
            .join(F.broadcast(prints) if small else prints, ["fp", "len"])
            .select("uid", "item_id", "pos", "len", "words", "item_words")
            .mapInArrow(_extend, "uid long, item_id string, a long, b long"))
    covered = F.aggregate(
        F.array_sort("parts"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.to))).alias("n"),
            F.greatest(s.to, x.b).alias("to")), lambda s: s.n)
    ids = F.collect_set("item_id")
    per = (hits.groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("parts"), ids.alias("ids"))
           .select("uid", covered.alias("hit"), "ids"))
    base = rows.where("fp is null").select("uid", "doc_id", "n_words").join(per, "uid", "left")
    n = F.coalesce("hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return base.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"),
        ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"))
