"""Quality classifier: linear hinge-loss model over n-gram indicators scaled by
naive Bayes log-count ratios (support vectors by dual coordinate descent).

Features are the distinct hashed n-grams of a text: single words and pairs of
lower-cased words, one to three word shapes (``Aa``, ``A!!``, ``a***``), and which
of four neighbouring words are equal.  Class counts run over all training rows;
the hinge-loss fit takes a documented sample of them (``fit_rows`` per class, by a
hash of doc_id, in expectation).  Every document is scored on its whole text.

Defined results: null and empty texts have no features and get the score of the
bias.  A training row needs a label and a doc_id; a doc_id with several labels
counts by their mean.  With labels of fewer than two classes every score is the
label's (0.5 without labels).  Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import stash

DIM = 18  # 2^18 hashed features
_shape = np.arange(256, dtype=np.uint8)
_shape[65:91], _shape[97:123], _shape[48:58], _shape[128:] = 65, 97, 48, 97


def _shapes(data, start, end):
    """Hash of each word's shape: letters as A or a, digits as 0, runs cut to two."""
    kind = _shape[data]
    one = np.concatenate([[0], kind[:-1]]) == kind
    keep = ~(one & np.concatenate([[False], one[:-1]]))
    fresh = start[:, None] + np.arange(2)
    keep[fresh[fresh < np.repeat(end[:, None], 2, 1)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return W.hashes(kind[keep], place[start], place[end])


def features(data, limits):
    """Distinct (row, feature) pairs of the rows of a batch, ordered."""
    start, end = W.runs(data, limits, W.GRAPH)
    row = np.searchsorted(limits, start, "right") - 1
    word, shape = W.hashes(W.LOWER[data], start, end), _shapes(data, start, end)
    found = [(row, word)]
    for h, k, salt in ((word, 2, 1), (shape, 1, 2), (shape, 2, 3), (shape, 3, 4)):
        first, g = W.grams(h, row, k)
        found.append((row[first], W.mix(g + W.U(salt))))
    if len(word) > 3:
        same = (word[1:] == word[:-1]).astype(np.uint64)
        code = same[:-2] * W.U(4) + same[1:-1] * W.U(2) + same[2:]
        inside = row[:-3] == row[3:]
        found.append((row[:-3][inside], W.mix(code[inside] + W.U(5 << 20))))
    rows = np.concatenate([r for r, _ in found]).astype(np.int64)
    cells = np.concatenate([h for _, h in found]) >> W.U(64 - DIM)
    both = np.unique((rows << DIM) | cells.astype(np.int64))
    return both >> DIM, both & ((1 << DIM) - 1)


def _chunks(column):
    data, limits = W.utf8(column)
    for a, b in W.pieces(limits):
        row, cell = features(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a])
        yield a, b - a, row, cell


def _training_rows(labelled: DataFrame, shares: dict[int, float]) -> DataFrame:
    """One pass: the sampled rows with their features, and per task the number of
    training rows with each feature by class."""
    def emit(batches):
        total, docs = np.zeros((2, 1 << DIM), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            draw = batch.column(2).to_numpy()
            taken = draw < np.where(label == 1, shares[1], shares[0])
            for a, n, row, cell in _chunks(batch.column(0)):
                for y in (0, 1):
                    total[y] += np.bincount(cell[label[a + row] == y], minlength=1 << DIM)
                    docs[y] += (label[a:a + n] == y).sum()
                size = np.bincount(row, minlength=n)
                keep = taken[a:a + n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[a:a + n][keep].astype(np.int32)),
                     W.long_lists(cell[keep[row]], size[keep]),
                     pa.array([None] * int(keep.sum()), pa.list_(pa.int64()))],
                    ["y", "cells", "counts"])
        for y in (0, 1):
            at = np.flatnonzero(total[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array([y], pa.int32()), W.long_lists(np.append(at, -1), [len(at) + 1]),
                 W.long_lists(np.append(total[y][at], docs[y]), [len(at) + 1])],
                ["y", "cells", "counts"])

    return labelled.select("text", "y", "draw").mapInArrow(
        emit, "y int, cells array<long>, counts array<long>")


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0,
            epochs: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; unit-length rows and a bias."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    value = [scale[i] / max(1e-9, np.sqrt((scale[i] ** 2).sum())) for i in rows]
    sign, draw = np.where(y == 1, 1.0, -1.0), np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            x, at = value[i], rows[i]
            gradient = sign[i] * (w[at] @ x + bias) - 1
            new = min(cost, max(0.0, alpha[i] - gradient / (2.0 if len(at) else 1.0)))
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin) by Newton steps on smoothed targets."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        m = np.array([[(h * margin ** 2).sum() + 1e-6, (h * margin).sum()],
                      [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 3000,
        label_rows: int = 10_000, alpha: float = 1.0, cost: float = 1.0) -> dict:
    """Model from the labelled rows that are not held out.  ``label_rows``: most rows of
    each class, in expectation, that the class counts are taken from, drawn by a hash of
    doc_id; ``fit_rows`` of them the hinge-loss fit sees.  As their number is bounded,
    their ids are broadcast and no text is shuffled."""
    train = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y")))
    size = {y: n for y, n in train.groupBy("y").count().collect()}
    if len(size) < 2:
        return {"constant": float(next(iter(size), 0.5))}
    shares = {y: fit_rows / max(1, n) for y, n in size.items()}
    drawn = {y: min(1.0, label_rows / max(1, n)) for y, n in size.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = train.withColumn("draw", draw).where(
        F.col("draw") < F.when(F.col("y") == 1, drawn[1]).otherwise(drawn[0]))
    # stored: the scan of all documents and the Python workers are stages of their own
    labelled = stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    rows = stash(_training_rows(labelled, shares), "nbsvm")
    sums = (rows.where("counts is not null")
            .select("y", F.explode(F.arrays_zip("cells", "counts")).alias("z"))
            .groupBy("y", F.col("z.cells").alias("cell")).agg(F.sum("z.counts").alias("n"))
            .toArrow())  # at most 2 * (2^18 + 1) rows
    y, cell, n = (sums[c].to_numpy() for c in ("y", "cell", "n"))
    count = np.full((2, 1 << DIM), alpha)
    for k in (0, 1):
        at = (y == k) & (cell >= 0)
        count[k][cell[at]] += n[at]
    prior = {k: float(n[(y == k) & (cell < 0)].sum()) / drawn[k] for k in (0, 1)}
    if not min(prior.values()):
        return {"constant": float(prior[1] > 0) if sum(prior.values()) else 0.5}
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def solve(batches):
        ys, xs = [], []
        for batch in batches:
            col = batch.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            ys.append(batch.column(0).to_numpy())
            xs += np.split(flat, np.cumsum(np.diff(col.offsets.to_numpy()))[:-1])
        y, r = np.concatenate(ys or [np.zeros(0)]), shared.value
        last = np.arange(len(y)) % 5 == 4
        w, bias = descend([x for x, t in zip(xs, last) if not t], y[~last], r, cost)
        margin = np.array([w[x] @ r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum())) + bias for x in xs])
        weight = np.where(y == 1, prior[1] / max(1, (y == 1).sum()),
                          prior[0] / max(1, (y == 0).sum()))
        slope, offset = _sigmoid_fit(margin[last], y[last], weight[last] / weight[last].sum()
                                     * last.sum()) if last.sum() > 20 else (4.0, 0.0)
        out = np.concatenate([(w * r).astype(np.float32), (r * r).astype(np.float32)])
        yield pa.RecordBatch.from_pydict({"w": [out.tobytes()], "m": [[bias, slope, offset]]})

    sample = rows.where("counts is null").select("y", "cells").repartition(1)
    w, m = sample.mapInArrow(solve, "w binary, m array<double>").first()
    w = np.frombuffer(w, np.float32)
    return {"weight": w[:1 << DIM], "square": w[1 << DIM:], "bias": m[0], "slope": m[1],
            "offset": m[2]}


def held_out(doc_id):
    """A fifth of the documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(column, model: dict) -> np.ndarray:
    out = np.full(len(column), model.get("constant", 0.5))
    if "constant" in model:
        return out
    for a, n, row, cell in _chunks(column):
        dot = np.bincount(row, model["weight"][cell], n)
        norm = np.sqrt(np.bincount(row, model["square"][cell], n))
        margin = dot / np.maximum(norm, 1e-9) + model["bias"]
        at = np.clip(model["slope"] * margin + model["offset"], -30, 30)
        out[a:a + n] = 1 / (1 + np.exp(-at))
    return out


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores(b.column(2), shared.value))],
                ["doc_id", "held_out", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        emit, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def emit(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), shared.value) >= least))

    return docs.mapInArrow(emit, docs.schema)
