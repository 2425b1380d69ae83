"""Homomorphic multiset fingerprints.

A text is the multiset of its paragraphs (non-empty lines).  Each paragraph is
hashed to a wide vector: 16 random lanes modulo 2^32 and 128 lanes modulo 2^16 that
count, with random signs, its pairs of neighbouring words.  A fingerprint is the sum of
the vectors, so it does not depend on the order of paragraphs, and a paragraph is
added or taken away by adding or subtracting its vector.  Unequal multisets have equal
sums in the first lanes only by an accident of two 64-bit hashes; the angle between the second lanes estimates how much
two texts share.

Defined results: null and empty texts and those of blank lines have the zero
vector; two zero vectors have likeness 1, a zero and another vector 0.  The next
document of rows with one doc_id goes by the order of a hash of their texts; null
doc_ids come last.  A table of one row has itself as next document.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SURE, WIDE = 16, 128
LINE = np.arange(256) != 10


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of the fingerprints of texts."""
    sure = np.zeros((len(texts), SURE), np.uint32)
    wide = np.zeros((len(texts), WIDE), np.uint16)
    data, limits = W.utf8(pa.array(texts, pa.large_string()))
    for a, b in W.pieces(limits):
        part, at = data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]
        start, end = W.runs(part, at, LINE)
        row = np.searchsorted(at, start, "right") - 1
        h = W.hashes(part, start, end)
        # half of the lanes from each of two hashes: 128 bits tell paragraphs apart
        both = np.repeat(np.stack([h, W.hashes(part, start, end, 1)], 1), SURE // 2, 1)
        lanes = W.mix(both + np.arange(SURE, dtype=W.U) * W.U(0x9E3779B97F4A7C15))
        for lane in range(SURE):  # exact: sums of 32-bit values in 64 bits, by halves
            low = (lanes[:, lane] & W.U(0xFFFFFFFF)).astype(np.float64)
            top, bottom = np.floor(low / 65536), low % 65536
            total = (np.bincount(row, top, b - a) % 65536) * 65536 + np.bincount(row, bottom, b - a)
            sure[a:b, lane] = (total % 2.0 ** 32).astype(np.uint32)
        word_start, word_end = W.runs(part, at, W.GRAPH)
        line = np.searchsorted(start, word_start, "right") - 1
        word = W.hashes(part, word_start, word_end)
        first, pair = W.grams(word, line, 2)
        alone = np.bincount(line, minlength=len(start))[line] == 1
        owner = np.concatenate([row[line[first]], row[line[alone]]])
        feature = np.concatenate([pair, W.mix(word[alone])])
        sign = np.where(feature >> W.U(63) == 1, 1.0, -1.0)
        cell = owner * WIDE + (feature & W.U(WIDE - 1)).astype(np.int64)
        counts = np.bincount(cell, sign, (b - a) * WIDE).astype(np.int64)
        wide[a:b] = (counts & 0xFFFF).astype(np.uint16).reshape(-1, WIDE)
    return sure, wide


def add(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """Fingerprint of the union of two multisets, or with -1 of their difference."""
    out = []
    for kind, at, to in (("<u4", 0, 4 * SURE), ("<u2", 4 * SURE, None)):
        x, y = np.frombuffer(a[at:to], kind), np.frombuffer(b[at:to], kind)
        out.append((x + y if sign > 0 else x - y).tobytes())
    return b"".join(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, row by row: cosine of the wide lanes."""
    x, y = a.view(np.int16).astype(float), b.view(np.int16).astype(float)
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    dot = (x * y).sum(1) / np.sqrt(np.maximum(nx * ny, 1e-9))
    return np.where((nx == 0) & (ny == 0), 1.0, np.clip(dot, 0.0, 1.0))


def as_text(sure, wide) -> list[str]:
    return [base64.b64encode(s.astype("<u4").tobytes() + w.astype("<u2").tobytes()).decode()
            for s, w in zip(sure, wide)]


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of (part, extra, doc_id, text) such that in each part, by extra and
    descending doc_id, every document is followed by its next one.  The first
    document of a part is repeated at the end of the one before."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    ids = docs.select(F.coalesce("doc_id", F.lit(low)).alias("i"))
    steps = [i / n for i in range(1, n)]
    found = ids.agg(F.max("i"), F.percentile_approx("i", steps, 10 * n) if steps else F.lit(None)).first()
    top = found[0] if found[0] is not None else low
    cuts = np.array(sorted(set(found[1] or []) - {top}), np.int64)

    def deal(batches):
        for b in batches:
            i = b.column(0).fill_null(low).to_numpy()
            part = len(cuts) - np.searchsorted(cuts, i, "left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.zeros(len(i), np.int32)), *b.columns], NAMES)
            again = np.flatnonzero(np.isin(i, cuts) | (i == top))
            before = np.where(i[again] == top, len(cuts), part[again] - 1)
            rows = b.take(pa.array(again))
            yield pa.RecordBatch.from_arrays(
                [pa.array(before), pa.array(np.ones(len(again), np.int32)), *rows.columns], NAMES)

    return (docs.mapInArrow(deal, "part long, extra int, doc_id long, text string")
            .withColumn("tie", F.xxhash64("text")).repartition(n, "part")
            .sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "tie")
            .select(*NAMES))


NAMES = ["part", "extra", "doc_id", "text"]


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprint of every row and of its edited text, and their likeness."""
    def emit(batches):
        kept = []
        for b in batches:
            at = 0
            while at < len(b):
                rows = list(zip(*(c.to_pylist() for c in b.slice(at, 500).columns)))
                at += 500
                rows = kept + rows
                kept = rows[-1:]
                texts = [r[3] or "" for r in rows]
                own = [i for i in range(len(rows) - 1)
                       if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
                if not own:
                    continue
                new = [edited(texts[i], texts[i + 1]) for i in own]
                sure, wide = vectors(texts)
                sure2, wide2 = vectors(new)
                here, there = np.array(own), np.array(own) + 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([rows[i][2] for i in own], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
                    "fingerprint": as_text(sure[here], wide[here]),
                    "edited_fingerprint": as_text(sure2, wide2),
                    "near_edited": likeness(wide[here], wide2),
                    "near_next": likeness(wide[here], wide[there])})

    return with_next(docs, partitions).mapInArrow(
        emit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
