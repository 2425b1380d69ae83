"""Helpers that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import new_path, stash  # noqa: F401
from . import words as W

#: size of the bit maps that stand for a set of 64-bit values: 2^23 bits, 1 MB
BITS = 23
#: about how many values a task of ``deal`` gathers before it sends them on, and receives
MEET = 1 << 20


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remove(spark, path: str) -> None:
    """Deletes a folder that a query stored and has no more use for."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bit map of a set of longs of any size.  It is always 1 MB: at most 2^17
    aggregated words of 64 bits reach the driver.  A value outside the set may
    share a bit with one inside, never the other way round."""
    bit = F.expr(f"`{column}` & {(1 << BITS) - 1}")
    rows = (values.select(bit.alias("b"))
            .groupBy(F.expr("b div 64").cast("int").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).collect())
    out = np.zeros(1 << (BITS - 6), np.int64)
    for w, v in rows:
        out[w] = v
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    b = values.view(np.uint64) & np.uint64((1 << BITS) - 1)
    word = bits.view(np.uint64)[(b >> np.uint64(6)).astype(np.int64)]
    return (word >> (b & np.uint64(63))) & np.uint64(1) == 1


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], count: str,
                share: float = 0.005) -> DataFrame:
    """Left join of many rows to one row per key.  ``right`` has in ``count`` how
    many left rows each key has.  Keys of at least ``share`` of the rows, so at
    most 1/share of them, are broadcast; the others join by a shuffle in which
    no key can be large.  ``count`` is dropped.  Both sides should be stored."""
    total = right.agg(F.sum(count)).first()[0] or 0
    most = max(2.0, total * share)
    cols = [c for c in right.columns if c not in (*keys, count)]
    hot = right.where(F.col(count) >= most).drop(count)
    cold = right.where(F.col(count) < most).drop(count)
    hot = hot.select(*keys, F.struct(*cols).alias("_hot"))
    cold = cold.select(*keys, F.struct(*cols).alias("_cold"))
    first = left.join(F.broadcast(hot), keys, "left")
    large, rest = first.where("_hot is not null"), first.where("_hot is null")
    names = [c for c in left.columns if c not in keys]
    a = large.select(*keys, *names, *[F.col(f"_hot.{c}") for c in cols])
    b = rest.drop("_hot").join(cold, keys, "left").select(
        *keys, *names, *[F.col(f"_cold.{c}") for c in cols])
    return a.unionByName(b)


def stash_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``stash``, and aggregates over the rows written, without a second job."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    out = stash(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), label)
    return out, seen.get


def _forest(batches):
    """The edges of one task as stars: every node but the smallest of a component
    with that smallest node."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent) if root(x) != x]
    for i in range(0, len(rows), 10_000):
        u, v = zip(*rows[i:i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given by edges (a, b) of longs:
    the smallest node each node can reach.  Tasks first reduce their own edges to
    stars.  Then two steps alternate until nothing changes: every node hangs its
    larger neighbours on its smallest one, then all smaller neighbours too.  Each
    round is stored; a task holds its share of the edges, never all of them."""
    mark = {"rows": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, before = stash_with(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .mapInArrow(_forest, "u long, v long").distinct(), "edges", **mark)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        now, after = stash_with(small, "edges", **mark)
        if after == before:
            roots = now.select(F.col("v").alias("u"), "v").distinct()
            return now.union(roots).toDF("node", "component")
        before = after


def _dealt(runs, types: list, lots: int):
    """Rows (lot, one binary per column) of runs of equally long arrays.  The first
    column is the key: equal keys go to one lot."""
    held, n = [], 0

    def send():
        columns = [np.concatenate(c) for c in zip(*held)]
        lot = (W.mix(columns[0].view(W.U)) >> W.U(20)) % W.U(lots)
        order = np.argsort(lot, kind="stable")
        which, count = np.unique(lot, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), *[W.binary_lists(c[order], count) for c in columns]],
            ["lot", *[f"c{i}" for i in range(len(types))]])

    for run in runs:
        held.append([np.ascontiguousarray(c, t) for c, t in zip(run, types)])
        n += len(run[0])
        if n >= MEET:
            yield send()
            held, n = [], 0
    if n:
        yield send()


def _received(batches, types: list) -> list[np.ndarray]:
    """All values of a task, column by column."""
    parts = [[np.frombuffer(v.as_buffer(), t) for v in batch.column(i + 1)]
             for batch in batches for i, t in enumerate(types)]
    return [np.concatenate([np.zeros(0, t), *[v for p in parts[i::len(types)] for v in p]])
            for i, t in enumerate(types)]


def deal(df: DataFrame, runs, types: list, total: int) -> DataFrame:
    """Shuffles ``total`` tuples by their first value, a 64-bit hash.  ``runs`` makes
    tuples from the Arrow batches of ``df``, as arrays of the numpy ``types``.  The
    values travel in blocks; ``receive`` takes them out.  The number of tasks grows
    with ``total``, so that each receives about ``MEET`` tuples."""
    tasks = max(1, -(-total // MEET))
    schema = ", ".join(["lot int", *[f"c{i} binary" for i in range(len(types))]])
    return (df.mapInArrow(lambda batches: _dealt(runs(batches), types, 8 * tasks), schema)
            .repartition(tasks, "lot"))


def receive(types: list, work):
    """Function for ``mapInArrow``, or ``runs`` of a further ``deal``, over what
    ``deal`` sent: ``work`` gets all columns of a task at once."""
    return lambda batches: work(*_received(batches, types))


def null_safe(name: str, kind: str = "string", empty: str = "") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast(kind), F.lit(empty))
