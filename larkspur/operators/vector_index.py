"""A clustered vector table and exact top-k search in it.

Vectors are filed under the nearest of a bounded number of centres, in bands by their
angle to it; large bands are cut into slots by a hash.  Angles obey the triangle
inequality, so a query at angle t to a centre is at least ``max(low - t, t - high)``
from every vector of the band ``low`` to ``high``.  A search scores the nearest bands
first; the k-th best similarity found there tells which other bands can still matter,
and only those are read.  Results equal a scan of all vectors.

Null vectors are left out.  Vectors of length zero have similarity 0 to everything and
form a band of their own that every search reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash
from . import search
from .dedup import top_n

MOST_CENTRES, SAMPLE = 1024, 20_000  # bounds of what is fitted on the driver
BANDS = 16  # per radian
SLOT = 4096  # vectors
PROBED = 4  # times k vectors that the first bands should hold
NARROW = 1e-9  # angles are compared with this slack
MEMBERS = "id long, vector array<double>, cluster int, band int, angle double"
PLACE = ["cluster", "band", "slot"]


def _centres(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit centres from a bounded sample by a hash of the id, after a few rounds of
    spherical k-means.  Any centres give exact results."""
    share = min(1.0, SAMPLE / max(1, count))
    rows = (vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
            .orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow())
    if not len(rows):
        return np.zeros((0, 1))
    x = search._matrix(rows.column("vector").combine_chunks())
    x = x[(x != 0).any(1)]
    c = x[:max(1, min(MOST_CENTRES, int(np.sqrt(count))))]
    for _ in range(4):
        owner = (x @ c.T).argmax(1)
        c = np.stack([x[owner == i].sum(0) if (owner == i).any() else c[i] for i in range(len(c))])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norm == 0, 1, norm)
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1, 1))


def build(vectors: DataFrame, path: str, vid: str = "vec_id", vector: str = "embedding") -> None:
    """Writes the table: ``centres``, ``bands`` with their figures, and ``members``."""
    spark = vectors.sparkSession
    slim = vectors.where(F.col(vector).isNotNull()).select(
        F.col(vid).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    centres = _centres(slim, slim.count())
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = search._matrix(batch.column(1))
            cluster, angle = np.full(len(x), -1), np.zeros(len(x))
            real = (x != 0).any(1)
            if real.any():
                a = _angles(x[real], shared.value)
                cluster[real], angle[real] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)),
                 pa.array((angle * BANDS).astype(np.int32)), pa.array(angle)],
                ["id", "vector", "cluster", "band", "angle"])

    members = stash(slim.mapInArrow(assign, MEMBERS), "members")
    # at most MOST_CENTRES * 4 * BANDS rows
    bands = stash(members.groupBy("cluster", "band").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        .withColumn("slots", F.expr(f"cast(1 + n div {SLOT} as int)")), "bands")
    bands.coalesce(1).write.parquet(f"{path}/bands")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>"
                          ).coalesce(1).write.parquet(f"{path}/centres")
    (members.join(F.broadcast(bands.select("cluster", "band", "slots")), ["cluster", "band"])
     .withColumn("slot", F.expr("cast(pmod(xxhash64(id), slots) as int)"))
     .repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
     .select("id", "vector", *PLACE).write.parquet(f"{path}/members"))


def _figures(centres: pa.Table, bands: pa.Table):
    """Bands as arrays, and a function from unit queries to the least angle at which each
    band can lie."""
    c = search._matrix(centres.column("centre").combine_chunks()) if len(centres) else np.zeros((0, 1))
    cluster, band, n, low, high = (bands[x].to_numpy() for x in ("cluster", "band", "n", "low", "high"))
    real = np.flatnonzero(cluster >= 0)

    def least(q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(cluster)))
        if len(real):
            t = _angles(q, c)[:, cluster[real]]
            out[:, real] = np.maximum(np.maximum(low[real] - t, t - high[real]), 0)
        return out
    return cluster, band, n, least


def _asked(queries: DataFrame, path: str, k: int, floor: DataFrame | None) -> DataFrame:
    """(query_id, vector, cluster, band) to read: without ``floor`` the nearest bands
    that hold enough vectors, with it all others that can hold a similarity that high."""
    spark = queries.sparkSession
    centres = spark.read.parquet(f"{path}/centres").orderBy("cluster").toArrow()
    bands = spark.read.parquet(f"{path}/bands").orderBy("cluster", "band").toArrow()
    held = spark.sparkContext.broadcast((centres, bands))  # bounded by MOST_CENTRES and BANDS

    def emit(batches):
        cluster, band, n, least = _figures(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = search._matrix(batch.column(1))
            away = least(q)
            # the nearest bands first, until they hold enough vectors; zero vectors always
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            near = np.zeros(away.shape, bool)
            np.put_along_axis(near, order, before < PROBED * k, axis=1)
            near |= (cluster < 0)[None, :] | ~(q != 0).any(1)[:, None]
            if batch.num_columns == 3:
                reach = batch.column(2).fill_null(-2.0).to_numpy()
                # similarities are rounded, so a band may be half a unit better than it looks
                can = np.cos(np.maximum(away - NARROW, 0)) + 10.0 ** -search.DIGITS >= reach[:, None]
                near = can & ~near
            row, at = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array(cluster[at].astype(np.int32)), pa.array(band[at].astype(np.int32))],
                ["query_id", "vector", "cluster", "band"])

    rows = queries if floor is None else queries.join(floor, "query_id", "left").select("query_id", "vector", "floor")
    return rows.mapInArrow(emit, "query_id long, vector array<double>, cluster int, band int")


def _scored(asked: DataFrame, path: str, k: int) -> DataFrame:
    """The k best members per query and slot.  A slot's members, of bounded number, come
    first, then the queries that ask for it, batch by batch."""
    spark = asked.sparkSession
    wanted = stash(asked, "asked")
    slots = spark.read.parquet(f"{path}/bands").select("cluster", "band", "slots")
    asks = (wanted.join(F.broadcast(slots), ["cluster", "band"])
            .withColumn("slot", F.explode(F.expr("sequence(0, slots - 1)")))
            .select(F.col("query_id").alias("id"), "vector", *PLACE, F.lit(1).alias("kind")))
    touched = wanted.select("cluster", "band").distinct()
    # as many as there are bands at most
    clusters = [r[0] for r in touched.select("cluster").distinct().collect()]
    members = (spark.read.parquet(f"{path}/members").where(F.col("cluster").isin(clusters))
               .join(F.broadcast(touched), ["cluster", "band"], "left_semi")
               .select("id", "vector", *PLACE, F.lit(0).alias("kind")))
    both = members.unionByName(asks).repartition(*PLACE).sortWithinPartitions(*PLACE, "kind")

    def score(batches):
        here, ids, x = None, [], []
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in PLACE], 1)
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(kind)]):
                if a == b:
                    continue
                if here != tuple(place[a]):
                    here, ids, x = tuple(place[a]), [], []
                part = batch.slice(a, b - a)
                m, i = search._matrix(part.column("vector")), part.column("id").to_numpy()
                if kind[a] == 0:
                    ids.append(i)
                    x.append(m)
                    continue
                if not ids:
                    continue
                ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                sims = np.round(m @ x[0].T, search.DIGITS)
                best = [search._best_rows(s, ids[0], k) for s in sims]
                size = [len(r) for r in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(i, size)), pa.array(np.concatenate([ids[0][r] for r in best])),
                     pa.array(np.concatenate([s[r] for s, r in zip(sims, best)]))],
                    ["query_id", "id", "similarity"])

    return both.mapInArrow(score, "query_id long, id long, similarity double")


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, qid: str = "vec_id",
            vector: str = "embedding", vid: str = "vec_id") -> tuple[DataFrame, dict[str, int]]:
    """(query_id, ``vid``, similarity, rank) of the k nearest vectors per query, and how
    many query-vector pairs were looked at out of all."""
    asked = stash(queries.where(F.col(vector).isNotNull()).select(
        F.col(qid).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")), "queries")
    order = [F.col("similarity").desc(), F.col("id")]
    near = stash(_asked(asked, path, k, None), "near")
    first = stash(top_n(_scored(near, path, k), ["query_id"], order, k, "rank"), "first")
    floor = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
    rest = stash(_asked(asked, path, k, floor), "rest")
    both = first.drop("rank").unionByName(_scored(rest, path, k))
    bands = spark.read.parquet(f"{path}/bands").select("cluster", "band", "n")
    read = (near.select("cluster", "band").unionByName(rest.select("cluster", "band"))
            .join(F.broadcast(bands), ["cluster", "band"]).agg(F.sum("n")).first()[0] or 0)
    total = (bands.agg(F.sum("n")).first()[0] or 0) * asked.count()
    found = top_n(both, ["query_id"], order, k, "rank").select("query_id", F.col("id").alias(vid), "similarity", "rank")
    return found, {"read": read, "all": total}
