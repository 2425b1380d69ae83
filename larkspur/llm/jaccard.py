"""Exact n-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles.  Two documents link when
``100 * |A & B| >= threshold * |A | B|``.

1. Shingles are ordered from rare to common: first those of a lot drawn by hash,
   by how many documents hold them (counted exactly, kept as a coarse level in a
   table of fixed size), then the others.  Any order is correct; this one keeps
   shared passages out of the prefixes and counts only part of the shingles.
2. Documents with equal sets form one class.  Linking sets must share a shingle
   among the first ``n - ceil(n * threshold) + 1`` of both (the prefix).  Classes
   that share no token of their prefixes are done.
3. Of the others all shingles are counted, and prefixes are taken again in that
   exact order.  Shingles that no other class has now come first, so a changed
   copy with more of its own than a link allows has nothing left to join, and
   families of copies below the threshold do not meet pair by pair.  Classes with
   identical shared prefix and size form one group.
4. Star rounds: per token one leader is compared with the other classes of the
   bucket, so a family of near copies costs rows in proportion to its size.  The
   first leader is the class with the fewest shingles of its own: the text that the
   others are changed copies of.  Found links merge components.
5. What is left: group pairs that share a token, may link by size and by the
   positions of a shared token, were it the first, and are not wholly in one component, are expanded to their
   members and verified.  Pairs inside one component need no check, as they
   cannot change the result; no other pair is left out.

Defined results: null text, empty text and text of white space only have size 0
and component ``doc_id``.  Rows that repeat a text, with or without their doc_id,
share a component.  A null doc_id never names a component, but its text links; a
component of null ids only is null.  Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bitmap, components, deal, in_bitmap, lookup_join, receive, stash, stash_with

CELLS = 24  # 2^24 cells of four bits in the table of repeated shingles, 16 MB as bytes
STAR_ROUNDS = 2


def shingle_sets(column, k: int):
    """For runs of rows: first row, number of rows, and their (row, hash) sets.
    A row of 1 to k - 1 words has its whole sequence as its one shingle."""
    data, limits = W.utf8(column)
    for a, b in W.pieces(limits):
        part = limits[a:b + 1] - limits[a]
        row, _, _, h = W.words(W.LOWER[data[limits[a]:limits[b]]], part, W.GRAPH)
        count = np.bincount(row, minlength=b - a)
        rows, found = [], []
        first, g = W.grams(h, row, k)
        rows.append(row[first])
        found.append(g)
        for short in range(1, k):
            at = count[row] == short
            first, g = W.grams(h[at], row[at], short)
            rows.append(row[at][first])
            found.append(g)
        yield a, b - a, *W.distinct(np.concatenate(rows), np.concatenate(found))


def set_ids(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of the set of each row; 0 for the empty set."""
    size = np.bincount(row, minlength=n)
    total = np.concatenate([np.zeros(1, W.U), np.cumsum(W.mix(h * W.U(0xD1342543DE82EF95)))])
    end = np.cumsum(size)
    ids = W.mix(total[end] - total[end - size] + size.astype(W.U) * W.U(0x9E3779B97F4A7C15))
    return size, np.where(size > 0, ids, W.U(0)).view(np.int64)


def in_lot(h: np.ndarray, threshold: int) -> np.ndarray:
    """The lot: about 2.5 prefixes' worth of the shingles of each set, by hash."""
    share = min(1.0, 2.5 * (100 - threshold) / 100)
    return (h & W.U(0xFFFF)) < W.U(int(share * 0x10000))


def repeats(docs: DataFrame, k: int, threshold: int) -> np.ndarray:
    """For each cell of hashes 0 to 4: how often its most frequent shingle of the
    lot occurs, 0 for at most once, then for up to 3, 7, 15 and more documents."""
    def emit(batches):
        for batch in batches:
            for *_, h in shingle_sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[in_lot(h, threshold)].view(np.int64))], ["h"])

    level = "least(4, cast(floor(log2(n)) as int))"
    seen = (docs.select("text").mapInArrow(emit, "h long").groupBy("h")
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(F.expr(f"shiftrightunsigned(h, {64 - CELLS})").alias("cell"),
                    F.expr(f"shiftleft(1L, {level}) - 1").alias("bits"))
            .groupBy(F.expr("cast(cell div 16 as int)").alias("w"))
            .agg(F.expr("bit_or(shiftleft(bits, cast(4 * (cell % 16) as int)))").alias("v"))
            .toArrow())  # at most 2^20 rows, 12 MB
    packed = np.zeros(1 << (CELLS - 4), np.int64)
    packed[seen["w"].to_numpy()] = seen["v"].to_numpy()
    nibbles = packed.view(np.uint8)
    cells = np.stack([nibbles & 15, nibbles >> 4], 1).ravel()
    return np.array([bin(i).count("1") for i in range(16)], np.uint8)[cells]


def prefixes(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, size, set id and prefix tokens (rare first) of every row."""
    level = docs.sparkSession.sparkContext.broadcast(repeats(docs, k, threshold))

    def emit(batches):
        for batch in batches:
            for a, n, row, h in shingle_sets(batch.column(1), k):
                size, ids = set_ids(row, h, n)
                rank = level.value[(h >> W.U(64 - CELLS)).astype(np.int64)].astype(W.U)
                rank = np.where(in_lot(h, threshold), rank, W.U(5))
                token = ((rank << W.U(58)) | (h & W.U((1 << 58) - 1))).view(np.int64)
                order = np.lexsort((token, row))
                start = np.cumsum(size) - size
                length = np.where(size > 0, size - (threshold * size + 99) // 100 + 1, 0)
                keep = np.arange(len(row)) - start[row] < length[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(size.astype(np.int32)),
                     pa.array(ids), W.long_lists(token[order][keep], length)],
                    ["doc_id", "n", "gid", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        emit, "doc_id long, n int, gid long, prefix array<long>")


def active_classes(sets: DataFrame, total: int) -> DataFrame:
    """gid of every class with a token of its prefix in the prefix of some other
    class; a gid may come more than once.  ``total``: tokens in all prefixes."""
    def runs(batches):
        for batch in batches:
            gid = batch.column(0).to_numpy()
            _, once = np.unique(gid, return_index=True)
            prefix = batch.column(1).take(pa.array(once))
            yield (prefix.flatten().to_numpy(zero_copy_only=False),
                   np.repeat(gid[once], np.diff(prefix.offsets.to_numpy())))

    def work(t, gid):
        order = np.lexsort((gid, t))
        t, gid = t[order], gid[order]
        other = (t[1:] == t[:-1]) & (gid[1:] != gid[:-1])
        found = np.unique(np.concatenate([gid[1:][other], gid[:-1][other]]))
        for i in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 10_000])], ["gid"])

    types = [np.int64, np.int64]
    return (deal(sets.where("n > 0").select("gid", "prefix"), runs, types, total)
            .mapInArrow(receive(types, work), "gid long"))


def ordered_tokens(sets: DataFrame, threshold: int, total: int) -> DataFrame:
    """Prefix tokens of the classes in ``sets`` in the exact order by frequency among
    them, without those that no other class has: (token, class, size, position,
    prefix group, share of the set that other classes have too).
    ``total``: tokens in all sets."""
    first = [np.uint64, np.int64, np.int32]
    then = [np.int64, np.uint64, np.int32, np.int32]

    def runs(batches):
        for batch in batches:
            gid, held = batch.column(0).to_numpy(), batch.column(1)
            h = np.concatenate([np.frombuffer(v.as_buffer(), W.U) for v in held])
            n = np.array([len(v.as_buffer()) // 8 for v in held])
            yield h, np.repeat(gid, n), np.repeat(n, n)

    def count(h, gid, n):
        order = np.argsort(h, kind="stable")
        _, start, often = np.unique(h[order], return_index=True, return_counts=True)
        often = np.repeat(often, often)
        keep = often > 1
        order = order[keep]
        yield gid[order], h[order], n[order], often[keep]

    def work(gid, h, n, often):
        order = np.lexsort((h, often, gid))
        gid, h, n = gid[order], h[order], n[order].astype(np.int64)
        _, start, shared = np.unique(gid, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(start)), shared)
        own = (n[start] - shared)[row]
        pos = own + np.arange(len(gid)) - start[row]
        keep = pos < n - (threshold * n + 99) // 100 + 1
        gid, h, n, pos, row, own = (x[keep] for x in (gid, h, n, pos, row, own))
        # equal tokens at equal places of sets of equal size: the same partners
        _, group = set_ids(row, h, len(start))
        group = W.mix(group.view(W.U)[row] + W.mix(n.astype(W.U)) + own.astype(W.U)).view(np.int64)
        part = (1 - own / n).astype(np.float32)
        for i in range(0, len(gid), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[i:i + 10_000]) for x in (h.view(np.int64), gid, n.astype(np.int32),
                                                     pos.astype(np.int32), group, part)],
                ["t", "gid", "n", "pos", "pg", "shared"])

    by_token = deal(sets.select("gid", "hashes"), runs, first, total)
    return (deal(by_token, receive(first, count), then, total)
            .mapInArrow(receive(then, work), "t long, gid long, n int, pos int, pg long, shared float"))


def sets_of(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """Set id and sorted shingle hashes of the classes whose id is in the bit map."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches):
        for batch in batches:
            for _, n, row, h in shingle_sets(batch.column(0), k):
                size, ids = set_ids(row, h, n)
                keep = in_bitmap(bits.value, ids) & (size > 0)
                _, once = np.unique(ids, return_index=True)
                new = np.zeros(n, bool)
                new[once] = True
                keep &= new
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), W.binary_lists(h[keep[row]], size[keep])],
                    ["gid", "hashes"])

    return (docs.select("text").mapInArrow(emit, "gid long, hashes binary")
            .groupBy("gid").agg(F.min("hashes").alias("hashes")))


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with a column ``linked`` from their whole sets."""
    def emit(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            out = np.zeros(len(left), bool)
            for i in range(len(left)):
                x = np.frombuffer(left[i].as_buffer(), W.U)
                y = np.frombuffer(right[i].as_buffer(), W.U)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                out[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "linked"])

    return (pairs.join(sets.withColumnRenamed("gid", "a").withColumnRenamed("hashes", "x"), "a")
            .join(sets.withColumnRenamed("gid", "b").withColumnRenamed("hashes", "y"), "b")
            .select("a", "b", "x", "y").mapInArrow(emit, "a long, b long, linked boolean"))


def _sizes_fit(a: str, b: str, threshold: int):
    return F.expr(f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})")


def _positions_fit(l: str, r: str, threshold: int):
    """Can two sets link whose first shared token is at these places?  From there on
    at most the shorter rest is shared.  A linking pair passes at its first shared
    token, which both prefixes hold; at later ones it may fail."""
    most = f"least({l}.n - {l}.pos, {r}.n - {r}.pos)"
    return F.expr(f"(100 + {threshold}) * ({most}) >= {threshold} * ({l}.n + {r}.n)")


def links(sets: DataFrame, tokens: DataFrame, threshold: int) -> DataFrame | None:
    """Set ids with the component of all links among them; None without links."""
    checked = comp = None
    for number in range(STAR_ROUNDS + 1):
        rows = (tokens.withColumn("c", F.col("gid")) if comp is None else
                tokens.join(comp, "gid", "left").withColumn("c", F.coalesce("c", "gid")))
        pairs = _stars(rows, number, threshold) if number < STAR_ROUNDS else _rest(rows, threshold)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.where("a <> b").distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        done, found = stash_with(verify(pairs, sets, threshold), "checked",
                                 linked=F.count_if(F.col("linked")))
        checked = done if checked is None else checked.union(done)
        if found["linked"]:
            comp = components(checked.where("linked").select("a", "b")).toDF("gid", "c")
    return comp


def _stars(rows: DataFrame, number: int, threshold: int) -> DataFrame:
    # first the class with the largest share of shared tokens: copies have tokens of
    # their own where they were changed, the text they were made from has none
    first = -F.col("shared") if number == 0 else F.lit(0)
    order = F.struct(first.alias("s"), F.xxhash64("gid", F.lit(number)).alias("o"), "gid", "n", "pos", "c")
    lead = (rows.groupBy("t").agg(F.min(order).alias("l"), F.min("c").alias("lo"),
                                  F.max("c").alias("hi")).where("lo <> hi").select("t", "l"))
    return (rows.alias("r").join(lead, "t").where("r.c <> l.c").where(_sizes_fit("r.n", "l.n", threshold))
            .where(_positions_fit("l", "r", threshold))
            .select(F.col("l.gid").alias("a"), F.col("r.gid").alias("b")))


def _rest(rows: DataFrame, threshold: int) -> DataFrame:
    members = stash(rows.select("pg", "gid", "c").distinct(), "members")
    group = members.groupBy("pg").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    places = stash(rows.select("t", "pg", "n", "pos").distinct().join(group, "pg"), "places")
    uniform = (places.where("lo = hi").groupBy("t", F.col("lo").alias("c")).count()
               .groupBy("t").agg(F.max_by("c", "count").alias("top")))
    mixed = (places.groupBy("t").agg(F.min("lo").alias("_l"), F.max("hi").alias("_h"))
             .where("_l <> _h").select("t").join(uniform, "t", "left"))
    places = places.join(mixed, "t").withColumn(
        "big", F.coalesce(F.expr("lo = hi and lo = top"), F.lit(False)))
    l, r = places.where("not big").alias("l"), places.alias("r")
    pairs = (l.join(r, F.expr("l.t = r.t and (r.big or l.pg <= r.pg)"
                              " and not (l.lo = l.hi and r.lo = r.hi and l.lo = r.lo)"))
             .where(_sizes_fit("l.n", "r.n", threshold))
             .where(_positions_fit("l", "r", threshold))
             .select(F.least("l.pg", "r.pg").alias("p"), F.greatest("l.pg", "r.pg").alias("q"))
             .distinct())
    one = members.select(F.col("pg").alias("p"), F.col("gid").alias("a"), F.col("c").alias("ca"))
    two = members.select(F.col("pg").alias("q"), F.col("gid").alias("b"), F.col("c").alias("cb"))
    return pairs.join(one, "p").join(two, "q").where("ca <> cb").select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    sets, seen = stash_with(prefixes(docs, k, threshold), "prefixes", total=F.sum(F.size("prefix")))
    active = bitmap(active_classes(sets, seen["total"] or 0), "gid")
    whole, seen = stash_with(sets_of(docs, k, active), "sets", total=F.sum(F.length("hashes")))
    tokens = stash(ordered_tokens(whole, threshold, (seen["total"] or 0) // 8), "tokens")
    comp = links(whole, tokens, threshold)
    classes = sets.where("n > 0").groupBy("gid").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = stash(classes, "sizes")
    if comp is not None:
        named = classes.join(comp, "gid")
        least = named.groupBy("c").agg(F.min("low").alias("first"))
        classes = stash(classes.join(named.join(least, "c").select("gid", "first"), "gid", "left")
                        .select("gid", F.coalesce("first", "low").alias("component_id"),
                                "copies"), "sizes")
    else:
        classes = classes.withColumnRenamed("low", "component_id")
    some = lookup_join(sets.where("n > 0").select("doc_id", "n", "gid"), classes, ["gid"], "copies")
    none = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (some.select("doc_id", "n", "component_id").unionByName(none)
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))
