"""Phrase collocations from weighted acyclic automata of n-grams.

A shard of text becomes an automaton whose paths from the root are its n-grams in
order; a state carries how often its n-gram occurs.  It is built level by level from
the sorted n-grams of the shard: the states of a level are the distinct pairs of a
state above and a next word.  Automata are cut by ranges of the hash of their first
two words, so no range is crowded by a frequent word, shuffled as compact arrays, and
united range by range: vocabularies are merged and the weights of equal paths summed.
In the united automaton the counts of the first parts of a phrase lie on its path; the
counts of the rests are looked up by a join that broadcasts its hot keys.

Phrases counted ``min_count`` times only hold words and word pairs counted as often, so
three passes suffice: words, pairs of frequent words, and longer phrases along frequent
pairs.  What is frequent is known to the shards as a bit map sized by the number of
frequent items, of at most 2^27 bits.  A bit map lets some infrequent items through and
never holds back frequent ones, so it only saves work; counts decide.

Defined results: null and empty texts have no words; a null lang is ``und``.  Repeated
rows count one by one.  Empty tables give no phrases.  Very long texts are counted whole,
a piece ends where a text does.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, stash
from .words import U, mix, utf8

BREAK = b"\xff"
#: bytes of text per shard automaton, and per range of united automata
SHARD, RANGE = 8 << 20, 64 << 20
MOST_BITS = 27
_map = np.arange(256)
_map[65:91] += 32
_map[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 0xFF
_map[9] = 32
FOLD = bytes(_map.astype(np.uint8))

BLOBS = "lang string, part int, blob binary"
PHRASES = "lang string, words array<string>, a long, heads array<long>, key long"


# ------------------------------------------------------------------ automata

class Automaton:
    """Levels of states (above, word, weight), sorted by (above, word); ``above`` is the
    row of the state one word shorter, 0 on the first level.  ``words`` is sorted."""

    def __init__(self, words: list[bytes], levels: list[tuple], root: int = 0):
        self.words, self.levels, self.root = words, levels, root

    def size(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def pack(self) -> bytes:
        out = [np.array([self.root, len(self.words), len(self.levels)], np.int64).tobytes()]
        for values in (np.array([len(w) for w in self.words], np.int64),
                       *[x for level in self.levels for x in (np.diff(level[0], prepend=0), *level[1:])]):
            small = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
            out += [np.array([len(values), small.itemsize], np.int64).tobytes(), values.astype(small).tobytes()]
        return b"".join([*out, *self.words])

    @staticmethod
    def unpack(blob: bytes) -> "Automaton":
        root, n_words, n_levels = np.frombuffer(blob, np.int64, 3)
        at, arrays = 24, []
        for _ in range(1 + 3 * int(n_levels)):
            n, width = (int(v) for v in np.frombuffer(blob, np.int64, 2, at))
            arrays.append(np.frombuffer(blob, f"u{width}", n, at + 16).astype(np.int64))
            at += 16 + n * width
        ends = at + np.cumsum(arrays[0])
        words = [blob[e - n:e] for e, n in zip(ends.tolist(), arrays[0].tolist())]
        levels = [(np.cumsum(arrays[i]), arrays[i + 1], arrays[i + 2])
                  for i in range(1, 1 + 3 * int(n_levels), 3)]
        return Automaton(words, levels, int(root))


def build(words: list[bytes], ids: np.ndarray, depth: int, linked: np.ndarray | None = None) -> Automaton:
    """Automaton of the n-grams of up to ``depth`` words in ``ids``, in which -1 parts
    pieces.  With ``linked``, only along neighbours for which it holds at the left one."""
    at = np.flatnonzero(ids >= 0)
    if linked is not None:
        at = at[linked[at]]
    key, state, levels = ids[at], np.zeros(len(at), np.int64), []
    for k in range(depth):
        key = state * len(words) + ids[at + k]
        found, state, n = np.unique(key, return_inverse=True, return_counts=True)
        levels.append((found // max(1, len(words)), found % max(1, len(words)), n))
        goes = at + k + 1 < len(ids)
        goes[goes] = ids[at[goes] + k + 1] >= 0
        if linked is not None:
            goes &= linked[at + k]
        at, state = at[goes], state[goes]
    return Automaton(words, levels, int((ids >= 0).sum()))


def unite(parts: list[Automaton]) -> Automaton:
    """Automaton of all paths, with the weights of equal paths summed."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*[p.words for p in parts]))
    place = {w: i for i, w in enumerate(words)}
    renamed = [np.array([place[w] for w in p.words], np.int64) for p in parts]
    above, levels = [np.zeros(1, np.int64)] * len(parts), []
    for k in range(max(len(p.levels) for p in parts)):
        keys = [above[i][p.levels[k][0]] * len(words) + renamed[i][p.levels[k][1]]
                for i, p in enumerate(parts)]
        found, to = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, to, np.concatenate([p.levels[k][2] for p in parts]))
        levels.append((found // max(1, len(words)), found % max(1, len(words)), n))
        above = np.split(to, np.cumsum([len(x) for x in keys])[:-1])
    return Automaton(words, levels, sum(p.root for p in parts))


def split(whole: Automaton, level: int, part: np.ndarray):
    """(part, automaton) for the states of ``level`` dealt to parts, with all above and
    below them.  The root weight goes to the first part."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    root = whole.root
    for some in np.split(order, cuts):
        if not len(some):
            continue
        number = int(part[some[0]])
        keep = [np.zeros(0, np.int64)] * len(whole.levels)
        keep[level] = np.sort(some)
        for k in range(level, 0, -1):
            keep[k - 1] = np.unique(whole.levels[k][0][keep[k]])
        for k in range(level + 1, len(whole.levels)):
            above = whole.levels[k][0]
            first, last = np.searchsorted(above, keep[k - 1]), np.searchsorted(above, keep[k - 1], "right")
            n = last - first
            keep[k] = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        used = np.unique(np.concatenate([whole.levels[k][1][keep[k]] for k in range(len(keep))]))
        levels = []
        for k, rows in enumerate(keep):
            above, word, n = (x[rows] for x in whole.levels[k])
            above = np.searchsorted(keep[k - 1], above) if k else above
            levels.append((above, np.searchsorted(used, word), n))
        yield number, Automaton([whole.words[i] for i in used], levels, root)
        root = 0
    if root:
        yield 0, Automaton([], [(np.zeros(0, np.int64),) * 3] * len(whole.levels), root)


# --------------------------------------------------------------------- tasks

def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), U, len(words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0x9E3779B97F4A7C15) + second)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & U(len(bits) * 64 - 1)
    return (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1


def _shard(lang, texts, depth, parts, frequent):
    """Rows of the automaton of some texts of one language."""
    found = (BREAK.join(texts) + BREAK).translate(FOLD).replace(BREAK, b" \xff ").split()
    words = sorted(dict.fromkeys(found))
    if words and words[-1] == BREAK:
        words.pop()
    place = {w: i for i, w in enumerate(words)}
    place[BREAK] = -1
    ids = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
    del found, place
    keys, linked = word_keys(lang, words), None
    if frequent:
        known = _has(frequent[0].value, keys)
        ids[ids >= 0] = np.where(known[ids[ids >= 0]], ids[ids >= 0], -1)
    if len(frequent) == 2:
        linked = np.zeros(len(ids), bool)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        linked[at] = _has(frequent[1].value, pair_keys(keys[ids[at]], keys[ids[at + 1]]))
    whole = build(words, ids, depth, linked)
    above, word, _ = whole.levels[min(depth, 2) - 1]
    prefix = mix(keys[word]) if depth == 1 else pair_keys(keys[whole.levels[0][1][above]], keys[word])
    for part, automaton in split(whole, min(depth, 2) - 1, (prefix >> U(32)).astype(np.int64) * parts >> 32):
        yield lang, part, automaton.pack()


def _rows(rows, schema_names, types):
    rows = list(rows)
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 2000]), types)],
                                         schema_names)


def _shards(depth, parts, frequent):
    types = [pa.string(), pa.int32(), pa.binary()]

    def run(batches):
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            data, limits = utf8(batch.column("text"))
            for r, lang in enumerate(batch.column("lang").to_pylist()):
                held.setdefault(lang, []).append(data[limits[r]:limits[r + 1]].tobytes())
                size[lang] = size.get(lang, 0) + int(limits[r + 1] - limits[r])
                if size[lang] >= SHARD or sum(size.values()) >= 4 * SHARD:
                    # the longest share goes first, so memory stays bounded for any number of languages
                    largest = max(size, key=size.get)
                    size.pop(largest)
                    yield from _rows(_shard(largest, held.pop(largest), depth, parts, frequent),
                                     ["lang", "part", "blob"], types)
        for lang, texts in held.items():
            yield from _rows(_shard(lang, texts, depth, parts, frequent), ["lang", "part", "blob"], types)
    return run


def _phrases(lang, whole, depth, least):
    """Rows of the states of at least ``least`` occurrences; the root is the phrase of
    no words.  Weights above the second level are partial and left out when depth > 1."""
    yield lang, [], whole.root, [], 0
    keys = word_keys(lang, whole.words)
    for k in range(0 if depth == 1 else 1, len(whole.levels)):
        rows = np.flatnonzero(whole.levels[k][2] >= least)
        path, counts, at = [], [], rows
        for j in range(k, -1, -1):
            path.append(whole.levels[j][1][at])
            counts.append(whole.levels[j][2][at])
            at = whole.levels[j][0][at]
        path, counts = path[::-1], counts[::-1]
        key = (keys[path[0]] if k == 0 else pair_keys(keys[path[0]], keys[path[1]])).astype(np.int64)
        words = [[whole.words[i] for i in p] for p in path]
        for i in range(len(rows)):
            yield (lang, [w[i].decode() for w in words], int(counts[-1][i]),
                   [int(c[i]) for c in counts[1:-1]], int(key[i]))


def _unions(depth, least):
    names = ["lang", "words", "a", "heads", "key"]
    types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches):
        group, waiting, size = None, [], 0
        for batch in batches:
            for key, blob in zip(zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist()),
                                 batch.column("blob").to_pylist()):
                if key != group:
                    if waiting:
                        yield from _rows(_phrases(group[0], unite(waiting), depth, least), names, types)
                    group, waiting, size = key, [], 0
                waiting.append(Automaton.unpack(blob))
                size += waiting[-1].size()
                if size > 2_000_000 and len(waiting) > 1:
                    waiting = [unite(waiting)]
                    size = 0
        if waiting:
            yield from _rows(_phrases(group[0], unite(waiting), depth, least), names, types)
    return run


# ---------------------------------------------------------------------- jobs

def counted(texts: DataFrame, depth: int, least: int, parts: int, frequent: list) -> DataFrame:
    """Phrases of up to ``depth`` words with their counts, in the shared folder."""
    shards = texts.mapInArrow(_shards(depth, parts, frequent), BLOBS)
    return stash(shards.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part")
                 .mapInArrow(_unions(depth, least), PHRASES), f"phrases-{depth}")


def bits_of(phrases: DataFrame):
    """Broadcast bit map of the keys: 16 bits each, at most 2^27 in all."""
    n = phrases.count()
    width = min(MOST_BITS, max(16, int(16 * n).bit_length()))
    bit = F.expr(f"key & {(1 << width) - 1}")
    rows = (phrases.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toArrow())
    out = np.zeros(1 << (width - 6), U)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(U)
    return phrases.sparkSession.sparkContext.broadcast(out)


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, longest: int = 5) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(1 + size // RANGE)
    words = counted(texts, 1, min_count, parts, [])
    totals = words.where("size(words) = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    words = words.where("size(words) = 1")
    frequent = [bits_of(words)]
    frequent.append(bits_of(counted(texts, 2, min_count, parts, frequent).where("size(words) = 2")))
    found = counted(texts, longest, min_count, parts, frequent).where("size(words) > 1")
    joined = F.concat_ws(" ", "words").alias("phrase")
    found, known = found.select("*", joined), words.select("lang", joined, "a")
    known = stash(known.unionByName(found.select("lang", "phrase", "a")), "known")

    inner = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")))
    longer = (found.where("size(words) > 2").select("lang", "a", inner.alias("words"))
              .groupBy("lang", joined).agg(F.max("a").alias("_longer")))
    kept = (found.join(longer, ["lang", "phrase"], "left").where("_longer is null or _longer < a")
            .drop("_longer"))
    cuts = stash(kept.select(
        "lang", "phrase", "a", "heads", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
        .select("lang", "phrase", "a", "k",
                F.expr("if(k > 1, get(heads, k - 2), null)").alias("head"),
                F.expr("words[0]").alias("first"),
                F.expr("concat_ws(' ', slice(words, k + 1, size(words) - k))").alias("rest")), "cuts")

    def looked_up(rows: DataFrame, part: str, name: str) -> DataFrame:
        wanted = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_uses"))
        right = stash(wanted.join(known.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)),
                                  ["lang", part]), "parts")
        return lookup_join(rows, right, ["lang", part], "_uses")

    one = looked_up(cuts.where("k = 1"), "first", "l").select(*cuts.columns, "l")
    more = cuts.where("k > 1").withColumn("l", F.col("head"))
    scored = looked_up(stash(one.unionByName(more), "left-parts"), "rest", "r").join(totals, "lang")
    score = F.expr("cast(1000 * a as decimal(20,0)) * cast(n as decimal(20,0)) div "
                   "(cast(l as decimal(20,0)) * cast(r as decimal(20,0)))")
    best = (scored.groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")))
    order = Window.partitionBy("lang").orderBy(F.col("_cut.score").desc(), F.col("a").desc(), "phrase")
    return (best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"),
                    "n", F.col("_cut.score").alias("score")))
