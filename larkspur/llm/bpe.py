"""Byte-pair encoding by speculation and verification.

A text is cut into chunks that its tokens never cross; each distinct chunk of a
batch is encoded once.  For every new word greedy longest match proposes tokens.
A proposal is the exact encoding if no two neighbours would have merged, or
merged in part, across their border; this is tested for all distinct neighbour
pairs at once, with numpy, from the merge histories of both tokens.  Only words
with a failing pair are merged step by step.

Defined results: null text is empty; empty text has no tokens and the digests of
nothing.  A special token written in a text is one token, as its file says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import words as W

#: fixed value: the splitting rule of byte-level vocabularies
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                        r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter by which vocabulary files write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Table:
    """Sorted long keys with values; lookups of whole arrays."""

    def __init__(self, keys=(), values=(), missing=-1):
        order = np.argsort(np.asarray(keys, np.int64), kind="stable")
        self.keys = np.asarray(keys, np.int64)[order]
        self.values = np.asarray(values, np.int64)[order]
        self.missing = missing

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.missing, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.size, self.bytes = n, [b""] * n
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        ids = model["vocab"]
        self.byte_id = [ids[c] for c in byte_letters()]
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        rank = np.full(n, -1, np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = ids[a], ids[b], ids[a + b]
            self.merges.setdefault(a * n + b, (r, c))
            if rank[c] < 0:
                left[c], right[c], rank[c] = a, b, r
        self.rank = rank
        self.ranks = Table(list(self.merges), [r for r, _ in self.merges.values()], NEVER)
        self.edge = [self._edges(right), self._edges(left)]
        made = np.flatnonzero(rank >= 0)
        whole = self.free_pair(left[made], right[made], rank[made])
        good = rank < 0
        for c, ok in sorted(zip(made.tolist(), whole.tolist()), key=lambda x: rank[x[0]]):
            good[c] = ok and good[left[c]] and good[right[c]]
        self.by_bytes = {self.bytes[i]: i for i in ids.values() if good[i]}
        self.longest: dict[bytes, int] = {}
        for t in self.by_bytes:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.letters = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pairs = Table()
        self.store = W.Store()

    def _edges(self, child):
        """Per token the pieces that lie on its border at some time, from the
        token down, and the rank of the merge that ends each."""
        token, end = np.arange(self.size), np.full(self.size, NEVER)
        out = []
        while (token >= 0).any():
            out.append((token, end))
            inner = token >= 0
            end = np.where(inner, self.rank[token], -1)
            token = np.where(inner, child[token], -1)
        return out

    def free_pair(self, a, b, below=None) -> np.ndarray:
        """Does no merge (of rank under ``below``) cross the border of a and b?
        A merge of two border pieces happens if it comes before both are taken up
        by others; among equal ranks the leftmost comes first."""
        ok = np.ones(len(a), bool)
        for x, ended in self.edge[0]:
            xs, xe = x[a], ended[a]
            if not (xs >= 0).any():
                break
            for y, over in self.edge[1]:
                ys, ye = y[b], over[b]
                at = np.flatnonzero((xs >= 0) & (ys >= 0) & ok)
                if not len(at):
                    break
                r = self.ranks.get(xs[at] * self.size + ys[at])
                hit = (r < NEVER) & (r < xe[at]) & (r <= ye[at])
                if below is not None:
                    hit &= r < below[at]
                ok[at[hit]] = False
        return ok

    def propose(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        known, longest = self.by_bytes, self.longest
        while i < n:
            for to in range(min(n, i + longest.get(word[i:i + 2], 1)), i, -1):
                token = known.get(word[i:to])
                if token is not None:
                    break
            out.append(token)
            i = to
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] * size + ids[i + 1])
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                m = merges.get(c * size + ids[after[j]])
                if m:
                    heapq.heappush(heap, (m[0], i, c, ids[after[j]], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] * size + c)
                if m:
                    heapq.heappush(heap, (m[0], h, ids[h], c, m[1]))
        return [t for t in ids if t >= 0]

    def words(self, items: list[bytes]) -> list[list[int]]:
        """Token ids of words that no token crosses."""
        out = [self.propose(w) for w in items]
        flat = np.array([t for ids in out for t in ids], np.int64)
        count = np.array([len(ids) for ids in out], np.int64)
        if len(flat) < 2:
            return out
        owner = np.repeat(np.arange(len(out)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key = flat[inner] * self.size + flat[inner + 1]
        distinct, place = np.unique(key, return_inverse=True)
        ok = self.pairs.get(distinct)
        new = distinct[ok < 0]
        if len(new):
            free = self.free_pair(new // self.size, new % self.size).astype(np.int64)
            ok[ok < 0] = free
            kept = self.pairs if len(self.pairs.keys) < 1 << 20 else Table()
            self.pairs = Table(np.concatenate([kept.keys, new]), np.concatenate([kept.values, free]))
        for i in np.unique(owner[inner[ok[place] == 0]]):
            out[i] = self.merge(items[i])
        return out

    # ------------------------------------------------------------ chunks

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and flat ids of chunks, cut into words by the splitting rule."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            found = PATTERN.findall(t.decode("utf-8"))
            pieces += [p.encode() for p in found]
            owner += [i] * len(found)
        ids = self.words(pieces)
        sizes = np.array([len(x) for x in ids], np.int64)
        count = np.bincount(np.array(owner, np.int64), sizes, len(texts)).astype(np.int64)
        return count, np.array([t for x in ids for t in x], np.uint32)

    def segment(self, text: str) -> list[int]:
        """A text with special tokens in it."""
        name = next((s for s in self.special if s in text), None)
        if name is None:
            return self.chunks([text.encode()])[1].tolist() if text else []
        first, *rest = text.split(name)
        out = self.segment(first)
        for part in rest:
            out += [self.special[name], *self.segment(part)]
        return out

    def encode(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per row and all their ids, for rows of UTF-8 bytes."""
        cut = np.zeros(len(data) + 1, bool)
        cut[limits] = True
        if len(data) > 1:
            # a blank before a visible ASCII letter always starts a token
            cut[:-2] |= (data[:-1] == 32) & (data[1:] > 32) & (data[1:] < 127)
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        count, ids = self.store.ids(data, start, end, self.chunks)
        row = np.searchsorted(limits, start, "right") - 1
        return np.bincount(row, count, len(limits) - 1).astype(np.int64), ids

    def encode_column(self, column):
        """(first row, rows, counts, ids) for runs of rows of a text column."""
        data, limits = W.utf8(column)
        for a, b in W.pieces(limits, 1 << 22):
            part, at = data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]
            count, ids = self.encode(part, at)
            whole = part.tobytes()
            if any(s.encode() in whole for s in self.special):
                rows = np.split(ids, np.cumsum(count)[:-1])
                for i in range(b - a):
                    text = whole[at[i]:at[i + 1]]
                    if any(s.encode() in text for s in self.special):
                        rows[i] = np.array(self.segment(text.decode()), np.uint32)
                count = np.array([len(r) for r in rows], np.int64)
                ids = np.concatenate(rows).astype(np.uint32)
            yield a, b - a, count, ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens."""
        n = self.lengths[ids]
        before = np.cumsum(n) - n
        at = np.repeat(self.starts[ids] - before, n) + np.arange(n.sum())
        return self.letters[at].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """By default the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers
    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the ids as little-endian 32-bit integers, and the text they decode to."""
    def emit(batches):
        v = vocabulary(path)
        for batch in batches:
            for a, n, count, ids in v.encode_column(batch.column(1)):
                text = [v.decode(x).decode("utf-8", "replace")
                        for x in np.split(ids, np.cumsum(count)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(count),
                     W.binary_lists(ids.astype("<u4"), count), pa.array(text, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(
        emit, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of the decoded text, of every row."""
    def emit(batches):
        v = vocabulary(path)
        for batch in batches:
            for a, n, count, ids in v.encode_column(batch.column(1)):
                rows = np.split(ids.astype("<u4"), np.cumsum(count)[:-1])
                text = [v.decode(x).decode("utf-8", "replace").encode() for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(count),
                     pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows], pa.string()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in text], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
