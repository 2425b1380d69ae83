"""Whole Arrow batches of text as numpy arrays: word limits, word hashes, n-gram
hashes.  The functions work on the UTF-8 bytes of a batch, so there is no Python
loop over words; memory is a small multiple of the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: the first 0 to 8 bytes of a block
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: spans longer than this are hashed one by one
STEP = 256

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: bytes of words of letters and digits (after LOWER), and of words between white space
ALNUM = (((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128))
GRAPH = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row limits in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def pieces(limits: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    at, n = 0, len(limits) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + most, "right")) - 1)
        yield at, to
        at = to


def runs(data: np.ndarray, limits: np.ndarray, inside: np.ndarray):
    """Start and end of every maximal run of ``inside`` bytes; rows end runs."""
    keep = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[limits] = True
    before = np.concatenate([[False], keep[:-1]]) if len(keep) else keep
    start = np.flatnonzero(keep & (~before | cut[:-1]))
    after = np.concatenate([keep[1:], [False]]) if len(keep) else keep
    end = np.flatnonzero(keep & (~after | cut[1:])) + 1
    return start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span: blocks of eight bytes go one after the other through
    ``mix``, all spans at once; the length goes in first."""
    length = end - start
    out = mix(length.astype(U) * U(0xD6E8FEB86659FD93) + U(seed))
    if len(data) < 8:
        data = np.concatenate([data, np.zeros(8 - len(data), np.uint8)])
    data = np.ascontiguousarray(data)
    block, last = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), len(data) - 8
    fits = (length > 0) & (length <= STEP)
    todo = slice(None) if fits.all() else np.flatnonzero(fits)
    at, left = start[todo], length[todo]
    while len(at):
        # a block that would pass the end of the data is read further left and shifted
        value, over = block[np.minimum(at, last)], np.flatnonzero(at > last)
        value[over] >>= ((at[over] - last) * 8).astype(U)
        value &= FIRST[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ value) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))
        more = np.flatnonzero(left > 8)
        todo, at, left = more if isinstance(todo, slice) else todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > STEP):
        out[i] = U(xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes(), seed))
    return out


def words(data, limits, inside):
    """Row, start, end and hash of every word of a batch."""
    start, end = runs(data, limits, inside)
    row = np.searchsorted(limits, start, "right") - 1
    return row, start, end, hashes(data, start, end)


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every ``k`` consecutive words of a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    out = np.full(n, k, U)
    for i in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i:i + n])
    first = np.flatnonzero(row[:n] == row[k - 1:])
    return first, out[first]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by both."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(row):
        return row, h
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[new], h[new]


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]


def binary_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Fixed-width values as one binary per row."""
    width = values.dtype.itemsize
    limits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(limits.tobytes()),
                                         pa.py_buffer(values.tobytes())]).cast(pa.binary())


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    limits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values.astype(np.int64)))


class Store:
    """Ids of text chunks seen so far, by hash; at most ``most`` chunks are kept.  A
    second hash is kept beside the first: where the two disagree about which chunks
    are equal, the chunks at hand are encoded afresh, without the store.  Chunks lie
    in the order they came; two sorted lists of keys, a long and a short one, say
    where, and the short one is merged into the long one now and then."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.n, self.used = 0, 0
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.second, self.flat = np.zeros(1 << 12, U), np.zeros(1 << 14, np.uint32)
        self.keys = [np.zeros(0, U), np.zeros(0, U)]
        self.where = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(wanted), -1)
        for keys, where in zip(self.keys, self.where):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                out[hit] = where[at[hit]]
        return out

    def _put(self, keys: np.ndarray, second: np.ndarray, count: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Keeps new chunks (keys ascend) and returns their places."""
        to, end = self.n + len(keys), self.used + len(flat)
        for name, size in (("at", to), ("count", to), ("second", to), ("flat", end)):
            have = getattr(self, name)
            if size > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(size - len(have), len(have) // 2), have.dtype)]))
        self.at[self.n:to] = self.used + np.cumsum(count) - count
        self.count[self.n:to], self.second[self.n:to] = count, second
        self.flat[self.used:end] = flat
        places = np.arange(self.n, to)
        self.n, self.used = to, end
        self._merge(1, keys, places)
        if len(self.keys[1]) > max(1 << 14, len(self.keys[0]) // 4):
            self._merge(0, self.keys[1], self.where[1])
            self.keys[1], self.where[1] = np.zeros(0, U), np.zeros(0, np.int64)
        return places

    def _merge(self, level: int, keys: np.ndarray, where: np.ndarray) -> None:
        both = np.concatenate([self.keys[level], keys])
        order = np.argsort(both, kind="stable")
        self.keys[level] = both[order]
        self.where[level] = np.concatenate([self.where[level], where])[order]

    def ids(self, data, start, end, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids per chunk and all ids; ``encode`` gets the bytes of each new chunk
        once and gives the same two arrays for them."""
        if self.n > self.most:
            self.forget()
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        h, second = hashes(data, start, end), hashes(data, start, end, 1)
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        where = self._find(distinct)
        new = where < 0
        if ((second[first][place] != second).any()
                or (self.second[where[~new]] != second[first[~new]]).any()):
            return encode(spans(data, start, end))
        if new.any():
            count, flat = encode(spans(data, start[first[new]], end[first[new]]))
            where[new] = self._put(distinct[new], second[first[new]], count, flat)
        where = where[place]
        count = self.count[where]
        before = np.cumsum(count) - count
        return count, self.flat[np.repeat(self.at[where] - before, count) + np.arange(count.sum())]
