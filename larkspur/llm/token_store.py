"""Token-id files: ids ranked by frequency, then written in whole bytes with the
lengths kept apart in control bytes (two bits each), and read by table lookup.

A store is a folder: ``ranks`` (Parquet: id by rank) and ``blocks``, binary files in
ascending doc_id order.  A file is a run of blocks; a block is a header (magic, its
number of documents and ids, length of its data), the doc_ids and token counts,
the control bytes (four ids each), the data bytes and a closing newline.

Defined results: null and empty texts hold the end id only.  Rows of one doc_id
follow each other in the order of a hash of their ids; null doc_ids come first.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import new_path, remove, stash

MAGIC = 0x31424B54
HEADER = np.dtype([("magic", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("data", "<u8")])
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 23
AT_ONCE, JOINED = 4096, 64  # words whose encodings a task holds at once, and words of one text
MARK = "\x01"  # keeps the words of such a text apart

#: kinds of bytes: white space, letter, digit, other, apostrophe, not ASCII
KINDS = bytes(5 if c > 127 else 0 if not W.GRAPH[c] else 1 if chr(c).isalpha() else 2 if chr(c).isdigit()
              else 4 if chr(c) == "'" else 3 for c in range(256))
#: whether ``SPLIT`` always parts a byte of kind a from one of kind b, at 6 a + b; an
#: apostrophe may belong to the letters after it
PARTED = bytes(a != b and 0 < a < 5 and 0 < b < 5 and (a, b) not in ((3, 4), (4, 3), (4, 1))
               for a in range(6) for b in range(6)).ljust(256, b"\0")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRETOKENIZERS = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
                 {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

#: bytes of each of the four ids of a control byte
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    longer = [np.flatnonzero(values > most) for most in (0xFF, 0xFFFF, 0xFFFFFF)]
    size = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    for at in longer:
        size[at] += 1
    control = size[::4] | size[1::4] << 2 | size[2::4] << 4 | size[3::4] << 6
    size = size[:len(values)].astype(np.int64) + 1
    first = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    data[first] = values & 0xFF
    for i, at in enumerate(longer, 1):
        data[first[at] + i] = values[at] >> 8 * i & 0xFF
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    first = np.cumsum(size) - size
    out = data[first].astype(np.uint32)
    for i in range(1, 4):
        at = np.flatnonzero(size > i)
        out[at] |= data[first[at] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer
    out = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out, W.Store()


@lru_cache(maxsize=2)
def _kept_whole(path: str | None) -> list[bytes] | None:
    """Lower-cased texts of the added tokens, if parts of words may be encoded by
    themselves and in lower case wherever none of these occurs; else None."""
    tokenizer = _tokenizer(path)[0]
    added = tokenizer.get_added_tokens_decoder().values()
    steps = [json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    if (steps[0].get("normalizers") != NORMALIZERS or steps[1].get("pretokenizers") != PRETOKENIZERS
            or any(t.normalized or t.content.isalpha() for t in added)):
        return None
    return [W.LOWER[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in added]


def chunks(data: np.ndarray, limits: np.ndarray, path: str | None = None):
    """Bytes of some rows, start and end of the chunks whose ids make up those of the
    rows: words, and where the tokenizer allows it their runs of letters, digits and
    other characters in lower case, of which there are fewer different ones."""
    whole = _kept_whole(path)
    if whole is not None:
        text = data.tobytes().translate(W.LOWER.tobytes())
        if not any(t in text for t in whole):
            low = np.frombuffer(text, np.uint8)
            kind = np.frombuffer(text.translate(KINDS), np.uint8)
            cuts = np.frombuffer((kind[:-1] * np.uint8(6) + kind[1:]).tobytes().translate(PARTED), bool)
            return low, *W.runs(low, np.concatenate([limits, np.flatnonzero(cuts) + 1]), W.GRAPH)
    return data, *W.runs(data, limits, W.GRAPH)


def _encoded(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_joined(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Many words go to the tokenizer as one text, each followed by ``MARK``, whose id
    tells where it ends.  Where words contain that character, or the ids do not tell,
    words are encoded one by one."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    apart = f" {MARK} ".encode()
    count, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for at in range(0, len(words), AT_ONCE):
        some, ends = words[at:at + AT_ONCE], []
        texts = [(apart.join(some[i:i + JOINED]) + apart).decode() for i in range(0, len(some), JOINED)]
        if len(mark) == 1 and sum(t.count(MARK) for t in texts) == len(some):
            ids = np.concatenate(_encoded(tokenizer, texts))
            ends = np.flatnonzero(ids == mark[0])
        if len(ends) == len(some):
            count.append(np.diff(ends, prepend=-1) - 1)
            flat.append(np.delete(ids, ends))
        else:
            found = _encoded(tokenizer, [w.decode() for w in some])
            count.append(np.array([len(x) for x in found], np.int64))
            flat.extend(found)
    return np.concatenate(count), np.concatenate(flat)


def _encode_letters(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For words that normalizer and pre-tokenizer leave as they are."""
    tokenize, count, flat = tokenizer.model.tokenize, array("q"), array("I")
    for word in words:
        found = [t.id for t in tokenize(word.decode())]
        count.append(len(found))
        flat.extend(found)
    return np.array(count, np.int64), np.array(flat, np.uint32)


def encode_words(words: list[bytes], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids."""
    tokenizer, known = _tokenizer(path)[0], _kept_whole(path) is not None
    letters = np.array([known and w.isalpha() and w.islower() for w in words], bool)  # a to z
    count = np.zeros(len(words), np.int64)
    count[letters], ids = _encode_letters(tokenizer, list(compress(words, letters)))
    count[~letters], others = _encode_joined(tokenizer, list(compress(words, ~letters)))
    flat, mine = np.zeros(count.sum(), np.uint32), np.repeat(letters, count)
    flat[mine], flat[~mine] = ids, others
    return count, flat


def id_type(path: str | None = None, end: int = 2) -> str:
    """Little-endian integers that hold every id of the vocabulary."""
    return "<u2" if max(end, _tokenizer(path)[0].get_vocab_size() - 1) < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """doc_id and its ids with the end id, as little-endian integers of 16 bits, or 32
    where the vocabulary has more ids than that.  The
    vocabulary must drop white space, as words between it are encoded by themselves,
    each new one of a task once."""
    def emit(batches):
        store = _tokenizer(path)[1]
        kind = id_type(path, end)

        def encode(words):
            return encode_words(words, path)

        for batch in batches:
            data, limits = W.utf8(batch.column(1))
            for a, b in W.pieces(limits):
                part, at = data[limits[a]:limits[b]], limits[a:b + 1] - limits[a]
                part, start, stop = chunks(part, at, path)
                count, ids = store.ids(part, start, stop, encode)
                row = np.searchsorted(at, start, "right") - 1
                count = np.bincount(row, count, b - a).astype(np.int64)
                ids = np.insert(ids, np.cumsum(count), end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), W.binary_lists(ids.astype(kind), count + 1)],
                    ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, ids binary")


def _ids(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[limits[0]:limits[-1]]
    return data.view(kind), np.diff(limits) // np.dtype(kind).itemsize


def write(tokens: DataFrame, folder: str, kind: str = "<u4") -> None:
    """Writes a store of (doc_id, ids) rows, ids being integers of type ``kind``."""
    spark = tokens.sparkSession

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_ids(batch.column(0), kind)[0])
            if len(more) > len(total):
                total, more = more, total
            total[:len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    used = (tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id")
            .agg(F.sum("n").alias("n")).toArrow())  # at most the size of the vocabulary
    ids, n = used["id"].to_numpy(), used["n"].to_numpy()
    order = np.lexsort((ids, -n))
    ids = ids[order]
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ids))), "id": pa.array(ids)}),
                          "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // FILE_IDS))

    def blocks(batches):
        for batch in batches:
            flat, size = _ids(batch.column(1), kind)
            values, limits = shared.value[flat], np.concatenate([[0], np.cumsum(size)])
            for a, b in W.pieces(limits, BLOCK_IDS):
                docs = np.zeros(b - a, DOC)
                ids = batch.column(0).slice(a, b - a)
                docs["id"], docs["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                docs["n"] = size[a:b]
                control, data = pack(values[limits[a]:limits[b]])
                head = np.array([(MAGIC, b - a, limits[b] - limits[a], len(data))], HEADER)
                block = head.tobytes() + docs.tobytes() + control.tobytes() + data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    tie = F.xxhash64("ids")
    (tokens.withColumn("tie", tie).repartitionByRange(files, "doc_id", "tie")
     .sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
     .mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
     .write.text(f"{folder}/blocks", lineSep="\n"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a store: file, place in it, ids before it in the file, doc_id,
    ids (as little-endian 32-bit integers) and their number."""
    ranks = spark.read.parquet(f"{folder}/ranks").toArrow()
    by_rank = np.zeros(len(ranks), np.uint32)
    by_rank[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    shared = spark.sparkContext.broadcast(by_rank)

    def emit(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = int(re.search(r"part-(\d+)", name).group(1))
                buffer = np.frombuffer(content.as_buffer(), np.uint8)
                at = place = before = 0
                while at < len(buffer):
                    head = buffer[at:at + HEADER.itemsize].view(HEADER)[0]
                    if head["magic"] != MAGIC:
                        raise ValueError(f"{name}: no block at {at}")
                    m, n, size = int(head["docs"]), int(head["ids"]), int(head["data"])
                    at += HEADER.itemsize
                    docs = buffer[at:at + m * DOC.itemsize].view(DOC)
                    at += m * DOC.itemsize
                    control = buffer[at:at + (n + 3) // 4]
                    at += len(control)
                    ids = shared.value[unpack(control, buffer[at:at + size], n)]
                    at += size + 1
                    count = docs["n"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, part)), pa.array(np.arange(place, place + m)),
                         pa.array(before + np.cumsum(count) - count),
                         pa.array(docs["id"].astype(np.int64), mask=docs["null"] == 1),
                         W.binary_lists(ids.astype("<u4"), count), pa.array(count)],
                        ["file", "place", "before", "doc_id", "ids", "n_tokens"])
                    place, before = place + m, before + n

    return (spark.read.format("binaryFile").load(f"{folder}/blocks/part-*").select("path", "content")
            .mapInArrow(emit, "file long, place long, before long, doc_id long, ids binary, n_tokens long"))


def offsets(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before it, from the files' totals
    (one row for each file, thousands of documents)."""
    total = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(total, "file").withColumn("start", F.col("ahead") + F.col("before"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes a store and reports on the documents read from it."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-store")
    interim = new_path(spark, "token-ids")
    token_ids(docs, path).write.option("compression", "zstd").parquet(interim)
    write(spark.read.parquet(interim), folder, id_type(path))
    remove(spark, interim)

    def check(batches):
        for b in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], b.column(4), pa.array(crc, pa.int64())],
                ["file", "before", "doc_id", "n_tokens", "ids_crc32"])

    rows = stash(read(spark, folder).select("file", "before", "doc_id", "ids", "n_tokens").mapInArrow(
        check, "file long, before long, doc_id long, n_tokens long, ids_crc32 long"), "store-rows")
    return offsets(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
