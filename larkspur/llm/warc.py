"""WARC archives with deduplicated payloads and a globally ordered capture index.

Pages become WARC/1.1 records, written through Spark's writer as archive files of
bounded length.  Of equal payloads (of at least ``least`` bytes) the record of the
smallest page_id is a response, the others are revisits that name it.  Each archive
read gives a run of captures sorted by URL key (host reversed, then path) and time;
range-partitioned tasks merge the runs with a loser tree.

Defined results: null html is an empty payload; a null url becomes ``urn:page:`` and
the id; control characters of urls are percent-encoded.  Pages with null page_id
are kept with null id; they are responses only if no page with an id has their
payload.  Rows that repeat a page_id are records of their own: the first by url is the
response.  Records without a ``captured`` column are dated by page_id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from uuid import UUID

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, lookup_join, new_path, stash

NO_ID = 1 << 64
END = "\r\n\r\n"
FIRST = datetime(2020, 1, 1, tzinfo=timezone.utc)


def record_id(page_id: int | None) -> str:
    number = NO_ID if page_id is None else page_id & (NO_ID - 1)
    return f"<urn:uuid:{UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = UUID(record.strip("<>")).int
    if number == NO_ID:
        return None
    return number - NO_ID if number >> 63 else number


def url_key(url: str) -> str:
    """Host parts reversed, then the path: one site's captures sort together."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\.", "", host.lower())
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_head(size: int) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"


def record(page_id, url, html: str, name: str, size: int, date: str, first, revisit: bool) -> str:
    """A record without its closing line ends."""
    url = f"urn:page:{page_id}" if url is None else re.sub(
        r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
    block = http_head(size) + ("" if revisit else html)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {url}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{name}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def write(pages: DataFrame, folder: str, least: int = 0, records: int = 4000) -> None:
    """Writes archives of at most ``records`` records each."""
    columns = ["page_id", "url", "html"] + ["captured"] * ("captured" in pages.columns)
    pages = pages.select(*columns)

    def measure(bits=None):
        def run(batches):
            for b in batches:
                html = [(x or "").encode() for x in b.column(2).to_pylist()]
                names = [digest(x) for x in html]
                mark = np.array([int.from_bytes(base64.b32decode(x)[:8]) for x in names], np.uint64).view(np.int64)
                out = [*b.columns, pa.array(names, pa.string()), pa.array([len(x) for x in html], pa.int64()),
                       pa.array(mark), pa.array(in_bitmap(bits.value, mark) if bits else np.ones(len(mark), bool))]
                yield pa.RecordBatch.from_arrays(out, [*columns, "digest", "size", "mark", "again"])
        return pages.mapInArrow(run, f"{pa_ddl(pages)}, digest string, size long, mark long, again boolean")

    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    first = stash(measure().where(F.col("size") >= least).groupBy("digest", "mark").agg(
        F.min(order).alias("o"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select("digest", "mark", F.col("o.page_id").alias("first"), F.col("o.url").alias("first_url"),
                F.lit(True).alias("known"), "copies"), "digests")
    # only pages whose payload may occur again are shuffled; any other is its own response
    measured = measure(pages.sparkSession.sparkContext.broadcast(bitmap(first, "mark"))).drop("mark")
    again = lookup_join(measured.where("again"), first.drop("mark"), ["digest"], "copies")
    again = (again.withColumn("first", F.when(F.col("known"), F.col("first")).otherwise(F.col("page_id")))
             .withColumn("first_url", F.when(F.col("known"), F.col("first_url")).otherwise(F.col("url"))))
    alone = measured.where("not again").withColumns({"first": F.col("page_id"), "first_url": F.col("url"), "known": F.lit(False)})
    rows = again.unionByName(alone).drop("again", "known")
    names = rows.columns

    def emit(batches):
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                r = dict(zip(names, r))
                same = r["page_id"] == r["first"] and r["url"] == r["first_url"]
                date = r.get("captured") or FIRST + timedelta(seconds=abs(r["page_id"] or 0) % (1 << 31))
                out.append(record(r["page_id"], r["url"], r["html"] or "", r["digest"], r["size"],
                                  date.strftime("%Y-%m-%dT%H:%M:%SZ"), r["first"],
                                  r["size"] >= least and not same))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(emit, "value string").write.option(
        "maxRecordsPerFile", records).text(folder, lineSep=END)


def pa_ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def parse(content: bytes) -> Iterator[dict]:
    """Headers and block limits of the records of an archive, by Content-Length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head | {"start": start, "stop": stop, "at": at}
        at = stop + len(END)


CAPTURE = ("key string, captured string, page_id long, url string, payload_bytes long, "
           "payload_digest string, record_type string, refers_to long, run string, place long")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record read from the archives; each archive is a sorted run."""
    def emit(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                content, rows = content.as_py(), []
                for h in parse(content):
                    block = content[h["start"]:h["stop"]]
                    top = block.index(b"\r\n\r\n") + 4
                    size = int(re.search(rb"Content-Length: (\d+)", block[:top]).group(1))
                    given = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (
                            len(block) - top != size or digest(block[top:]) != given):
                        raise ValueError(f"{name}: damaged record at {h['at']}")
                    ref = h.get("WARC-Refers-To")
                    url = h["WARC-Target-URI"]
                    rows.append((url_key(url), h["WARC-Date"], page_of(h["WARC-Record-ID"]), url,
                                 size, given, h["WARC-Type"], page_of(ref) if ref else None,
                                 name.rsplit("/", 1)[-1], h["at"]))
                rows.sort(key=lambda r: (r[0], r[1], r[-1]))
                yield from _batches(rows)

    return (spark.read.format("binaryFile").load(f"{folder}/part-*").select("path", "content")
            .mapInArrow(emit, CAPTURE))


def _batches(rows: list, size: int = 5000):
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in CAPTURE.split(", ")))
    for i in range(0, len(rows), size):
        cols = zip(*rows[i:i + size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[t]) for c, t in zip(cols, types)], list(names))


def merge_runs(runs: list, key) -> Iterator:
    """k-way merge by a tree of losers: inner nodes keep the loser of their match,
    so the next winner takes one match per level."""
    k = len(runs)
    its = [iter(r) for r in runs]
    done = object()
    head = [next(it, done) for it in its]

    def beats(i: int, j: int) -> bool:
        if head[i] is done or head[j] is done:
            return head[j] is done and (head[i] is not done or i < j)
        a, b = key(head[i]), key(head[j])
        return a < b or (a == b and i < j)

    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    winner = play(1) if k else 0
    while k and head[winner] is not done:
        yield head[winner]
        head[winner] = next(its[winner], done)
        node = (winner + k) // 2
        while node >= 1:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def merged(found: DataFrame) -> DataFrame:
    """The captures in global order of key, time, archive and place: tasks own ranges
    of that order, get each run's part of it in order, and merge the parts.  A
    key of any number of captures is split by time, archive and place."""
    order = ["key", "captured", "run", "place"]

    def emit(batches):
        runs, last = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[8] != last:
                    runs.append([])
                    last = row[8]
                runs[-1].append(row)
        out = []
        for row in merge_runs(runs, lambda r: (r[0], r[1], r[8], r[9])):
            out.append(row)
            if len(out) == 5000:
                yield from _batches(out)
                out = []
        yield from _batches(out)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (found.repartitionByRange(n, *order).sortWithinPartitions("run", "key", "captured", "place")
            .mapInArrow(emit, CAPTURE))


def histories(index: DataFrame) -> DataFrame:
    """First and last capture and their number for each URL key."""
    return index.groupBy("key").agg(F.min("captured").alias("first"), F.max("captured").alias("last"),
                                    F.count(F.lit(1)).alias("captures"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives, reads them, merges the index, stores it, and
    returns the captures from it."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write(pages, folder, least)
    index = stash(merged(stash(captures(spark, folder), "runs")), "capture-index")
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "key", "captured")
