"""Secret scan: fixed patterns and a token-efficiency test for random strings.

Base kinds are patterns with a length limit: assigned passwords and keys, access
key ids, long hex strings.  The test adds kind ``random``: a run of key characters
with digits and letters that a byte-pair vocabulary cuts into unusually short
tokens (few characters per token), unless it is a known digest or identifier or
overlaps a base span.  Offsets count code points; ends are exclusive.

Defined results: null and empty texts have no spans.  Repeated rows are scanned
one by one.  Very long texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: fixed values of the contract
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: digests in hex or base64 behind the name of their algorithm, uuids, dates and times,
#: plain numbers, and words joined by one kind of separator
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|(?:md5|sha1|sha224|sha256|sha384|sha512)[-=_].+"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9/_=+-]+|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-].*"
    r"|[A-Za-z]*[0-9]{0,6}(?:([-_/])[A-Za-z]*[0-9]{0,6})*)")


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """Vocabulary file of ranks, as tiktoken reads it; by default the byte-level one."""
    import public_tokenizers
    import tiktoken
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: float,
                 path: str | None) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)) or KNOWN.fullmatch(word):
            continue
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if any(s < m.end() and e > m.start() for s, _, e in base[at:at + 8]):
            continue
        # a longer string is measured in parts, so that the merge stays linear
        tokens = sum(len(encoding(path).encode_ordinary(word[i:i + 256]))
                     for i in range(0, len(word), 256))
        if len(word) < ratio * tokens:
            out.append((m.start(), 3, m.end()))
    return out


def spans(text: str | None, ratio: float = 2.4, path: str | None = None):
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, ratio, path))


def as_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, ratio: float = 2.4, path: str | None = None) -> DataFrame:
    """doc_id, counts of base kinds, their digest and all spans of every row.
    ratio: a run with fewer characters per token than this is random."""
    def emit(batches):
        for b in batches:
            rows = [spans(t, ratio, path) for t in b.column(1).to_pylist()]
            count = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            digest = [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()),
                 pa.array([as_text(a) for _, a in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        emit, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, found, by: str = "[secret]") -> str:
    parts, at = [], 0
    for s, _, e in found:
        if s >= at:
            parts += [text[at:s], by]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, ratio: float = 2.4, path: str | None = None) -> DataFrame:
    """``docs``, all columns and rows, with every span in ``text`` replaced."""
    at = docs.columns.index("text")

    def emit(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                found = spans(t, ratio, path)[1] if t else None
                if found:
                    texts[i] = mask(t, found)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(emit, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
