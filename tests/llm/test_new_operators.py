"""Merkle manifest, context-tree scores and collocations against brute force, and
strings that a polynomial hash modulo 2^64 confuses."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, collocations, context_tree, decontaminate, jaccard, merkle, multiset_hash, token_store, words

RNG = random.Random(7)
VOCABULARY = ["the", "red", "House", "of", "Ünder", "漢字", "a.b", "x,", "end!", "\t", "42"]
TEXTS = [None, "", "  \n", "A", "the red house the red house", "x" * 20_000, "y " * 4000,
         *[" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(1, 80))) for _ in range(50)]]
TEXTS += TEXTS[-3:] + ["line one\nline two\n"] * 4
SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, grp string, place string, "
          "node long, lot string, phrase string, rank string")


def _row(i, text):
    return (i, [None, "", "s1", "s1", "é"][(i or 0) % 5], [None, "en"][(i or 0) % 2],
            None if i == 3 else len(text or ""), text, "g", "p", 5, "l", "f", "r")


ROWS = [_row(i, t) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[10], ROWS[10], _row(None, "no\nid"), _row(2**40, "far")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


# -------------------------------------------------------------------- merkle

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def tree_of(leaves, arity):
    """Root and, per leaf, its siblings (before, after) upward."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % arity
            run = level[first:first + arity]
            paths[i].append(("".join(run[:p - first]), "".join(run[p - first + 1:])))
            at[i] = p // arity
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(docs, arity):
    by_source = defaultdict(list)
    for r in ROWS:
        cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        now = leaf_of(r, r[4].replace("\n", "") if cut else r[4])
        by_source[(r[1] is not None, (r[1] or "").encode())].append(
            ((r[0] is not None, r[0] or 0), leaf_of(r, r[4]), now, r[0]))
    subs, paths, order = [], [], sorted(by_source)
    for key in order:
        by_source[key].sort()
        sub, path = tree_of([x[1] for x in by_source[key]], arity)
        subs.append(sub)
        paths.append(path)
    root, tops = tree_of(subs, arity)
    want = Counter()
    for key, sub, path, top in zip(order, subs, paths, tops):
        for (_, leaf, now, i), steps in zip(by_source[key], path):
            h = now
            for a, b in steps + top:
                h = H(a, h, b)
            want[(i, leaf, sub, root, H(*[a + b for a, b in steps + top]), h, h == root)] += 1
    got = merkle.manifest(docs, arity, merkle.without_newlines())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_small(docs, empty):
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(docs.where("doc_id = 4"))
    r, = one.collect()
    assert r.root == r.leaf == r.subroot == r.folded_root and r.verified


# -------------------------------------------------------------- context tree

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute_scores(rows, depth):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [(t or "").encode().translate(FOLD) for _, t in rows]
    counts, seen = defaultdict(lambda: [0, 0]), Counter()

    def decisions(b):
        padded = b"\xff" * depth + b + b"\xff"
        for k in range(depth, len(padded)):
            for j in range(8):
                yield padded[k - depth:k], (1 << j) | (padded[k] >> (8 - j)), (padded[k] >> (7 - j)) & 1

    for b, out in zip(texts, held):
        if not out:
            seen.update([*b.split(), b""])
            for context, node, bit in decisions(b):
                for d in range(depth + 1):
                    counts[(context[depth - d:], node)][bit] += 1
    below, weight = defaultdict(float), {}
    for s, node in sorted(counts, key=lambda x: -len(x[0])):
        a, b = counts[(s, node)]
        own = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
        kids, mixed = below[(s, node)], own
        weight[(s, node)] = 1.0
        if len(s) < depth:
            mixed = max(own, kids) + math.log1p(math.exp(-abs(own - kids))) - math.log(2)
            weight[(s, node)] = 1 / (1 + math.exp(min(700, kids - own)))
        if s:
            below[(s[1:], node)] += mixed
    n, v = sum(seen.values()), len(seen)
    for b, out in zip(texts, held):
        total = 0.0
        for context, node, bit in decisions(b):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                key = (context[depth - d:], node)
                if key not in counts:
                    p, rest = p + rest / 2, 0.0
                    break
                c, w = counts[key], weight[key]
                p, rest = p + rest * w * (c[bit] + .5) / (sum(c) + 1), rest * (1 - w)
            total += math.log10(p)
        tokens = [*b.split(), b""]
        yield (out, len(tokens), sum(seen[t] > 0 for t in tokens), n,
               sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in tokens), total)


@pytest.mark.parametrize("depth, lot", [(0, 1 << 20), (3, 2000), (5, 20_000)])
def test_context_tree(docs, depth, lot):
    rows = [(r[0], r[4]) for r in ROWS]
    want = sorted(((str(i), *w) for (i, _), w in zip(rows, brute_scores(rows, depth))), key=repr)
    got = sorted(((str(r[0]), *r[1:]) for r in context_tree.score(docs, depth, lot).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-8)


def test_probabilities_sum_to_one(spark):
    """The model's next-byte probabilities after a context are a distribution."""
    rows = spark.createDataFrame([(1, "abcabcabd", "x")], "doc_id long, text string, source string")
    pool = spark.range(256).select(F.expr("(97 << 16) | (98 << 8) | id").alias("gram"), F.lit(0).cast("long").alias("n"))
    data, limits = words.utf8(pa.array(["abcabcabd"]))
    seen, n = np.unique(context_tree.byte_grams(data, limits, 2)[0], return_counts=True)
    grams = spark.createDataFrame(list(zip(seen.tolist(), n.tolist())), "gram long, n long").unionByName(pool)
    grams = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    model = context_tree.fit(grams, 2)
    got = context_tree.gram_scores(pool, model).agg(F.sum(F.pow(F.lit(10.0), "lp"))).first()[0]
    assert got == pytest.approx(1.0, abs=1e-9)
    assert context_tree.score(rows, 2).count() == 1


def test_context_tree_empty(spark, docs, empty):
    assert context_tree.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "ab")], "doc_id long, text string")
    r, = context_tree.score(only).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0.0)
    assert r.score == pytest.approx(-24 * math.log10(2))


# -------------------------------------------------------------- collocations

def brute_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                counts[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {long[i:i + n] for long, a in some.items() for n in range(2, len(long))
                  for i in range(len(long) - n + 1) if f[long[i:i + n]] <= a}
        best = []
        for p, a in some.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, shard, span", [(2, 2000, 8 << 20, 64 << 20), (3, 5, 500, 700), (40, 9, 2000, 10**6)])
def test_collocations(docs, monkeypatch, least, top, shard, span):
    monkeypatch.setattr(collocations, "RANGE", span)
    monkeypatch.setattr(collocations, "SHARD", shard)
    got = sorted(map(tuple, collocations.collocations(docs, least, top).collect()))
    assert got == brute_phrases([(r[2], r[4]) for r in ROWS], least, top)


def test_collocations_empty(docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


def test_automata_unite_and_split():
    rng = np.random.default_rng(3)
    vocabulary = sorted(f"w{i}".encode() for i in range(9))
    streams = [np.where(rng.random(400) < .1, -1, rng.integers(0, 9, 400)) for _ in range(3)]
    streams = [np.append(s, -1) for s in streams]
    one = collocations.build(vocabulary, np.concatenate(streams), 4)
    many = [collocations.build(vocabulary, s, 4) for s in streams]
    parts = [p for a in many for p in collocations.split(a, 1, a.levels[1][1] % 3)]
    for number in range(3):
        whole = dict(collocations.split(one, 1, one.levels[1][1] % 3))[number]
        joined = collocations.unite([collocations.Automaton.unpack(a.pack()) for n, a in parts if n == number])
        assert joined.words == whole.words and joined.root == whole.root
        # a first-level weight belongs to all ranges below it, so only deeper ones are whole
        for k, (x, y) in enumerate(zip(joined.levels, whole.levels)):
            assert all((a == b).all() for a, b in zip(x[:3 if k else 2], y[:3 if k else 2]))


# ---------------------------------------------------------------------- hash

def probe(length):
    """Two strings that any polynomial modulo 2^64 hashes alike."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module", params=[128, 1024, 2048])
def twins(request, spark):
    a, b = probe(request.param)
    return a, b, spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id long, text string").coalesce(1)


def test_twins_bpe(twins):
    a, b, docs = twins
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    from tokenizers import Tokenizer
    sys_path = "/opt/tokenizers/byte_bpe_50k.json"
    real = Tokenizer.from_file(sys_path)
    for i, text in ((1, a), (2, b)):
        ids = real.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(real.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_twins_elsewhere(spark, twins):
    a, b, docs = twins
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 3, 90).collect()} == {1: 1, 2: 2, 3: 3}
    prints = [r.fingerprint for r in multiset_hash.fingerprints(docs).collect()]
    assert len(set(prints)) == 3
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert hit == {1: 1, 2: 0, 3: 1}
    from tokenizers import Tokenizer
    real = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    ids = {i: real.encode(t, add_special_tokens=False).ids + [2] for i, t in ((1, a), (2, b))}
    got = {r.doc_id: r for r in token_store.round_trip(docs).collect()}
    for i in ids:
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids[i], "<u4").tobytes())


def test_store_does_not_trust_one_hash(monkeypatch):
    real = words.hashes
    monkeypatch.setattr(words, "hashes", lambda d, s, e, seed=0: real(d, s, e, seed) & words.U(3 if not seed else 2**64 - 1))
    store, data = words.Store(), np.frombuffer(b"aa bb cc dd ee ff gg hh", np.uint8)
    start = np.arange(0, 24, 3)

    def encode(chunks):
        return np.ones(len(chunks), np.int64), np.array([c[0] for c in chunks], np.uint32)

    for part in (start[:1], start[1:2], start[2:3], start, start[::-1]):
        n, ids = store.ids(data, part, part + 2, encode)
        assert ids.tolist() == data[part].tolist() and n.tolist() == [1] * len(part)
