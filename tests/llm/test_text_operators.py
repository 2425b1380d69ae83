"""Operators on text against brute force, on random and awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from larkspur.llm import (bpe, common, decontaminate, jaccard, multiset_hash, pii, quality, quotes,
                          secret_scan, token_store, warc)

RNG = random.Random(5)
WORDS = ["the", "of", "Ünder", "état", "ab1", "x", "It's", "42", "漢字", "!!", "end."]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = sentence(400)
TEXTS = [None, "", "   \n", "a", "a b", "A B\tc", LONG, LONG, LONG + " tail", "x" * 30_000,
         " ".join(["y"] * 5000), *[sentence(RNG.randint(1, 60)) for _ in range(60)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "clash", "q") for i, t in enumerate(TEXTS)] + [(None, "a b c d", 0, None, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, score string, gid string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k, threshold", [(3, 90), (5, 80), (2, 40)])
def test_jaccard(docs, k, threshold):
    got = rows_of(jaccard.jaccard_components(docs, k, threshold))
    sets = {i: shingles(t, k) for i, t in enumerate(TEXTS)}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= threshold * len(sets[a] | sets[b]) and low[b] < low[a]:
                    low[a] = low[b]
                    changed = True
    assert {i: (len(sets[i]), low[i]) for i in sets} == {
        i: (got[i].n_shingles, got[i].component_id) for i in sets}
    # the row without id, "a b c d", links to "A B c" at 0.4 only
    assert got[None].component_id == (4 if threshold == 40 else None)


def test_jaccard_family_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"z{i}"] + base[i + 1:]) for i in range(0, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(jaccard.jaccard_components(df, 3, 90))
    assert {r.component_id for r in got.values()} == {0}


def test_jaccard_compares_few_of_a_family_below_the_threshold(spark, monkeypatch):
    # 100 copies of one text, each with nine words of its own: none links with another
    # but for two pairs, so there is hardly anything to compare
    rng, base, texts = random.Random(3), [f"w{i}" for i in range(240)], []
    for i in range(100):
        copy = list(base)
        for at in rng.sample(range(0, 240, 4), 9):
            copy[at] = f"z{i}-{at}"
        texts.append(" ".join(copy))
    texts += [texts[7] + " end", "start " + texts[30]]
    compared, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *more: (
        compared.append(pairs.count()), verify(pairs, *more))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(jaccard.jaccard_components(df, 3, 90))
    assert {i: r.component_id for i, r in got.items()} == {**{i: i for i in range(100)}, 100: 7, 101: 30}
    assert sum(compared) <= len(texts)


def test_jaccard_over_many_tasks(spark, docs, monkeypatch):
    once = rows_of(jaccard.jaccard_components(docs, 3, 90))
    monkeypatch.setattr(common, "MEET", 200)
    assert rows_of(jaccard.jaccard_components(docs, 3, 90)) == once


def test_deal(monkeypatch):
    monkeypatch.setattr(common, "MEET", 30)
    rng, types = np.random.default_rng(1), [np.uint64, np.int32]
    key = rng.integers(0, 2**63, 40).astype(np.uint64)[rng.integers(0, 40, 100)]
    value = np.arange(100, dtype=np.int32)
    runs = [(key[i:i + 20], value[i:i + 20]) for i in range(0, 100, 20)] + [(key[:0], value[:0])]
    blocks = list(common._dealt(runs, types, 5))
    assert len(blocks) == 3
    lot_of = {}
    for block in blocks:
        for lot, keys in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
            for k in np.frombuffer(keys, np.uint64):
                assert lot_of.setdefault(k, lot) == lot
    assert 1 < len(set(lot_of.values())) <= 5
    k, v = common._received(blocks, types)
    order = np.argsort(v)
    assert (v[order] == value).all() and (k[order] == key).all()
    assert [len(x) for x in common._received([], types)] == [0, 0]
    assert list(common._dealt([], types, 5)) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 103), (103, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}


def hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                 re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(13, len(v))
            for q in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[q:q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(name))
        out.append((len(w), len(hit), len(ids),
                    hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_winnowing(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    parts = [" ".join(LONG.split()[i:i + n]) for i, n in ((3, 20), (50, 14), (90, 30), (10, 9), (200, 4))]
    items = list(enumerate([*parts, "", "!!", None, parts[0], "zz " + parts[1] + " qq", LONG[:300]]))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.contamination(docs, df))
    for i, want in enumerate(hits(TEXTS, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want, TEXTS[i]
        assert r.contaminated == (want[1] > 0 and 20 * want[1] >= want[0])


def test_winnowing_without_items(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())


def test_secrets(docs, spark):
    key = "q7Rz0Xk2Vb9Lm4Tn8Yw3"
    cases = ["password=token: abcdefgh1 x", 'API_KEY = "abc-12345"', "ſecret=abcdefgh9", "é AKIA" + "A1" * 8,
             "0" * 31 + " " + "0a" * 16, f"see {key}", "sha256-" + "ab1" * 14, "some_long_identifier_name_12",
             "d41d8cd98f00b204e9800998ecf8427e", None, "secret : " + "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = rows_of(secret_scan.scan(df))
    for i, t in enumerate(cases):
        found = []
        for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                             t or "", re.I | re.A):
            found += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert f"random:4:{4 + len(key)}" in got[5].spans
    # the contract's hex span stays behind a digest name; the method adds nothing to it
    assert got[6].spans == "hex:7:49" and got[7].spans == ""
    assert rows_of(secret_scan.redact(df))[5].text == "see [secret]"
    assert secret_scan.redact(docs).columns == docs.columns


def test_encoding_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    letters = "aabe tTsdl \t\n\r\x0b\x1c\x85\xa0 　éñ漢1٣½…😀_=-!'"
    texts = [*TEXTS, "x<|endoftext|> y  <|endoftext|>", "ab=" * 5000,
             *["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 60))) for _ in range(2000)]]
    v, at = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), 0
    for _, n, count, ids in v.encode_column(pa.array(texts)):
        for x in np.split(ids, np.cumsum(count)[:-1]):
            want = library.encode(texts[at] or "", add_special_tokens=False).ids
            assert x.tolist() == want, texts[at]
            assert v.decode(x).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)
            at += 1
    assert at == len(texts)


def test_encoded_rows(docs, empty):
    got = rows_of(bpe.encode(docs))
    assert all(got[i].decoded == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.digests(empty).count() == 0


def test_token_files(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows_of(token_store.round_trip(docs)), 0
    for name, text in [(None, "a b c d"), *enumerate(TEXTS)]:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        r = got[name]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.round_trip(empty).count() == 0


class _Direct:
    """Stands for ``documents``; applies what it is mapped with to batches at hand."""

    def select(self, *_):
        return self

    def mapInArrow(self, emit, _):
        return lambda texts: [np.frombuffer(ids, "<u2").tolist() for b in emit(iter([pa.record_batch(
            [pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])]))
            for ids in b.column(1).to_pylist()]


def test_token_ids_of_parts_of_words():
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    atoms = ["a", "B", "t", "LL", "re", "'", "'S", "don't", "1", "23", "²", ".", ",", "***", "<|endoftext|>", "<|ENDOFTEXT|>",
             "<|", "|>", "\x01", "\0", "\x1c", "\x85", "\xa0", "é", "e\u0301", "\u0301", "\u0338", "=", ">", "ΑΣ", "İ",
             "ſ", "\u212a", "\u037e", ";", "中", "😀", "\u1112", "\u1161", " ", " ", "\n"]
    encode = token_store.token_ids(_Direct())
    for _ in range(60):
        some = RNG.sample([x for x in atoms if RNG.random() < 0.3 or x not in ("\x01", "<|endoftext|>", "<|ENDOFTEXT|>")], 12)
        texts = ["".join(RNG.choice(some) for _ in range(RNG.randint(0, 30))) for _ in range(30)]
        assert encode(texts) == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_token_ids_encode_few_texts(monkeypatch):
    class Counting:
        given = 0

        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **options):
            Counting.given += len(texts)
            return real.encode_batch_fast(texts, **options)

    real, store = token_store._tokenizer(None)
    store.forget()
    monkeypatch.setattr(token_store, "_tokenizer", lambda path: (Counting(), store))
    words = ["".join(RNG.choices("bcdfg", k=9)) for _ in range(640)]
    encode = token_store.token_ids(_Direct())
    assert encode([", ".join(w.title() for w in words) + "!", " ".join(words)])[0][-2:] == real.encode("!").ids + [2]
    assert store.n <= 642 and Counting.given <= 1  # were 1,280 both
    encode([" ".join("é" + w for w in words)])
    assert Counting.given <= 11  # 640 more


def test_packing():
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    control, data = token_store.pack(values)
    assert len(control) == 3 and token_store.unpack(control, data, 9).tolist() == values.tolist()


def test_archives(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "WARC/1.1\r\n\r\nWARC/1.1", "<p>é</p>", "x" * 50_000, "<p>é</p>"]
    urls = ["http://www.B.example.org/z#f", None, "https://a.example.org/q r\n", "http://b.example.org/a"] * 2
    rows = [(10 - i, u, h, "s") for i, (u, h) in enumerate(zip(urls, html))] + [(None, None, "<p>é</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    assert [(r.key, r.captured) for r in sorted(got, key=lambda r: (r.key, r.captured))]
    by = {r.page_id: r for r in got}
    first = {}
    for p, _, h, _ in sorted(rows[:-1]):
        first.setdefault(h or "", p)
    for p, _, h, _ in rows:
        data, owner = (h or "").encode(), first[h or ""]
        r = by[p]
        assert (r.payload_bytes, r.payload_digest) == (
            len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if p == owner else ("revisit", owner))
    assert warc.round_trip(df.where("page_id = -5")).count() == 0


def test_archives_shuffle_repeated_payloads_only(spark, tmp_path, monkeypatch):
    html = [f"page {i}" for i in range(20)] + ["page 3", None, None]
    df = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    joined = []

    def spy(left, *rest):
        joined.extend(r.page_id for r in left.select("page_id").collect())
        return lookup_join(left, *rest)

    lookup_join = warc.lookup_join
    monkeypatch.setattr(warc, "lookup_join", spy)
    for least, revisits in ((0, {20: 3, 22: 21}), (1, {20: 3})):
        joined.clear()
        warc.write(df, str(tmp_path / f"w{least}"), least)
        assert {3, 20} | set(revisits) <= set(joined) and len(joined) < 10
        got = warc.captures(spark, str(tmp_path / f"w{least}")).collect()
        assert len(got) == 23 and {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == revisits


def test_loser_tree():
    for _ in range(200):
        runs = [sorted(RNG.randint(0, 9) for _ in range(RNG.randint(0, 6))) for _ in range(RNG.randint(0, 7))]
        assert list(warc.merge_runs(runs, lambda v: v)) == sorted(v for r in runs for v in r)


def luhn(d):
    v = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(v) <= 255 for v in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m.group()))


def test_personal_data(spark):
    texts = [None, "", *["".join(RNG.choice("a.@1 +-()b9%_2\n é😀5:") for _ in range(RNG.randint(0, 80)))
                         for _ in range(400)],
             *["".join(RNG.choice("0123456789 -.+") for _ in range(RNG.randint(0, 60))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(pii.find(df))
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(personal(t or "").encode()).hexdigest(), t


def test_context_finds_unseen_identifiers(spark):
    seen = [f"write mail a{i}00{i}9@x.org now" for i in range(4)]
    df = spark.createDataFrame(list(enumerate([*seen, "write mail zz12345 now", "page 123456 end"])),
                               "doc_id long, text string")
    got = rows_of(pii.find(df))
    assert got[4].spans == "context:11:18" and got[5].spans == ""


def test_quotes(spark):
    df = spark.createDataFrame(
        [(1, 0, "u", "Hello  World\nsecond line"), (1, 1, "a", "> hello world\nyes"),
         (1, 2, "u", ">> hello world\n> yes\nno"), (1, 3, "u", None), (2, 0, "u", "> nothing\nhi"),
         (None, 1, "u", "> x")], "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.root_turn, r.depth, r.clean_text)
           for r in quotes.conversations(df).collect()}
    assert got == {(1, 0): (None, 0, 0, "Hello  World\nsecond line"), (1, 1): (0, 0, 1, "yes"),
                   (1, 2): (1, 0, 2, "no"), (1, 3): (None, 3, 0, ""), (2, 0): (None, 0, 0, "hi"),
                   (None, 1): (None, 1, 0, "")}
    assert quotes.conversations(df.where("turn = 9")).count() == 0


def test_fingerprints(docs, empty):
    got = multiset_hash.fingerprints(docs, 5).collect()
    order = sorted(range(len(TEXTS)), reverse=True)
    texts = {**dict(enumerate(TEXTS)), None: "a b c d"}
    order.append(None)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(order)
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        want = multiset_hash.edited(text, after)
        assert by[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= by[d].near_edited <= 1 and 0 <= by[d].near_next <= 1
    assert by[6].fingerprint == by[7].fingerprint != by[8].fingerprint
    assert multiset_hash.fingerprints(empty).count() == 0


def test_fingerprints_add_up():
    pack = lambda t: base64.b64decode(multiset_hash.as_text(*multiset_hash.vectors([t]))[0])
    a, b = pack("one two\nthree"), pack("four five six")
    assert multiset_hash.add(a, b) == pack("four five six\nthree\none two")
    assert multiset_hash.add(multiset_hash.add(a, b), b, -1) == a


def test_quality(spark):
    good = [sentence(40) for _ in range(300)]
    bad = [" ".join(w + "***" for w in sentence(40).split()) for _ in range(100)]
    rows = list(enumerate([*good, *bad, None, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = rows_of(quality.score(df, model))
    right = [(got[i].score >= 0.3) == (i < 300) for i in range(400) if got[i].held_out]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.fit(df, labels.where("quality = 1"))["constant"] == 1.0
    assert quality.fit(df, labels.where("quality = 5"))["constant"] == 0.5
