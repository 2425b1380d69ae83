from collections import Counter
import re
import time
import random
from datetime import datetime

import pytest
from larkspur import vocab
from larkspur.functions import rules, text
from larkspur.operators import enrich, pages
from pyspark.sql import functions as F


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [
    ("Contact john@example.com for help", "Contact [EMAIL_REDACTED] for help"),
    ("Call 555-123-4567 for support", "Call [PHONE_REDACTED] for support"),
    ("SSN 123-45-6789.", "SSN [SSN_REDACTED]."),
    ("card 4111 1111 1111 1111 ok", "card [CARD_REDACTED] ok"),
    ("Visit https://fake-site.com now", "Visit [URL_REMOVED] now"),
    ("This product has a 4.5 star rating.", "This product has a 4.5 star rating."),
    ("", ""), (None, None),
])
def test_redact(spark, raw, want):
    assert one(spark, raw, text.redact) == want


def test_guarded_redaction_equals_plain_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    differing = docs.where(~text.redact(F.col("text")).eqNullSafe(text.apply_rules(F.col("text"), vocab.REDACTIONS)))
    assert differing.count() == 0


def test_cleaners(spark):
    assert one(spark, "a<br>b  https://x.y/z c", text.clean_basic) == "a b c"
    raw = "Great<br />item &#34;x&#34; [[VIDEOID:1 2]] [[ASIN:B0 name]] see www.a.b  end"
    assert one(spark, raw, text.clean_full) == 'Great item ;x; see end'
    assert len(one(spark, "ab" * 6000, text.clean_full)) == 8000


def test_title_styles(spark):
    df = spark.createDataFrame([("T", "b"), ("", "b"), (None, "b")], "t string, b string")
    t, b = F.col("t"), F.col("b")
    rows = df.select(text.join_title(t, b, " ", always=True), text.join_title(t, b, " — "), text.join_title(t, b, ". ")).collect()
    assert [tuple(r) for r in rows] == [("T b", "T — b", "T. b"), (" b", "b", "b"), (" b", "b", "b")]


@pytest.mark.parametrize("raw, want", [
    ("[2-Pack] Cable  USB, ", "Cable USB"), ("short", "short"), (None, None),
    ("word " * 30, ("word " * 16).rsplit(" ", 1)[0] + "…"), ("x" * 90, "x" * 80 + "…")])
def test_clean_title(spark, raw, want):
    assert one(spark, raw, text.clean_title) == want


@pytest.mark.parametrize("raw, want", [
    (None, None), ("1600000000", datetime(2020, 9, 13, 12, 26, 40)),
    ("1600000000000", datetime(2020, 9, 13, 12, 26, 40)), ("2020-09-13 12:26:40", datetime(2020, 9, 13, 12, 26, 40)),
    ("soon", None)])
def test_event_time(spark, raw, want):
    assert one(spark, raw, rules.event_time) == want


@pytest.mark.parametrize("raw, want", [("4", 4), ("4.5", 5), ("n/a", None), (None, None)])
def test_lenient_int(spark, raw, want):
    assert one(spark, raw, rules.lenient_int) == want


@pytest.mark.parametrize("raw, want", [
    ('"Speakers"\n', "speakers"), ("i think camera_accessories", "cameras_accessories"), ("tablet", "computer_peripherals"),
    ("phone-accessories", "other_electronics"), ("wearables and speakers", "speakers")])
def test_canonical_category(spark, raw, want):
    assert one(spark, raw, rules.canonical_category) == want


@pytest.mark.parametrize("raw, want", [
    ("Brand - Amazon - Echo Dot", ("Amazon", "Echo Dot")), ("Product Name: Lamp", ("Unknown", "Lamp")),
    ("Sony - WH-1000", ("Sony", "WH-1000")), ("x" * 120, ("Unknown", None)), (None, ("Unknown", None))])
def test_clean_name(spark, raw, want):
    assert tuple(one(spark, raw, lambda c: F.struct(*[x.alias(n) for x, n in zip(rules.clean_name(c), "bp")]))) == want


def test_tiers_and_signals(spark):
    assert [one(spark, n, rules.quality_tier, "int") for n in (500, 150, 149)] == ["high", "medium", "low"]
    assert [one(spark, n, rules.confidence_tier, "int") for n in (50, 10, 3)] == ["high", "medium", "low"]
    assert [one(spark, n, rules.rating_label, "int") for n in (4, 3, 2)] == ["Positive", "Neutral", "Negative"]
    assert [one(spark, p, rules.price_bracket, "double") for p in (14.99, 15.0, 59.0, 60.0, None)] == [
        *vocab.PRICE_LABELS[:1], vocab.PRICE_LABELS[1], vocab.PRICE_LABELS[2], vocab.PRICE_LABELS[3], None]
    df = spark.createDataFrame([(3.4, 0.0), (4.5, 0.31), (3.9, 0.1), (4.5, 0.16), (4.0, 0.15)], "r double, n double")
    assert [r[0] for r in df.select(rules.business_signal(F.col("r"), F.col("n"))).collect()] == [
        "RED", "RED", "YELLOW", "YELLOW", "GREEN"]


def test_aliases(spark):
    assert one(spark, " Amazon-Basics ", rules.normal_brand) == "amazonbasics"
    assert one(spark, "TV", rules.normal_category) == "tv_accessories"
    assert one(spark, "cars", rules.normal_category) is None
    assert one(spark, "wifi", rules.normal_theme) == "connectivity"


def test_claims(spark):
    raw = "short| long enough claim |" + "|".join(f"claim number {i}" for i in range(9))
    every = ["long enough claim", *[f"claim number {i}" for i in range(9)]]
    assert one(spark, raw, text.claims) == every
    assert one(spark, raw, lambda c: text.claims(c, limit=5)) == every[:5]


def test_escape(spark):
    assert one(spark, "<a href='x'>\"&\"</a>", text.escape_html) == "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;"


def test_sentiment_and_theme(spark):
    assert float(one(spark, "Great sound but broken, bad", enrich.sentiment)) == pytest.approx(-0.3333)
    assert float(one(spark, None, enrich.sentiment)) == 0
    assert one(spark, "The battery and the charger: great battery", enrich.theme) == "battery_life"
    assert one(spark, "nothing here", enrich.theme) == "other"
    assert one(spark, None, enrich.theme) == "other"


def brute_summary(body, keep=3):
    parts = [p for p in re.split(r"(?<=[.!?])[ \t\n\r\f\v]+", body.strip(" \t\n\r\f\v")) if p]
    if len(parts) <= keep:
        return " ".join(parts)
    words = [re.findall(r"\w+", p.lower()) for p in parts]
    often = Counter(w for ws in words for w in ws)
    score = [sum(often[w] for w in ws) / len(ws) if ws else 0.0 for ws in words]
    best = sorted(range(len(parts)), key=lambda i: (-score[i], i))[:keep]
    return " ".join(parts[i] for i in sorted(best))


def test_summary_only_for_long_text(spark):
    body = "Alpha beta gamma. Beta beta alpha. Zeta omega. Alpha alpha beta gamma beta."
    df = spark.createDataFrame([(1, "short. text. a. b.", 20), (2, body, 501), (3, "no length. x", None), (4, None, 900)],
                               "id int, t string, text_len int")
    got = {r.id: r.review_summary for r in enrich.with_summary(df, "t").collect()}
    assert got == {1: "short. text. a. b.", 2: brute_summary(body), 3: "no length. x", 4: None}


def test_summary_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["red ", "Red ", "é ", "a_1 ", "x", "!", ". ", "?\n", ".", "  ", "漢字 "]) for _ in range(rng.randint(0, 120)))
             for _ in range(150)]
    df = spark.createDataFrame([(i, t, 501) for i, t in enumerate(texts)], "id int, t string, text_len int")
    out = enrich.with_summary(df, "t")
    assert {r.id: r.review_summary for r in out.collect()} == {i: brute_summary(t) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and plan.count("Scan") == 1


def test_summary_of_a_long_text_is_quick(spark):
    """100,000 words, most of them different: looking each up in the others takes minutes."""
    rng = random.Random(9)
    body = " ".join(" ".join(rng.choice([f"w{i}x{j}", f"common{j % 7}"]) for j in range(20)) + rng.choice([".", "!", "?"])
                    for i in range(5000)) + " ... ?"
    df = spark.createDataFrame([(1, body, 501)], "id int, t string, text_len int")
    began = time.time()
    assert enrich.with_summary(df, "t").first().review_summary == brute_summary(body)
    assert time.time() - began < 20


def test_parameters_are_checked(spark):
    for given, want in ((" b01g8jo5f2 ", "B01G8JO5F2"), ("B0123", None), ("A01G8JO5F2", None), (None, None)):
        assert one(spark, given, rules.valid_product_id) == want
    for given, want in (("3", 3), (" 9 ", 5), ("-2", 1), ("many", None), (None, None)):
        assert one(spark, given, rules.rating_bound) == want


def test_page_fields(spark):
    html = ('<span id="productTitle" class="x"> Echo \n Dot </span><a id="bylineInfo" href="/s"><b>Visit the Acme Store</a>'
            '<span class="a-price-whole">1,029</span><span class="a-price-fraction">95</span>'
            '<span class="a-list-item"> A long feature line </span><span class="a-list-item">short</span>'
            '<a class="a-link-normal a-color-tertiary" href="#"> Home </a>')
    df = spark.createDataFrame([(1, html), (2, "<p>no title</p>")], "page_id int, html string")
    r, = pages.page_fields(df, "page_id").collect()
    assert (r.title, r.brand, r.price, r.features, r.category) == (
        "Echo \n Dot", "Acme", "$1,029.95", ["A long feature line"], ["Home"])
