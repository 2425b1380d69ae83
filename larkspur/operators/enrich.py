"""Review enrichment: sentiment, theme, summary, product category and name,
term vectors.  Deterministic stand-ins with the output contract of hosted
models; pass your own ``Column -> Column`` scorer to replace any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import rules, text
from ..functions.numeric import SCORE, percent_of
from ..session import stash
from .dedup import top_n

POSITIVE = ["good", "great", "excellent", "love", "loved", "loves", "perfect", "amazing",
            "awesome", "best", "nice", "happy", "recommend", "works", "fast", "easy",
            "comfortable", "clear", "solid", "sturdy", "reliable", "fantastic", "wonderful",
            "pleased", "satisfied", "worth", "quality", "beautiful", "impressed"]
NEGATIVE = ["bad", "poor", "terrible", "awful", "hate", "hated", "worst", "broke", "broken",
            "cheap", "disappointed", "disappointing", "return", "returned", "refund",
            "defective", "useless", "junk", "waste", "slow", "hard", "fail", "failed",
            "fails", "died", "problem", "problems", "issue", "issues", "uncomfortable",
            "flimsy", "worthless"]

THEME_WORDS = {
    "battery_life": ["battery", "charge", "charging", "charger", "charged", "power"],
    "build_quality": ["build", "built", "plastic", "metal", "sturdy", "flimsy", "solid"],
    "sound_quality": ["sound", "sounds", "audio", "bass", "volume", "noise", "music"],
    "connectivity": ["bluetooth", "wifi", "connect", "connection", "pair", "pairing", "signal"],
    "comfort": ["comfort", "comfortable", "ear", "ears", "fit", "fits", "weight", "wear"],
    "value_for_money": ["price", "value", "money", "cheap", "expensive", "worth", "cost"],
    "customer_service": ["service", "support", "refund", "warranty", "return", "seller"],
    "durability": ["durable", "broke", "broken", "lasted", "last", "months", "died"],
    "ease_of_use": ["easy", "setup", "install", "simple", "instructions", "difficult"],
}
CATEGORY_WORDS = {
    "headphones_earbuds": ["headphone", "headphones", "earbud", "earbuds", "headset"],
    "speakers": ["speaker", "speakers", "soundbar", "subwoofer"],
    "streaming_devices": ["roku", "firestick", "stick", "streaming", "chromecast"],
    "smart_home": ["alexa", "echo", "smart", "thermostat", "doorbell"],
    "cables_adapters": ["cable", "cables", "adapter", "hdmi", "usb"],
    "chargers_batteries": ["charger", "battery", "batteries", "charging"],
    "phone_accessories": ["phone", "case", "iphone", "screen", "protector"],
    "computer_peripherals": ["keyboard", "mouse", "monitor", "laptop", "router"],
    "storage_media": ["drive", "ssd", "sd", "storage", "flash"],
    "cameras_accessories": ["camera", "lens", "tripod", "photo"],
    "tv_accessories": ["tv", "antenna", "mount", "remote"],
    "gaming_accessories": ["xbox", "playstation", "controller", "gaming"],
    "wearables": ["watch", "fitbit", "band", "wrist"],
}


def word_hits(words: Column, vocabulary: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*vocabulary)))


def sentiment(body: Column, positive: list[str] = POSITIVE,
              negative: list[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) words, in [-1, 1]; 0 when
    no polar word occurs or the text is NULL."""
    counts = text.let(text.tokens(body), lambda words: F.struct(
        word_hits(words, positive).alias("pos"), word_hits(words, negative).alias("neg")))
    score = text.let(counts, lambda c: (c["pos"] - c["neg"]) / F.greatest(c["pos"] + c["neg"], F.lit(1)))
    return F.coalesce(F.round(score, 4), F.lit(0.0)).cast(SCORE)


def label_by_words(body: Column, profiles: dict[str, list[str]], fallback: str) -> Column:
    """Label whose words occur most often; the earlier label wins a tie and no
    hit at all gives the fallback."""
    best = text.let(text.tokens(body), lambda words: F.array_max(F.array(*[
        F.struct(word_hits(words, vocabulary).alias("hits"), F.lit(-i).alias("rank"),
                 F.lit(label).alias("label"))
        for i, (label, vocabulary) in enumerate(profiles.items())])))
    return F.coalesce(text.let(best, lambda b: F.when(b["hits"] > 0, b["label"])), F.lit(fallback))


def theme(body: Column, profiles: dict[str, list[str]] = THEME_WORDS) -> Column:
    return label_by_words(body, profiles, vocab.FALLBACK_THEME)


def product_category(body: Column, profiles: dict[str, list[str]] = CATEGORY_WORDS) -> Column:
    return label_by_words(body, profiles, vocab.FALLBACK_CATEGORY)


SENTENCE_END = r"([.!?])\s+"
MARK = "\x01"


def summarise(body: Column, keep: int = 3) -> Column:
    """The ``keep`` sentences with the highest mean word frequency, in their original
    order, all inside the row and by sorting only: words with their sentence are sorted,
    a word occurs as often as its run is long, and those counts are sorted by sentence."""
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    sentences = F.array_remove(F.split(F.regexp_replace(trimmed, SENTENCE_END, "$1" + MARK), MARK), "")

    def runs(array: Column, starts: Callable[[Column], Column], use: Callable[[Column, Column], Column]) -> Column:
        """``use(place, length)`` of every run, given which places start one."""
        firsts = F.filter(F.sequence(F.lit(0), F.size(array) - 1), starts)
        return text.let(firsts, lambda at: F.transform(at, lambda first, j: text.let(
            F.coalesce(F.get(at, j + 1), F.size(array)) - first, lambda n: use(first, n))))

    def places(first: Column, n: Column) -> Column:
        return F.sequence(first, first + n - 1)

    def scored(s: Column) -> Column:
        # the empty word, in each sentence once, stands for the sentence itself
        words = F.flatten(F.transform(s, lambda x, i: F.transform(
            F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))),
            lambda w: F.struct(w.alias("w"), i.alias("i")))))
        return text.let(F.sort_array(words), lambda every: text.let(
            F.sort_array(F.flatten(counts(every))), lambda each: pick(s, means(each))))

    def counts(every: Column) -> Column:
        """Per word the sentence (upper half) and count (lower half, 0 for the empty word)
        of each of its places."""
        def word(k):
            return F.get(every, k)["w"]
        return runs(every, lambda k: (k == 0) | (word(k) != word(k - 1)), lambda first, n: text.let(
            F.when(word(first) == "", 0).otherwise(n).cast("bigint"), lambda times: F.transform(
                places(first, n), lambda k: F.shiftleft(F.get(every, k)["i"].cast("bigint"), 32) + times)))

    def means(each: Column) -> Column:
        def count(k):
            return F.get(each, k).bitwiseAND(F.lit((1 << 32) - 1))
        return runs(each, lambda k: count(k) == 0, lambda first, n: F.when(n == 1, F.lit(0.0)).otherwise(
            F.aggregate(places(first, n), F.lit(0).cast("bigint"), lambda t, k: t + count(k)) / (n - 1)))

    def pick(s: Column, scores: Column) -> Column:
        ranked = F.slice(F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, keep)
        places = F.array_sort(F.transform(ranked, lambda r: r["i"]))
        return F.array_join(F.transform(places, lambda i: F.get(s, i)), " ")

    return text.let(sentences, lambda s: F.when(F.size(s) <= keep, F.array_join(s, " ")).otherwise(scored(s)))


def with_summary(df: DataFrame, body: str, length: str = "text_len", over: int = 500,
                 summariser: Callable[[Column], Column] = summarise) -> DataFrame:
    """Summary for long texts, the text itself otherwise."""
    long = F.coalesce(F.col(length) > over, F.lit(False))
    return df.withColumn("review_summary", F.when(long, summariser(F.col(body))).otherwise(F.col(body)))


def enrich_reviews(staged: DataFrame, sentiment_of: Callable[[Column], Column] = sentiment,
                   theme_of: Callable[[Column], Column] = theme,
                   summariser: Callable[[Column], Column] = summarise) -> DataFrame:
    body = F.col("review_text_clean")
    scored = (staged.drop("review_text_full")
              .withColumn("sentiment_score", sentiment_of(body))
              .withColumn("review_theme", theme_of(body)))
    return with_summary(scored, "review_text_clean", summariser=summariser)


def longest_texts(reviews: DataFrame, body: Column, n: int, min_reviews: int,
                  chars: int | None = None, row_id: str = "review_id") -> DataFrame:
    """Per product with enough reviews: count and the n longest texts joined by
    `` | ``.  Where the caller needs only the first ``chars`` of a text, the
    rest is left behind before the shuffle."""
    shown = text.head(body, chars)
    slim = reviews.select("asin", "text_len", F.col(row_id).alias("_id"), shown.alias("_text"))
    longest = top_n(slim, ["asin"], [F.col("text_len").desc_nulls_last(), F.col("_id")], n, "_rn")
    counts = reviews.groupBy("asin").agg(F.count(F.lit(1)).alias("review_count")).where(
        F.col("review_count") >= min_reviews)
    parts = F.array_sort(F.collect_list(F.struct("_rn", "_text")))
    joined = longest.groupBy("asin").agg(parts.alias("_parts"))
    return counts.join(joined, "asin").select(
        "asin", "review_count",
        F.array_join(F.transform("_parts", lambda p: p["_text"]), " | ").alias("sample_text"))


def product_categories(reviews: DataFrame, body: str = "review_text_clean",
                       category_of: Callable[[Column], Column] = product_category,
                       n: int = 3, min_reviews: int = 3, chars: int | None = None,
                       row_id: str = "review_id") -> DataFrame:
    """Category per product from its longest reviews joined, or from the first
    ``chars`` characters of them."""
    samples = longest_texts(reviews, F.col(body), n, min_reviews, chars, row_id)
    return samples.select(
        "asin", "review_count",
        F.trim(F.lower(category_of(text.head(F.col("sample_text"), chars)))).alias("derived_category"),
        rules.confidence_tier(F.col("review_count")).alias("derivation_confidence"))


def product_name_samples(reviews: DataFrame, title: str = "title", body: str = "review_text",
                         n: int = 5, min_reviews: int = 20, chars: int | None = None,
                         row_id: str = "review_id") -> DataFrame:
    snippet = F.concat(F.col(title), F.lit(". "), F.col(body))
    return longest_texts(reviews, snippet, n, min_reviews, chars, row_id).drop("review_count")


def product_names(reviews: DataFrame, raw: str = "title", min_reviews: int = 20) -> DataFrame:
    """Name per product: its most frequent raw title, split into brand and
    product.  Titles are counted before any per-product choice is made."""
    counts = reviews.groupBy("asin", raw).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("asin").agg(F.sum("_n").alias("_total")).where(
        F.col("_total") >= min_reviews)
    best = top_n(counts.where(F.col(raw).isNotNull()), ["asin"],
                 [F.col("_n").desc(), F.col(raw)], 1).join(totals, "asin", "left_semi")
    brand, product = rules.split_name(F.col(raw))
    return best.select("asin", F.trim(raw).alias("raw_product_name"), brand.alias("brand"),
                       product.alias("product_name"))


def term_vectors(docs: DataFrame, body: str, features: int = 1024, doc_id: str = "review_id") -> DataFrame:
    """Hashed term vectors, weighted by inverse document frequency and scaled to unit
    length, as ``embedding array<float>``.  The cell of a term is its md5 modulo
    ``features``, which is also the most rows the document frequencies can have."""
    cell = F.expr(f"cast(conv(substr(md5(cast(term as binary)), 1, 8), 16, 10) as bigint) % {features}")
    words = docs.select(F.col(doc_id).alias("_id"), F.explode(
        text.tokens(F.coalesce(F.col(body), F.lit("")), r"[^\p{L}\p{N}]+")).alias("term"))
    counts = stash(words.groupBy("_id", cell.alias("cell")).agg(F.count(F.lit(1)).alias("tf")), "cells")
    total = docs.count()
    idf = counts.groupBy("cell").agg(F.ln((total + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "cell").select("_id", "cell", (F.col("tf") * F.col("idf")).alias("w"))
    # in the order of cells, so that sums do not depend on task order
    filled = weighted.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("_cells"))
    norm = F.sqrt(F.aggregate("_cells", F.lit(0.0), lambda t, c: t + c["w"] * c["w"]))
    unit = filled.withColumn("_norm", norm).select("_id", F.when(F.col("_norm") > 0, F.map_from_entries(F.transform(
        "_cells", lambda c: F.struct(c["cell"], c["w"] / F.col("_norm"))))).alias("_map"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.coalesce(
        F.try_element_at(F.col("_map"), i.cast("bigint")), F.lit(0.0)).cast("float"))
    return (docs.join(unit, F.col(doc_id) == F.col("_id"), "left").withColumn("embedding", dense)
            .drop("_id", "_map"))


def complaint_breakdown(reviews: DataFrame, body: str = "review_text",
                        groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Percent of a product's negative reviews per overlapping word group."""
    groups = groups or vocab.COMPLAINT_GROUPS
    low = reviews.where(F.col("rating") <= 2).withColumn("_low", F.lower(body))
    return low.groupBy("asin").agg(
        *[percent_of(F.coalesce(text.any_contains(F.col("_low"), words), F.lit(False)), 1)
          .alias(f"{name}_pct") for name, words in groups.items()],
        F.count(F.lit(1)).alias("total_negative_reviews"))
