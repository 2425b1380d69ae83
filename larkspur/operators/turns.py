"""Conversation turns and screened questions as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import rules, text
from ..session import stash
from . import phrases
from .dedup import top_n
from .skew import last_before


def vocabulary(summary: DataFrame, metadata: DataFrame, themes: DataFrame,
               max_brands: int | None = None) -> DataFrame:
    """Screening words as (kind, term): categories, brands, themes with spaces.
    All brands, unless ``max_brands`` asks for the first ones by name."""
    brand = F.lower("brand")
    cats = summary.select(F.lit("category").alias("kind"), F.lower("derived_category").alias("term")).distinct()
    brands = metadata.where(F.col("brand").isNotNull() & (F.col("brand") != "")).select(brand.alias("term")).distinct()
    if max_brands is not None:
        brands = brands.orderBy("term").limit(max_brands)
    tops = themes.select(F.lit("theme").alias("kind"),
                         F.replace(F.lower("review_theme"), F.lit("_"), F.lit(" ")).alias("term")).distinct()
    return cats.unionByName(brands.select(F.lit("brand").alias("kind"), "term")).unionByName(tops).where(
        F.col("term").isNotNull())


def topic_pattern(words: DataFrame) -> DataFrame:
    """Categories and themes, which are short fixed lists, as one row with one
    regular expression: category parts and themes match anywhere."""
    quoted = F.regexp_replace("term", r"([\\.\[\]{}()*+?^$|#])", r"\\$1")
    piece = F.when(F.col("kind") == "category", F.replace(quoted, F.lit("_"), F.lit("|"))).otherwise(quoted)
    return words.where(F.col("kind") != "brand").agg(
        F.array_join(F.sort_array(F.collect_set(piece)), "|").alias("topic_pattern"))


def screen(rows: DataFrame, body: str, words: DataFrame, has_history: Column | None = None) -> DataFrame:
    """Adds ``verdict``: the first rule a text fails, else ``allowed``; and
    ``mostly_ascii``, which only warns.  Brands, of which there may be any number,
    are looked for as whole words in the texts that nothing else allows."""
    t = F.col(body)
    q = F.lower(t)
    known = F.broadcast(topic_pattern(words))
    history = F.lit(False) if has_history is None else has_history
    base = text.any_contains(q, vocab.TOPIC_WORDS)
    # an empty vocabulary gives an empty pattern, which would match anything
    named = (F.col("_pattern") != "") & F.expr("rlike(lower(%s), _pattern)" % f"`{body}`")
    verdict = (F.when(F.length(F.trim(t)) < 3, "input_length").when(F.length(t) > 1000, "input_length")
               .when(text.any_pattern(q, vocab.INJECTION_PATTERNS), "prompt_injection")
               .when(text.any_pattern(q, vocab.ABUSE_PATTERNS), "toxicity")
               .when(history | t.rlike(vocab.PRODUCT_ID_PATTERN) | base | named, "allowed")
               .otherwise("off_topic"))
    ascii_chars = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    # stored, so that the row numbers stay the same in the second look
    judged = stash(rows.crossJoin(known.withColumnRenamed("topic_pattern", "_pattern"))
                   .withColumn("verdict", verdict)
                   .withColumn("mostly_ascii", (F.length(t) <= 5) | (ascii_chars >= 0.6 * F.length(t)))
                   .withColumn("_row", F.monotonically_increasing_id()).drop("_pattern"), "judged")
    brands = words.where((F.col("kind") == "brand") & (F.length("term") > 2)
                         & ~F.col("term").isin(vocab.BRAND_STOPWORDS))
    open_rows = judged.where(F.col("verdict") == "off_topic").select("_row", body)
    found = (phrases.occurrences(open_rows, "_row", body, brands).select("_row").distinct()
             .withColumn("_brand", F.lit(True)))
    return (judged.join(found, "_row", "left")
            .withColumn("verdict", F.when(F.col("_brand"), "allowed").otherwise(F.col("verdict")))
            .drop("_row", "_brand"))


def cut(body: Column, chars: int) -> Column:
    return F.concat(F.substring(body, 1, chars), F.when(F.length(body) > chars, "...").otherwise(""))


def recent_context(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", last: int = 4,
                   long: int = 400, short: int = 150) -> DataFrame:
    """Per conversation of two or more turns: its last turns as text.  The last
    assistant turn among them may be longer than the others."""
    slim = turns.select(conv, turn, "role", F.substring("text", 1, long + 1).alias("text"))
    recent = top_n(slim, [conv], [F.col(turn).desc()], last, "_back")
    w = Window.partitionBy(conv)
    mine = F.min(F.when(F.col("role") == "assistant", F.col("_back"))).over(w)
    marked = recent.withColumn("_mine", mine).withColumn("_turns", F.count(F.lit(1)).over(w)).where("_turns >= 2")
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    body = F.when(F.col("_back") == F.col("_mine"), cut(F.col("text"), long)).otherwise(cut(F.col("text"), short))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.concat(who, F.lit(": "), body).alias("l"))))
    return marked.groupBy(conv).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("context"))


def mentioned_ids(turns: DataFrame, pattern: str = vocab.PRODUCT_ID_PATTERN, conv: str = "conv_id",
                  turn: str = "turn", role: str = "assistant") -> DataFrame:
    """Products the assistant named, one row per conversation and product with
    the first turn that did.  Full text, before any cut."""
    found = turns.where(F.col("role") == role).select(
        conv, turn, F.explode_outer(F.array_distinct(text.product_ids(F.col("text"), pattern))).alias("asin"))
    return found.where(F.col("asin").isNotNull()).groupBy(conv, "asin").agg(F.min(turn).alias("first_turn"))


def follow_ups(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", hint_chars: int = 100,
               min_hint: int = 20, sessions: DataFrame | None = None) -> DataFrame:
    """User turns with ``is_follow_up`` and the resolved question: a pronoun or
    a question of three words or fewer takes a hint from the last assistant
    turn longer than 20 characters.  Without one, ``sessions`` (conversation, products,
    brands: arrays of what was discussed, latest last, one row each) may help out."""
    said = F.when((F.col("role") == "assistant") & (F.length("text") > min_hint), F.substring("text", 1, hint_chars))
    hinted = last_before(turns, conv, turn, said, "topic_hint")
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    signal = text.any_contains(padded, [f" {s} " for s in vocab.FOLLOWUP_SIGNALS])
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    is_follow = (F.col(turn) > 0) & (signal | (words <= 3))
    resolved = F.when(is_follow & F.col("topic_hint").isNotNull(), F.concat(
        F.lit("Follow-up on: "), "topic_hint", F.lit(". Question: "), "text"))
    asked = hinted.where(F.col("role") == "user")
    if sessions is not None:
        asked = asked.join(sessions.select(conv, F.col("products").alias("_products"), F.col("brands").alias("_brands")),
                           conv, "left")
        for kind, after in (("_products", "product "), ("_brands", "")):
            last = F.try_element_at(F.col(kind), F.lit(-1)).cast("string")
            before = F.concat(F.lit(f"Regarding {after}"), last, F.lit(": " if after else " products: "), F.col("text"))
            resolved = resolved.when(is_follow & last.isNotNull(), before)
    return (asked.withColumn("is_follow_up", is_follow)
            .withColumn("resolved", resolved.otherwise(F.col("text"))).drop("_products", "_brands"))


def with_intent(rows: DataFrame, body: str = "text") -> DataFrame:
    return rows.withColumn("intent", rules.intent(F.col(body)))


def entities(rows: DataFrame, body: str = "text", categories: list[str] | None = None,
             brands: list[str] | None = None, pattern: str = vocab.PRODUCT_ID_PATTERN) -> DataFrame:
    """Three arrays per row: product ids, categories and known brands named."""
    low = F.lower(body)

    def named(values: list[str]) -> Column:
        return F.array_compact(F.array(*[F.when(low.contains(v.lower()), F.lit(v)) for v in values]))

    return rows.withColumns({
        "product_ids": text.product_ids(F.col(body), pattern),
        "categories": named(categories if categories is not None else vocab.CATEGORIES),
        "brands": named(brands if brands is not None else vocab.KNOWN_BRANDS)})


def review_context(reviews: DataFrame, body: str, k: int, keys: list[str], order: list[Column],
                   chars: int | None = None) -> DataFrame:
    """Per key: the k first reviews as ``- Review (Rating: r/5): text`` lines."""
    shown = F.col(body) if chars is None else F.substring(body, 1, chars)
    line = F.concat(F.lit("- Review (Rating: "), F.col("rating").cast("string"), F.lit("/5): "), shown)
    best = top_n(reviews.withColumn("_line", line), keys, order, k, "_rn")
    lines = F.array_sort(F.collect_list(F.struct("_rn", "_line")))
    return best.groupBy(*keys).agg(F.count(F.lit(1)).alias("review_count"), F.array_join(
        F.transform(lines, lambda x: x["_line"]), "\n").alias("context"))


def stats_block(stats: DataFrame) -> DataFrame:
    """Label statistics (``label_summary`` per asin) as a text block."""
    c = lambda n: F.col(n).cast("string")
    block = F.concat_ws("\n", F.concat(F.lit("PRODUCT: "), c("asin")), F.concat(F.lit("TOTAL REVIEWS: "), c("total_reviews")),
                        F.concat(F.lit("AVERAGE RATING: "), c("avg_rating"), F.lit(" out of 5")),
                        F.concat(F.lit("POSITIVE: "), c("positive_reviews"), F.lit(" ("), c("positive_pct"), F.lit("%)")),
                        F.concat(F.lit("NEGATIVE: "), c("negative_reviews"), F.lit(" ("), c("negative_pct"), F.lit("%)")))
    return stats.select("asin", block.alias("stats_block"))
