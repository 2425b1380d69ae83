"""Classification by rule: one ``Column`` in, one label out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def tier(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for bound, label in cuts:
        out = (F.when if out is None else out.when)(value >= bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def quality_tier(text_len: Column) -> Column:
    return tier(text_len, [(500, "high"), (150, "medium")], "low")


def confidence_tier(review_count: Column) -> Column:
    return tier(review_count, [(50, "high"), (10, "medium")], "low")


def rating_label(rating: Column) -> Column:
    return (F.when(rating >= 4, F.lit("Positive")).when(rating == 3, F.lit("Neutral"))
            .otherwise(F.lit("Negative")))


def price_bracket(price: Column, cuts=tuple(vocab.PRICE_CUTS),
                  labels=tuple(vocab.PRICE_LABELS)) -> Column:
    out = None
    for bound, label in zip(cuts, labels):
        out = (F.when if out is None else out.when)(price < bound, F.lit(label))
    return out.when(price >= cuts[-1], F.lit(labels[-1]))


def business_signal(avg_rating: Column, negative_rate: Column) -> Column:
    return (F.when((avg_rating < 3.5) | (negative_rate > 0.30), F.lit("RED"))
            .when((avg_rating < 4.0) | (negative_rate > 0.15), F.lit("YELLOW"))
            .otherwise(F.lit("GREEN")))


def extended_signal(avg_rating: Column, negative_pct: Column, recent_negative: Column,
                    total_negative: Column) -> Column:
    """As above in percent, plus: over 40% of the negatives are recent."""
    return (F.when((avg_rating < 3.5) | (negative_pct > 30), F.lit("RED"))
            .when(avg_rating.between(3.5, 4.0) | negative_pct.between(15, 30)
                  | (recent_negative > total_negative * 0.4), F.lit("YELLOW"))
            .otherwise(F.lit("GREEN")))


def canonical_category(label: Column) -> Column:
    """Free-form label to one of the known categories: exact name, then the
    first known name it contains, then the known variants."""
    c = F.trim(F.replace(F.replace(F.lower(label), F.lit("\n"), F.lit("")), F.lit('"'), F.lit("")))
    out = F.when(c.isin(vocab.CATEGORIES), c)
    for name in vocab.CATEGORIES:
        hit = c.contains(name)
        for variant, target in vocab.CATEGORY_VARIANTS.items():
            if target == name and variant.endswith("_accessories"):
                hit = hit | c.contains(variant)
        out = out.when(hit, F.lit(name))
    for variant, target in vocab.CATEGORY_VARIANTS.items():
        out = out.when(c.contains(variant), F.lit(target))
    return out.otherwise(F.lit(vocab.FALLBACK_CATEGORY))


def split_name(raw: Column) -> tuple[Column, Column]:
    """``Brand - Product`` at the first dash -> (brand, product)."""
    dash = F.instr(raw, "-")
    brand = F.when(dash > 0, F.trim(F.split_part(raw, F.lit("-"), F.lit(1)))).otherwise(F.lit("Unknown"))
    product = F.when(dash > 0, F.trim(F.substr(raw, dash + 1))).otherwise(F.trim(raw))
    return brand, product


def clean_name(raw: Column) -> tuple[Column, Column]:
    """Like ``split_name`` after stripping prefixes; a name of 100 or more
    characters is taken as prose and gives (Unknown, NULL)."""
    s = F.trim(F.replace(raw, F.lit("\n"), F.lit("")))
    s = F.regexp_replace(s, r"^Brand\s*-\s*", "")
    s = F.regexp_replace(s, r"Product Name:\s*", "")
    s = F.regexp_replace(s, r"^Based on.*$", "")
    brand, product = split_name(s)
    short = F.length(s) < 100
    return F.when(short, brand).otherwise(F.lit("Unknown")), F.when(short, product)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def normal_brand(brand: Column) -> Column:
    key = F.lower(F.trim(brand))
    return F.coalesce(_lookup(key, vocab.BRAND_ALIASES), key)


def normal_category(value: Column) -> Column:
    key = F.lower(F.trim(value))
    return F.when(key.isin(vocab.CATEGORIES), key).otherwise(_lookup(key, vocab.CATEGORY_ALIASES))


def normal_theme(value: Column) -> Column:
    key = F.lower(F.trim(value))
    return F.when(key.isin(vocab.THEMES), key).otherwise(_lookup(key, vocab.THEME_ALIASES))


def valid_product_id(value: Column) -> Column:
    """A product id in upper case, NULL for anything that is none."""
    key = F.upper(F.trim(value))
    return F.when(key.rlike(r"^B0[A-Z0-9]{8,}$"), key)


def rating_bound(value: Column) -> Column:
    """A rating bound between 1 and 5, NULL for what is no whole number."""
    number = F.trim(value.cast("string")).try_cast("int")
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), number)))


def intent(text: Column) -> Column:
    q, out, last = F.lower(text), None, None
    for label, words in vocab.INTENT_SIGNALS.items():
        hit = q.contains(words[0])
        for w in words[1:]:
            hit = hit | q.contains(w)
        out = (F.when if out is None else out.when)(hit, F.lit(label))
        last = label
    return out.otherwise(F.lit(last))


def lenient_int(text: Column) -> Column:
    """Text to a whole number, rounding decimals; anything else is NULL."""
    return text.try_cast("decimal(38,0)").try_cast("bigint")


def event_time(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds or a text timestamp -> timestamp_ntz."""
    n = raw.try_cast("decimal(38,0)").try_cast("bigint")
    return (F.when(raw.isNull(), F.lit(None).cast("timestamp_ntz"))
            .when(n.isNull(), raw.try_cast("timestamp_ntz"))
            .when(n >= 1000000000000, F.timestamp_millis(n).cast("timestamp_ntz"))
            .otherwise(F.timestamp_seconds(n).cast("timestamp_ntz")))


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "HIGH", 1).when(severity == "MEDIUM", 2)
            .when(severity == "LOW", 3).otherwise(4))
