"""Text expressions: cleaning, joining, redaction, extraction.  All built-ins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def join_title(title: Column, body: Column, separator: str = " ",
               always: bool = False) -> Column:
    """Title and body in one field.  ``always`` keeps the separator even when
    the title is empty (the staging convention); otherwise it is dropped and
    the result trimmed."""
    head, tail = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    if always:
        return F.concat(head, F.lit(separator), tail)
    glue = F.when(head == "", F.lit("")).otherwise(F.lit(separator))
    return F.trim(F.concat(head, glue, tail))


def clean_basic(text: Column) -> Column:
    return apply_rules(text, vocab.BASIC_CLEANING)


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; the whole text by default."""
    return text if chars is None else F.substring(text, 1, chars)


def clean_full(text: Column, max_chars: int | None = None) -> Column:
    """The embedding-side cleaner, over whole texts unless ``max_chars`` is given."""
    return head(F.trim(apply_rules(text, vocab.FULL_CLEANING)), max_chars)


def redact(text: Column) -> Column:
    """Redaction rules in order.  Each regular expression only runs on texts
    holding what it cannot match without (an @, three digits, a scheme)."""
    out = text
    for pattern, tag in vocab.REDACTIONS:
        if "@" in pattern:
            possible = out.contains("@")
        elif "http" in pattern:
            possible = out.contains("http")
        else:
            possible = out.rlike("[0-9]{3}")
        out = F.when(possible, F.regexp_replace(out, pattern, tag)).otherwise(out)
    return out


def escape_html(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def clean_title(raw: Column, max_len: int = 80) -> Column:
    """Drop bracket tags, collapse spaces, strip edges, cut at a word."""
    s = F.regexp_replace(raw, r"\[[^\]]{1,40}\]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s{2,}", " "), r"^[ ,-]+|[ ,-]+$", "")
    head = F.substring(s, 1, max_len)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(s) > max_len, F.concat(cut, F.lit("…"))).otherwise(s)


def tokens(text: Column, pattern: str = r"[^a-z]+") -> Column:
    """Lower-cased words as an array, without empty strings."""
    return F.array_remove(F.split(F.lower(text), pattern), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def product_ids(text: Column, pattern: str = vocab.PRODUCT_ID_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_product_id(text: Column, pattern: str = vocab.PRODUCT_ID_PATTERN) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def preview(text: Column, chars: int = 200) -> Column:
    return F.substring(text, 1, chars)


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def claims(features: Column, min_chars: int = 10, limit: int | None = None) -> Column:
    """Feature list ``a|b|c`` to an array of trimmed claims."""
    parts = F.transform(F.split(features, r"\|"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: F.length(p) > min_chars)
    return kept if limit is None else F.slice(kept, 1, limit)
