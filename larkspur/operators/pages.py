"""Field extraction from stored product pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: where a product page keeps its fields
PRODUCT_PAGE = {
    "title": r'(?s)id="productTitle"[^>]*>(.*?)</span>',
    "brand": r'(?s)id="bylineInfo"[^>]*>.*?>(.*?)</a>',
    "price_whole": r'class="a-price-whole">([\d,]+)</span>',
    "price_fraction": r'class="a-price-fraction">(\d+)</span>',
    "feature": r'<span class="a-list-item">\s*(.*?)\s*</span>',
    "breadcrumb": r'class="a-link-normal a-color-tertiary"[^>]*>\s*(.*?)\s*</a>',
}


def page_fields(pages: DataFrame, key: str, html: str = "html", patterns: dict[str, str] | None = None,
                max_features: int | None = None, min_chars: int = 10) -> DataFrame:
    """Title, brand, price, feature bullets and breadcrumb of every page that
    has a title.  Patterns can be replaced one by one."""
    p = PRODUCT_PAGE | (patterns or {})
    body = F.col(html)

    def one(name: str):
        return F.nullif(F.trim(F.regexp_extract(body, p[name], 1)), F.lit(""))

    def many(name: str):
        return F.filter(F.transform(F.regexp_extract_all(body, F.lit(p[name]), F.lit(1)), lambda p: F.trim(p)), lambda x: x != "")

    brand = F.regexp_replace(F.regexp_replace(one("brand"), r"^(Visit the |Brand: )", ""), r" Store$", "")
    whole = one("price_whole")
    price = F.when(whole.isNotNull(), F.concat(F.lit("$"), whole, F.lit("."), F.coalesce(one("price_fraction"), F.lit("00"))))
    bullets = F.filter(many("feature"), lambda f: (F.length(f) > min_chars) & ~f.contains("<"))
    return pages.select(F.col(key), one("title").alias("title"), F.trim(brand).alias("brand"), price.alias("price"),
                        (bullets if max_features is None else F.slice(bullets, 1, max_features)).alias("features"),
                        many("breadcrumb").alias("category")).where(F.col("title").isNotNull())
