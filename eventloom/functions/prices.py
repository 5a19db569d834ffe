"""Price ranges as (price_min, price_max, price_text)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import strip


def _price(low: Column, high: Column, text: Column) -> Column:
    return F.struct(
        low.cast("int").alias("price_min"),
        high.cast("int").alias("price_max"),
        text.cast("string").alias("price_text"),
    )


def price_range(prices: Column) -> Column:
    """Struct for an array of whole prices; nulls are skipped, none at all is unknown."""
    known = F.array_compact(prices)
    low, high = F.array_min(known), F.array_max(known)
    text = (
        F.when(low < high, F.format_string(vocab.PRICE_RANGE, low, high))
        .when(low == 0, vocab.PRICE_FREE)
        .otherwise(F.format_string(vocab.PRICE_FROM, low))
    )
    none = F.coalesce(F.size(known) <= 0, F.lit(True))
    return F.when(none, _price(F.lit(0), F.lit(0), F.lit(vocab.PRICE_UNKNOWN))).otherwise(
        _price(low, high, text)
    )


def whole_price(text: Column) -> Column:
    """A price written as text, cut to whole units; null when it is no number."""
    cleaned = strip(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))
    shaped = F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned)
    return shaped.try_cast("double").try_cast("int")


def price_from_text(text: Column) -> Column:
    """Struct read out of a free price text."""
    shown = strip(text)
    groups = F.regexp_extract_all(shown, F.lit(r"(?U)\d[\d\s]*"), F.lit(0))
    numbers = F.array_compact(
        F.transform(
            groups, lambda g: strip(F.replace(g, F.lit(" "), F.lit(""))).try_cast("int")
        )
    )
    cut = F.substring(shown, 1, vocab.PRICE_TEXT_LENGTH)
    return (
        F.when(
            shown.isNull() | (shown == ""),
            _price(F.lit(0), F.lit(0), F.lit(vocab.PRICE_UNKNOWN)),
        )
        .when(
            F.lower(shown).contains(vocab.PRICE_FREE_STEM),
            _price(F.lit(0), F.lit(0), F.lit(vocab.PRICE_FREE)),
        )
        .when(F.size(numbers) == 0, _price(F.lit(0), F.lit(0), cut))
        .otherwise(_price(F.array_min(numbers), F.array_max(numbers), cut))
    )
