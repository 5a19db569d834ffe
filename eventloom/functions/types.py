"""Types, tags and labels through fixed maps (literal maps: no join, nothing to broadcast)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import contains_any


def literal_map(mapping: dict) -> Column:
    pairs = []
    for key, value in mapping.items():
        pairs.append(F.lit(key))
        pairs.append(F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value))
    return F.create_map(*pairs)


def first_mapped(keys: Column, mapping: dict, default: Column | str) -> Column:
    """The value of the first key that has one."""
    table = literal_map(mapping)
    hits = F.filter(F.transform(keys, lambda k: table[k]), lambda v: v.isNotNull())
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(hits, F.lit(1)), fallback)


def map_type_by_category(keys: Column, mapping: dict) -> Column:
    return first_mapped(keys, mapping, "other")


def map_type_by_schema(types: Column, default: Column | str) -> Column:
    return first_mapped(types, vocab.SCHEMA_TYPE_MAP, default)


def infer_type(text: Column) -> Column:
    """Type of the first keyword group found in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for name, words in vocab.TYPE_KEYWORDS:
        hit = contains_any(low, words)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("other")


def filter_tags(tags: Column, allowed: list[str] = vocab.ALLOWED_TAGS) -> Column:
    """Allowed tags in their order, each once."""
    return F.array_intersect(tags, F.array(*[F.lit(t) for t in allowed]))


def default_tags(event_type: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(literal_map(vocab.DEFAULT_TAGS)[event_type], none)


def fill_tags(tags: Column, event_type: Column) -> Column:
    """The tags, or those of the type when there are none."""
    return F.when(F.size(F.coalesce(tags, F.array())) <= 0, default_tags(event_type)).otherwise(tags)


def type_label(event_type: Column) -> Column:
    return literal_map(vocab.TYPE_LABELS)[event_type]


def venue_type_label(venue_type: Column) -> Column:
    return F.coalesce(
        literal_map(vocab.VENUE_TYPE_LABELS)[venue_type], F.lit(vocab.VENUE_TYPE_FALLBACK)
    )


def type_ordinal(event_type: Column) -> Column:
    """Display position of a type."""
    return literal_map({name: i for i, name in enumerate(vocab.EVENT_TYPES)})[event_type]
