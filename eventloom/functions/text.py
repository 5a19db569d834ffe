"""Slugs, normal forms and hashes."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .. import vocab

# Characters read as blank besides Unicode white space: the four ASCII separators.
SPACE = r"\s\x1c-\x1f"


def clean(value: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(value), F.lit(""))


def strip(value: Column) -> Column:
    """Trim any white space, not only the plain blank."""
    return F.regexp_replace(value, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def present(value: Column) -> Column:
    """The value as it is, null when empty (blank text is kept)."""
    return F.nullif(value, F.lit(""))


def clean_description(value: Column) -> Column:
    return F.substring(clean(value), 1, vocab.DESCRIPTION_LENGTH)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs in the text, as plain substrings."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def _ascii_part(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if ord(c) < 128)


@lru_cache(maxsize=1)
def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """ASCII parts of compatibility decompositions, from the Unicode database.

    Returns (lower-case characters with one ASCII character, those characters, characters
    of any case with a longer form). Forms are those of the lower-case character; capitals
    left in them separate words, as any character outside a slug does.
    """
    one_from, one_to, longer = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        form = "".join(_ascii_part(c) for c in char.lower())
        if len(form) == 1 and char == char.lower():
            one_from.append(char)
            one_to.append(form)
        elif len(form) > 1:
            longer[char] = "".join("-" if c.isupper() else c for c in form)
    return "".join(one_from), "".join(one_to), longer


def _ranges(codes: list[int]) -> str:
    """Inside of a character class for code points, neighbours joined to ranges."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def _expand(text: Column) -> Column:
    """Spell out characters with longer ASCII forms; only rows that hold any are taken apart.

    The class of these has hundreds of ranges, so text of ASCII and Cyrillic characters only isn't tested with it.
    """
    _, _, longer = _ascii_forms()
    rare = _ranges([ord(c) for c in longer])
    maybe = text.rlike(r"[^\x00-\x7f\x{400}-\x{4ff}]")
    forms = F.str_to_map(
        F.lit("\x01".join(f"{c}\x02{form}" for c, form in longer.items())), F.lit("\x01"), F.lit("\x02")
    )
    pieces = F.regexp_extract_all(text, F.lit(f"[^{rare}]+|[{rare}]"), F.lit(0))
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(forms[p], p)), "")
    return F.when(maybe & text.rlike(f"[{rare}]"), spelled).otherwise(text)


def transliterate(text: Column) -> Column:
    """Lower case with Cyrillic letters spelled in Latin ones."""
    spelled = F.lower(text)
    for letter, latin in vocab.TRANSLIT_MULTI.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(latin))
    source, target = vocab.TRANSLIT_SINGLE
    return F.translate(spelled, source + vocab.TRANSLIT_DROPPED, target)


def slugify(title: Column, date: Column | None = None) -> Column:
    """Url-safe form of a title, with the date appended unless it is the undated marker.

    Every step uses the one before once, so the chain is evaluated once per row.
    """
    one_from, one_to, _ = _ascii_forms()
    latin = F.translate(transliterate(_expand(title)), one_from, one_to)
    plain = F.regexp_replace(latin, r"[^\x00-\x7f]+", "")
    dashed = F.regexp_replace(plain, "[^a-z0-9]+", "-")
    slug = F.substring(F.trim(dashed, F.lit("-")), 1, vocab.SLUG_LENGTH)
    if date is None:
        return slug
    suffix = F.when(date == vocab.ALWAYS, "").otherwise(F.concat(F.lit("-"), date))
    return F.concat(slug, suffix)


def normalize_text(text: Column) -> Column:
    """Lower case, ё as е, punctuation as blanks, single blanks."""
    lowered = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    words = F.regexp_replace(lowered, rf"(?U)[^\p{{L}}\p{{N}}_]+", " ")
    return F.trim(words)


def fingerprint(title: Column, date: Column, venue: Column) -> Column:
    key = F.concat_ws("|", normalize_text(title), date, normalize_text(venue))
    return F.substring(F.sha2(key, 256), 1, 16)


def visible_text(html: Column) -> Column:
    """Text of the page body without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?is)^.*?<body\b[^>]*>", "")
    text = F.regexp_replace(bare, r"(?Us)\s*<[^>]*>\s*", "")
    return strip(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def content_hash(content: Column, visible_only: Column | bool = False) -> Column:
    """SHA-256 of the content, or of its visible text for pages whose markup is unstable."""
    if visible_only is False:
        return F.sha2(content, 256)
    visible = F.sha2(visible_text(content), 256)
    if visible_only is True:
        return visible
    return F.when(visible_only, visible).otherwise(F.sha2(content, 256))


def event_id(city: Column, slug: Column) -> Column:
    return F.concat_ws("-", city, slug)


def plural_ru(n: Column, forms: tuple[str, str, str] = vocab.PLURAL_EVENTS) -> Column:
    """The Russian plural form for a count: one, few or many."""
    one, few, many = forms
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    return (
        F.when(tens.between(11, 14), many)
        .when(ones == 1, one)
        .when(ones.between(2, 4), few)
        .otherwise(many)
    )
