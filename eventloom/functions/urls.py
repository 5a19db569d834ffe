"""Urls and domains, by text rules so that a malformed url never fails a job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from .text import strip

# scheme, authority, path, query and fragment of a reference
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, group)


def domain_of(url: Column) -> Column:
    """Lower-case host (with port or user as written) without `www.`; null when there is none."""
    return normalize_domain(F.nullif(_part(F.trim(url), 2), F.lit("")))


def normalize_domain(domain: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(domain), r"^www\.", ""), F.lit(""))


def domain_in_set(domain: Column, domains: list[str]) -> Column:
    """Whether the domain or one of its parents is listed; a listed child never matches its parent."""
    listed = "|".join(re.escape(d) for d in domains)
    return F.coalesce(normalize_domain(domain).rlike(rf"(^|\.)({listed})$"), F.lit(False))


def domain_suffixes(domain: Column) -> Column:
    """The domain and all its parents."""
    labels = F.split(normalize_domain(domain), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def drop_listed_domains(df: DataFrame, domain: str, listed: DataFrame) -> DataFrame:
    """Rows whose domain and parents are all absent from `listed` (one column `domain`).

    For sets too large for a pattern: the distinct domains are exploded to their
    suffixes, so the join sees each domain once however many rows it has.
    """
    blocked = (
        df.select(F.col(domain).alias("_domain")).distinct()
        .withColumn("domain", F.explode(domain_suffixes(F.col("_domain"))))
        .join(listed.select("domain").distinct(), "domain", "left_semi")
        .select("_domain").distinct()
    )
    return df.join(blocked, F.col(domain) == F.col("_domain"), "left_anti")


def has_path(urls: Column, hints: list[str]) -> Column:
    """Whether any url of the array contains one of the hints."""
    return F.exists(
        F.coalesce(urls, F.array().cast("array<string>")), lambda u: _hinted(u, hints)
    )


def _hinted(url: Column, hints: list[str]) -> Column:
    return F.lower(url).rlike("|".join(re.escape(h) for h in hints))


def first_with_path(urls: Column, hints: list[str]) -> Column:
    return F.try_element_at(F.filter(urls, lambda u: _hinted(u, hints)), F.lit(1))


def _remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments and drop empty inner ones."""
    segments = F.split(path, "/")
    count = F.size(segments)
    inner = F.filter(
        segments, lambda s, i: (i == 0) | (i == count - 1) | (s != "")
    )
    walked = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    last = F.element_at(inner, -1)
    closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(closed, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def url_join(base: Column, reference: Column) -> Column:
    """The reference made absolute against the base, dot segments resolved."""
    reference = F.regexp_replace(reference, r"^[\x00-\x20]+|[\t\r\n]", "")
    scheme, host = _part(reference, 1), _part(reference, 2)
    path, query, fragment = _part(reference, 3), _part(reference, 4), _part(reference, 5)
    base_scheme, base_host = _part(base, 1), _part(base, 2)
    base_path, base_query = _part(base, 3), _part(base, 4)
    root = F.concat(base_scheme, F.lit("://"), base_host)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), path)
    )
    needs_walk = merged.rlike(r"//|(^|/)\.{1,2}(/|$)")
    resolved = F.when(needs_walk, _remove_dots(merged)).otherwise(merged)
    tail = lambda part: F.when(F.length(part) > 1, part).otherwise("")
    own_scheme = (scheme != "") & (F.lower(scheme) != F.lower(base_scheme))
    return (
        F.when(reference == "", base)
        .when(own_scheme | ((scheme != "") & (host != "")), reference)
        .when(host != "", F.concat(base_scheme, F.lit(":"), reference))
        .when(
            path == "",
            F.concat(
                root, base_path,
                F.when(F.length(query) > 1, query).otherwise(tail(base_query)), tail(fragment),
            ),
        )
        .otherwise(F.concat(root, resolved, tail(query), tail(fragment)))
    )


def resolve_url(event_url: Column, base: Column) -> Column:
    """Link of one event: absolute links stay, relative ones join the base, junk gives the base."""
    link = strip(event_url)
    host = F.lower(_part(link, 2))
    junk_host = host.rlike(
        r"(^|\.)(" + "|".join(re.escape(h) for h in vocab.JUNK_HOSTS) + ")$"
    )
    return (
        F.when(link.isNull() | link.isin(vocab.JUNK_LINKS), base)
        .when(host == "", url_join(base, link))
        .when(junk_host, base)
        .otherwise(link)
    )


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's redirect link; other links as they are."""
    wrapped = _part(href, 3).endswith("/l/")
    target = F.regexp_extract(_part(href, 4), r"[?&]uddg=([^&]+)", 1)
    decoded = F.try_url_decode(F.nullif(target, F.lit("")))
    return F.when(wrapped, F.coalesce(decoded, href)).otherwise(href)


def percent_encode(text: Column) -> Column:
    """Percent-encoding with blanks as %20 and the marks a browser leaves as they are."""
    encoded = F.url_encode(text)
    for code, mark in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(code), F.lit(mark))
    return encoded
