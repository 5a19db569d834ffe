"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical: a host, lower-cased, and the beginning of a path. An entry fits a url
whose host is the entry's or a subdomain of it and whose path begins with the entry's; of several that
fit, the longest decides. So a url is looked up under every host suffix and path prefix that can be
listed, as counted in labels and characters.

Each listed entry sets bits in one block of eight 64-bit words, chosen by its hash; blocks are a table
built by one aggregation. A look-up reads one block. What passes goes to a hash join with the entries
themselves, which removes false positives. Distinct hosts and paths are looked up, not pages.

Nulls and ties: a url that is null or has no `://` has an empty host and path, fits nothing and is
given the default verdict. Entries of equal length are ordered by host. A repeated entry blocks if any
of its verdicts does. Empty tables of pages or entries work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 8
BITS_PER_ENTRY = 16
PROBES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased and the path as written; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _key() -> Column:
    return F.concat("_host", F.lit("\n"), "_path")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "_key"), F.lit(blocks))


def _masks() -> list[Column]:
    """The bits of a key in each of its block's words, from one hash of nine bits for each probe."""
    bits = F.xxhash64(F.lit("bits"), "_key")
    places = [F.shiftrightunsigned(bits, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table (_block, w0..): the bits of all entries (`_key`), combined before the shuffle."""
    marked = entries.select(_block(blocks).alias("_block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks())))
    return marked.groupBy("_block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def maybe_listed(keys: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows of `keys` (with `_key`) whose bits are all set in their block."""
    probed = keys.withColumn("_block", _block(blocks)).join(filter_blocks, "_block")
    hit = F.lit(True)
    for i, mask in enumerate(_masks()):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return probed.filter(hit).select(*keys.columns)


def judge(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id, `host`, `path`, `rule` and `verdict`.

    `entries` has host, path and verdict (`allow` or `block`).
    """
    listed = entries.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("verdict").alias("_verdict"))
    listed = listed.withColumn("_key", _key())
    shape = listed.agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.size(F.split("_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("_path"))).alias("lengths")).first()
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = urls.select("_id", host.alias("_host"), path.alias("_path"))
    blocks = max(1, -(-shape["n"] * BITS_PER_ENTRY // (WORDS * 64)))
    labels = F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    distinct = urls.select("_host", "_path").distinct()
    looked = distinct.select(
        F.col("_host").alias("_of_host"), F.col("_path").alias("_of_path"),
        F.explode(F.filter(labels, lambda n: n <= F.size(F.split("_host", r"\.")))).alias("_labels"))
    looked = looked.select(
        "_of_host", "_of_path", F.expr("substring_index(_of_host, '.', -_labels)").alias("_host"),
        F.explode(F.filter(lengths, lambda n: n <= F.length("_of_path"))).alias("_length"))
    looked = looked.select("_of_host", "_of_path", "_host", F.expr("substring(_of_path, 1, _length)").alias("_path"))
    looked = looked.withColumn("_key", _key())
    possible = maybe_listed(looked.select("_of_host", "_of_path", "_key"), bloom_blocks(listed, blocks), blocks)
    exact = possible.join(listed, "_key")
    rule = F.concat("_host", "_path")
    best = exact.groupBy("_of_host", "_of_path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.col("_host").alias("host"), rule.alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    best = best.select(F.col("_of_host").alias("_host"), F.col("_of_path").alias("_path"), "_best")
    return urls.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
