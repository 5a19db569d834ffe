"""The registered queries of the operators and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encode_documents
from .common import table
from .exact_dedup import duplicate_groups
from .html_content import extract_text, labelled_pages, train as train_content
from .importance import resample
from .language_id import held_out, identify, train
from .mixing import plan_mix
from .near_dedup import near_duplicates
from .prefix_trie import prefix_trie
from .quality_rules import CUTOFFS, LEVEL, RISK, judge_quality
from .secrets_scan import find_secrets
from .sharding import interleave
from .token_counts import count_tokens
from .url_filter import judge

#: Listed canonical urls: host, beginning of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = x.doc_id) + (SELECT n FROM sizes WHERE doc_id = y.doc_id) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, m.least) AS component_id,
       d.doc_id = least(d.doc_id, m.least) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON m.a = d.doc_id
""")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs, model, F.col("doc_id")).select(
        F.col("kept").alias("doc_id"), held_out("kept").alias("held_out"), "lang_pred", "score")


@query("""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
digits AS (SELECT doc_id, source, string_split(hex(encode(coalesce(text, ''))), '') AS d FROM documents),
bytes AS (
  SELECT doc_id, source, CASE WHEN len(d) < 2 THEN [] ELSE list_transform(range(1, len(d), 2), lambda i:
    ((strpos('0123456789ABCDEF', d[i]) - 1) * 16 + strpos('0123456789ABCDEF', d[i + 1]) - 1)::BIGINT) END AS b FROM digits),
docs AS (
  SELECT doc_id, coalesce('s' || source, 't') AS source_key, (len(b) + 1)::BIGINT AS size, md5('17:' || coalesce(doc_id::text, 'null')) AS h,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM bytes, crc),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source_key ORDER BY h, doc_id, text_crc32, size) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY source_key)) AS fraction FROM docs),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source_key) - 1 AS position, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 16 // n)::INT AS shard,
  position - ((position * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard, source_key, fraction FROM placed
""")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source_key", "fraction")


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
        "n_layers", "n_unopened")


@query(r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('29:' || coalesce(doc_id::text, 'null')) AS h FROM documents),
sources AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM docs GROUP BY source),
room AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][k % 3 + 1] AS w FROM sources),
filled AS (
  SELECT *, row_number() OVER r AS place, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () * 150 AS every
  FROM room WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
opened AS (SELECT place, caps, rest, every FROM filled WHERE NOT ((every - caps * 100) * w > cap * rest * 100) ORDER BY place LIMIT 1),
targets AS (
  SELECT f.source, f.source_size, f.k, CASE WHEN o.place IS NULL OR f.place < o.place THEN f.cap::double
         ELSE f.w * (f.every / 100.0::double - o.caps) / o.rest END AS target
  FROM filled f LEFT JOIN opened o ON true),
placed AS (
  SELECT d.*, t.source_size, t.k, t.target,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          + size / 2.0::double) AS middle
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle <= target)::int + (middle + source_size <= target)::int END AS readings,
         middle / target AS u, (middle + source_size) / target AS again FROM placed)
SELECT doc_id, size, source_size, target, size * readings AS taken,
       CASE WHEN readings > 0 THEN round(CASE k % 3
         WHEN 0 THEN (sqrt(2.25 - 2 * u) - 1.5) / -1.0 WHEN 1 THEN u ELSE (sqrt(0.25 + 2 * u) - 0.5) / 1.0 END, 6) END AS position,
       CASE WHEN readings > 1 THEN round(CASE k % 3
         WHEN 0 THEN (sqrt(greatest(2.25 - 2 * again, 0)) - 1.5) / -1.0 WHEN 1 THEN again ELSE (sqrt(0.25 + 2 * again) - 0.5) / 1.0 END, 6) END
         AS second_position
FROM counted
""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    out = plan.withColumn("position", F.get("times", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "source_key", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"),
                      F.round(F.get("times", F.lit(1)), 6).alias("second_position"))


@query(r"""
WITH urls AS (
  SELECT page_id, contains(coalesce(url, ''), '://') AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM urls),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_TRIED = ", ".join(f"('{m}', {k}, {c}::DOUBLE)" for m, cs in CUTOFFS.items() for k, c in enumerate(cs))
_PART = RISK / len(CUTOFFS)


@query(rf"""
WITH texts AS (SELECT doc_id, coalesce('s' || lang, 't') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars FROM counted),
long AS (
  UNPIVOT (SELECT doc_id, stratum, base_failed, symbol_share::DOUBLE AS symbol_share, dup_line_share::DOUBLE AS dup_line_share,
    repeat_share::DOUBLE AS repeat_share, mean_word_chars::DOUBLE AS mean_word_chars FROM measured)
  ON symbol_share, dup_line_share, repeat_share, mean_word_chars INTO NAME measure VALUE value),
held AS (SELECT * FROM long WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS (
  SELECT stratum, measure, k, cutoff, count(*) AS n, count(*) FILTER (WHERE value > cutoff) AS rejected
  FROM held JOIN (VALUES {_TRIED}) AS c(measure, k, cutoff) USING (measure) GROUP BY ALL),
chances AS (
  SELECT *, list_sum(list_transform(range(rejected + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
    + j * ln({_PART}::DOUBLE) + (n - j) * ln(1 - {_PART}::DOUBLE)))) AS p, (SELECT count(DISTINCT stratum) FROM held) AS strata FROM tests),
usable AS (
  SELECT *, bool_and(p * strata * {len(CUTOFFS)} <= {LEVEL}) OVER (PARTITION BY stratum, measure ORDER BY k) AS ok FROM chances),
limits AS (SELECT stratum, measure, min(cutoff) AS cutoff FROM usable WHERE ok GROUP BY ALL),
above AS (SELECT DISTINCT doc_id FROM long JOIN limits USING (stratum, measure) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM above) AS kept FROM measured
""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, with_ids=False)


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_CRC32 = """list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"""


def _crc32_of(text: str) -> str:
    """SQL for the CRC-32 of a text, with the table `crc` in reach."""
    digits = f"string_split(hex(encode({text})), '')"
    each = f"""CASE WHEN {text} = '' THEN [] ELSE list_transform(range(1, len({digits}), 2), lambda i:
      ((strpos('0123456789ABCDEF', {digits}[i]) - 1) * 16 + strpos('0123456789ABCDEF', {digits}[i + 1]) - 1)::BIGINT) END"""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"


@query(f"""
WITH crc AS (SELECT {_CRC32} AS t),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
convs AS (
  SELECT s.c, s.c - s.c % 5 AS b, s.n, h, least(h, coalesce(f.n, 0)) AS taken
  FROM (SELECT c, n, {_crc32_of("c::VARCHAR")} % 9 AS h FROM sizes, crc) s LEFT JOIN sizes f ON f.c = s.c - s.c % 5),
turns AS (
  SELECT v.c, o.place AS d, o.turn, o.bytes FROM convs v JOIN own o ON o.c = v.b AND o.place <= v.taken
  UNION ALL SELECT v.c, v.taken + o.place - v.h, o.turn, o.bytes FROM convs v JOIN own o ON o.c = v.c AND o.place > v.h),
paths AS (
  SELECT c, d, bytes, string_agg(sha256(turn), '') OVER (PARTITION BY c ORDER BY d) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs),
ends AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (
  SELECT p.d, p.path, min(p.c) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE e.d = p.d), '')) AS ends_sha256
  FROM paths p JOIN ends e ON e.c = p.c GROUP BY p.d, p.path),
up AS (SELECT x.*, y.conv_id AS parent_conv_id FROM nodes x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.path = left(x.path, 64 * (x.d - 1)::INT)),
kids AS (SELECT d - 1 AS d, left(path, 64 * (d - 1)::INT) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT x.d, x.path, sum((y.n_convs - 1) * y.bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM nodes x JOIN nodes y ON y.d >= x.d AND starts_with(y.path, x.path) LEFT JOIN kids k ON k.d = y.d AND k.path = y.path GROUP BY x.d, x.path)
SELECT u.conv_id, u.d AS depth, u.parent_conv_id, u.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, u.ends_sha256
FROM up u JOIN below b USING (d, path) LEFT JOIN kids k USING (d, path)
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def _lower_words(column: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@query(f"""
WITH crc AS (SELECT {_CRC32} AS t),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_lower_words("text")} AS w FROM documents),
wanted AS (SELECT {_lower_words("text")} AS w FROM benchmark),
mine AS (SELECT r, unnest(w) AS word FROM docs),
theirs AS (SELECT unnest(w) AS word FROM wanted),
hashed AS (SELECT word, {_crc32_of("word")} % 10000 AS bucket FROM (SELECT word FROM mine UNION SELECT word FROM theirs), crc),
counted AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
    SELECT bucket, count(*) AS s, 0 AS t FROM mine JOIN hashed USING (word) GROUP BY bucket
    UNION ALL SELECT bucket, 0, count(*) FROM theirs JOIN hashed USING (word) GROUP BY bucket) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE))) AS gain FROM counted),
weighed AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM mine JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, r, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, 10 * count(*) OVER () // 100 AS drawn
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
""")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The tables' pages hold their main text in an article of headings and paragraphs, with few character references.
@query(r"""
WITH inner_html AS (SELECT page_id, url, row_number() OVER () AS r, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (SELECT r, unnest(regexp_split_to_array(a, '</?(?:p|h1)>')) AS b, generate_subscripts(regexp_split_to_array(a, '</?(?:p|h1)>'), 1) AS i FROM inner_html),
plain AS (
  SELECT r, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
    chr(160), ' '), '\s+', ' ', 'g')) AS t FROM blocks),
joined AS (SELECT r, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM plain WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM inner_html LEFT JOIN joined USING (r)
""")
def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = train_content(labelled_pages(pages, table(spark, sf_dir, "documents")))
    return extract_text(pages, model)
