import random

from pyspark.sql import functions as F

from eventloom.llm.url_filter import _key, bloom_blocks, judge, maybe_listed

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b", "", "block"), ("x.org", "/fr", "block")]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_plain_rules(spark):
    rnd = random.Random(4)
    hosts = ["net", "example.net", "EXAMPLE.net", "m.example.net", "badexample.net", "example.com", "org", "x.org", "y.x.org", "a.b", "z.a.b",
             "user@net", "net:80", "", "..net", "É.org", "a" * 500 + ".net"]
    paths = ["", "/", "/en/", "/en", "/de/1?x=/fr/", "/fr/#a", "/fr", "?q=://x", "#://", "/en//", "/fr/é", "//"]
    urls = [rnd.choice(["http://", "https://", "", "://", "x:"]) + h + p for h in hosts for p in paths] + [None, "", "http://a://net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")],
                                  "page_id long, url string, host string, _key string").repartition(3)
    entries = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = judge(pages, entries).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], RULES), urls[r.page_id]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("_host"), F.lit("/").alias("_path")).withColumn("_key", _key())
    other = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("_host"), F.lit("/").alias("_path")).withColumn("_key", _key())
    blocks = bloom_blocks(listed, 94).cache()
    assert maybe_listed(listed, blocks, 94).count() == 3000
    assert maybe_listed(other, blocks, 94).count() < 400


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    entries = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judge(pages.limit(0), entries).count() == 0
    assert [(r.rule, r.verdict) for r in judge(pages, entries.limit(0)).collect()] == [(None, "allow")]
