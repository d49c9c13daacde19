import random

import duckdb

from twinbill.llm.queries import URL_FILTER_SQL, URL_RULES, op7_url_filter
from twinbill.llm.url_filter import BloomSize, Rule, bloom_filter, canonical, host, judge, path
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    relation = con.execute(URL_FILTER_SQL)
    names = [d[0] for d in relation.description]
    expected = sorted(tuple(str(x) for x in row) for row in relation.fetchall())
    got = sorted(tuple(str(x) for x in r) for r in op7_url_filter(spark, SMALL).select(*names).collect())
    assert got == expected


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    own, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own), tail[:end]


def _rule(h, p):
    fits = [r for r in URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def _urls(seed, n):
    rng = random.Random(seed)
    hosts = ["www.Example.com", "example.com", "a.example.com", "x.net", "NET", "com", "xcom", "É.net", "example.com.", "u:p@h.net:80", ""]
    paths = ["", "/", "/en/", "/en/1", "/en", "/es/a://b", "/fr/\nq", "//en/", "/ES/1"]
    tails = ["", "?a=/en/", "#x?y", "?://", "?q#r"]
    return [rng.choice(["http://", "", "x://", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(n)]


def _name(h, p):
    return (h[4:] if h.startswith("www.") else h) + p.rstrip("/")


def test_rules_and_list_against_python(spark):
    urls = [*_urls(1, 3000), None, "", "://", "a", "http://x.net/es/" + "long/" * 20000]
    listed = sorted({_name(*_parts(u)) for u in _urls(2, 40)} - {""})
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, block int, w0 int")
    names = spark.createDataFrame([(x,) for x in [*listed, listed[0], None, ""]], "canonical string")
    small = BloomSize(bits_per_url=1)  # a crowded filter, so that the exact join has work
    for size in (BloomSize(), small, BloomSize(broadcast_bytes=0)):
        out = {r.page_id: r for r in judge(pages, names, URL_RULES, size).collect()}
        assert len(out) == len(urls)
        for k, url in enumerate(urls):
            h, p = _parts(url)
            rule, on_list = _rule(h, p), _name(h, p) in listed
            r = out[k]
            assert (r.host, r.path, r.listed) == (h, p, on_list), url
            assert r.rule == (rule.name if rule else None)
            assert r.verdict == (rule.verdict if rule else "block" if on_list else "allow")


def test_hot_urls_and_empty_tables(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.org/x").otherwise(F.concat(F.lit("http://h.org/"), "id")).alias("url")
    )
    listed = spark.createDataFrame([("hot.org/x",)], "canonical string")
    out = judge(pages, listed, [Rule("allow", "zz", "/")])
    assert out.where("verdict = 'block'").count() == 1000 and out.count() == 3000
    assert judge(pages, listed.limit(0), URL_RULES).where("listed").count() == 0
    assert judge(pages.limit(0), listed, ()).count() == 0


def test_filter_has_no_false_negatives(spark):
    names = spark.range(2000).select(F.concat(F.lit("h.org/"), F.col("id")).alias("canonical"))
    rows = bloom_filter(names, 16).collect()
    assert len(rows) == 16 and all(len(r) == 5 for r in rows)
    one = spark.createDataFrame([("HTTPS://WWW.Abc.org/x/?q",)], "url string")
    assert one.select(canonical(host(F.col("url")), path(F.col("url")))).first()[0] == "abc.org/x"
