import random

from util import rows, same_as_sql, saved

from recollect.llm import common, sql
from recollect.llm import url_filter as u

URLS = [
    "http://EXAMPLE.net/en/1", "http://a.b.example.net/de/", "http://example.net", "https://net/", "http://xnet/", "http://shop.example.com/de/x?q=1#f",
    "http://example.com/de", "ftp://sub.org/fr/", "http://sub.org/frx", "no scheme example.net/en/", "", None, "http://", "a://b://c.net/x", "http://casino-win.example.com/en/4",
    "http://m.casino-win.example.com", "http://casino-win.example.net/fr/1", "http://notcasino-win.example.com/x", "http://example.net/en/?x=http://o.org/fr/", "http://ads-track.example.org/fr/1",
    "http://UPPER.ORG/FR/", "http://u@www.hot-x63.EXAMPLE.com:8080/a/../b", "http://hot-x64.example.com/", "http://hot-x63.example.com./", "https://lucky-loans7.example.org?q", "x\n://y.net/\nz",
]


def test_same_as_sql(spark, tmp_path):
    table = spark.createDataFrame([(k, x, "<p>") for k, x in enumerate([*URLS, URLS[0]])], "page_id bigint, url string, html string")
    folder = saved(tmp_path, pages=table)
    same_as_sql(u.op5_url_filter(spark, folder), folder, sql.op5(), ["pages"])


def test_contract_by_hand(spark):
    table = spark.createDataFrame([(k, x) for k, x in enumerate(URLS)], "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as rule", "'z' as key")
    schema = "host string, path string, verdict string"
    found = {r.page_id: r for r in u.judged(table, common.inline_table(spark, u.RULES, schema), u.listed_urls(spark)).collect()}
    said = lambda k: (found[k].host, found[k].path, found[k].rule, found[k].verdict)
    assert said(0) == ("example.net", "/en/1", "example.net/en/", "allow")
    assert said(1) == ("a.b.example.net", "/de/", "net/", "block")
    assert said(2) == ("example.net", "", None, "allow")
    assert said(5) == ("shop.example.com", "/de/x", "example.com/de/", "block")
    assert said(6)[2:] == (None, "allow") and said(7)[2:] == ("org/fr/", "allow") and said(8)[2:] == (None, "allow")
    assert said(9) == ("", "", None, "allow") and said(11) == ("", "", None, "allow")
    assert said(14)[2:] == (None, "block") and found[14].listed == "casino-win.example.com/"
    assert said(15)[3] == "block" and said(16)[2:] == ("net/", "block") and said(17)[3] == "allow" and said(19)[2:] == ("org/fr/", "allow")


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    rng = random.Random(4)
    names = [f"host{rng.random()} /p" for _ in range(3000)]
    listed = spark.createDataFrame([(n,) for n in names[:1000]], "key string")
    asked = spark.createDataFrame([(n,) for n in names], "key string")
    for blocks in (u.BROADCAST_BLOCKS, 0):
        passed = {r[0] for r in u.possible(asked, listed, blocks).collect()}
        assert set(names[:1000]) <= passed and len(passed) < 1000 + 40


def test_empty_lists_and_tables(spark):
    schema = "host string, path string, verdict string"
    none = spark.createDataFrame([], schema)
    table = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id bigint, url string")
    empty = spark.createDataFrame([], "url string, verdict string")
    assert rows(u.judged(table, none, empty), "page_id", "verdict") == [(1, "allow"), (1, "allow")]
    assert u.judged(table.limit(0), none, empty).count() == 0
    nulls = spark.createDataFrame([(None, "block"), ("", "block"), ("no url", "block")], "url string, verdict string")
    assert rows(u.judged(table, none, nulls), "page_id", "verdict") == [(1, "allow"), (1, "allow")]


def test_canonical_urls(spark):
    same = ["http://Host.example:80/a/b", "https://host.example/a//b/", "ftp://me:pw@host.example./a/./c/../b?x=1#y", "HTTP://HOST.EXAMPLE/a/b/#"]
    other = ["http://host.example/a", "http://host.example/b/a", "http://host.example/../b", "http://xhost.example/a/b"]
    table = spark.createDataFrame([(k, x) for k, x in enumerate([*same, "http://sub.host.example/a/b/c/d.html", *other, "http://host.example/a/bc"])], "page_id bigint, url string")
    rules = common.inline_table(spark, [], "host string, path string, verdict string")
    for one in same:
        listed = spark.createDataFrame([(one, "block")], "url string, verdict string")
        assert rows(u.judged(table, rules, listed).where("verdict = 'block'"), "page_id", "listed") == [(k, "host.example/a/b") for k in range(5)]


def test_the_exact_join_removes_false_positives_of_the_filter(spark, monkeypatch):
    # With one bit a key the filter passes many keys that are not listed.
    listed = u.listed_urls(spark)
    assert listed.select("url").distinct().count() == listed.count() == 27648
    table = spark.range(3000).selectExpr("id as page_id", "concat('http://site', id, '.test/x/y') as url")
    monkeypatch.setattr(u, "HASHES", 1)
    rules = common.inline_table(spark, u.RULES, "host string, path string, verdict string")
    asked = u.candidates(table.selectExpr("url", "concat('site', page_id, '.test') as host", "'/x/y' as path"), [1], 3, 1)
    keys = listed.select(u.F.concat(u.F.lit("list "), u.F.substring("url", 8, 99)).alias("key"))
    wrong = u.possible(asked, keys).count()
    assert wrong > 100 and u.judged(table, rules, listed).where("verdict = 'block'").count() == 0


def test_very_long_urls(spark):
    long = ["http://" + "a." * 20_000 + "spam-farm.example.com/x", "http://host.test" + "/seg" * 20_000, "http://spam-farm.example.com" + "/a/.." * 300 + "/b"]
    table = spark.createDataFrame(list(enumerate(long)), "page_id bigint, url string")
    found = u.judged(table, common.inline_table(spark, u.RULES, "host string, path string, verdict string"), u.listed_urls(spark))
    assert rows(found, "page_id", "verdict") == [(0, "block"), (1, "allow"), (2, "block")]
