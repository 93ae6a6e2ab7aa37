import itertools
import random
import re

from seqweft.llm.url_queries import RULES
from seqweft.llm.url_rules import judge


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_nested_rules_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["net", "example.net", "a.example.net", "anexample.net", "example.com", "org", "x.y.org", "ORG", "n", "netx", ""]
    paths = ["", "/", "/en/", "/en/1?x", "/de", "/de/2#y", "/fr/3", "?q=/en/", "#/fr/"]
    urls = [f"{s}{h}{p}" for s, h, p in itertools.product(["http://", "x://"], hosts, paths)] + [None, "", "no scheme", "://", "http://a://b/en/"]
    check(spark, urls, RULES)
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:7] for p in ("/", "/en/", "/e", "") if rng.random() < 0.7]
    check(spark, urls, rules)


def test_hot_host_is_spread_and_whole(spark):
    check(spark, ["https://hot.example.net/en/1"] * 500 + [f"https://h{i}.org/fr/" for i in range(50)], RULES)


def test_empty_tables_nulls_and_clashing_columns(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("", "", "block"), ("net", "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/", "h", "k", 7)], "page_id long, url string, host string, key string, part int")
    got = judge(df, rules).collect()
    assert [(r.host, r.rule, r.verdict, r.key, r.part) for r in got] == [("a.net", "net/", "block", "k", 7)]
    assert judge(df.limit(0), rules).count() == 0
    assert [r.verdict for r in judge(df, rules.limit(0), otherwise="block").collect()] == ["block"]
