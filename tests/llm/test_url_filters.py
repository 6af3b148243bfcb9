import random
import re

from wiretide.llm import url_filters


def brute(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for own, start, verdict in rules:
        own = own.lower()
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            rank = len(own + start), len(own), verdict
            if best is None or rank > best[0]:
                best = rank, own + start, verdict
    return host, path, best and best[1], best[2] if best else default


def test_sweep_equals_all_pairs(spark):
    dice = random.Random(5)
    labels, parts = ["a", "b", "ab", "com", "x-y"], ["/", "/en/", "/en/a", "/fr/", "", "/e"]
    host = lambda: ".".join(dice.choice(labels) for _ in range(dice.randint(1, 4)))
    rules = list({(host(), dice.choice(parts)): dice.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"{dice.choice(['http', 'https'])}://{host()}{dice.choice(parts)}{dice.choice(['', 'x', '?q=/en/', '#/fr/'])}" for _ in range(700)]
    urls += ["http://a.com/en/x"] * 500 + [None, "", "no scheme", "x://", "://A.COM/EN/", "http://com?x://b/", "http://.com./", "http://é.com/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string").repartition(6)
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for cuts in (1, 4):
        url_filters.CUTS = cuts
        got = url_filters.judge(pages, table).select("row.page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got)) == sorted((k, *brute(u, rules, "allow")) for k, u in enumerate(urls))


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filters.judge(pages, rules).collect() == []
    one = spark.createDataFrame([(None, "http://a.b/")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge(one, rules, default="block").collect()] == ["block"]
