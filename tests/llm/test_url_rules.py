"""URL rules against a plain restatement."""


from corpusmill.llm import url_rules
from corpusmill.llm.catalog import URL_RULES

URLS = ["http://example.org/es/x", "https://A.Example.ORG/en/12?q", "https://example.org/en/1#f", "http://org", "http://org/", "ftp://x.com/fr/",
        "http://x.com/fr", "http://com/de/y", "http://notexample.org/es/", "//example.org/es/", None, "", "http://", "http://a.b.c.d.example.org/es/",
        "x://Ä.org/", "http://example.org?/es/", "http://x.net/a", "http://example.org/en/1\n", "http://..org/", "a://b://c.com/de/",
        "http://" + "sub." * 500 + "example.org/es/" + "p" * 5000]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[1], "x"), (None, URLS[0], "x")]
    urls = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for given in (URL_RULES, (*URL_RULES, URL_RULES[1], ("example.org", "/es/", "allow"), ("net", "", "block"), (None, "/", "block")), ()):
        rules = spark.createDataFrame(list(given), "host string, path string, action string")
        one = {(h, p): "block" if (h, p, "block") in given else a for h, p, a in given if h is not None}
        got = url_rules.judge_urls(urls, rules).collect()
        assert sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(
            ((str(i), *plain(u, [(h, p, a) for (h, p), a in one.items()])) for i, u, _ in rows), key=str)
    assert url_rules.judge_urls(urls.limit(0), rules).collect() == []


def test_ten_thousand_shapes(spark):
    """Hosts of many depths with paths of many lengths."""
    rules = [(".".join(["a"] * (d % 100 + 1)), "/" + "p" * n, "block" if (d + n) % 3 else "allow") for d in range(100) for n in range(100)]
    urls = [(i, f"http://{'.'.join(['a'] * (i * 7 % 130 + 1))}/{'p' * (i * 11 % 150)}q") for i in range(60)]
    got = url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string"))
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == sorted((i, *plain(u, rules)) for i, u in urls)
