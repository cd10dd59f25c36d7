from pathloom.llm.url_filter import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "/x", "block"), ("a.b", "/x", "allow"), (None, "/", "block"), ("b", "", "block")]
URLS = [
    "http://WWW.Example.NET/en/1?x=/de/", "https://example.net/de/1", "http://net", "http://net/", "http://notnet/", "ftp://a.example.com:80/de/", "http://example.com/de/#a", "x://y.org/fr/é",
    "no scheme/en/", "", None, "http://?q", "http://a.b/xyz", "http://c.a.b/y", "a://b://c/d", "http://..net/", "http://example.com/DE/", "http://" + "s." * 300 + "net/" + "p/" * 5000, "http://é.Net/a\nb",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def judged(url):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    rule, verdict = min(fits, key=lambda f: (-len(f[0]), f[1]))
    return host, path, rule, verdict


def test_against_brute_force(spark):
    rows = [(i if i != 3 else None, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, ((r["row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found))) == sorted(map(str, ((i, *judged(u)) for i, u, *_ in rows)))


def test_nothing(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert url_filter(one, rules, default="block").first()["verdict"] == "block"


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
