import re

from fieldframe.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.com", "", "block"), ("a.com", "", "allow"), ("B.a.com", "/x", "allow"), (None, "/", "block"), ("", "/", "block")]
URLS = ["http://x.example.org/es/1", "https://EXAMPLE.org/en/12?q", "http://notexample.org/en/1", "http://a.b.com/de/", "http://z.com/d",
        "http://a.com/de/x", "ftp://b.a.com/x", "//no.scheme", None, "", "http://", "http://org", "http://org/?a", "http://a.com:80/", "x://y://z/p#f", "http://c.com/fr/\n?"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in RULES:
        h = (h or "").lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), len(h), v == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, v)
    return host, path, best and best[1], best[2] if best else "allow"


def test_against_brute_force_with_many_ranges(spark):
    urls = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 40)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(urls, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 40)}


def test_empty_tables(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge_urls(urls, rules).count() == 0
    one = spark.createDataFrame([(None, "http://a/b"), (None, "http://a/b")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(one, rules).collect()] == ["allow", "allow"]


def test_very_long_urls(spark):
    """Hosts and paths far beyond the length of a boundary key are judged whole."""
    host = ".".join(["sub"] * 20_000) + ".example.org"
    urls = [f"http://{host}/es/{'p' * 300_000}", f"http://{host[1:]}/en/2", f"http://x{host}.com/de/{'é' * 100_000}?q", f"http://{host}x/es/", "http://example.org/es/"] * 3
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES + [(host, "/es/" + "p" * 299_999, "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(table, rules).collect()}
    want = {i: brute(u) for i, u in enumerate(urls)}
    for i in range(0, len(urls), 5):
        want[i] = (*want[i][:2], host + "/es/" + "p" * 299_999, "allow")
    assert got == want
