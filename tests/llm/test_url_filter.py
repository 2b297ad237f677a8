import time

import pytest

from helixlake.llm import url_filter as U

RULES = (*U.RULES, ("allow", "example.org", "/es/ok"), ("block", "a.b", ""), ("allow", "a.b", ""), ("block", "com", "/fr/"))
URLS = ["https://www.example.org/es/x", "http://example.org/es/okay", "http://EXAMPLE.org/en/123?x", "http://example.org/en/", "http://x.com/fr/y#z", "http://com/de/", "http://notexample.org/es/", "http://x.org", "http://x.org?q=/es/", None, "", "no scheme/es/", "http://a.b", "x://a://b.org/c", "http://user.example.org:80/es/", "http:///es/"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("trie_rules", [1_000_000, 2])
def test_matches_brute_force(spark, trie_rules):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, verdict string")
    out = U.filter_urls(df, rules=RULES, trie_rules=trie_rules)
    assert out.count() == len(URLS) + 1
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url


def test_empty_table_and_default(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/" + "y" * 300_000)], "page_id long, url string")
    assert U.filter_urls(one, default="block").first().verdict == "block"


def test_a_long_path_under_a_known_host_takes_no_longer():
    root, began = U.build_trie([*U.RULES, ("block", "x.org", "/a/b")]), time.time()
    assert U.match(root, "x.org", "/" + "y" * 2_000_000)[3] == "org/"
    assert time.time() - began < 1
