from __future__ import annotations

import random

import pytest

from pairlab.llm import url_rules
from pairlab.llm.queries import URL_RULES

RULES = [
    *URL_RULES,
    ("block", "", "/ads"),
    ("allow", "a.b.net", ""),
    ("block", "b.net", "/x/y"),
    ("block", "b.net", "/x/y/"),
    ("allow", "b.net", "/x/y/z"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path


def expected(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h.split(".")) if h else 0, len(p), v, h + p)
        for v, h, p in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, *((best[3], best[2]) if best else (None, default))


def urls():
    rnd = random.Random(3)
    hosts = ["example.org", "x.example.org", "Fr.COM", "com", "a.b.net", "c.a.b.net"]
    hosts += ["b.net", "xb.net", "org", "notorg", "example.org:80", "", "u@b.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/de/a", "/x/y"]
    paths += ["/x/y/z/1", "/x/yy", "/ads.js", "//", "/é/ü"]
    tails = ["", "?q=/es/", "#/de/", "?a#b", "\n"]
    made = [
        f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}{rnd.choice(tails)}"
        for h in hosts
        for p in paths
    ]
    return [*made, None, "", "no scheme/x", "a://b://c/d", "://", "http://org?x/"]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_all_rules(spark, limit):
    rows = list(enumerate(urls())) + [(None, "http://org/"), (0, "http://a.org/")]
    pages = spark.createDataFrame(
        [(i, u, "x", "y") for i, u in rows],
        "page_id bigint, url string, host string, URL2 string",
    )
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    found = url_rules.judge_urls(pages, table, limit=limit).collect()
    want = [(i, *expected(u, RULES)) for i, u in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge_urls(pages, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert url_rules.judge_urls(one, []).head().verdict == "allow"


def test_equal_rules_block():
    trie = url_rules.Trie([("block", "a.org", "/"), ("allow", "a.org", "/")])
    assert trie.judge("a.org", "/x") == ("a.org/", "block")
