import re

from rollcall.llm import url_filter as u
from rollcall.llm.url_filter import RULES, Rule


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    hits = []
    for r in rules:
        if r.pattern:
            ok = re.search(".*".join(map(re.escape, r.pattern.split("*"))), host + path, re.S)
        else:
            ok = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        if ok:
            hits.append((len(r.text), r.action == "block", r.text, r.action))
    best = max(hits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://example.com/en/x?y#z", "https://WWW.Example.com/en/", "http://xexample.com/en/1",
    "http://m.example.com/en", "http://x.net/es/1", "http://net/fr/", "http://x.net/esx/", "http://x.net?/es/", "http://É.com/À", "ftp://a.com#/x", "http://a\nb.com/x", "http://u:p@a.com:80/en/",
    "http://x.org/a/ads/b.gif", "http://x.org/loads/b.gif", "http://x.org/a/ads", "://example.com/en/ http://b.net/es/", "http://" + "a" * 100_000 + ".com/en/", "http://t.co.uk/", "http://co.uk",
]
MORE = RULES + [Rule("block", pattern="/ads/*.gif"), Rule("block", "co.uk", "/"), Rule("block", "co.uk"), Rule("block", "com", "/À"), Rule("block", pattern="*@*")]


def test_query_against_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(i, x, "own") for i, x in enumerate(URLS * 2)], "page_id int, url string, rule string")
    for rules in (RULES, MORE):
        want = sorted((str(i), *map(str, brute(x, rules))) for i, x in enumerate(URLS * 2))
        for limit in (u.BROADCAST_RULES, 0):
            monkeypatch.setattr(u, "BROADCAST_RULES", limit)
            got = u.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
            assert sorted(tuple(map(str, r)) for r in got) == want
    assert u.judge(pages.limit(0), RULES).count() == 0


def test_rules_are_found_by_whole_tokens():
    assert Rule("block", "b.com", "/en/x").tokens == ["b", "com", "en"]
    assert Rule("block", pattern="*/ads/*x.gif").tokens == ["ads"]
    assert Rule("block", pattern="*").tokens == []
