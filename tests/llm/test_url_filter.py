import random

from restate.llm.queries import URL_RULES
from restate.llm.url_filter import judge_urls

RULES = "host string, path string, action string"


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[:min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[2] if best else default)


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr(
        "page_id", "url", "'x' as host", "'y' as rule", "0 as r_host")
    got = judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted(
        ((i, *brute(u, rules)) for i, u in enumerate(urls)), key=lambda t: t[0])


def test_contract_rules(llm):
    check(llm, [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/EN/",
                "https://a.example.com/en/", "https://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/fr/?a", "http://x.net?/fr/", "http://com./", "a://b://c.net/es/",
                "http://user@x.net:80/es/", "http://example.com/en//", "http://É.net/fr/", "http://.com/", "http://x..com/a", "http://net/es/", "x" * 50_000 + "://net/es/" + "d/" * 500], URL_RULES)


def test_general_rules(llm):
    rng = random.Random(1)
    hosts, parts = ["a", "b.a", "c.b.a", "x.a", "a.x", "..a"], ["", "/", "/p", "/p/", "/p/q", "/pq", "/p/q/r", "p"]
    rules = [(rng.choice(hosts), rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(25)] + [("", "/", "block")]
    seen = {}
    for h, p, a in rules:  # of one host and path, block is kept
        seen[h, p] = max(a, seen.get((h, p), ""))
    rules += [(h.upper(), p, a) for (h, p), a in list(seen.items())[:3]]
    urls = [f"s://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    pages = llm.createDataFrame([(i % 90, u) for i, u in enumerate(urls)], "page_id long, url string")  # repeated ids
    got = judge_urls(pages, llm.createDataFrame(rules, RULES), default="none").collect()
    want = [(i % 90, *brute(u, [(h, p, a) for (h, p), a in seen.items()], "none")) for i, u in enumerate(urls)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_null_rules_and_empty_tables(llm):
    pages = llm.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = llm.createDataFrame([], RULES)
    assert judge_urls(pages, none).first().verdict == "allow"
    assert judge_urls(pages.limit(0), none).count() == 0
    assert judge_urls(pages, llm.createDataFrame([(None, "/", "block"), ("b", None, "block")], RULES)).first().rule == "b"


def test_very_long_urls_are_expanded_to_the_depths_of_rules_only(llm):
    deep, wide = "http://a.example.com/" + "x/" * 8000 + "end", "http://" + "s." * 3000 + "example.com/en/"
    rules = [("example.com", "/x/x/x/", "block"), ("com", "/", "allow"), ("a.example.com", "/x/x/x/x/xx", "allow"), ("s.example.com", "", "block")]
    check(llm, [deep, wide, "http://example.com" + "//" * 500], rules)
    check(llm, [deep, wide], [("com", "", "block")])
