import random
import re

from lacuna.llm import urlfilter as U

SITES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def plain(url):
    """Host, path and site rule without any index."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in SITES if host and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def urls():
    rng = random.Random(0)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.net", "xexample.com", "net", "m.x.net", "spam-farm.example.org", "b.org", "com", "", "É.com", "click.b.org"]
    paths = ["/en/", "/en/1", "/en", "/es/a", "/fr/?q", "/EN/", "", "/x/casino/y", "/casinos", "?affiliate=1&campaign=2", "#/en/", "/adserver/z", "/robots.txt", "/q/track", "?u=http://example.com/en/"]
    return [f"{rng.choice(['http', 'HTTPS'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/", "://", "x://example.com/en/" + "a" * 100_000]


def test_against_plain_rules(spark):
    rows = list(enumerate(urls())) + [(0, urls()[0]), (None, "http://net/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS html", "2 AS host", "3 AS rule")
    out = U.judge(df).collect()
    assert len(out) == len(rows)
    rules = [r for r in U.rules_of() if not r.weight]
    for r, (page, url) in zip(sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"])), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        host, path, rule = plain(url)
        assert (r["page_id"], r["host"], r["path"], r["rule"]) == (page, host, path, rule)
        fit = {x.verdict for x in rules if re.search(x.expression, (url or "").lower(), re.DOTALL)}  # every expression, not only candidates
        assert r["verdict"] == (SITES[rule] if rule else "block" if fit == {"block"} else "allow")


def test_index_uses_rarest_tokens():
    rules = U.rules_of()
    index = U.build_index(rules, {"example": 100, "com": 200, "en": 150, "www": 90, "net": 80, "es": 10, "fr": 20})
    assert sorted(rules[k].name for k in index["www"]) == ["www.example.com/en/"]
    assert sorted(rules[k].name for k in index["es"]) == ["net/es/"]
    assert sum(map(len, index.values())) == len(rules)


def test_few_candidates():
    rules = [U.site_rule(f"h{k}.org", "/", "block") for k in range(5000)]
    judge = U.Judge(rules, U.build_index(rules, {"org": 10**6}))
    assert judge("http://a.h17.org/x") == ("a.h17.org", "/x", "h17.org/", "block")
    assert len(judge.candidates("http://a.h17.org/x")) == 1


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
