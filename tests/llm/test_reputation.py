import numpy as np
from dockflow.llm import reputation

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:cut]


def fitting(host, path):
    best = None
    for said, rule in RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = said, rule
    return best


def test_beta_cdf():
    x = np.linspace(0, 1, 200_001)[1:-1]
    for a, b in ((0.3, 2.0), (5.0, 5.0), (80.0, 20.0), (2.0, 0.5), (400.0, 700.0)):
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - (a - 1) * np.log((a or 1) / (a + b)) - (b - 1) * np.log(b / (a + b)))
        for t in (0.2, 0.4, 0.8):
            want = density[x <= t].sum() / density.sum()
            assert abs(reputation.beta_cdf(t, np.array([a]), np.array([b]))[0] - want) < 0.02


def test_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "x://b.net?es/", "x://b.net/es/1", "x://É.com/p", "x://com", "x://notexample.com/en/", "a://b://c.org/d"]
    urls += [f"http://bad{i % 2}.evil.org/{i}" for i in range(60)] + [f"http://h{i % 9}.good.org/{i}" for i in range(90)] + ["http://new.evil.org/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    known = [(u, "evil" in u) for u in urls if u and ("evil" in u and "new" not in u or "good" in u)] + [(None, True), (urls[20], None)]
    outcomes = spark.createDataFrame(known, "url string, bad boolean")
    got = {r["page_id"]: r for r in reputation.judge(pages, outcomes, RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        rule = fitting(host, path)
        assert got[i]["rule"] == (rule and rule[1])
        if rule:
            assert got[i]["verdict"] == rule[0]
        elif "bad" in host:
            assert got[i]["verdict"] == "block"
        elif "good" in host:
            assert got[i]["verdict"] == "allow"
    # a host without labels leans on its domain
    assert got[len(urls) - 1]["rate"] > 0.5 > max(r["rate"] for r in got.values() if "good" in r["host"])


def test_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    no_outcomes = spark.createDataFrame([], "url string, bad boolean")
    assert reputation.judge(none, no_outcomes, RULES).count() == 0
    one = spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/")], "page_id long, url string")
    assert [r["verdict"] for r in reputation.judge(one, no_outcomes, RULES).collect()] == ["allow", "allow"]
