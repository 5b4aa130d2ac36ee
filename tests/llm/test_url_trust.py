import pytest

from cellweave.llm import url_trust

RULES = [("com", "/", "com/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
         ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("net", "/es/", "net/es/", "block"),
         ("net", "/fr/", "net/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    cut = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min(cut, default=len(rest))]


def ruled(host, path):
    fit = [(len(r), r, v) for h, p, r, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://A.COM", "http://a.com/", "https://Example.com/en/x?y#z", "x://www.example.com/en/",
        "http://x.www.example.com/en/1", "http://notexample.com/en/", "http://e.net/es/", "http://e.net/fr", "http://net/fr/q",
        "http://a.org?u=http://b.com/", "http://a.org#/es/", "http:///en/", "a://b://c/d", "http://É.com/en/\n?x"]


def brute(pages, edges, damping=0.85, rounds=200):
    hosts = sorted({p[0] for p in pages} | {h for e in edges for h in e})
    mean = lambda h, f: sum(f(v) for g, v in pages if g == h) / max(1, sum(g == h for g, _ in pages))
    good = {h: mean(h, lambda v: float(v == "allow")) for h in hosts}
    bad = {h: mean(h, lambda v: float(v == "block")) for h in hosts}
    def run(seed, pairs):
        out = {}
        for a, _ in pairs:
            out[a] = out.get(a, 0) + 1
        rank = dict(seed)
        for _ in range(rounds):
            got = dict.fromkeys(hosts, 0.0)
            for a, b in pairs:
                got[b] += rank[a] / out[a]
            rank = {h: (1 - damping) * seed[h] + damping * got[h] for h in hosts}
        return rank
    return run(good, edges), run(bad, [(b, a) for a, b in edges])


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    for r in url_trust.judge(pages).collect():
        host, path = split(URLS[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.com/", link("a.org", "b.org")), (2, "http://bad.net/es/", link("good.com")),
            (3, "http://farm.org/x", link("bad.net", "bad.net", "BAD.net", "farm.org")), (4, "http://a.org/", link("b.org", "good.com")),
            (5, "http://farm.org/x", None), (5, "http://farm.org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_trust.judge(pages, tolerance=1e-8).collect()}
    marks = [("good.com", "allow"), ("bad.net", "block"), *[("farm.org", None)] * 3, ("a.org", None)]
    edges = [("good.com", "a.org"), ("good.com", "b.org"), ("bad.net", "good.com"), *[("farm.org", "bad.net")] * 3,
             ("a.org", "b.org"), ("a.org", "good.com")]
    trust, distrust = brute(marks, edges)
    for h in got:
        assert got[h].trust == pytest.approx(trust[h], rel=1e-6) and got[h].distrust == pytest.approx(distrust[h], rel=1e-6)
    assert got["farm.org"].verdict == "block" and got["a.org"].verdict == "allow"


def test_ranks_stand_still_before_they_are_returned(spark):
    """A ring of hosts passes trust around for long; a host that nothing reaches is allowed."""
    link = lambda h: f'<a href="http://{h}/x">'
    ring = [f"h{i}.org" for i in range(5)]
    rows = [(i, f"http://{h}/", link(ring[(i + 1) % 5]) + (link("good.com") if i == 2 else "")) for i, h in enumerate(ring)]
    rows += [(10, "http://good.com/", link(ring[0])), (11, "http://alone.org/", None), (None, "http://b.net/fr/" + "x" * 100000, link("h1.org"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_trust.judge(pages, damping=0.6, tolerance=1e-9).collect()}
    edges = [(h, ring[(i + 1) % 5]) for i, h in enumerate(ring)] + [("h2.org", "good.com"), ("good.com", "h0.org"), ("b.net", "h1.org")]
    trust, distrust = brute([("good.com", "allow"), ("b.net", "block"), *[(h, None) for h in (*ring, "alone.org")]], edges, damping=0.6)
    for h in got:
        assert got[h].trust == pytest.approx(trust[h], rel=1e-6) and got[h].distrust == pytest.approx(distrust[h], rel=1e-6)
    assert got["alone.org"].verdict == "allow" and (got["alone.org"].trust, got["alone.org"].distrust) == (0.0, 0.0)
    assert got["b.net"].page_id is None and got["b.net"].verdict == "block" and len(got["b.net"].path) > 100000


def test_share_of_blocked_pages(spark):
    """A host is suspect by its own pages where more than half of them are blocked."""
    rows = [(i, f"http://a.net/{p}/", None) for i, p in enumerate(["es", "es", "en"])]
    rows += [(9 + i, f"http://b.net/{p}/", None) for i, p in enumerate(["es", "en", "it"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_trust.judge(pages).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 9: "block", 10: "allow", 11: "allow"}


def test_whole_table_and_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = url_trust.judge(pages).collect()
    assert len(rows) == pages.count()
    url = {r.page_id: r.url for r in pages.collect()}
    for r in rows:
        assert (r.host, r.path) == split(url[r.page_id]) and r.rule == ruled(r.host, r.path)[0]
    assert url_trust.judge(pages.limit(0)).count() == 0
