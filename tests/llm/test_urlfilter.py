from pyspark.sql import functions as F

from terrastat.llm import urlfilter as U

URLS = [("http://a.example.net/en/x?q=1", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("HTTPS://A.Example.NET/EN/x", "a.example.net", "/EN/x", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("ftp://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://w.org/fr/1://2", "w.org", "/fr/1://2", "org/fr/", "allow"),
        ("http://w.org?/fr/", "w.org", "", None, "allow"),
        ("no scheme.net/", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://É.net\n/a\nb#c", "É.net\n", "/a\nb", None, "allow"), ("http://", "", "", None, "allow")]


def test_hosts_paths_rules(spark):
    rows = [(i, u, "clash") for i, (u, *_) in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = U.filter_urls(pages).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r
    assert U.filter_urls(pages.limit(0)).count() == 0


def shrunk(hosts):
    """Posterior bound per host by plain arithmetic; hosts: (host, domain, suffix, n, bad)."""
    def strength(members):
        seen = [(n, b) for n, b in members if n > 0]
        n = sum(x for x, _ in seen)
        if not n:
            return U.STRENGTH[1]
        m, free = sum(b for _, b in seen) / n, n - sum(x * x for x, _ in seen) / n
        noise = m * (1 - m)
        if noise <= 0 or free <= 0:
            return U.STRENGTH[1]
        between = (sum(x * (b / x - m) ** 2 for x, b in seen) - (len(seen) - 1) * noise) / free
        return min(max(noise / between - 1, U.STRENGTH[0]), U.STRENGTH[1]) if between > 0 else U.STRENGTH[1]

    def rolled(key):
        out = {}
        for h in hosts:
            n, b = out.get(h[key], (0, 0))
            out[h[key]] = (n + h[3], b + h[4])
        return out
    sfx, dom = rolled(2), rolled(1)
    total = sum(h[3] for h in hosts)
    every = sum(h[4] for h in hosts) / total if total else 0
    ss, sd, sh = strength(sfx.values()), strength(dom.values()), strength([h[3:] for h in hosts])
    out = {}
    for h, d, x, n, b in hosts:
        mx = (sfx[x][1] + ss * every) / (sfx[x][0] + ss)
        md = (dom[d][1] + sd * mx) / (dom[d][0] + sd)
        mean = (b + sh * md) / (n + sh)
        out[h] = max(0.0, mean - U.Z * (mean * (1 - mean) / (n + sh + 1)) ** 0.5)
    return out


def test_posterior_against_plain_arithmetic(spark):
    hosts = [("a.bad.com", "bad.com", "com", 40, 40), ("b.bad.com", "bad.com", "com", 0, 0),
             ("www.good.com", "good.com", "com", 50, 1), ("x.shop.co.uk", "shop.co.uk", "co.uk", 6, 3),
             ("lone", "lone", "lone", 2, 0)]
    rows, i = [], 0
    for h, _, _, n, bad in hosts:
        for k in range(max(n, 1)):
            rows.append((i, f"http://{h}/", None if n == 0 else k < bad))
            i += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, out boolean")
    got = {r.host: r for r in U.filter_urls(pages, bad=F.col("out")).collect()}
    want = shrunk(hosts)
    assert all(abs(got[h].bound - w) < 1e-9 for h, w in want.items())
    assert {h for h, r in got.items() if r.verdict == "block"} == {
        h for h, w in want.items() if w >= U.MAX_BAD} >= {"a.bad.com"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", True)], "page_id long, url string, out boolean")
    plan = U.filter_urls(pages, bad=F.col("out"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_suffixes_are_an_input(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.shop.example",), ("net",)], "h string")
    got = {r.h: (r.d, r.s) for r in hosts.select(
        "h", *[c.alias(n) for c, n in zip(U.domains(F.col("h"), ["shop.example"]), "ds")]).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "uk"), "x.shop.example": ("x.shop.example", "shop.example"),
                   "net": ("net", "net")}
