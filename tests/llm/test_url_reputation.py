"""Rules by longest match, shrinkage against a plain computation, odd rows."""

import math

from pyspark.sql import functions as F

from riskfuse.llm import url_reputation as U

PAGES = "page_id long, url string, host int, verdict string"
OUT = "page_id long, bad int"


def test_host_and_path(spark):
    cases = {"http://A.Example.COM/Path?q#f": ("a.example.com", "/Path"), "x://h#f/p": ("h", ""), "a://b://c/d": ("b:", "//c/d"),
             "no scheme/x": ("", ""), None: ("", ""), "": ("", ""), "://h?x/y": ("h", ""), "http://\u00c4X/ \n/z": ("\u00c4x", "/ \n/z")}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    host, path = U.host_and_path(F.col("url"))
    assert {r.url: (r.h, r.p) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == cases


def test_rules(spark):
    urls = {"http://a.net/x": ("net/", "block"), "http://net/": ("net/", "block"), "http://anet/": (None, "allow"), "http://a.net": (None, "allow"),
            "http://example.net/en/1": ("example.net/en/", "allow"), "http://w.example.net/en/": ("example.net/en/", "allow"),
            "http://example.net/en": ("net/", "block"), "http://b.example.com/de/x": ("example.com/de/", "block"),
            "http://example.com/fr/x": (None, "allow"), "https://x.org/fr/": ("org/fr/", "allow"), None: (None, "allow")}
    pages = spark.createDataFrame([(k, u, 0, "clash") for k, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame([], OUT), U.RULES).collect()}
    assert got == dict(enumerate(urls.values()))


def test_domains(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "u@h.org:80": ("h.org", "org"), "local": ("local", "local"), "": ("", "")}
    domain, suffix = U.domain_and_suffix(F.col("h"))
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", domain.alias("d"), suffix.alias("s"))
    assert {r.h: (r.d, r.s) for r in df.collect()} == cases


def test_shrinkage_against_plain_python(spark):
    pages, outcomes = [], []
    for k in range(600):
        domain = f"d{k % 7}.com" if k % 3 else f"e{k % 4}.org"
        pages.append((k, f"http://h{k % 11}.{domain}/", 0, ""))
        if k % 2:
            outcomes.append((k, int(k % 7 < 2 or k % 11 == 1)))
    got = {r.host: r for r in U.host_reputation(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUT)).collect()}
    bad = dict(outcomes)

    def level(groups, above):
        over = sum((k - n * above[g]) ** 2 - n * above[g] * (1 - above[g]) for g, (n, k) in groups.items() if n)
        scale = sum(n * above[g] * (1 - above[g]) * (n - 1) for g, (n, k) in groups.items() if n)
        rho = over / scale
        return 10_000.0 if rho <= 1 / 10_001 else max(0.5, 1 / rho - 1)

    def grouped(key):
        out = {}
        for page_id, url, *_ in pages:
            g = out.setdefault(key(url.split("/")[2]), [0, 0])
            if page_id in bad:
                g[0], g[1] = g[0] + 1, g[1] + bad[page_id]
        return out

    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    s, d, h = grouped(suffix), grouped(domain), grouped(lambda x: x)
    mean = (sum(bad.values()) + 0.5) / (len(bad) + 1)
    up = dict.fromkeys(s, mean)
    strength = level(s, up)
    su = {g: (k + strength * up[g]) / (n + strength) for g, (n, k) in s.items()}
    up = {g: su[suffix(g)] for g in d}
    strength = level(d, up)
    du = {g: (k + strength * up[g]) / (n + strength) for g, (n, k) in d.items()}
    up = {g: du[domain(g)] for g in h}
    strength = level(h, up)
    for g, (n, k) in h.items():
        a, b = k + strength * up[g], n - k + strength * (1 - up[g])
        assert math.isclose(got[g].bad_rate, a / (a + b), abs_tol=2e-6)
        assert math.isclose(got[g].bad_bound, max(0, a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))), abs_tol=2e-6)


def test_bad_host_is_blocked_and_odd_rows_pass(spark):
    pages = [(k, f"http://bad.example.com/{k}", 0, "") for k in range(60)] + [(100 + k, f"http://good{k}.example.com/", 0, "") for k in range(60)]
    outcomes = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(60)] + [(3, 0), (5, None), (None, 1)]
    rows = spark.createDataFrame([*pages, (None, None, 0, ""), (7, "http://bad.example.com/again", 0, "")], PAGES)
    got = U.judge(rows, spark.createDataFrame(outcomes, OUT), []).collect()
    assert len(got) == 122
    assert {r.host for r in got if r.verdict == "block"} == {"bad.example.com"}
    assert U.judge(rows.limit(0), spark.createDataFrame(outcomes, OUT), U.RULES).count() == 0


def test_native(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a.b/", 0, "")], PAGES), spark.createDataFrame([(1, 0)], OUT), U.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_addresses_and_final_dots(spark):
    cases = {"192.168.0.1": ("192.168.0.1", "192.168.0.1"), "10.9.0.1:8080": ("10.9.0.1", "10.9.0.1"), "[::1]:80": ("[::1]", "[::1]"), "example.com.": ("example.com", "com"),
             "a.b.co.uk.": ("b.co.uk", "co.uk"), "1.2.3": ("2.3", "3"), "...": ("", "")}
    domain, suffix = U.domain_and_suffix(F.col("h"))
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", domain.alias("d"), suffix.alias("s"))
    assert {r.h: (r.d, r.s) for r in df.collect()} == cases


def test_suffix_rules_as_a_table(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "gov.uk", "uk", "github.io", "*.ck", "!www.ck", "GitLab.IO ", "", None, "com")], "rule string")
    cases = {"a.gov.uk": ("a.gov.uk", "gov.uk"), "x.a.gov.uk": ("a.gov.uk", "gov.uk"), "b.uk": ("b.uk", "uk"), "me.github.io": ("me.github.io", "github.io"),
             "x.y.z.ck": ("y.z.ck", "z.ck"), "z.ck": ("z.ck", "z.ck"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "q.gitlab.io": ("q.gitlab.io", "gitlab.io"),
             "un.known.zone": ("known.zone", "zone"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "u@h.com:1": ("h.com", "com"), "com": ("com", "com"), "": ("", "")}
    hosts = spark.createDataFrame([(k,) for k in cases], "host string")
    assert {r.host: (r.domain, r.suffix) for r in U.with_suffix_rules(hosts, rules).collect()} == cases
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(cases)], "page_id long, url string")
    outcomes = spark.createDataFrame([(k, k % 2) for k in range(8)], "page_id long, bad int")
    assert U.judge(pages, outcomes, U.RULES, suffix_rules=rules).count() == len(cases)


def test_a_bad_host_beneath_a_clean_domain(spark):
    """With the query's own parameters the method blocks a planted bad host and leaves its clean neighbours alone."""
    pages, outcomes = [], []
    for k in range(4000):
        host = "bad.shop.example" if k % 40 == 0 else f"h{k % 50}.shop.example" if k % 2 else f"w{k % 30}.other.example"
        pages.append((k, f"http://{host}/p{k}"))
        outcomes.append((k, int(host.startswith("bad") or k % 33 == 1)))
    got = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, OUT), U.RULES).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.shop.example"} and all(r.rule is None for r in got)
