"""Host reputation against a plain version: numeric integration instead of quantile code, loops instead of joins."""

import numpy as np

from millrace.llm import url_filter


def plain_quantile(level, a, b):
    x = np.linspace(0, 1, 400_001)[1:-1]
    logp = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    p = np.cumsum(np.exp(logp - logp.max()))
    return float(x[np.searchsorted(p / p[-1], level)])


def plain(pages, outcomes):
    """Shrinks host rates towards domain, suffix and the whole; returns {host: (mean, bound)}."""
    hosts = {}
    for i, url in pages:
        host = url.split("://", 1)[1].split("/")[0].lower()
        n, k = hosts.get(host, (0, 0))
        own = [g for j, g in outcomes if j == i and g is not None]
        hosts[host] = (n + len(own), k + sum(own))
    two = lambda h: h.split(".")[-2] in ("co", "com") and len(h.split(".")[-1]) == 2
    suffix, domain = (lambda h, c=c: ".".join(h.split(".")[-(c + two(h)) :]) for c in (1, 2))

    def summed(name):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(name(h), (0, 0))
            out[name(h)] = (a + n, b + k)
        return out

    def shrink(level, mu):
        rows = [(n, k, mu[x]) for x, (n, k) in level.items() if n and 0 < mu[x] < 1]
        chi, d = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for n, k, m in rows), sum(n - 1 for n, _, _ in rows)
        rho = min(0.999, max(0.001, (chi - len(rows)) / d)) if rows and d else 0.5
        return {x: (mu[x] * (1 / rho - 1) + k, (1 - mu[x]) * (1 / rho - 1) + n - k) for x, (n, k) in level.items()}

    mean = lambda ab: ab[0] / sum(ab)
    n, k = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    s = shrink(summed(suffix), dict.fromkeys(map(suffix, hosts), (k + 0.5) / (n + 1)))
    d = shrink(summed(domain), {domain(h): mean(s[suffix(h)]) for h in hosts})
    posterior = shrink(hosts, {h: mean(d[domain(h)]) for h in hosts})
    return {h: (mean(ab), plain_quantile(0.05, *ab)) for h, ab in posterior.items()}


def test_equals_the_plain_version_and_blocks_bad_hosts(spark):
    rng = np.random.default_rng(3)
    names = ["good.a.com", "bad.a.com", "x.b.co.uk", "y.b.co.uk", "z.c.co.uk", "one.org", "none.d.net", "10.0.0.1"]
    rate = [0.95, 0.05, 0.9, 0.85, 0.1, 0.9, 0.5, 0.8]
    pages = [(i, f"http://{names[i % 8]}/p{i}") for i in range(400)]
    outcomes = [(i, bool(rng.random() < rate[i % 8])) for i in range(400) if i % 8 != 6 and i % 3] + [(1, None)]
    got = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean")).collect()}
    want = plain([p for p in pages if "10.0" not in p[1]] + [], [o for o in outcomes if o[0] % 8 != 7])
    alone = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame([p for p in pages if p[0] % 8 != 7], "page_id long, url string"), spark.createDataFrame([o for o in outcomes if o[0] % 8 != 7], "page_id long, good boolean")).collect()}
    assert set(alone) == set(want)
    for host, (mean, bound) in want.items():
        assert abs(alone[host].reputation - mean) < 1e-9 and abs(alone[host].reputation_bound - bound) < 1e-4
    verdicts = {h: r.verdict for h, r in got.items()}
    assert verdicts["bad.a.com"] == verdicts["z.c.co.uk"] == "block" and verdicts["good.a.com"] == verdicts["x.b.co.uk"] == "allow"


def test_parts_and_rules_equal_python(spark):
    urls = ["http://Sub.Example.ORG/en/1?x", "https://example.org/es/", "ftp://a.b/c#d", "x", None, "", "http://com/fr/1", "://h", "http://a?b://c/d", "http://notexample.org/es/x", "http://shop.com/de/1"]
    rules = [url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/"), url_filter.Rule("block", "example.org/en/1"), url_filter.Rule("allow", "com/fr/"), url_filter.Rule("block", "com/de/")]

    def cut(text, marks):
        return text[: min([text.index(m) for m in marks if m in text], default=len(text))]

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r.pattern for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=len, default=None)

    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "page_id long, good boolean"), rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {i: judged(u) for i, u in enumerate(urls)}
