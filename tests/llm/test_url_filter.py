"""Operator 6: URL parts and rules by table, ranks against matrix iteration,
and the driver's pages (their oracle runs with all others)."""

import numpy as np

from tagwright.llm.url_filter import DAMPING, ROUNDS, RULES, filter_urls, host_links

URLS = [
    ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://a.example.com/fr/x", "a.example.com", "/fr/x", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    ("http://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
    ("http://b.net/en/1", "b.net", "/en/1", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("http://x.com?q=/a", "x.com", "", None, None),
    ("x://h.org/p://q", "h.org", "/p://q", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
    ("http://É.Com/", "É.com", "/", "com/", "allow"),
]


def test_parts_and_rules(spark):
    rows = [(i, u, None, "c", "c") for i, (u, *_) in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chosen string, RULE string")
    got = {r["page_id"]: r for r in filter_urls(pages).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert got[10]["verdict"] == "allow"


def test_links(spark):
    html = ("""<a href="/x">1</a> <a class=q HREF='//B.org/y'>2</a><a href=https://c.org>3</a>"""
            """<a href="mailto:me@d.org">4</a><link href="relative#f"><a href="">5</a><a data-href="http://e.org">""")
    pages = spark.createDataFrame([("a.org", html), ("", html), ("z.org", None)], "host string, html string")
    got = {(r["src"], r["dst"]): r["n"] for r in host_links(pages).collect()}
    assert got == {("a.org", "a.org"): 3, ("a.org", "b.org"): 1, ("a.org", "c.org"): 1}


def brute(pages):
    """Verdicts of hosts without a rule, by matrix iteration."""
    import re
    hosts, links = {}, {}
    for url, html in pages:
        host = url.split("://")[1].split("/")[0]
        path = url.split("://")[1][len(host):]
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        verdict = max(fit, key=lambda r: len(r[1] + r[2]))[0] if fit else None
        h = hosts.setdefault(host, [0, 0, 0])
        h[0] += 1
        h[1] += verdict == "allow"
        h[2] += verdict == "block"
        for target in re.findall(r'href="([^"]*)"', html):
            to = target.split("://")[1].split("/")[0] if "://" in target else host
            links[host, to] = links.get((host, to), 0) + 1
    names = sorted(set(hosts) | {x for e in links for x in e})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        m[at[a], at[b]] = n
    seeds = np.array([hosts.get(h, [0, 0, 0]) for h in names], float)
    seeds /= np.maximum(1, seeds.sum(axis=0))
    along = m / np.maximum(1, m.sum(axis=1, keepdims=True))
    against = (m / np.maximum(1, m.sum(axis=0, keepdims=True))).T
    t, d = seeds[:, 1], seeds[:, 2]
    for _ in range(ROUNDS):
        t = (1 - DAMPING) * seeds[:, 1] + DAMPING * t @ along
        d = (1 - DAMPING) * seeds[:, 2] + DAMPING * d @ against
    return {h: "block" if round(d[at[h]] - t[at[h]] - seeds[at[h], 0], 9) > 0 else "allow" for h in hosts}


def test_ranks_on_a_linked_graph(spark):
    import random
    rng = random.Random(8)
    names = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(30)]
    pages = []
    for i in range(300):
        host = rng.choice(names)
        to = [f'<a href="http://{rng.choice(names)}/p">' if rng.random() < 0.7 else '<a href="/own">' for _ in range(rng.randrange(5))]
        pages.append((f"http://{host}/{rng.choice(['en', 'es', 'fr'])}/{i}", "".join(to)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    verdicts = brute(pages)
    assert len(set(verdicts.values())) == 2
    free = 0
    for r in filter_urls(df).collect():
        if r["rule"] is None:
            free += 1
            assert r["verdict"] == verdicts[r["host"]]
    assert free > 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(df).collect() == []
