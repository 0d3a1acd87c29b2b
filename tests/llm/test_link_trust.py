"""Hosts, rules and ranks against plain loops."""

import pytest
from corpus_fixtures import table  # noqa: F401

from tillwright.llm import link_trust as lt

PAGES = "page_id long, url string, html string, host string, rank double"


def plain_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    stop = min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in lt.RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def plain_ranks(seeds, links, rounds=200):
    ranks = dict.fromkeys(seeds, 0.0)
    for _ in range(rounds):
        new = {h: w * 0.15 for h, w in seeds.items()}
        for (a, b), n in links.items():
            new[b] = new.get(b, 0.0) + 0.85 * ranks.get(a, 0.0) * n / sum(m for (x, _), m in links.items() if x == a)
        ranks = new
    return ranks


URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2#/es/", "http://com/fr/x", "http://b.com/de/", "b.com/de/", None, "",
    "http://notexample.org?y=/es/", "ftp://x.com", "http://u@c.com:80/de/z", "http://x.com/a://y.org/b", "http://É.org/", "://org/", "http://evilorg/", "http://net/fr/",
]


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x", 1.0) for i, u in enumerate(URLS)], PAGES)
    for row in lt.judge(pages).collect():
        host, path = plain_split(URLS[row.page_id])
        rule, verdict = plain_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict or rule is None


def test_the_table(table):
    pages = table("pages")
    rows = lt.judge(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(urls)
    for row in rows:
        host, path = plain_split(urls[row.page_id])
        rule, verdict = plain_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule) and row.verdict in ((verdict,) if rule else ("allow", "block"))


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: " ".join(f'<p><A class="x" href="{h}">t</a>' for h in hosts)
    pages = [
        (1, "http://good.org/a", link("http://friend.net/", "//friend.net/b", "https://other.net?q"), "x", 0.0),
        (2, "http://bad.com/de/1", link("/local"), "x", 0.0),
        (3, "http://linker.net/1", link("http://BAD.com/de/1", "http://friend.net"), "x", 0.0),
        (4, "http://friend.net/1", link("http://friend2.net"), "x", 0.0),
        (5, "http://second.net/1", link("http://linker.net"), "x", 0.0),
        (6, "http://alone.net/1", None, "x", 0.0),
        (7, "http://friend2.net/1", "", "x", 0.0),
    ]
    rows = {r.page_id: r for r in lt.judge(spark.createDataFrame(pages, PAGES)).collect()}
    links = {("good.org", "friend.net"): 2, ("good.org", "other.net"): 1, ("linker.net", "bad.com"): 1, ("linker.net", "friend.net"): 1, ("friend.net", "friend2.net"): 1, ("second.net", "linker.net"): 1}
    trust = plain_ranks({"good.org": 1.0}, links)
    distrust = plain_ranks({"bad.com": 1.0}, {(b, a): n for (a, b), n in links.items()})
    for r in rows.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0.0), abs=1e-3) and r.distrust == pytest.approx(distrust.get(r.host, 0.0), abs=1e-3)
    assert [rows[i].verdict for i in range(1, 8)] == ["allow", "block", "block", "allow", "block", "allow", "allow"]


def test_empty_table(spark):
    assert lt.judge(spark.createDataFrame([], PAGES)).collect() == []


def test_ranks_do_not_depend_on_unlinked_seeds(spark):
    """A chain behind one blocked host and a circle that feeds it, beside thousands of hosts without links."""
    chain = [("bad.com", "h0")] + [(f"h{i}", f"h{i + 1}") for i in range(48)]
    links = {**dict.fromkeys(chain, 1), ("h3", "round1"): 2, ("round1", "round2"): 1, ("round2", "h3"): 1}
    want = plain_ranks({"bad.com": 1.0}, links, rounds=400)
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "source string, target string, n long")
    seeds = [("bad.com", 1.0), *((f"alone{i}", 1.0) for i in range(5_000))]
    ranks = {r.host: r["rank"] for r in lt.spread(spark.createDataFrame(seeds, "host string, weight double"), frame).collect()}
    assert len(ranks) == len(want) + 5_000
    assert {h: ranks[h] for h in want} == pytest.approx(want, rel=1e-3)


def test_verdicts_beside_unlinked_seeds(spark):
    linked = [(1, "http://a.net/", '<a href="http://b.net/">x</a>'), (2, "http://b.net/", '<a href="http://c.net/">x</a>'), (3, "http://c.net/", '<a href="http://z.com/de/1">x</a>')]
    seeds = [(4, "http://z.com/de/1", "")] + [(10 + i, f"http://s{i}.com/de/{i}", "") for i in range(3_000)]
    pages = spark.createDataFrame([(i, u, h, "x", 0.0) for i, u, h in linked + seeds], PAGES)
    assert {r.verdict for r in lt.judge(pages).collect()} == {"block"}
