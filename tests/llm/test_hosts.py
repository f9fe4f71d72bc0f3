import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from rasterweave.llm import hosts, queries

FOLDER = "/root/testdata/sf0.001"


def parsed(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def fitting(host, path, rules):
    fit = [r for r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fit, key=len, default=None)


def brute(rows, rules, rounds=200):
    edges, pages, said = Counter(), Counter(), Counter()
    for url, html in rows:
        host, path = parsed(url)
        if host:
            pages[host] += 1
            said[host, rules.get(fitting(host, path, rules))] += 1
            for dst in re.findall(r'(?:href|src)="(?:https?:)?//([^/?#"]+)', html or ""):
                if dst.lower() != host:
                    edges[host, dst.lower()] += 1
    names = sorted(set(pages) | {x for e in edges for x in e})

    def rank(links, seeds):
        start = {h: 1 / len(seeds) if h in seeds else 0.0 for h in names}
        r = dict(start)
        out = Counter()
        for (a, _), n in links.items():
            out[a] += n
        for _ in range(rounds):
            t = dict.fromkeys(names, 0.0)
            for (a, b), n in links.items():
                t[b] += 0.85 * r[a] * n / out[a]
            back = (1 if seeds else 0) - sum(t.values())
            r = {h: t[h] + back * start[h] for h in names}
        return r

    trust = rank(edges, {h for h in pages if 2 * said[h, "allow"] > pages[h]})
    distrust = rank(Counter({(b, a): n for (a, b), n in edges.items()}), {h for h in pages if 2 * said[h, "block"] > pages[h]})
    out = []
    for url, _ in rows:
        host, path = parsed(url)
        rule = fitting(host, path, rules)
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        out.append((url, host, path, rule, rules.get(rule) or ("block" if d > t else "allow"), t, d))
    return out


def test_against_plain_iteration(spark):
    link = lambda *hs: "".join(f'<p><a class=x href="{h}">x</a>' for h in hs)
    rows = [
        ("http://good.com/a", link("//b.org/x", "https://c.org", "/local", "#x")), ("http://Good.COM/b?q=//z", link("http://b.org")),
        ("https://b.org/", link("http://c.org/1", "http://B.org/self")), ("https://c.org", link("http://bad.net/es/1")),
        ("https://d.org/p", link("http://c.org", "http://bad.net/")), ("http://bad.net/es/q", link("http://good.com")), ("http://bad.net/es/r", None),
        ("http://bad.net/en/r", ""), ("http://e.org?x", link("http://good.com", "http://f.org")), ("http://far.org#f", None), (None, link("http://bad.net")),
        ("no url", None), ("", None), ("x://", None), ("http://far.org#f", None), ("a://h1://h2/p", None),
    ]
    rules = queries.RULES
    table = spark.createDataFrame([(*r, "mine", 1) for r in rows], "url string, html string, verdict string, src int")
    got = hosts.judge(table, rules, rounds=200)
    assert got.columns == ["url", "html", "src", "host", "path", "rule", "verdict", "trust", "distrust"]
    key = lambda r: str(r)
    own = sorted([(r["url"], r["host"], r["path"], r["rule"], r["verdict"], r["trust"], r["distrust"]) for r in got.collect()], key=key)
    for a, b in zip(own, sorted(brute(rows, rules), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)
    assert {r[4] for r in own if r[3] is None} == {"allow", "block"}
    assert hosts.judge(table.limit(0), rules).count() == 0


def test_query(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    expected = {p: e[1:5] for (p, _, _), e in zip(rows, brute([r[1:] for r in rows], queries.RULES))}
    got = queries.op4_link_graph_filter(spark, FOLDER).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == expected and len(got) == len(rows)


def test_all_links_of_a_tag(spark):
    """Every href and src of a tag counts, other attributes do not, and open tags take linear time."""
    html = [
        '<a href="http://bad.net/x" data-src="//cdn.org/i" src=//c.com>', "<IMG SRC='https://A.b/?q'><a class=\"x\"href='//d.e#f'", "< < <" * 50_000 + '<a href="//z.z">', "<a href=/local>", None, "",
    ]
    pages = spark.createDataFrame([(h,) for h in html], "html string")
    edges = hosts.host_edges(pages, F.lit("own.org"), F.col("html")).collect()
    assert {(e["dst"], e["n"]) for e in edges} == {(h, 1) for h in ("bad.net", "c.com", "a.b", "d.e", "z.z")}


def test_distant_hosts_are_reached(spark):
    """A chain longer than 30 links: shares at its end are those of the limit, and too few rounds fail."""
    chain = [f"h{i:02}.org" for i in range(41)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(chain, chain[1:])], "src string, dst string, n long")
    seeds = spark.createDataFrame([(h, float(h == chain[0]), float(h == chain[-1])) for h in chain], "host string, good double, bad double")
    got = {r["host"]: r["trust"] for r in hosts.propagate(edges, seeds, tolerance=1e-5).collect()}
    whole = sum(0.85**i for i in range(41))
    assert got[chain[40]] == pytest.approx(0.85**40 / whole, abs=1e-5) and got[chain[40]] > 0
    with pytest.raises(RuntimeError):
        hosts.propagate(edges, seeds, rounds=3)
