"""URL rules and alias groups on a hand-made site, and against plain code."""

import urllib.parse

import pytest
from pyspark.sql import functions as F

from sparkweave.llm import urls
from sparkweave.llm.queries import URL_RULES

FIELDS = "page_id long, url string, html string, host string, node string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "n", "c") for i, u, h in rows], FIELDS)


def verdicts(spark, rows, rules=URL_RULES):
    return {r["page_id"]: (r["rule"], r["verdict"], r["via"]) for r in urls.judge(frame(spark, rows), rules).collect()}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([k for c in "?#" if (k := tail.find(c)) >= 0], default=len(tail))]


def own(url, rules=URL_RULES):
    host, path = parts(url)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no-scheme.com/x", "http://", "http://a.com", "http://a.com/", "HTTP://A.COM/En/", "http://example.com/en/1", "https://m.example.com/en/1?q#f", "http://www.example.com/en/2", "http://x.www.example.com/en/", "http://badexample.com/en/1", "http://x.net/es/9", "http://x.net/es", "http://net/fr/", "http://x.net?u=/es/", "http://x.net#/es/", "a://b.net/fr/://c.com/", "http://É.COM/x", "http://x.org/en/\nnew"]


def test_hosts_paths_and_rules(spark):
    got = urls.judge(frame(spark, [(k, u, None) for k, u in enumerate(URLS)]), URL_RULES).collect()
    for r in got:
        assert (r["host"], r["path"]) == parts(r["url"])
        rule, verdict = own(r["url"])
        assert r["rule"] == rule and r["verdict"] == (verdict or "allow")


def link(url):
    return f"<html><head><link rel='canonical' href='{url}'></head></html>"


def test_aliases(spark):
    rows = [
        (1, "http://a.org/1", link("http://x.net/es/1")),  # canonical to a blocked page that is not in the table
        (2, "http://b.org/2", "<META http-equiv=refresh content=\"0; url=http://a.org/1\">"),  # on to a page that is blocked
        (3, "https://b.org/2/?utm_source=feed&ref=x#top", None),  # the same as 2
        (4, "http://c.org/", link("http://www.example.com/en/7")),  # to an allowed page
        (5, "http://d.org/", link("http://c.org/") + link("http://x.net/fr/5")),  # a group with both: allowed
        (6, "http://x.net/fr/5", None),  # its own rule blocks it all the same
        (7, "http://e.org/dir/page", '<meta property="og:url" content="../x"><link href=/other rel=canonical>'),
        (8, "http://e.org/other", '<link rel="canonical" href="//f.org/z?a=1&amp;b=2">'),
        (9, "http://f.org/z?a=1&b=2", link("HTTP://Y.NET/es/q")),  # host in capitals
        (10, "http://f.org/z?a=1&b=3", None),  # another page
        (11, None, link("http://x.net/es/1")),
        (12, "http://g.org/p", "<a href='http://x.net/es/1'>a plain link says nothing</a><link rel=stylesheet href='http://x.net/es/1'>"),
        (13, "http://a.org/1", None),  # the same url again
    ]
    got = verdicts(spark, rows)
    assert {k: v for k, (_, v, _) in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow", 13: "block"}
    assert got[6] == ("net/fr/", "block", "rule") and got[1] == (None, "block", "alias") and got[10] == (None, "allow", "default")


BASES = ["http://a.org", "http://a.org/", "http://a.org/b", "http://a.org/b/c/d;p?q=1#f", "https://a.org/b/c/", "http://a.org/x.y/../z/w"]
REFERENCES = ["g", "./g", "g/", "/g", "//g.org/h", "?y=2", "g?y=2", "#s", "g#s", "g?y=2#s", ";x", "g;x=1", "..", "../", "../g", "../..", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/../y", "g?y/../x", "g#s/../x", ".", "./", "http://b.org/../k", "a/b/../../../c?d=..", "g?a=1&amp;b=2"]


def test_references_resolve_as_the_standard_says(spark):
    pairs = [(b, t) for b in BASES for t in REFERENCES]
    df = spark.createDataFrame([(b, t, urllib.parse.urljoin(b, t.replace("&amp;", "&"))) for b, t in pairs], "base string, target string, want string")
    got = df.select("base", "target", "want", urls._absolute(F.col("target"), F.col("base")).alias("to")).select("*", urls.node(F.col("to")).alias("node"), urls.node(F.col("want")).alias("want_node"), urls.node(F.col("base")).alias("base_node")).collect()
    for r in got:
        assert r["node"] == r["want_node"] or (r["node"] is None and r["want_node"] == r["base_node"]), r


def test_one_page_under_several_addresses(spark):
    same = ["http://a.org/x/y?q=1", "HTTPS://A.org:443/x/y/?q=1#top", "http://a.org:80/x/./y?q=1", "http://a.org:/x/z/../y?utm_source=s&q=1"]
    other = ["http://a.org:8080/x/y?q=1", "http://a.org:443/x/y?q=1", "http://a.org/x/Y?q=1", "http://a.org/x/y?q=2", "http://a.org/x/y/..?q=1"]
    node = lambda rows: [r[0] for r in spark.createDataFrame([(u,) for u in rows], "u string").select(urls.node(F.col("u"))).collect()]
    assert set(node(same)) == {"a.org/x/y?q=1"} and "a.org/x/y?q=1" not in node(other) and len(set(node(other))) == 5


def test_a_very_long_page(spark):
    rows = [(1, "http://a.org/1", "<p>text</p>" * 200_000 + link("../es/").replace("../es/", "http://x.net/es/1")), (2, "http://a.org/2", "<" * 500_000)]
    assert {k: v[1] for k, v in verdicts(spark, rows).items()} == {1: "block", 2: "allow"}


def test_a_long_chain_and_a_hub(spark):
    chain = [(k, f"http://c{k}.org/", link(f"http://c{k + 1}.org/")) for k in range(40)] + [(40, "http://c40.org/", link("http://x.net/es/"))]
    hub = [(100 + k, f"http://h{k}.org/", link("http://hub.org/")) for k in range(60)] + [(200, "http://hub.org/", None), (201, "http://hub.org/q", None)]
    got = verdicts(spark, chain + hub)
    assert {got[k][1] for k in range(41)} == {"block"} and {got[k][1] for k in range(100, 202) if k in got} == {"allow"}


def test_many_rules_agree_with_few(spark):
    rules = [*URL_RULES, *(("block", f"r{k}.org", f"/{k % 7}") for k in range(300)), ("allow", "r5.org", "/55")]
    pages = [(k, f"http://{'www.' * (k % 2)}r{k % 320}.org/{k % 9}{k % 3}", None) for k in range(400)] + [(1000 + k, u, None) for k, u in enumerate(URLS)]
    got = urls.judge(frame(spark, pages), rules).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["rule"], r["verdict"]) == (own(r["url"], rules)[0], own(r["url"], rules)[1] or "allow")


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "http://a.net/es/", "")] * 3])
def test_small_tables(spark, rows):
    assert urls.judge(frame(spark, rows), URL_RULES).count() == len(rows)
    assert urls.judge(frame(spark, rows), []).where("verdict <> 'allow'").isEmpty()
