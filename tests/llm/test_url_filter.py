import random
import re
import time

from retentio.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("Sub.Example.com", "", "block"), ("dup.net", "/", "block"), ("dup.net", "/", "allow")]


def parts(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)) if m else ""
    return host, m.group(2) if m else ""


def best(url):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "allow", h + p) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits and "://" in (url or "") else None


def slow(rows, edges):
    parent = {}

    def root(u):
        parent.setdefault(u, u)
        while parent[u] != u:
            u = parent[u]
        return u
    for a, b in edges:
        if a and b and "://" in a and "://" in b:
            parent[root(a)] = root(b)
    seen = {}
    for u in {u for _, u in rows if u} | set(parent):
        if best(u):
            seen.setdefault(root(u), []).append(best(u)[2])
    out = []
    for i, u in rows:
        b = best(u)
        if b:
            v = "allow" if b[2] else "block"
        else:
            mine = seen.get(root(u), []) if u and "://" in u else []
            v = "block" if mine and not any(mine) else "allow"
        out.append((i, *parts(u), b[3] if b else None, v))
    return sorted(out, key=str)


def judged(spark, rows, edges):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, component string")
    e = spark.createDataFrame(edges, "src string, dst string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return sorted(map(tuple, U.judge(pages, e, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_rules_and_aliases_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.org", "example.org", "b.com", "x.sub.example.com", "n.net", "dup.net", "WWW.Big.ORG", "org", "q.info", "r.info", "s.info"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/1', '/en/12', '/fr/2', '/de/3', '/en/2?x=/es/', '#f', '?q'])}" for _ in range(120)]
    urls += [f"http://alias{i}.info/" for i in range(60)]
    edges = [(rng.choice(urls), rng.choice(urls[100:])) for _ in range(70)] + [(None, urls[0]), (urls[1], None), (urls[2], urls[2]), ("nothing", urls[3])]
    chain = [f"http://c{i}.info/" for i in range(40)]
    edges += list(zip(chain, chain[1:])) + [(chain[-1], "https://b.com/de/9")]
    rows = [(i, u) for i, u in enumerate(urls + chain)] + [(900, None), (901, ""), (902, "no scheme/x"), (903, "a://b://c/d"), (None, urls[5]), (3, urls[3]),
                                                            (904, "http://" + "a." * 20_000 + "org/x"), (905, "http://h/" + "p" * 100_000)]
    got = judged(spark, rows, edges)
    assert got == slow(rows, edges)
    by = {r[0]: r for r in got}
    assert by[len(urls)][3:] == (None, "block")  # the far end of the chain


def test_explicit_allow_goes_first(spark):
    edges = [("http://x.info/", "http://b.com/de/1"), ("http://x.info/", "http://b.com/fr/1"), ("http://y.info/", "http://b.com/de/2")]
    rows = [(1, "http://x.info/"), (2, "http://y.info/"), (3, "http://b.com/de/1"), (4, "http://z.info/")]
    assert [r[4] for r in judged(spark, rows, edges)] == ["allow", "block", "block", "allow"]


def test_edges_of_pages(spark):
    pages = spark.createDataFrame([
        ("http://www.a.com/x/?utm_source=f#top", None),
        ("https://b.com/dir/p", '<LINK href="/c" REL="canonical"><link rel=stylesheet href="/s.css">'),
        ("https://b.com/q", "<meta http-equiv='refresh' content='0; url=other'>"),
        ("https://b.com/r", '<link rel="canonical" href="//c.org/z"><link rel="canonical" href="https://d.org/">'),
        ("relative", '<link rel="canonical" href="https://d.org/">'), (None, "canonical")], "url string, html string")
    got = {(r.src, r.dst) for r in U.alias_edges(pages).collect()}
    assert got == {("http://www.a.com/x/?utm_source=f#top", "https://a.com/x"), ("https://b.com/dir/p", "https://b.com/c"), ("https://b.com/q", "https://b.com/other"),
                   ("https://b.com/r", "https://c.org/z"), ("https://b.com/r", "https://d.org/"), ("https://d.org/", "https://d.org")}


def test_links_are_read_as_browsers_do(spark):
    def link(href, rest=""):
        return f'{rest}<link rel="canonical" href="{href}">'
    pages = {"https://b.org/a/b/c?q": (link("http://b.org/?x=1&amp;y=2&#38;z"), "http://b.org/?x=1&y=2&z"), "https://b.org/a/b/d": (link("../z"), "https://b.org/a/z"),
             "https://b.org/a/b/e": (link("./../../../z/."), "https://b.org/z/"), "https://b.org/a/f": ("<!-- " + link("http://evil.org/") + " -->" + link("/ok"), "https://b.org/ok"),
             "https://b.org/a/g": (link("x/y", '<base target=_top><base href="/root/">'), "https://b.org/root/x/y"), "https://b.org/a/h": (link("?p=2"), "https://b.org/a/h?p=2"),
             "https://b.org/a/i": (link("i2?u=a/../b"), "https://b.org/a/i2?u=a/../b"), "https://b.org/a/j": ("<!-- never closed " + link("http://evil.org/"), None),
             "https://b.org/a/k": ('<a data-x=1 rel=canonical href="/no">refresh</a>', None), "https://b.org/a/l": (link("//c.org/../p/./q"), "https://c.org/p/q")}
    edges = U.alias_edges(spark.createDataFrame([(u, h) for u, (h, _) in pages.items()], "url string, html string")).collect()
    got = {u: {r.dst for r in edges if r.src == u} - {"https://b.org/a/b/c"} for u in pages}
    assert got == {u: {d} if d else set() for u, (_, d) in pages.items()}


def test_hostile_pages_take_linear_time(spark):
    texts = ["<link " * 170_000 + "canonical", "<link rel=canonical " + "x" * 1_000_000, "<!--" * 250_000 + "canonical", "<meta " + "url=" * 250_000 + "refresh>",
             "<link " + "rel " * 250_000 + "canonical>", "<link rel=canonical " + "href " * 200_000 + ">"]
    pages = spark.createDataFrame([(f"http://h{i}.org/x", t) for i, t in enumerate(texts)], "url string, html string")
    start = time.time()
    assert U.alias_edges(pages).count() == len(texts)
    assert time.time() - start < 30


def test_neighbouring_tracking_parameters_go_at_once(spark):
    tracked = {"http://a.org/p?utm_source=a&utm_medium=b": "https://a.org/p", "http://a.org/p?utm_source=a&utm_medium=b&utm_campaign=c": "https://a.org/p",
               "http://a.org/p?x=1&utm_a=1&utm_b=2&utm_c=3&y=2&utm_d=4&utm_e=5#f": "https://a.org/p?x=1&y=2", "http://a.org/p?my_utm_x=1&autm_y=2": "https://a.org/p?my_utm_x=1&autm_y=2",
               "http://a.org/?" + "utm_q=1&" * 20_000: "https://a.org"}
    got = {r.src: r.dst for r in U.alias_edges(spark.createDataFrame([(u, None) for u in tracked], "url string, html string")).collect()}
    assert got == tracked
    pages = spark.createDataFrame([(1, "http://x.info/?utm_a=1&utm_b=2&utm_c=3", None), (2, "https://x.info", '<link rel=canonical href="http://b.com/de/1">')],
                                  "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in U.judge(pages, U.alias_edges(pages), rules).collect()} == {1: "block", 2: "block"}


def test_empty_tables(spark):
    assert judged(spark, [], []) == []
    assert judged(spark, [(1, "http://a.org/")], []) == [(1, "a.org", "/", "org/", "allow")]
