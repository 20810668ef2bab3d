import fnmatch
import random
import re

import numpy as np

from tessera.llm import url_filter
from tessera.llm.queries import QUERIES
from tessera.llm.url_filter import RULES, Automaton, judge


def plain(url):
    """Host, path, rule and its verdict by the wording of the rules."""
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.Example.org/es/1?x#y", "http://example.org/es",
    "http://example.org/en/1", "http://example.org/en/2", "http://notorg/x", "ftp://x.com/fr/?a=/de/", "http://x.com/de/..",
    "http://a.b/x.org/y", "http://a.com?u=/fr/", "a://b://c.org/x", "http://ÄÖ.org/é", "http://user@x.org:80/", "http://x.org\n/y",
    "http://" + "a." * 4000 + "com/de/" + "z" * 9000, "http://free-bets.example.net/q", "http://a.net/wp-login.php", "http://x.COM/FR/",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == verdict or verdict is None
    assert [got[i]["verdict"] for i in (0, 20, 21, 22)] == ["allow", "block", "block", "allow"]


def test_a_host_alone_is_judged_like_its_root(spark):
    urls = ["http://adult-x.com", "http://adult-x.com/", "http://adult-x.com?a", "http://adult-x.org", "http://adult-x.org/", "http://", "x://?q"]
    got = {r["page_id"]: (r["path"], r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(7)] == [
        ("", None, "block"), ("/", None, "block"), ("", None, "block"), ("", None, "block"), ("/", "org/", "allow"), ("", None, "allow"), ("", None, "allow"),
    ]
    # A rule for a host alone fits without a path, too.
    alone = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=[("allow", "adult-x.com", "")])
    assert [r["rule"] for r in sorted(alone.collect())][:4] == ["adult-x.com", "adult-x.com", "adult-x.com", None]


def test_many_rules_and_long_urls_in_bounded_memory(spark, monkeypatch):
    globs = [f"*.host{i}.net/**" for i in range(3000)]
    automaton = Automaton(globs)
    sizes, whole = [], automaton.matched
    monkeypatch.setattr(automaton, "matched", lambda urls: sizes.append(len(urls) * automaton.words * 8) or whole(urls))
    urls = [f".a.host{i}.net/".encode() for i in range(0, 12000, 2)]
    got = automaton.match(urls)
    assert max(sizes) <= url_filter.STATES and len(sizes) > 1
    assert np.argwhere(got).tolist() == [[i // 2, i] for i in range(0, 3000, 2)]
    pages = spark.createDataFrame([(1, "http://x.host7.net/" + "y" * 200_000), (2, "http://host3000.net/"), (2, "http://host3000.net/"), (3, "http://a.host0.net")], "page_id long, url string")
    table = spark.createDataFrame([(g, 1) for g in [*globs, globs[0], None, ""]], "glob string, page_id int")
    assert sorted((r["page_id"], r["verdict"]) for r in judge(pages, blocked=table).collect()) == [(1, "block"), (2, "allow"), (2, "allow"), (3, "block")]


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in QUERIES["op4_url_filter"](spark, sf).collect()}
    assert len(got) == len(pages)
    for page_id, url in pages:
        host, path, rule, verdict = plain(url)
        row = got[page_id]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or row["verdict"])


def test_no_rows_and_nulls(spark):
    pages = spark.createDataFrame([(None, None), (None, "http://x.org/")], "page_id long, url string")
    assert sorted(r["rule"] or "" for r in judge(pages).collect()) == ["", "org/"]
    assert judge(pages.limit(0)).collect() == []


def test_automaton_against_backtracking():
    random.seed(5)
    globs = ["".join(random.choice(["a", "b", "?", "**", "ab"]) for _ in range(random.randint(1, 30))) for _ in range(60)]
    urls = ["".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(300)]
    got = Automaton(globs).match([u.encode() for u in urls])
    assert got.dtype == bool
    wanted = np.array([[bool(re.fullmatch(fnmatch.translate(g.replace("**", "*")), u)) for g in globs] for u in urls])
    assert (got == wanted).all()


def test_star_stays_in_a_segment():
    got = Automaton(["*.org/x**", r"a\*b", "?"]).match([b".org/x", b".a.org/xy", b"./a.org/x", b"a*b", b"axb", b"/", b"c", b""])
    assert got.T.tolist() == [
        [True, True, False, False, False, False, False, False],
        [False, False, False, True, False, False, False, False],
        [False, False, False, False, False, False, True, False],
    ]
