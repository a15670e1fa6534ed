import pytest

from tessera.llm import url_filter
from tessera.llm.queries import URL_RULES
from tessera.llm.url_filter import Rule


def link(href):
    return f'<html><head><LINK href="{href}" rel="canonical"></head>'


PAGES = [
    (1, "https://a.example.com/en/x", None), (2, "https://www.example.com/en/x?q=1", ""), (3, "HTTP://X.NET/es/1#t", "<p>"), (4, "http://x.net/de/1", link("http://x.net/es/9")),
    (5, "http://other.org/p", link("//x.net/de/1")), (6, "http://free.org/p", '<meta http-equiv="refresh" content="0; url=http://y.net/fr/2">'), (7, "http://free.org/q", link("/p")), (8, "http://ok.com/z", link("http://free.org/q")),
    (9, None, link("http://x.net/es/1")), (10, "no scheme/en", None), (11, "http://com", None), (12, "http://notcom.org/a?b=://c", None), (12, "http://notcom.org/a?b=://c", None), (13, "http://xcom/en/", None),
    (14, "http://rel.net/a/b", link("c?x=1&amp;y=2")), (15, "http://rel.net/a/c?x=1&y=2", link("http://z.net/es/")),
]
EXPECTED = {
    1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 3: ("x.net", "/es/1", "net/es/", "block"),
    4: ("x.net", "/de/1", None, "block"), 5: ("other.org", "/p", None, "block"),
    # free.org leads to a blocked address, but ok.com, which is allowed, leads to it.
    6: ("free.org", "/p", None, "allow"), 7: ("free.org", "/q", None, "allow"), 8: ("ok.com", "/z", "com/", "allow"),
    9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("com", "", None, "allow"), 12: ("notcom.org", "/a", None, "allow"), 13: ("xcom", "/en/", None, "allow"),
    14: ("rel.net", "/a/b", None, "block"), 15: ("rel.net", "/a/c", None, "block"),
}


@pytest.mark.parametrize("most", [200, 0])
def test_rules_aliases_and_precedence(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_IN_EXPRESSION", most)
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, host string, component int")
    got = url_filter.judge(df, URL_RULES).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == EXPECTED


def test_given_redirects_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", ""), (2, "http://b.org/2", "")], "page_id long, url string, html string")
    more = spark.createDataFrame([("a.org/1", "bad.org/"), ("b.org/2", "a.org/1")], "a string, b string")
    got = url_filter.judge(pages, [Rule("block", "bad.org")], redirects=more).collect()
    assert {r.verdict for r in got} == {"block"} and len({r.component for r in got}) == 1
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_long_alias_chains(spark):
    pages = spark.createDataFrame([(i, f"http://s{i}.org/", link(f"http://s{i + 1}.org/")) for i in range(40)], "page_id long, url string, html string")
    got = url_filter.judge(pages, [Rule("block", "s40.org")]).collect()
    assert [r.verdict for r in got] == ["block"] * 40


def test_the_sql_says_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from tessera.llm.queries import ORACLES

    c = duckdb.connect()
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])
    c.register("pages_frame", pages)
    c.execute("create view pages as select page_id, url, html from pages_frame")
    got = {r[0]: tuple(None if x is None else x for x in r[1:]) for r in c.execute(ORACLES["op4_url_filter"]).fetchall()}
    assert got == EXPECTED
