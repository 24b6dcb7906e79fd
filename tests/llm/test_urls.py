"""URL rules and aliases."""

import pytest

from tidemark.llm import urls


def page(link="", refresh=""):
    return (f'<html><head><link href="{link}" rel="canonical">' if link else "<html><head>") + (
        f'<META http-equiv=refresh content="0; URL={refresh}">' if refresh else "") + "</head><body>x</body></html>"


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", None), (2, "https://example.net/fr/x", ""), (3, "https://www.example.com/de/1", "<p>"), (4, "https://example.com/en/1", ""),
        (5, "http://x.org/fr/", ""), (6, None, "x"), (7, "no scheme", "x"), (8, "http://notexample.com/de/", ""), (9, "http://net", ""), (10, "http://net/", ""),
        (11, "a://b.net?x=://c/", ""), (12, "http://evilnet/", ""), (13, "https://EXAMPLE.com", ""), (14, "http://example.net/EN/", ""), (15, "", "")]
    assert judged(spark, rows) == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/fr/x", "net/", "block"), 3: ("www.example.com", "/de/1", "example.com/de/", "block"),
        4: ("example.com", "/en/1", None, "allow"), 5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notexample.com", "/de/", None, "allow"), 9: ("net", "", None, "allow"), 10: ("net", "/", "net/", "block"), 11: ("b.net", "", None, "allow"),
        12: ("evilnet", "/", None, "allow"), 13: ("example.com", "", None, "allow"), 14: ("example.net", "/EN/", "net/", "block"), 15: ("", "", None, "allow")}


def test_aliases(spark):
    rows = [
        (1, "http://a.com/1", page("http://B.com/2#top")), (2, "http://b.com/2", page("", "/3")), (3, "http://b.com/3", page("4?a=1&amp;b=2")),
        (4, "http://b.com/4?a=1&b=2", page("", "http://bad.net/x")),  # nobody has a page for the blocked end
        (5, "http://example.net/en/1", page("http://bad.net/x")),  # its own allow comes first
        (6, "http://c.org/fr/1", page("http://c.org/es/1")), (7, "http://c.org/es/1", page()),  # an allow doesn't block
        (8, "https://d.com/", page("//e.com/")), (9, "https://e.com/", page("https://example.com/de/9")), (10, "http://a.com/1#part", ""), (11, "http://a.com/2", "")]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block", 11: "allow"}


@pytest.mark.parametrize("hosts", [-1, urls.HOSTS])
def test_same_as_sql(spark, monkeypatch, hosts):
    import duckdb

    monkeypatch.setattr(urls, "HOSTS", hosts)
    rows = [(i, f"http://h{i}.com/{i}", page(f"http://h{i + 1}.com/{i + 1}") if i % 10 else page("http://x.net/")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    want = sorted(con.execute(urls.SQL).fetchall())
    assert sorted(map(tuple, urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())) == want
    assert [r[4] for r in want] == ["block"] * 51 + ["allow"] * 9


def test_odd_rows(spark):
    rows = [(1, "http://a.net/", "x", "h"), (1, "http://a.net/", "x", "h"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = urls.judge(df)
    assert out.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "alias_blocked"]
    assert sorted(str(r.verdict) for r in out.collect()) == ["allow", "block", "block"] and urls.judge(df.limit(0)).count() == 0
