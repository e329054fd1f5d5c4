"""Sites: lists kept in step with a crawl, and articles for an instruction, on small link graphs."""

from datetime import datetime

from folioforge.operators import library, sites
from pyspark.sql import functions as F

T0, T1, NOW = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 5, 5)
SITES = "site_id int, root_url string, created_at timestamp"
LISTED = "site_id int, url string, title string, discovered_at timestamp"
PAGES = [
    ("http://a.org/", '<a href="/1.html">One</a><a href="/sub">s</a><a href="http://b.org/9.html">other</a><a href="/2.html"></a>'),
    ("http://a.org/sub", '<a href="/3.html">Three</a><a href="/1.html">again</a>'),
    ("http://b.org/", '<a href="/9.html">Nine</a>'),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sync_keeps_lists_in_step(spark):
    s = spark.createDataFrame([(1, "http://A.org", T0), (2, "http://b.org/", T0), (3, "no url", T0), (4, None, T0), (5, "http://b.org/", T0), (6, "http://gone.org/", T0)], SITES)
    listed = spark.createDataFrame([(1, "http://a.org/1.html", "Old", T0), (1, "http://a.org/3.html", "Three", T0), (1, "http://a.org/0.html", "Left", T0), (2, "http://b.org/9.html", None, T0), (None, None, None, None)], LISTED)
    pages = spark.createDataFrame(PAGES, "url string, html string")
    changed, state = sites.sync(s, listed, pages, F.lit(NOW))
    assert rows(changed) == sorted([
        (1, "http://a.org/1.html", "One", T0), (1, "http://a.org/2.html", "http://a.org/2.html", NOW), (2, "http://b.org/9.html", "Nine", T0), (5, "http://b.org/9.html", "Nine", NOW),
    ], key=repr)
    assert rows(state) == [(1, NOW, 1), (2, NOW, 0), (3, NOW, 0), (4, NOW, 0), (5, NOW, 1), (6, NOW, 0)]
    after = library.upsert(listed, changed, ["site_id", "url"])
    again, state = sites.sync(s, after, pages, F.lit(NOW))
    assert rows(again) == [] and {r.added for r in state.collect()} == {0}
    for empty in (s.limit(0), s):
        none, state = sites.sync(empty, listed, pages.limit(0), F.lit(NOW))
        assert rows(none) == [] and state.count() == empty.count()


def related(spark, listed, stored=(), pages=(), query="标题为“river”", task="t"):
    s = spark.createDataFrame([(1, "r", T1), (2, "r", T0)], SITES)
    found, added = sites.related(
        s, spark.createDataFrame(list(listed), LISTED), spark.createDataFrame(list(stored), "url string, task_id string"), spark.createDataFrame(list(pages), "url string, html string"), query, task, F.lit(NOW)
    )
    return rows(found), {r.url: r for r in added.collect()}


def test_related_articles(spark):
    listed = [(1, "u1", "a river", T0), (1, "u2", "ri", T0), (1, "u3", "ri", T0), (1, "u4", "tree", T0), (1, "u5", "river", T0), (1, "u6", "river", T0), (1, "u7", None, T0)]
    pages = [("u1", "<p>b</p>"), ("u2", "<p>ri<b>ver</b></p>"), ("u3", "<p>lake</p>"), ("u4", "<p>river</p>"), ("u6", None)]
    found, added = related(spark, listed, [("u5", "t"), ("u1", "other"), ("u2", None)], pages)
    assert found == [(1, "u1"), (1, "u2"), (1, "u5")]  # u3 fails by its text, u4 by its title; u5 is there already; u6 couldn't be read
    assert set(added) == {"u1", "u2"} and (added["u2"].text, added["u2"].title, added["u2"].task_id, added["u2"].status, added["u2"].created_at) == ("river", "ri", "t", "ready", NOW)


def test_sites_count_in_order(spark):
    listed = [(1, "u", "river one", T0), (2, "u", "ri", T0)]  # site 2 is older, so it is asked first
    assert related(spark, listed, (), [("u", "<p>dry</p>")])[0] == [(1, "u")]  # its title fails, the other's holds
    found, added = related(spark, listed, (), [("u", "<p>river</p>"), ("u", "<p>river</p>")])
    assert found == [(1, "u"), (2, "u")] and added["u"].title == "ri"
    found, added = related(spark, [(2, "u", "older river", T0), (2, "v", "x river", T1)], (), [("u", "<p>a</p>"), ("v", "<p>b</p>")])
    assert found == [(2, "u"), (2, "v")] and set(added) == {"u", "v"}


def test_long_texts_and_no_terms(spark):
    far = "<p>" + "x" * 12_000 + "river</p>"
    assert related(spark, [(1, "u", "ri", T0)], (), [("u", far)]) == ([], {})
    found, added = related(spark, [(1, "u", "the river", T0)], (), [("u", far)])
    assert found == [(1, "u")] and len(added["u"].text) == 12_005
    assert related(spark, [(1, "u", "river", T0)], (), [("u", far)], query="  ") == ([], {})
    assert related(spark, [], [], []) == ([], {})
