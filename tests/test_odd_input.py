"""Odd pages, links, numbers and keys: no row stops a job, none is lost."""

from folioforge.functions import html as hx
from folioforge.functions import text as tx
from folioforge.functions import url as ux
from folioforge.operators import crawl, provenance, review
from pyspark.sql import functions as F

# the examples of RFC 3986, sections 5.4.1 and 5.4.2
BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_rfc_examples(spark):
    rows = spark.createDataFrame(list(EXAMPLES.items()), "r string, want string")
    wrong = [(r.r, r.got, r.want) for r in rows.withColumn("got", ux.resolved(F.col("r"), F.lit(BASE))).collect() if r.got != r.want]
    assert not wrong


LINKS = {
    "http://A.Example:80/x y": "http://a.example/x%20y", "https://h:443": "https://h/", "https://h:8443/": "https://h:8443/", "http://a b/x": None, "http://": None, "http:///x": None,
    "mailto:a@b": None, "JavaScript:x()": None, "ftp://h/x": None, "//o.org/é?ü#ß": "http://o.org/%C3%A9?%C3%BC#%C3%9F", "\\x\\y?a\\b": "http://s.org/x/y?a\\b", " /a\n/b ": "http://s.org/a/b",
    "http://u:p@h/": "http://u:p@h/", "http://h:99999/": None, "http://h:0080/": "http://h/", "http://[::1]:8/x": "http://[::1]:8/x", "http://[x]/": None, "http://h%20/": None, "?": "http://s.org/d/e?",
    "http://h:abc/": None, "../../../x": "http://s.org/x", "a:b:c": None, "'\"<>`": "http://s.org/d/'%22%3C%3E%60", "http://h:99999999999999999999/": None,
}


def test_links_of_all_kinds(spark):
    rows = spark.createDataFrame(list(LINKS.items()), "r string, want string").withColumn("got", ux.link_target(F.col("r"), F.lit("http://s.org/d/e")))
    wrong = [(r.r, r.got, r.want) for r in rows.collect() if r.got != r.want]
    assert not wrong
    assert spark.range(1).select(ux.link_target(F.lit("x"), F.lit(None).cast("string")), ux.link_target(F.lit(None).cast("string"), F.lit("http://h/"))).first() == (None, None)
    assert spark.range(1).select(ux.link_target(F.lit("x"), F.lit("no url")), ux.host(F.lit("http://u@h:8/x")), ux.host(F.lit("x"))).first() == (None, "h:8", None)


ENTITIES = {
    "a&#55357;&#56832;b": "a😀b", "&#55357;x&#56832;": "�x�", "&#55357;": "�", "&#56832;&#55357;": "��", "&#55357;&#55357;&#56832;&#56832;": "�😀�",
    "&#65;&#66;&#100000000000000016384;": "AB䀀", "&#99999999999999999999;x": "\x00x", "&#65601;": "A", "&#" + "9" * 400 + ";x": "\x00x", "&#;&#x41;": "&#;&#x41;",
}


def test_entities(spark):
    rows = spark.createDataFrame([(k,) for k in ENTITIES], "t string").select("t", hx.strip_tags(F.col("t")).alias("s"), hx.clean_html(F.col("t")).alias("c")).collect()
    assert {r.t: r.s for r in rows} == ENTITIES and all(r.c == r.s for r in rows)


def test_crawl_passes_bad_links_over(spark):
    html = '<a href="http://a b/x">bad</a><a href="/n">next</a><a href="http://h.org:80/m">same</a><a href="http://h.org:81/o">other port</a><a href="x.html">art</a>'
    pages = spark.createDataFrame([("http://h.org/", html), ("http://h.org/", "zz"), ("http://h.org/n", ""), ("http://h.org/m", None), ("http://h.org:81/o", "")], "url string, html string")
    seen, found = crawl.discover(pages, spark.createDataFrame([("http://h.org/",)], "url string"))
    assert {(r.url, r.depth) for r in seen.collect()} == {("http://h.org/", 0), ("http://h.org/n", 1), ("http://h.org/m", 1)}
    assert [r.url for r in found.collect()] == ["http://h.org/x.html"]


def test_long_numbers(spark):
    t = F.lit("【矛盾#99999999999999999999】#99999999999999999999 【矛盾#2】 #3")
    valid = F.array(F.lit(3).cast("bigint"))
    assert spark.range(1).select(tx.marker_numbers(t), provenance.ref_tokens(t, valid)).first() == ([2], [3])


def test_ladder_keeps_null_and_repeated_keys(spark):
    asked = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "k int, p string")
    client = lambda p, t: f"{p}{t}"
    found = review.ladder(asked, "k", "p", client, lambda r: r, lambda r: r.contains("a") | (r.contains("c") & r.contains("0.3")), (0.0, 0.3, 0.7))
    assert sorted((r.k or 0, r.parsed) for r in found.collect()) == [(0, "b0.7"), (0, "c0.3"), (1, "a0.0"), (1, "d0.7")]


def test_markdown_is_linear(spark):
    lines = 20_000
    text = "\n".join(f"## h{i}\nbody {i}" for i in range(lines))
    assert tx.markdown_segments(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").count() == lines


MASKED = {
    '{"token": {"a":1}, "b":2}': '{"token":"***","b":2}', '{"a":{"b":{"c":{"d":{"e":1}},"k":[1,[2,[3]]]}}}': '{"a":{"b":{"c":{"d":"[…]"},"k":["[…]","[…]"]}}}',
    '[1, "a\\"b", null, true, {"apiKey": [1,2], "z": "{\\"token\\": 1}"}]': '[1,"a\\"b",null,true,{"apiKey":"***","z":"{\\"token\\": 1}"}]', '"str"': '"str"', "5": "5", "null": "null", "no json": None, "": None,
    "{}": "{}", "[]": "[]", '{"x": "é\\n", "Password": null, "s":"5", "n": null}': '{"x":"é\\n","Password":"***","s":"5","n":null}', '{"b":1,"b":2}': None, '{"tokens": [1, 2]': None,
}


def test_masking_follows_the_tree(spark):
    rows = spark.createDataFrame([(k,) for k in MASKED], "t string").select("t", tx.masked(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == MASKED
