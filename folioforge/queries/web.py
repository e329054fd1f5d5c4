"""Queries over vectors, full text, change capture, pages and the crawl."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.functions import html as hx
from folioforge.functions.text import trim_ws
from folioforge.operators import cdc, crawl, retrieval
from folioforge.operators.versions import Change, Tables, cascade
from folioforge.plans.lineage import shared_folder
from folioforge.sources import files
from folioforge.queries.tables import derived, duck, table
from folioforge.queries.text import LEXICAL, W



#: Pages with what stops careless decoders at their end: halves of a character, numbers beyond 64 bits; and with links of all kinds.
ENDINGS = {0: ("&#55357;&#56832;&#33;", "😀!"), 1: ("&#100000000000000016384;x", "䀀x"), 2: ("y&#55357;&#65;", "y�A"), 3: ("", "")}
ODD_PAGES = "SELECT page_id, concat(html, CASE page_id % 4 {}END) AS html FROM {{pages}}"
ODD, MEANT = (ODD_PAGES.format("".join(f"WHEN {k} THEN '{v[i]}' " for k, v in ENDINGS.items())) for i in (0, 1))
LINKED = """SELECT page_id, url, concat(html, '<a href="../x', page_id, '/./y.html">up</a><a href="//CDN.example.org:443/z?q=', page_id, '#f">other</a><a href="http://a b/x">bad</a>',
  '<a href="?p=', page_id, '">same</a><a href="mailto:x@y.org">mail</a><a href="https://h:99999/">port</a>') AS html FROM {pages}"""


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first().embedding]


def vector_topk(spark, d):
    e = table(spark, d, "embeddings").where("vec_id <> 0")
    return retrieval.vector_search(e, _query_vector(spark, d), "embedding", limit=10, tie="vec_id").select("vec_id", F.round("cosine", 6).alias("cosine"))


def vector_threshold(spark, d):
    found = retrieval.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d), "embedding", least=0.2)
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"))


def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", retrieval.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def hybrid_retrieve(spark, d):
    """Chunks of all documents by words, and the stored vectors of first paragraphs, in one list by document and place."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    lex = retrieval.lexical(docs, "tion and the", "doc_id", "source", "text")
    vec = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("position", F.lit("第1段"))
    return retrieval.hybrid(lex, retrieval.vector_search(vec, _query_vector(spark, d), "embedding", least=0.2), ["doc_id", "position"])


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))






def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 0").select(F.concat(F.lit("Dir\\"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash"))
    moved = F.when(F.col("doc_id") % 17 == 0, F.lit("new/")).otherwise(F.lit("dir/"))
    new = docs.where("doc_id % 11 <> 0").select(F.concat(moved, F.col("doc_id").cast("string")).alias("path"), F.md5(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return old, new


def cdc_diff(spark, d):
    return cdc.diff(*_snapshots(spark, d)).select("path", "change")


def cdc_moves(spark, d):
    return cdc.moves(cdc.diff(*_snapshots(spark, d)))


def _stamps(spark, d):
    docs = table(spark, d, "documents")
    stamp = lambda touched: [F.col("n_chars").alias("size"), (F.col("doc_id") + F.when(touched, 1).otherwise(0)).alias("mtime")]
    known = docs.where("doc_id % 10 <> 0").select(F.concat(F.lit("Dir\\"), F.col("doc_id").cast("string")).alias("path"), *stamp(F.lit(False)))
    return known, docs.where("doc_id % 11 <> 0").select(F.concat(F.lit("dir/"), F.col("doc_id").cast("string")).alias("path"), *stamp(F.col("doc_id") % 13 == 0))


def cdc_screen(spark, d):
    """Which files a scan by time and size leaves to be opened."""
    return cdc.screen(*_stamps(spark, d)).select("path", "state")


def cascade_commit(spark, d):
    """Customers go, with their orders and lines, in one change of three tables that were written in two."""
    t = Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line"})
    read = lambda n: table(spark, d, n)
    customer, orders = read("customer").select("c_custkey", "c_nationkey"), read("orders").select("o_orderkey", "o_custkey")
    lines = read("lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), "l_orderkey", F.col("l_quantity").alias("quantity"))
    t.commit({"customer": Change(customer), "orders": Change(orders.where("o_orderkey % 2 = 0")), "lineitem": Change(lines.where("l_orderkey % 2 = 0"))})
    t.commit({"orders": Change(orders.where("o_orderkey % 2 = 1")), "lineitem": Change(lines.where("l_orderkey % 2 = 1"))})
    cascade(t, [("customer", "c_custkey", "orders", "o_custkey", "cascade"), ("orders", "o_orderkey", "lineitem", "l_orderkey", "cascade")], "customer", customer.where("c_nationkey % 3 = 0"))
    of = lambda n, total: t.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(total).cast("bigint").alias("total"))
    return of("customer", "c_custkey").union(of("orders", "o_orderkey")).union(of("lineitem", "quantity"))


def ingest_status(spark, d):
    """Documents as files of several kinds, through the parsers: what was read, by kind and error. A text is no Word file or sheet."""
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".docx", ".xlsx", ".pdf"))), (F.col("doc_id") % 5 + 1).cast("int")))
    data = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("504B0304")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    got = files.parse(table(spark, d, "documents").select(name.alias("path"), F.md5("text").alias("hash"), data.alias("content")))
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1))
    return got.groupBy(kind.alias("kind"), "error_code").agg(F.count("*").alias("n"))


def mean_pool(spark, d):
    """Three token vectors made of each stored one, the third masked."""
    v = F.col("embedding").cast("array<double>")
    pooled = retrieval.mean_pooled(F.array(v, F.reverse(v), F.transform(v, lambda x: x * 100)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(pooled, F.lit(0)), 6).alias("first"), F.round(F.get(pooled, F.lit(5)), 6).alias("sixth"))


def vector_model(spark, d):
    """The nearest of the vectors that one of two models made, among every other source."""
    e = table(spark, d, "embeddings").withColumn("model_id", F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")))
    scope = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("vec_id"))
    found = retrieval.vector_search(e.join(scope, "vec_id", "left_semi"), _query_vector(spark, d), "embedding", limit=20, tie="vec_id", model=("model_id", "m1"))
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"))


def crawl_new(spark, d):
    """Pages that a second crawl finds and the store lacks."""
    pages = table(spark, d, "pages").select(hx.url_key(F.col("url")).alias("key"), F.length("html").alias("n"))
    return crawl.new_only(pages.select("key"), table(spark, d, "pages").where("page_id % 3 = 0").select(hx.url_key(F.col("url")).alias("key")), "key")


def strip_tags(spark, d):
    return derived(spark, d, ODD).select("page_id", F.sha2(hx.strip_tags(F.col("html")), 256).alias("hash"))


def clean_html(spark, d):
    t = hx.clean_html(F.col("html"))
    return derived(spark, d, ODD).select("page_id", F.sha2(t, 256).alias("hash"))


def crawl_links(spark, d):
    return hx.raw_links(table(spark, d, "pages").select("page_id", "html"), "page_id", "html").select("page_id", "position", "href", "link_text")


def resolved_links(spark, d):
    """Where the links of all pages lead to; those that lead nowhere are gone."""
    return hx.extract_links(derived(spark, d, LINKED), "page_id", "url", "html")


def url_dedupe(spark, d):
    return table(spark, d, "pages").groupBy(hx.url_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


def article_urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit(".htm?page=2")).when(F.col("page_id") % 3 == 1, F.lit(".xml")).otherwise(F.lit(".ASPX"))).alias("url"))
    return pages.where(hx.article_url(F.col("url"))).select("page_id")



def page_size_cap(spark, d):
    return table(spark, d, "pages").where(F.octet_length("html") <= 5 * 1024 * 1024).select("page_id", F.octet_length("html").cast("bigint").alias("size"))


def import_pages(spark, d):
    pages = table(spark, d, "pages").where(hx.valid_url(F.col("url")) & (F.octet_length("html") <= 5 * 1024 * 1024))
    return pages.select("page_id", trim_ws(F.col("url")).alias("title"), F.length(hx.clean_html(F.col("html"))).cast("bigint").alias("n_chars"))




QUERIES = {f.__name__: f for f in (vector_topk, vector_threshold, l2_normalize, hybrid_retrieve, content_hash, cdc_diff, cdc_moves, cdc_screen, cascade_commit, mean_pool, vector_model, crawl_new, ingest_status, strip_tags, clean_html, crawl_links, resolved_links, url_dedupe, article_urls, page_size_cap, import_pages)}

_v = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_cos = f"list_cosine_similarity(embedding::DOUBLE[], {_v})"


def _tags(x: str) -> str:
    x = f"regexp_replace({x}, '<script[^>]*>.*?</script>', '', 'gis')"
    x = f"regexp_replace({x}, '<style[^>]*>.*?</style>', '', 'gis')"
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def _strip(x: str) -> str:
    x = f"replace(replace(replace(replace(replace({_tags(x)}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
    return f"regexp_replace(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"replace(replace(replace(replace(replace({_tags(x)}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', '''')"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{W}+|{W}+$', '', 'g')"


_old = "SELECT 'dir/' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0"
_new = "SELECT CASE WHEN doc_id % 17 = 0 THEN 'new/' ELSE 'dir/' END || doc_id AS path, md5(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0"
_anchor = r"""<a\b[^>]*href\s*=\s*["''']([^"''']+)["'''][^>]*>(.*?)</a>""".replace("'''", "''")


def _links(pages: str, columns: str) -> str:
    found = f"WITH a AS (SELECT {columns}, regexp_extract_all(html, '(?is){_anchor}', 1) AS h, regexp_extract_all(html, '(?is){_anchor}', 2) AS x FROM {pages}), e AS (SELECT {columns}, generate_subscripts(h, 1) - 1 AS position, trim(unnest(h)) AS href, unnest(x) AS x FROM a)"
    return f"{found} SELECT {columns}, position, href, {_strip('x')} AS link_text FROM e WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')"



ORACLES = {
    "vector_topk": f"SELECT vec_id, round({_cos}, 6) AS cosine FROM embeddings WHERE vec_id <> 0 ORDER BY {_cos} DESC, vec_id LIMIT 10",
    "vector_threshold": f"SELECT vec_id, round({_cos}, 6) AS cosine FROM embeddings WHERE {_cos} >= 0.2",
    "l2_normalize": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE * 3 / sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3)))), 6) AS first FROM embeddings",
    "hybrid_retrieve": f"WITH k AS ({LEXICAL}) SELECT doc_id, position, score, 'lexical' AS route FROM k UNION ALL SELECT vec_id, '第1段', floor({_cos} * 100 + 0.5)::BIGINT, 'vector' FROM embeddings WHERE {_cos} >= 0.2 AND vec_id IN (SELECT doc_id FROM documents) AND vec_id NOT IN (SELECT doc_id FROM k WHERE position = '第1段')",
    "content_hash": "SELECT doc_id, sha256(text) AS hash, strlen(text) AS size FROM documents",
    "cdc_diff": f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS change FROM ({_old}) o FULL JOIN ({_new}) n ON o.path = n.path",
    "cdc_moves": f"WITH g AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM ({_old}) WHERE path NOT IN (SELECT path FROM ({_new}))), c AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM ({_new}) WHERE path NOT IN (SELECT path FROM ({_old}))) SELECT g.h AS hash, g.path AS old_path, c.path AS new_path FROM g JOIN c ON g.h = c.h AND g.n = c.n",
    "cdc_screen": "WITH k AS (SELECT 'dir/' || doc_id AS path, doc_id AS m, n_chars AS s FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT 'dir/' || doc_id AS path, doc_id + (doc_id % 13 = 0)::INT AS m, n_chars AS s FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(k.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN k.m = n.m AND k.s = n.s THEN 'same' ELSE 'open' END AS state FROM k FULL JOIN n ON k.path = n.path",
    "cascade_commit": "WITH c AS (SELECT * FROM customer WHERE c_nationkey % 3 <> 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0)), l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders ANTI JOIN o USING (o_orderkey))) SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM c UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_quantity)::BIGINT FROM l",
    "ingest_status": "SELECT ['txt', 'md', 'docx', 'xlsx', 'pdf'][doc_id % 5 + 1] AS kind, CASE doc_id % 5 WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'PARSE_FAILED' ELSE 'PARSE_UNSUPPORTED' END WHEN 3 THEN 'PARSE_FAILED' WHEN 4 THEN 'PARSE_UNSUPPORTED' END AS error_code, count(*) AS n FROM documents GROUP BY ALL",
    "mean_pool": "WITH p AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE + embedding[len(embedding) + 1 - i]::DOUBLE) / 2) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[6] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS sixth FROM p",
    "vector_model": f"SELECT vec_id, round({_cos}, 6) AS cosine FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 2 = 0 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY {_cos} DESC, vec_id LIMIT 20",
    "crawl_new": "WITH k AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '/+$', '') AS key FROM pages) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_id % 3 = 0)",
    "strip_tags": f"SELECT page_id, sha256({_strip('html')}) AS hash FROM ({duck(MEANT)})",
    "clean_html": f"SELECT page_id, sha256({_clean('html')}) AS hash FROM ({duck(MEANT)})",
    "crawl_links": _links("pages", "page_id"),
    "resolved_links": f"""WITH l AS ({_links(f"({duck(LINKED)})", "page_id, url")}), u AS (
  SELECT *, regexp_extract(url, '^https?://[^/?#]*') AS site, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^$', '/') AS path FROM l
), r AS (
  SELECT page_id, position, link_text, CASE
    WHEN href LIKE '../%' THEN site || regexp_replace(regexp_extract(path, '^.*/'), '([^/]+/)?$', '') || replace(substr(href, 4), '/./', '/')
    WHEN href LIKE '//CDN%' THEN regexp_extract(url, '^https?:') || replace(href, 'CDN.example.org:443', CASE WHEN url LIKE 'https%' THEN 'cdn.example.org' ELSE 'cdn.example.org:443' END)
    WHEN href LIKE '?%' THEN site || path || href WHEN href LIKE '/%' THEN site || href WHEN href LIKE 'http://a b%' OR href LIKE 'mailto:%' OR href LIKE '%:99999/' THEN NULL
    ELSE '?' || href END AS href
  FROM u
)
SELECT page_id, position, link_text, array_to_string(list_transform(regexp_extract_all(href, '[\x21-\x7E]+|[^\x21-\x7E]+'), lambda s: CASE WHEN regexp_matches(s, '^[\x21-\x7E]') THEN s ELSE url_encode(s) END), '') AS href FROM r WHERE href IS NOT NULL""",
    "url_dedupe": "SELECT regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '/+$', '') AS key, count(*) AS n FROM pages GROUP BY 1",
    "article_urls": "SELECT page_id FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.htm?page=2' WHEN 1 THEN '.xml' ELSE '.ASPX' END AS url FROM pages) WHERE regexp_matches(regexp_extract(url, '^[^?#]*'), '(?i)\\.(htm|html|shtml|aspx?)\\b')",
    "page_size_cap": "SELECT page_id, strlen(html) AS size FROM pages WHERE strlen(html) <= 5242880",
    "import_pages": f"SELECT page_id, url AS title, length({_clean('html')}) AS n_chars FROM pages WHERE regexp_matches(url, '(?i)^https?://.+')",
}
