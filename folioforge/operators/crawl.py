"""Crawling a link graph of pages that are there already: breadth-first discovery and two-level recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions import html as hx
from folioforge.functions import text as tx
from folioforge.functions import url as ux
from folioforge.operators import library
from folioforge.plans.lineage import cut_lineage

#: Links from the start that are followed at most; pages read at most; characters of a body that the exact filter sees.
DEPTH, PAGES, BODY_CHARS = 2, 20, 12_000


def discover(pages: DataFrame, roots: DataFrame, depth: int = DEPTH, most: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """Breadth-first over the sites of ``roots`` (url), in ``pages`` (url, html) that were fetched already.

    Returns the pages read, ``(root, url, depth, visited)``, and the articles found, ``(root, key, url, title)``. Only links to the root's
    own host and port count; a link that is no URL counts nowhere. Of pages with one URL the smallest text stands. Links to articles are collected, each once by its key, the first one found; other links are followed, in the order
    of a queue, down to ``depth``. At most ``most`` pages that could be read count for a site. All sites go one level in a step; a site's
    queue is bounded by the links of ``most`` pages.
    """
    by_url = pages.groupBy("url").agg(F.min("html").alias("html"))
    queue = roots.select(F.col("url").alias("root"), "url", F.array(F.lit(0).cast("bigint")).alias("place")).distinct()
    seen, articles = None, None
    for at in range(depth + 1):
        if seen is not None:
            queue = queue.join(seen.select("root", "url"), ["root", "url"], "left_anti")
        ready = queue.groupBy("root", "url").agg(F.min("place").alias("place")).join(by_url.select("url"), "url", "left_semi")
        done = seen.groupBy("root").agg(F.count("*").alias("_done")) if seen is not None else None
        ready = ready.join(done, "root", "left") if done is not None else ready.withColumn("_done", F.lit(0))
        nth = F.coalesce("_done", F.lit(0)) + F.row_number().over(Window.partitionBy("root").orderBy("place", "url"))
        level = cut_lineage(ready.withColumn("visited", nth.cast("bigint")).where(F.col("visited") <= most).select("root", "url", F.lit(at).cast("bigint").alias("depth"), "visited"))
        seen = level if seen is None else cut_lineage(seen.unionByName(level))
        links = hx.extract_links(level.join(by_url, "url").withColumn("_from", F.struct("root", "visited")), "_from", "url", "html")
        links = links.select("_from.root", F.col("href").alias("url"), "link_text", F.array(F.col("_from.visited"), "position").alias("place")).where(ux.host(F.col("url")) == ux.host(ux.normal(F.col("root"))))
        links = cut_lineage(links)
        found = links.where(hx.article_url(F.col("url"))).select("root", hx.url_key(F.col("url")).alias("key"), "place", "url", F.coalesce(F.nullif("link_text", F.lit("")), "url").alias("title"))
        articles = found if articles is None else articles.unionByName(found)
        queue = links.where(~hx.article_url(F.col("url"))).select("root", "url", "place")
    first = articles.groupBy("root", "key").agg(F.min_by(F.struct("url", "title"), F.struct("place", "url")).alias("a"))
    return seen, first.select("root", "key", "a.url", "a.title")


def holds(title: Column, body: Column, terms: Column) -> Column:
    """Whether a title and the start of a cleaned body, read as one text, hold a whole term."""
    return tx.matches_exact(F.left(F.concat_ws("\n", F.coalesce(title, F.lit("")), body), F.lit(BODY_CHARS)), terms)


def recall(pages: DataFrame, query: str, title: str, html: str) -> DataFrame:
    """Pages whose title has to do with the query's topic terms and what they stand for, and of them those whose title or cleaned body
    holds a whole term near the start. The cheap test comes first."""
    terms = tx.topic_terms(F.lit(query))
    terms = F.array_union(terms, tx.expand_terms(terms))
    coarse = pages.where(tx.matches_any(F.col(title), terms))
    return coarse.where(holds(F.col(title), hx.clean_html(F.col(html)), terms))


def save_to_task(found: DataFrame, stored: DataFrame, task: str, url: str = "url", task_col: str = "task_id") -> DataFrame:
    """``stored`` with the found pages in the scope of a task; what the task has already isn't added again."""
    return library.insert_ignore(stored, found.withColumn(task_col, F.lit(task)).select(*stored.columns), [url, task_col])


def new_only(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incremental crawl: what isn't stored yet, each once."""
    return found.dropDuplicates([key]).join(stored, key, "left_anti")
