"""Registered sites: lists of their articles, kept in step with what a crawl finds, and the articles that a task's instruction asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions import html as hx
from folioforge.functions import text as tx
from folioforge.functions import url as ux
from folioforge.operators import crawl
from folioforge.plans.lineage import cut_lineage


def sync(sites: DataFrame, listed: DataFrame, pages: DataFrame, now: Column, depth: int = crawl.DEPTH, most: int = crawl.PAGES) -> tuple[DataFrame, DataFrame]:
    """What a crawl of all ``sites`` (site_id, root_url) in ``pages`` (url, html) changes in ``listed`` (site_id, url, title, discovered_at).

    Returns the changes for ``library.upsert`` or a version of tables: rows of ``listed`` that are new, discovered now, or whose title
    differs, which keep their time; and ``(site_id, last_synced_at, added)`` of every site, where ``added`` counts new articles. A
    root that is no URL finds nothing and counts as synced; sites with one root have the same articles each. Nothing leaves the list.
    """
    roots = cut_lineage(sites.select("site_id", ux.normal(F.col("root_url")).alias("root")))
    _, found = crawl.discover(pages, roots.where("root IS NOT NULL").select(F.col("root").alias("url")), depth, most)
    found = roots.join(found.select("root", "url", F.col("title").alias("_title")), "root").select("site_id", "url", "_title").distinct()
    own = listed.select("site_id", "url", "title", "discovered_at", F.lit(True).alias("_there"))
    both = cut_lineage(found.join(own, ["site_id", "url"], "left").where(~F.col("title").eqNullSafe(F.col("_title")) | F.col("_there").isNull()))
    kind = listed.schema["discovered_at"].dataType
    changed = both.select("site_id", "url", F.col("_title").alias("title"), F.when(F.col("_there"), F.col("discovered_at")).otherwise(now.cast(kind)).alias("discovered_at"))
    added = both.where("_there IS NULL").groupBy("site_id").agg(F.count("*").alias("added"))
    state = sites.select("site_id").join(added, "site_id", "left").select("site_id", now.alias("last_synced_at"), F.coalesce("added", F.lit(0).cast("bigint")).alias("added"))
    return changed, state


def _rank(at: Column) -> Column:
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(0).cast("bigint"))


def related(sites: DataFrame, listed: DataFrame, stored: DataFrame, pages: DataFrame, query: str, task: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Articles of all sites that an instruction asks for: ``(site_id, url)``, and of them the rows to add to the task's pages, ``(url,
    task_id, title, text, status, created_at)``.

    An article on a list whose title has to do with the query's terms, or with what they stand for, is a candidate. One that the task has
    in ``stored`` (url, task_id) is found as it is. Of the others those are read that ``pages`` (url, html) has, and stay if their title
    and the start of their cleaned text hold a whole term. Sites count by ``created_at``, their articles newest first; of an article that
    several sites list, the first title that holds makes the row, and what comes after it in this order is found too. An empty title is
    replaced by the URL. A query without terms finds nothing. Pages are cleaned once each, and only those of candidates.
    """
    terms = tx.topic_terms(F.lit(query))
    terms = F.array_union(terms, tx.expand_terms(terms))
    order = F.struct(_rank(F.col("created_at")).alias("a"), F.col("site_id").alias("b"), (-_rank(F.col("discovered_at"))).alias("c"))
    hits = listed.where(tx.matches_any(F.col("title"), terms)).join(sites.select("site_id", "created_at"), "site_id")
    hits = cut_lineage(hits.select("site_id", "url", F.coalesce("title", F.lit("")).alias("title"), order.alias("place")))
    have = stored.where(F.col("task_id").eqNullSafe(F.lit(task))).select("url").distinct()
    due = cut_lineage(hits.join(have, "url", "left_anti"))
    bodies = pages.where("html IS NOT NULL").join(due.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    bodies = cut_lineage(bodies.select("url", hx.clean_html(F.col("html")).alias("text")))
    heads = due.join(bodies.select("url", F.left("text", F.lit(crawl.BODY_CHARS)).alias("_head")), "url")
    good = heads.where(crawl.holds(F.col("title"), F.col("_head"), terms))
    first = cut_lineage(good.groupBy("url").agg(F.min("place").alias("_first"), F.min_by("title", F.struct("place", "title")).alias("title")))
    added = first.join(bodies, "url").select("url", F.lit(task).alias("task_id"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "text", F.lit("ready").alias("status"), now.alias("created_at"))
    later = due.join(first.select("url", "_first"), "url").where(F.col("place") >= F.col("_first"))
    return hits.join(have, "url", "left_semi").select("site_id", "url").unionByName(later.select("site_id", "url")), added
