"""Queries over the full-text index: an index is built once for a table, below the shared folder, and searched by all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.operators import fulltext as ft
from folioforge.plans.lineage import shared_folder
from folioforge.queries.tables import derived, duck, table

_built: dict[tuple[str, str], ft.Index] = {}

#: What the documents are after the changes of fts_changes.
CHANGED = "SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN concat('Changed with care: ', text) ELSE text END AS text FROM {documents} WHERE doc_id % 5 <> 0"


def _new(spark, docs) -> ft.Index:
    index = ft.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(docs, "text")
    return index


def _index(spark, d) -> ft.Index:
    at = spark.sparkContext.applicationId, d
    if at not in _built:
        _built[at] = _new(spark, table(spark, d, "documents"))
    return _built[at]


def _rounded(found):
    return found.select("doc_id", F.round("score", 6).alias("score"))


def fts_index(spark, d):
    """A whole index, built anew: of each word how many documents have it, how often, and the sum of its positions."""
    postings = _new(spark, table(spark, d, "documents")).tables.read("postings")
    places = F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda s, x: s + x))
    return postings.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").cast("bigint").alias("n"), places.cast("bigint").alias("places"))


def fts_search(spark, d):
    return _rounded(_index(spark, d).search(ft.bare("this with")))


def fts_phrase(spark, d):
    return _rounded(_index(spark, d).search(ft.phrase("of the") | ft.phrase("with this with"), None))


def fts_prefix(spark, d):
    return _rounded(_index(spark, d).search(ft.prefix("tio") & ft.phrase("from a", prefix=True), None))


def fts_boolean(spark, d):
    return _rounded(_index(spark, d).search((ft.phrase("the") & (ft.phrase("from") | ft.phrase("por"))) - ft.phrase("is the"), None))


def fts_changes(spark, d):
    """Documents come in two parts, some change, some go; then they are searched."""
    docs, late = table(spark, d, "documents").select("doc_id", "text"), "doc_id % 3 = 0"
    index = _new(spark, docs.where(f"NOT {late}"))
    index.put(docs.where(late), "text")
    index.put(derived(spark, d, CHANGED).where("doc_id % 7 = 1"), "text", gone=docs.where("doc_id % 10 = 0").select("doc_id"))
    index.remove(docs.where("doc_id % 5 = 0").select("doc_id"))
    return _rounded(index.search(ft.phrase("changed with") | (ft.prefix("car") - ft.phrase("from")), None))


QUERIES = {f.__name__: f for f in (fts_index, fts_search, fts_phrase, fts_prefix, fts_boolean, fts_changes)}

_words = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _tf(words: str, begins: bool = False) -> str:
    parts = words.split()
    test = [f"l[i + {k}] = '{w}'" for k, w in enumerate(parts)]
    if begins:
        test[-1] = f"starts_with(coalesce(l[i + {len(parts) - 1}], ''), '{parts[-1]}')"
    return f"len(list_filter(range(1, len(l) + 1), lambda i: {' AND '.join(test)}))"


def _search(leaves: list[str], holds: str, docs: str = "documents", best: bool = False) -> str:
    counts = ", ".join(f"{tf}::DOUBLE AS f{i}" for i, tf in enumerate(leaves))
    dfs = ", ".join(f"count_if(f{i} > 0) AS d{i}" for i in range(len(leaves)))
    part = "greatest(ln((docs - d{0} + 0.5::DOUBLE) / (d{0} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{0} * 2.2::DOUBLE / (f{0} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))"
    score = " + ".join(part.format(i) for i in range(len(leaves)))
    return f"""WITH w AS (SELECT doc_id, {_words} AS l FROM {docs}), t AS (SELECT doc_id, len(l)::DOUBLE AS n, {counts} FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, {dfs} FROM t)
SELECT doc_id, round(exact, 6) AS score FROM (SELECT doc_id, {score} AS exact FROM t, s WHERE {holds}) {"ORDER BY exact DESC, doc_id LIMIT 50" if best else ""}"""


ORACLES = {
    "fts_index": f"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS place FROM (SELECT doc_id, {_words} AS l FROM documents)) GROUP BY term",
    "fts_search": _search([_tf("this"), _tf("with")], "f0 > 0 AND f1 > 0", best=True),
    "fts_phrase": _search([_tf("of the"), _tf("with this with")], "f0 > 0 OR f1 > 0"),
    "fts_prefix": _search([_tf("tio", True), _tf("from a", True)], "f0 > 0 AND f1 > 0"),
    "fts_boolean": _search([_tf("the"), _tf("from"), _tf("por"), _tf("is the")], "f0 > 0 AND (f1 > 0 OR f2 > 0) AND NOT f3 > 0"),
    "fts_changes": _search([_tf("changed with"), _tf("car", True), _tf("from")], "f0 > 0 OR (f1 > 0 AND NOT f2 > 0)", f"({duck(CHANGED)})"),
}
