"""Queries over the library operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioforge.functions.text import pinned
from folioforge.operators import library as lib
from folioforge.queries.tables import table, values



def library_scan(spark, d):
    docs = table(spark, d, "documents")
    return lib.library_scan(docs.select("doc_id", "source", "lang"), docs.where("doc_id % 7 = 0").select("doc_id"), "doc_id", "doc_id")


def point_lookup(spark, d):
    return table(spark, d, "documents").where("doc_id = 5").select("doc_id", "lang", "source", "n_chars")


def scope_filter(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isin(1, 3, 9, 27)).select("doc_id", "lang")


def lookup_in_order(spark, d):
    return lib.lookup_in_order(table(spark, d, "documents").select("doc_id", "lang"), [9, 3, 9, 1, -1], "doc_id")



def ordered_lists(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("nth"))
    return turns.orderBy("conv_id", "turn")


def tag_division(spark, d):
    kinds = ["click", "view", "purchase"]
    ev = table(spark, d, "events")
    return lib.having_all(ev, "user_id", "event_type", kinds + kinds[:1])


def tags_of_source(spark, d):
    return lib.tags_of(table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("r_regionkey")), table(spark, d, "region").select("r_regionkey", "r_name"), "n_name", "r_regionkey", "r_name")


def segment_enrich(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return lib.enrich(table(spark, d, "documents").select("doc_id", "source"), labels, "doc_id")



def pending_summaries(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def semi_exists(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


def chunks_per_source(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"))





def insert_ignore(spark, d):
    base = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    new = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("origin"))
    return lib.insert_ignore(base, new.union(new), ["doc_id"])


def batch_tag_cross(spark, d):
    existing = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"))
    return lib.batch_tag(existing, table(spark, d, "documents").select("doc_id"), values(spark, "('toxic'), ('clean')", "tag"))



def delete_anti(spark, d):
    return lib.delete_keys(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("quality = 0"), "doc_id")


def replace_children(spark, d):
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("qty"))
    new = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("qty"))
    found = lib.replace_children(base.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")), new.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")), "l_orderkey")
    return found.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("qty"), 6).alias("qty"))


def _delta(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 6))


def upsert_merge(spark, d):
    base, delta = _delta(spark, d)
    return lib.upsert(base, delta, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


def upsert_new_count(spark, d):
    base, delta = _delta(spark, d)
    return lib.count_new(base, delta.union(delta), ["c_custkey"])


def patch_columns(spark, d):
    """Two columns of customers at once, some of either, some set to null; the later of two changes of a customer."""
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    some = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast(base.schema["c_nationkey"].dataType).alias("c_nationkey"))
    names = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_mktsegment"), F.lit("c_nationkey")))
    first = some.select("*", names.alias("given"), F.lit(1).alias("n"))
    later = some.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("LATE")).select("*", F.array(F.lit("c_mktsegment"), F.lit("c_acctbal")).alias("given"), F.lit(2).alias("n"))
    return lib.patch_columns(base, first.unionByName(later), "c_custkey", "given", "n").select("c_custkey", "c_mktsegment", "c_nationkey")


def patch_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = rows.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, F.lit("PATCHED")).alias("value"))
    return lib.patch(rows, changes, "c_custkey", "c_mktsegment")


def cascade_delete(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    left = lib.cascade({"orders": o, "lineitem": li}, [("orders", "o_orderkey", "lineitem", "l_orderkey", "cascade")], "orders", o.where("o_orderkey % 10 = 0"), "o_orderkey")
    return left["lineitem"].groupBy("l_returnflag").agg(F.count("*").alias("n"))


def contradiction_nested(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("bigint").alias("nr"), F.col("l_quantity").cast("double").alias("qty"))
    nested = lib.nested_children(o, li, "key", "nr", ["qty"])
    return nested.select("key", F.size("children").cast("bigint").alias("n"), F.get("children", F.lit(0))["nr"].alias("first_nr"), F.expr("round(aggregate(children, 0D, (a, c) -> a + c.qty), 6)").alias("qty"))


def latest_draft(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return lib.latest_per_key(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


def workspace_status(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.count_if(F.col("doc_id") % 2 == 0).alias("workspace"), F.count_if((F.col("lang") == "en") & (F.col("doc_id") % 2 == 1)).alias("legacy"))


def pending_split(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("source", (F.col("toxic") == 1).alias("in_draft"))
    shown = F.coalesce("in_draft", F.lit(True))
    return rows.groupBy("source").agg(F.count_if(shown).alias("contradictions"), F.count_if(~shown).alias("warnings"))


def dup_hash_count(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")



def array_ops(spark, d):
    w, half = F.split("text", " "), F.ceil(F.size(F.split("text", " ")) / 2).cast("int")
    rows = pinned(table(spark, d, "documents").select("doc_id", "text"), w=w, a=F.slice(w, F.lit(1), half), b=F.slice(w, half + 1, F.size(w)))
    size = lambda x: F.size(x).cast("bigint")
    return rows.select("doc_id", size(F.array_distinct("w")).alias("n_distinct"), size(F.array_union("a", "b")).alias("n_union"), size(F.array_intersect("a", "b")).alias("n_both"), size(F.array_except("a", "b")).alias("n_first"))



QUERIES = {f.__name__: f for f in (patch_columns, library_scan, point_lookup, scope_filter, lookup_in_order, ordered_lists, tag_division, tags_of_source, segment_enrich, pending_summaries, semi_exists, chunks_per_source, insert_ignore, batch_tag_cross, delete_anti, replace_children, upsert_merge, upsert_new_count, patch_update, cascade_delete, contradiction_nested, latest_draft, workspace_status, pending_split, dup_hash_count, array_ops)}

ORACLES = {
    "library_scan": "SELECT doc_id, source, lang FROM documents WHERE doc_id % 7 <> 0",
    "point_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 5",
    "scope_filter": "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 3, 9, 27)",
    "lookup_in_order": "WITH w AS (SELECT id, min(at_) AS place FROM (SELECT unnest([9, 3, 9, 1, -1]) AS id, generate_subscripts([9, 3, 9, 1, -1], 1) AS at_) GROUP BY id) SELECT doc_id, lang, row_number() OVER (ORDER BY place) - 1 AS position FROM documents JOIN w ON doc_id = id",
    "ordered_lists": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations",
    "tag_division": "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 3",
    "tags_of_source": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "segment_enrich": "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)",
    "pending_summaries": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_exists": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "chunks_per_source": "SELECT source, count(*) AS n_docs, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "insert_ignore": "SELECT doc_id, 'labelled' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "batch_tag_cross": "SELECT doc_id, tag FROM documents, (VALUES ('toxic'), ('clean')) t(tag) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1 AND tag = 'toxic')",
    "delete_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "replace_children": "SELECT l_orderkey, count(*) AS n, round(sum(qty), 6) AS qty FROM (SELECT l_orderkey, l_quantity::DOUBLE AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY l_orderkey",
    "upsert_merge": "SELECT c_custkey, c_name, round(c_acctbal::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, 6) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "upsert_new_count": "SELECT count(*) AS n_new FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0",
    "patch_columns": "SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 THEN 'LATE' WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 AND c_custkey % 5 <> 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer",
    "patch_update": "SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'PATCHED' WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 = 0) GROUP BY l_returnflag",
    "contradiction_nested": "SELECT l_orderkey AS key, count(*) AS n, min(l_linenumber)::BIGINT AS first_nr, round(sum(l_quantity::DOUBLE), 6) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
    "latest_draft": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "workspace_status": "SELECT count_if(doc_id % 2 = 0)::BIGINT AS workspace, count_if(lang = 'en' AND doc_id % 2 = 1)::BIGINT AS legacy FROM documents",
    "pending_split": "SELECT source, count_if(coalesce(toxic = 1, true))::BIGINT AS contradictions, count_if(NOT coalesce(toxic = 1, true))::BIGINT AS warnings FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "dup_hash_count": "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "array_ops": "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), h AS (SELECT doc_id, w, w[1:ceil(len(w) / 2)::INT] AS a, w[ceil(len(w) / 2)::INT + 1:] AS b FROM w) SELECT doc_id, len(list_distinct(w))::BIGINT AS n_distinct, len(list_distinct(w))::BIGINT AS n_union, len(list_distinct(list_intersect(a, b)))::BIGINT AS n_both, (len(list_distinct(a)) - len(list_distinct(list_intersect(a, b))))::BIGINT AS n_first FROM h",
}
