"""Queries over clusters, contradictions, provenance and telemetry."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioforge.functions import text as tx
from folioforge.operators import cluster, provenance, retrieval, telemetry
from folioforge.plans.lineage import cut_lineage
from folioforge.queries.tables import table
from folioforge.queries.text import LEXICAL, W, _bare, _p

#: Dice of the cluster queries; the operator's own is lower, which on tables of one language links all documents to all.
LEAST = 0.9



def _cluster_source(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def gram_sets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("i"), "text")
    return cluster.gram_sets(docs, "doc_id", ["i"], "text").groupBy("doc_id").agg(F.count("*").alias("n"))


def _gram_lists(docs):
    return cluster.gram_lists(docs.withColumn("i", F.lit(0)), "doc_id", ["i"], "text")


def topic_edges(spark, d):
    return cluster.list_edges(_gram_lists(_cluster_source(spark, d)), "doc_id", LEAST).select("a", "b", F.round("dice", 6).alias("dice"))


def topic_clusters(spark, d):
    docs = _cluster_source(spark, d)
    return cluster.topic_clusters(docs, cluster.list_links(_gram_lists(docs), "doc_id", LEAST), "doc_id")


def topic_clusters_low(spark, d):
    """All documents at the operator's own Dice, where nearly all of a language link to all."""
    return cluster.linked_lists(_gram_lists(_cluster_source(spark, d)), "doc_id", pairs=True)


def scan_windows(spark, d):
    docs = _cluster_source(spark, d)
    sizes = docs.select("doc_id", F.length("text").alias("size"))
    c = cut_lineage(cluster.topic_clusters(docs, cluster.list_links(_gram_lists(docs), "doc_id", LEAST), "doc_id").join(sizes, "doc_id"))
    big = c.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2").select("cluster")
    blocks = c.join(big, "cluster").select("cluster", "doc_id", "size")
    w = cluster.greedy_windows(blocks, "cluster", ["doc_id"], "size", 4000)
    return w.groupBy("cluster").agg(F.max("window").alias("n_windows"), F.sum("size").alias("size"))


def greedy_windows(spark, d):
    p = tx.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "paragraph", F.length("text").alias("size"))
    return cluster.greedy_windows(p, "doc_id", ["paragraph"], "size", 1500).select("doc_id", "paragraph", "window")






def locate_apply(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("bigint").alias("line"))
    nth = o.withColumn("variant", F.row_number().over(Window.partitionBy("seq").orderBy("line")).cast("bigint"))
    asked = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("seq"), F.lit(2).cast("bigint").alias("variant"))
    return asked.join(nth, ["seq", "variant"])


def status_fold(spark, d):
    ev = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "adopt").when(F.col("event_type") == "error", "ignore").otherwise("revert")
    acts = ev.select("user_id", "event_id", action.alias("action"), (F.col("event_id") % 3).alias("variant"))
    own = acts.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("variant"))
    return cluster.status_fold(acts, own, "user_id", ["event_id"])


def _selection(spark, d):
    return table(spark, d, "documents").where("doc_id = 3").select(F.substring("text", 101, 60)).first()[0]


def exact_trace(spark, d):
    return provenance.exact_matches(table(spark, d, "documents"), _selection(spark, d), "doc_id", "text")


def _paragraphs(spark, d):
    """Every paragraph stands for a chunk that was given to a model."""
    return tx.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("paragraph").alias("position"), F.col("text").alias("chunk"))


def overlap_top10(spark, d):
    return retrieval.overlap_top(_paragraphs(spark, d), "tion and the erinth", "chunk", ["doc_id", "position"]).select("doc_id", "position", "hits")


def trace_fallback5(spark, d):
    lex = retrieval.lexical(table(spark, d, "documents").select("doc_id", "source", "text"), "tion and the", "doc_id", "source", "text")
    return lex.orderBy("doc_id", "paragraph", "piece").limit(5).select("doc_id", "paragraph", "piece", "score")


def trace_cascade(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return provenance.trace(docs, _paragraphs(spark, d), _selection(spark, d), "doc_id", "source", "text")


def trace_context(spark, d):
    """A selection that no document holds, so that the second stage answers."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return provenance.trace(docs, _paragraphs(spark, d), "tionqq xandz thez erinth", "doc_id", "source", "text")


def source_ref_list(spark, d):
    return cluster.ordered_refs(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")




def json_lists(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.split("text", " ")).alias("j"))
    return rows.select("doc_id", F.sha2(F.array_join(F.from_json("j", "array<string>"), " "), 256).alias("hash"))






def event_props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


def recent5_eta(spark, d):
    ev = table(spark, d, "events").withColumn("ms", F.col("value") * 1000)
    return telemetry.recent_estimate(ev, "event_type", F.col("event_id"), F.col("event_type") != "error", "ms", {"error": 30, "generate": 180, "click": 60})


def chat_last20(spark, d):
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (tx.trim_ws(F.col("text")) != ""))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("n", nth).where("n <= 20").select("conv_id", "turn", "role")


def ring_buffer(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(1000).select("event_id", "event_type")


def progress_curve(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id")
    done = F.count("*").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("conv_id", "turn", F.round(100.0 * done / F.count("*").over(w), 6).alias("percent"))


def conv_chars(spark, d):
    """Characters of each conversation's messages as JSON."""
    return telemetry.json_chars(table(spark, d, "conversations"), "conv_id", {"role": "role", "content": "text"}).select("conv_id", "n_chars")


def log_report(spark, d):
    """Reports by type and day in pages: a header, a line for each call, and its payload."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit("\n"), "props")
    calls = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", line.alias("line"))
    return telemetry.log_pages(calls, ["event_type", "day"], "event_id", "line", 50).select("event_type", "day", "page", "n", F.sha2("text", 256).alias("hash"))


QUERIES = {f.__name__: f for f in (gram_sets, topic_edges, topic_clusters, topic_clusters_low, scan_windows, greedy_windows, locate_apply, status_fold, exact_trace, overlap_top10, trace_fallback5, trace_cascade, trace_context, source_ref_list, json_lists, event_props, recent5_eta, chat_last20, ring_buffer, progress_curve, conv_chars, log_report)}

_sets = f"SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, length(b))), lambda i: substring(b, i::BIGINT, 2))) AS g FROM (SELECT doc_id, {_bare('text')} AS b FROM documents)"
_edges = f"""s AS ({_sets}), kl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(list_sort(g), chr(0))) AS first FROM s WHERE len(g) > 0),
w AS (SELECT doc_id, unnest(g) AS gram, len(g) AS n FROM s JOIN kl USING (doc_id) WHERE doc_id = first),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, 2.0::DOUBLE * count(*) / (x.n + y.n) AS dice FROM w x JOIN w y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 2.0::DOUBLE * count(*) / (x.n + y.n) >= {LEAST}
  UNION ALL SELECT first, doc_id, 1.0 FROM kl WHERE doc_id <> first)"""
_cc = f"{_edges}, l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.v, r.m FROM r JOIN l ON l.u = r.n WHERE r.m < l.v), c AS (SELECT n AS doc_id, min(m) AS cluster FROM r GROUP BY n)"
#: The smallest source within twelve links; documents that link at a low Dice lie nearer to each other.
_SPREAD = ", ".join(f"n{i + 1} AS MATERIALIZED (SELECT n, least(any_value(m), min(o)) AS m FROM (SELECT x.n, x.m, y.m AS o FROM n{i} x LEFT JOIN l ON u = x.n LEFT JOIN n{i} y ON y.n = v) GROUP BY n)" for i in range(12))
_sel = "(SELECT trim(substring(text, 101, 60)) FROM documents WHERE doc_id = 3)"


def _windows(src: str, key: str, order: str, most: int) -> str:
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM ({src})), f AS (SELECT {key}, {order}, i, size, size AS used, 1::BIGINT AS w FROM o WHERE i = 1 UNION ALL SELECT o.{key}, o.{order}, o.i, o.size, CASE WHEN used + o.size > {most} THEN o.size ELSE used + o.size END, CASE WHEN used + o.size > {most} THEN w + 1 ELSE w END FROM f JOIN o ON o.{key} = f.{key} AND o.i = f.i + 1)"


ORACLES = {
    "gram_sets": f"SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(b))), lambda i: substring(b, i::BIGINT, 2))))::BIGINT AS n FROM (SELECT doc_id, {_bare('text')} AS b FROM documents) WHERE length(b) > 1",
    "topic_edges": f"WITH {_edges} SELECT a, b, round(dice, 6) AS dice FROM e",
    "topic_clusters": f"WITH RECURSIVE {_cc} SELECT doc_id, cluster FROM c",
    "topic_clusters_low": f"WITH {_edges.replace(str(LEAST), str(cluster.LEAST_DICE))}, l AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), n0 AS (SELECT doc_id AS n, doc_id AS m FROM kl), {_SPREAD} SELECT n AS doc_id, m AS cluster FROM n12",
    "scan_windows": f"WITH RECURSIVE {_cc}, k AS (SELECT cluster, doc_id, length(text) AS size FROM c JOIN documents USING (doc_id) WHERE cluster IN (SELECT cluster FROM c GROUP BY cluster HAVING count(*) >= 2)), {_windows('SELECT * FROM k', 'cluster', 'doc_id', 4000)} SELECT cluster, max(w) AS n_windows, sum(size)::BIGINT AS size FROM f GROUP BY cluster",
    "greedy_windows": f"WITH RECURSIVE p AS ({_p()}), {_windows('SELECT doc_id, paragraph, length(t) AS size FROM p', 'doc_id', 'paragraph', 1500)} SELECT doc_id, paragraph, w AS \"window\" FROM f",
    "locate_apply": "SELECT seq, variant, line FROM (SELECT l_orderkey AS seq, l_linenumber::BIGINT AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS variant FROM lineitem) WHERE variant = 2 AND seq IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)",
    "status_fold": "WITH v AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'adopt' WHEN 'error' THEN 'ignore' ELSE 'revert' END AS a, event_id % 3 AS variant FROM events), l AS (SELECT user_id, arg_max(a, event_id) AS a, arg_max(variant, event_id) AS variant FROM v WHERE a <> 'adopt' OR variant < 2 GROUP BY user_id) SELECT user_id, CASE a WHEN 'adopt' THEN 'adopted' WHEN 'ignore' THEN 'ignored' ELSE 'pending' END AS status, CASE WHEN a = 'adopt' THEN variant END AS variant FROM l",
    "exact_trace": f"SELECT doc_id, '第 ' || (len(regexp_extract_all(left(text, (instr(text, {_sel}) - 1)::BIGINT), '\\n{{2,}}')) + 1) || ' 段' AS position FROM documents WHERE contains(text, {_sel})",
    "overlap_top10": f"WITH s AS (SELECT doc_id, paragraph, {_bare('t')} AS b FROM ({_p()})) SELECT doc_id, paragraph AS position, len(list_filter(list_transform(range(1, greatest(1, length(b))), lambda i: substring(b, i::BIGINT, 2)), lambda g: contains('tionandtheerinth', g)))::BIGINT AS hits FROM s ORDER BY hits DESC, doc_id, paragraph LIMIT 10",
    "trace_fallback5": f"SELECT doc_id, paragraph, piece, score FROM (SELECT doc_id, CAST(regexp_extract(position, '第([0-9]+)段', 1) AS BIGINT) AS paragraph, coalesce(try_cast(regexp_extract(position, '片段([0-9]+)', 1) AS BIGINT), 1) AS piece, score FROM ({LEXICAL})) ORDER BY doc_id, paragraph, piece LIMIT 5",
    "trace_context": f"WITH s AS (SELECT doc_id, paragraph, {_bare('t')} AS b FROM ({_p()})), h AS (SELECT doc_id, paragraph, len(list_filter(list_transform(range(1, greatest(1, length(b))), lambda i: substring(b, i::BIGINT, 2)), lambda g: contains('tionqqxandzthezerinth', g))) AS n FROM s ORDER BY n DESC, doc_id, paragraph LIMIT 10) SELECT DISTINCT doc_id, 'context' AS stage FROM h WHERE n > 0",
    "trace_cascade": f"SELECT doc_id, 'exact' AS stage FROM documents WHERE contains(text, {_sel})",
    "source_ref_list": "SELECT row_number() OVER (ORDER BY min(event_id)) AS index, user_id FROM events GROUP BY user_id",
    "json_lists": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "event_props": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "recent5_eta": "WITH k AS (SELECT event_type, greatest(5, floor(avg(value) + 0.5))::BIGINT AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n <= 5 GROUP BY event_type) SELECT * FROM k UNION ALL SELECT * FROM (VALUES ('error', 30::BIGINT), ('generate', 180), ('click', 60)) f(event_type, seconds) WHERE event_type NOT IN (SELECT event_type FROM k)",
    "chat_last20": f"SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND regexp_replace(text, '{W}+', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
    "ring_buffer": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000",
    "progress_curve": "SELECT conv_id, turn, round(100.0::DOUBLE * count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY conv_id), 6) AS percent FROM conversations",
    "conv_chars": "SELECT conv_id, length(to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR) AS n_chars FROM conversations GROUP BY conv_id",
    "log_report": "WITH l AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || event_type || ' ' || user_id || chr(10) || props AS line FROM events), p AS (SELECT *, (row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) - 1) // 50 + 1 AS page FROM l) SELECT event_type, day, page, count(*) AS n, sha256('# ' || event_type || ' ' || day || ' / ' || page || ': ' || count(*) || chr(10) || string_agg(line, chr(10) ORDER BY event_id)) AS hash FROM p GROUP BY event_type, day, page",
}
