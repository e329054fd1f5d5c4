"""Queries over the text expressions, and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import retrieval
from folioforge.queries.tables import table

QUERY = "tion and the"
RELEVANT = "the nation and its 12 rivers"


def title_like_lines(spark, d):
    lines = tx.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count_if(tx.title_like(F.col("text"))).alias("n_titles"), F.count("*").alias("n_lines"))


def chunk_paragraphs(spark, d):
    p = tx.paragraphs(table(spark, d, "documents"), "doc_id", "text").where(~tx.title_like(F.col("text")))
    return p.select("doc_id", "paragraph", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("hash"))


def chunk_pack(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", ".", "。").alias("text"))
    c = tx.chunks(docs, "doc_id", "text")
    return c.select("doc_id", "paragraph", "piece", "position", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("hash"))


def bigram_explode(spark, d):
    docs = table(spark, d, "documents").select(F.explode(tx.bigrams(F.col("text"))).alias("gram"))
    return docs.groupBy("gram").agg(F.count("*").alias("n"))


def dice_score(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"), F.expr("substring(text, 41)").alias("b"))
    return b.select("item_id", F.round(tx.dice(tx.bigrams(F.col("a")), tx.bigrams(F.col("b"))), 6).alias("dice"))


def lexical_retrieve(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return retrieval.lexical(docs, QUERY, "doc_id", "source", "text").select("doc_id", "position", "score")


def summary_relevance(spark, d):
    """Whole texts stand for summaries."""
    words = F.split("text", " ")
    score = tx.summary_relevance(F.lit(RELEVANT), F.col("text"), F.slice(words, 1, 10), F.slice(words, 11, 10))
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


def summary_prefilter(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    summaries = labels.join(docs.select("doc_id", F.col("text").alias("summary"), F.slice(F.split("text", " "), 1, 3).alias("keywords")), "doc_id").select("doc_id", "summary", "keywords", F.array().cast("array<string>").alias("entities"))
    return retrieval.summary_prefilter(docs.select("doc_id"), summaries, "zuenzz qqer xx", "doc_id")





def match_exact(spark, d):
    terms = F.array(F.lit("ofthe"), F.lit("denein"), F.lit(""))
    return table(spark, d, "documents").where(tx.matches_exact(F.left("text", F.lit(12000)), terms)).select("doc_id")



def tag_suggest(spark, d):
    tags = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    return retrieval.suggest_tags(tags, "name", "promo small", 5).select("name", F.round("score", 6).alias("score"))


def fuzzy_subsequence(spark, d):
    return table(spark, d, "part").where(tx.fuzzy_match(F.col("p_name"), "Rdgt", F.array("p_brand", "p_type"), F.concat_ws(" ", "p_type", "p_name"))).select("p_partkey", "p_name")


def truncate_probe(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.truncated(F.col("text"), 300), 256).alias("hash"))



def render_markdown(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", tx.render_segment(F.when(F.col("role") != "system", F.col("role")), F.col("text")).alias("part"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n").alias("md"))
    return whole.select("conv_id", F.sha2("md", 256).alias("hash"))






QUERIES = {f.__name__: f for f in (title_like_lines, chunk_paragraphs, chunk_pack, bigram_explode, dice_score, lexical_retrieve, summary_relevance, summary_prefilter, match_exact, tag_suggest, fuzzy_subsequence, truncate_probe, render_markdown)}

W = tx.WS
PARAGRAPHS = f"""SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph, t FROM (
  SELECT doc_id, source, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^{W}+|{W}+$', '', 'g') AS t FROM (SELECT doc_id, source, regexp_split_to_array(text, '\\r?\\n+') AS l FROM documents_)
) WHERE t <> ''"""
TITLE = "(length(t) > 0 AND NOT regexp_matches(t, '[。！？；：，,;]$') AND NOT regexp_matches(t, '[0-9０-９]') AND (length(t) <= 12 OR (length(t) <= 20 AND contains(t, ' '))))"


def _p(docs: str = "documents") -> str:
    return PARAGRAPHS.replace("documents_", docs)


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '{W}+', '', 'g')"


def _grams(x: str) -> str:
    return f"list_transform(range(1, greatest(1, length({_bare(x)}))), lambda i: substring({_bare(x)}, i::BIGINT, 2))"


_pack = """
WITH RECURSIVE p AS (SELECT * FROM ({p}) WHERE NOT {title}),
s AS (SELECT doc_id, paragraph, list_filter(list_transform(regexp_extract_all(t, '[^。！？；;]*[。！？；;]|[^。！？；;]+$'), lambda x: regexp_replace(x, '^{w}+|{w}+$', '', 'g')), lambda x: x <> '') AS l FROM p WHERE length(t) > 500),
f AS (
  SELECT doc_id, paragraph, l, 1 AS i, l[1] AS open, 1 AS piece, false AS closed, '' AS done FROM s WHERE len(l) > 0
  UNION ALL
  SELECT doc_id, paragraph, l, i + 1, CASE WHEN i = len(l) THEN '' WHEN length(open) + length(l[i + 1]) > 500 THEN l[i + 1] ELSE open || l[i + 1] END,
    piece + (i = len(l) OR length(open) + length(l[i + 1]) > 500)::INT, (i = len(l) OR length(open) + length(l[i + 1]) > 500), open FROM f WHERE i <= len(l)
)
SELECT doc_id, paragraph, 1::BIGINT AS piece, '第' || paragraph || '段' AS position, length(t) AS n, sha256(t) AS hash FROM p WHERE length(t) <= 500
UNION ALL SELECT doc_id, paragraph, (piece - 1)::BIGINT, '第' || paragraph || '段（片段' || (piece - 1) || '）', length(done), sha256(done) FROM f WHERE closed
""".replace("{title}", TITLE).replace("{w}", W)

_q = QUERY
_hits = " + ".join(f"contains(b, '{g}')::INT" for g in tx._pairs_of(_q))
_n = len(tx._pairs_of(_q))
LEXICAL = f"""WITH c AS ({_pack.replace("sha256(t) AS hash", "t AS body").replace("sha256(done)", "done").replace("{p}", _p())}),
x AS (SELECT c.doc_id, position, source, lower(body) AS t, {_bare("lower(body)")} AS b FROM c JOIN documents USING (doc_id))
SELECT doc_id, position, score FROM (SELECT doc_id, position, floor(CASE WHEN contains(t, '{_q}') THEN 100 + {len(_q)} ELSE 0 END
 + {" + ".join(f"CASE WHEN contains(t, '{w}') THEN 20 ELSE 0 END" for w in tx.query_terms(_q) if len(w) > 1)}
 + CASE WHEN length(b) < 2 THEN 0.0 ELSE 60 * (2.0::DOUBLE * ({_hits}) / ({_n} + length(b) - 1)) END + CASE WHEN contains(lower(source), '{_q}') THEN 20 ELSE 0 END + 0.5)::BIGINT AS score FROM x) WHERE score > 0"""

_rel = f"(3 * len(list_filter(keywords, lambda k: k <> '' AND (contains(q, k) OR contains(k, q)))) + 3 * len(list_filter(entities, lambda e: e <> '' AND contains(q, e))) + len(list_filter(list_transform(range(1, greatest(1, length(q))), lambda i: substring(q, i::BIGINT, 2)), lambda g: contains(tt, g))))::BIGINT"

ORACLES = {
    "title_like_lines": f"SELECT doc_id, count_if({TITLE})::BIGINT AS n_titles, count(*) AS n_lines FROM ({_p()}) GROUP BY doc_id",
    "chunk_paragraphs": f"SELECT doc_id, paragraph, length(t) AS n, sha256(t) AS hash FROM ({_p()}) WHERE NOT {TITLE}",
    "chunk_pack": _pack.replace("{p}", _p("(SELECT doc_id, source, replace(text, '.', '。') AS text FROM documents)")),
    "bigram_explode": f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(1, length(b))), lambda i: substring(b, i::BIGINT, 2))) AS gram FROM (SELECT {_bare('text')} AS b FROM documents)) GROUP BY gram",
    "dice_score": f"WITH x AS (SELECT item_id, {_grams('text')} AS a, {_grams('substring(text, 41)')} AS b FROM benchmark) SELECT item_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_filter(a, lambda x: list_contains(b, x))) / (len(a) + len(b)) END, 6) AS dice FROM x",
    "lexical_retrieve": LEXICAL,
    "summary_relevance": f"WITH s AS (SELECT doc_id, {_bare(chr(39) + RELEVANT + chr(39))} AS q, string_split(text, ' ')[1:10] AS keywords, string_split(text, ' ')[11:20] AS entities, {_bare("text || ' ' || array_to_string(string_split(text, ' ')[1:10], ' ')")} AS tt FROM documents) SELECT doc_id, {_rel} AS score FROM s",
    "summary_prefilter": f"WITH s AS (SELECT doc_id, quality, 'zuenzzqqerxx' AS q, string_split(text, ' ')[1:3] AS keywords, []::VARCHAR[] AS entities, {_bare("text || ' ' || array_to_string(string_split(text, ' ')[1:3], ' ')")} AS tt FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id FROM s WHERE quality IS NULL OR {_rel} > 0",
    "match_exact": f"SELECT doc_id FROM documents WHERE contains({_bare('left(text, 12000)')}, 'ofthe') OR contains({_bare('left(text, 12000)')}, 'denein')",
    "tag_suggest": "WITH t AS (SELECT DISTINCT p_type AS name, lower(trim(p_type)) AS n, 'promo small' AS q FROM part), g AS (SELECT *, list_transform(range(1, length(n)), lambda i: substring(n, i::BIGINT, 2)) AS a, list_transform(range(1, length(q)), lambda i: substring(q, i::BIGINT, 2)) AS b FROM t), h AS (SELECT *, len(list_filter(a, lambda x: list_contains(b, x))) AS c FROM g), s AS (SELECT name, CASE WHEN n = q THEN 1000.0::DOUBLE WHEN contains(n, q) THEN 500.0 + length(n) WHEN contains(q, n) THEN 300.0 + length(n) ELSE c * 100.0::DOUBLE / (len(a) + len(b) - c) END AS score FROM h) SELECT name, round(score, 6) AS score FROM s WHERE score >= 40 ORDER BY s.score DESC, name LIMIT 5",
    "fuzzy_subsequence": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*g.*t') OR regexp_matches(lower(p_brand), 'r.*d.*g.*t') OR regexp_matches(lower(p_type), 'r.*d.*g.*t') OR contains(lower(p_type || ' ' || p_name), 'rdgt')",
    "truncate_probe": "SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END) AS hash FROM documents",
    "render_markdown": "SELECT conv_id, sha256(string_agg(CASE WHEN role = 'system' THEN text ELSE '## ' || role || chr(10) || chr(10) || text END, chr(10) || chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id",
}
