"""Queries over a model's reviews; stub clients stand for the model and answer by what they are asked."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioforge.operators import review
from folioforge.queries.tables import table
from folioforge.queries.text import W


def scan_contradictions(spark, d):
    """Documents stand for windows. The stub fails, rambles or finds nothing at low temperatures, by the prompt's length."""

    def client(prompt, t):
        n = len(prompt)
        if t == 0 and n % 4 == 0:
            raise TimeoutError("slow")
        if t == 0 and n % 4 == 1:
            return "no json"
        if t < 0.5 and n % 4 == 2:
            return '{"contradictions": []}'
        if n % 5 == 0:
            return '{"contradictions": [{"topic": " ", "variants": []}]}'
        said = [{"text": "a", "sourceRefs": ["#1"]}, {"text": f"b{t}", "sourceRefs": ["#2"]}]
        found = {"contradictions": [{"topic": f" n{n} ", "kind": "data", "variants": said}, {"topic": "one", "variants": said[:1]}]}
        return f"```json\n{json.dumps(found)}\n```"

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = review.scan_contradictions(docs, "doc_id", "text", client, at_once=8)
    return found.select("doc_id", "nr", "topic", "kind", F.expr("array_join(transform(variants, v -> v.text), '|')").alias("texts"))


def locate_review(spark, d):
    """Places in drafts. The stub forgets replacements, at every temperature for a third of the drafts."""

    def client(prompt, t):
        n = len(prompt)
        if n % 3 == 2:
            return "[]"
        item = {"seq": n, "draftQuote": " q "}
        if n % 3 == 1 and t > 0:
            item |= {"merged": True, "replacements": [{"variantIndex": 0, "text": "y"}, {"variantIndex": 1, "text": f" x{t} "}, {"variantIndex": 2, "text": " "}]}
        return "so: " + json.dumps({"items": [item, {"draftQuote": "no number"}]})

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = review.locate(docs, "doc_id", "text", client, at_once=8)
    return found.select("doc_id", "seq", "quote", "merged", F.expr("array_join(transform(replacements, r -> concat(r.variant, ':', r.text)), '|')").alias("replacements"))


def suggest_skills(spark, d):
    """Rules for a need. The stub answers by the number in the need: prose, an object, a bare list, or a failure."""

    def client(prompt, t):
        n = int(prompt.rsplit("-", 1)[1])
        if n % 4 == 3:
            raise OSError("down")
        if 'id="n3"' not in prompt:
            return '["n0"]'
        return ("no json", '{"skillIds": ["n3", "n99", "n1", "n3"]}', 'here: ["n2"]')[n % 4]

    need = F.when(F.col("doc_id") % 9 == 0, " \u3000 ").otherwise(F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.col("doc_id").cast("string")))
    skills = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.array("n_name").alias("tags"), F.repeat("n_name", F.lit(40)).alias("content"))
    found = review.suggest_skills(table(spark, d, "documents").select("doc_id", need.alias("need")), skills, "doc_id", "need", client, waits=(0,))
    return found.select("doc_id", F.array_join("ids", ",").alias("ids"), "error")


def task_chat(spark, d):
    """The stub says how many turns it was given, and how many characters."""

    def client(prompt, t):
        turns = json.loads(prompt)
        return f" {len(turns)} {sum(len(x['content']) for x in turns)} {turns[-1]['content']}\n"

    c = table(spark, d, "conversations")
    tasks = c.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 6 == 0, " ").otherwise(F.concat(F.lit("m"), F.col("conv_id").cast("string"))).alias("message"))
    drafts = c.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.repeat(F.min_by(F.coalesce("text", F.lit("")), "turn"), F.lit(50)).alias("text"))
    return review.chat(tasks, drafts, c, "conv_id", "message", "turn", client, system="sys").select("conv_id", "reply", "error")


QUERIES = {f.__name__: f for f in (scan_contradictions, locate_review, suggest_skills, task_chat)}

ORACLES = {
    "scan_contradictions": "SELECT doc_id, 1::BIGINT AS nr, 'n' || n AS topic, 'data' AS kind, 'a|b' || CASE n % 4 WHEN 2 THEN '0.7' WHEN 3 THEN '0.0' ELSE '0.3' END AS texts FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) WHERE n % 5 <> 0",
    "locate_review": "SELECT doc_id, n AS seq, 'q' AS quote, n % 3 = 1 AS merged, CASE WHEN n % 3 = 1 THEN '1:x0.3' ELSE '' END AS replacements FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) WHERE n % 3 <> 2",
    "suggest_skills": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'n3,n1' WHEN doc_id % 4 = 2 THEN 'n2' ELSE '' END AS ids, CASE WHEN doc_id % 9 = 0 THEN 'INVALID_PARAM' WHEN doc_id % 4 = 0 THEN 'LLM_FORMAT_INVALID' WHEN doc_id % 4 = 3 THEN 'down' END AS error FROM documents",
    "task_chat": f"""WITH t AS (SELECT conv_id, arg_min(coalesce(text, ''), turn) AS first FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND regexp_replace(text, '{W}+', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 6 <> 0 THEN (2 + coalesce(n, 0)) || ' ' || (3 + length('m' || conv_id) + coalesce(chars, 0) + CASE WHEN conv_id % 2 = 0 THEN 2 + least(12000, 50 * length(first)) ELSE 0 END)::BIGINT || ' m' || conv_id END AS reply,
CASE WHEN conv_id % 6 = 0 THEN 'INVALID_PARAM' END AS error FROM t LEFT JOIN s USING (conv_id)""",
}
