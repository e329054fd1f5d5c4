"""Reviews by a model: scans of windows for contradictions, places in a draft, rules for a need, free chat. Clients are injected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions import text as tx
from folioforge.operators import library
from folioforge.operators.telemetry import BACKOFF_MS, call_model, json_candidate
from folioforge.plans.lineage import cut_lineage

Client = Callable[[str, float], str]

#: Temperatures of a review's attempts; calls at once; characters of a draft, and turns, that a chat carries; characters of a rule's sketch.
TEMPERATURES, AT_ONCE, DRAFT_CHARS, TURNS, SKETCH_CHARS = (0.0, 0.3, 0.7), 2, 12_000, 20, 160

GROUPS = "array<struct<topic:string,kind:string,variants:array<struct<text:string,sourceRefs:array<string>>>>>"
PLACES = "array<struct<seq:bigint,draftQuote:string,merged:boolean,replacements:array<struct<variantIndex:int,text:string>>>>"


def _listed(reply: Column, name: str, kind: str, bare: bool = False) -> Column:
    """The array under ``name`` in a reply's JSON, or with ``bare`` the reply itself where it is an array; null if there is none."""
    j = json_candidate(reply)
    own = F.get_json_object(j, f"$.{name}")
    if bare:
        own = F.when(F.startswith(j, F.lit("[")), j).otherwise(own)
    return F.when(F.startswith(own, F.lit("[")), F.from_json(own, kind))


def ladder(prompts: DataFrame, key: str, prompt: str, client: Client, parse: Callable[[Column], Column], settled: Callable[[Column], Column], temperatures: tuple[float, ...] = TEMPERATURES, at_once: int = AT_ONCE) -> DataFrame:
    """``(key, parsed)``: what a model's reply says. What a reply doesn't settle is asked again at the next temperature; at the last one any
    reply that parses counts, and null is left where none does. ``at_once`` bounds the calls that run together
    to what one provider takes; raise it where a cluster may call more. Null and repeated keys are prompts like others. Each attempt's replies are
    kept by a checkpoint, so that a lost executor doesn't ask for all of them again."""
    rows = cut_lineage(prompts.select(key, prompt, F.monotonically_increasing_id().alias("_id")))  # keys may be null or repeat
    left, found = rows, None
    for i, t in enumerate(temperatures):
        called = call_model(left.repartition(at_once), "_id", prompt, client, (t,))
        replies = cut_lineage(called.select("_id", F.when(F.col("error").isNull(), parse(F.col("reply"))).alias("parsed")))
        good = F.lit(True) if i + 1 == len(temperatures) else F.coalesce(settled(F.col("parsed")), F.lit(False))
        found = replies.where(good) if found is None else found.unionByName(replies.where(good))
        left = left.join(replies.where(~good).select("_id"), "_id", "left_semi")
    return rows.join(found, "_id").select(key, "parsed")


def scan_contradictions(windows: DataFrame, key: str, prompt: str, client: Client, at_once: int = AT_ONCE) -> DataFrame:
    """``(key, nr, topic, kind, variants)``: groups that a model finds in each window, numbered from 1, as ``cluster.valid_groups`` takes
    them. A window without a find is asked again at every temperature."""
    parse = lambda reply: _listed(reply, "contradictions", GROUPS)
    valid = lambda g: (tx.trim_ws(F.coalesce(g["topic"], F.lit(""))) != "") & (F.size(F.filter(F.coalesce(g["variants"], F.array().cast("array<struct<text:string,sourceRefs:array<string>>>")), lambda v: tx.trim_ws(F.coalesce(v["text"], F.lit(""))) != "")) >= 2)
    found = ladder(windows, key, prompt, client, lambda reply: F.filter(parse(reply), valid), lambda groups: F.size(groups) > 0, at_once=at_once)
    each = found.select(key, F.posexplode("parsed").alias("nr", "g"))
    kind = tx.trim_ws(F.coalesce(F.col("g.kind"), F.lit("")))
    return each.select(key, (F.col("nr") + 1).cast("bigint").alias("nr"), tx.trim_ws(F.col("g.topic")).alias("topic"), kind.alias("kind"), F.col("g.variants").alias("variants"))


def locate(drafts: DataFrame, key: str, prompt: str, client: Client, at_once: int = AT_ONCE) -> DataFrame:
    """``(key, seq, quote, merged, replacements)``: where each contradiction stands in a draft. A reply that quotes a place without a
    replacement is asked again; replacements count with a number from 1 and a text."""
    parse = lambda reply: F.filter(_listed(reply, "items", PLACES), lambda x: x["seq"].isNotNull())
    text = lambda r: tx.trim_ws(F.coalesce(r["text"], F.lit("")))
    good = lambda x: F.filter(F.coalesce(x["replacements"], F.array().cast("array<struct<variantIndex:int,text:string>>")), lambda r: (r["variantIndex"] >= 1) & (text(r) != ""))
    quote = lambda x: F.nullif(tx.trim_ws(F.coalesce(x["draftQuote"], F.lit(""))), F.lit(""))
    clean = lambda reply: F.transform(parse(reply), lambda x: F.struct(x["seq"].alias("seq"), quote(x).alias("quote"), F.coalesce(x["merged"], F.lit(False)).alias("merged"), F.transform(good(x), lambda r: F.struct(r["variantIndex"].alias("variant"), text(r).alias("text"))).alias("replacements")))
    whole = lambda items: ~F.exists(items, lambda x: x["quote"].isNotNull() & (F.size(x["replacements"]) == 0))
    found = ladder(drafts, key, prompt, client, clean, whole, at_once=at_once)
    return found.select(key, F.inline("parsed"))


def skill_catalog(skills: DataFrame, order: str) -> DataFrame:
    """``(catalog)``: one row, the list of rules (id, name, tags, content) that a prompt shows. It is as long as a prompt may be."""
    nth = F.row_number().over(Window.orderBy(order))  # a user's own rules, a prompt's worth
    line = F.concat(nth.cast("string"), F.lit('. id="'), "id", F.lit('" 名称="'), "name", F.lit('" 关键词="'), F.array_join("tags", "、"), F.lit('"\n内容摘要：'), F.left("content", F.lit(SKETCH_CHARS)))
    listed = skills.select(F.struct(nth.alias("n"), line.alias("line")).alias("x"))
    return listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("catalog"))


def suggest_skills(tasks: DataFrame, skills: DataFrame, key: str, need: str, client: Client, order: str = "id", waits: tuple[int, ...] = BACKOFF_MS) -> DataFrame:
    """``(key, ids, error)``: of each task's need the rules that a model picks, those that exist, each once in the model's order; none and
    ``INVALID_PARAM`` for an empty need, ``LLM_FORMAT_INVALID`` for a reply that isn't a list, else the client's error."""
    asked = tasks.select(key, tx.trim_ws(F.coalesce(F.col(need), F.lit(""))).alias("_need"))
    prompts = asked.where("_need <> ''").crossJoin(F.broadcast(skill_catalog(skills, order)))  # one row
    prompt = F.concat(F.lit("【规范目录】\n"), "catalog", F.lit("\n\n【撰写需求】\n"), "_need")
    called = cut_lineage(call_model(prompts.select(key, prompt.alias("_prompt")), key, "_prompt", client, (0.0, 0.0), waits))
    picked = called.select(key, "error", _listed(F.col("reply"), "skillIds", "array<string>", bare=True).alias("_ids"))
    valid = library.valid_ids(picked.where("_ids IS NOT NULL").select(key, F.col("_ids").alias("ids")), skills.select("id"), key, "ids", "id")
    error = F.when(F.col("_need") == "", "INVALID_PARAM").when(F.col("error").isNotNull(), F.col("error")).when(F.col("_ids").isNull(), "LLM_FORMAT_INVALID")
    return asked.join(picked, key, "left").join(valid, key, "left").select(key, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), error.alias("error"))


def chat(tasks: DataFrame, drafts: DataFrame, history: DataFrame, key: str, message: str, order: str, client: Client, system: str = "") -> DataFrame:
    """``(key, messages, reply, error)``: a client's answer to each task's message. ``messages`` is the JSON list it is given: a system turn
    with the draft's (key, text) beginning, the last turns of ``history`` (key, order, role, text) that a user or an assistant said, and
    the message. An empty message isn't sent and is ``INVALID_PARAM``."""
    said = history.where(F.col("role").isin("user", "assistant") & (tx.trim_ws(F.col("text")) != ""))
    last = library.latest_per_key(said, key, F.desc(order), n=TURNS)
    turn = F.struct(F.col(order).alias("_at"), F.struct("role", F.col("text").alias("content")).alias("turn"))
    turns = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["turn"]).alias("_turns"))
    known = F.concat(F.lit("\n\n"), F.left("_draft", F.lit(DRAFT_CHARS)))
    first = F.struct(F.lit("system").alias("role"), F.concat(F.lit(system), F.coalesce(known, F.lit(""))).alias("content"))
    own = F.struct(F.lit("user").alias("role"), F.col(message).alias("content"))
    rows = tasks.select(key, message).join(drafts.select(key, F.col("text").alias("_draft")), key, "left").join(turns, key, "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    asked = rows.select(key, F.when(tx.trim_ws(F.coalesce(F.col(message), F.lit(""))) != "", F.to_json(F.concat(F.array(first), F.coalesce("_turns", none), F.array(own)))).alias("messages"))
    called = call_model(asked.where("messages IS NOT NULL"), key, "messages", client, (0.7, 0.7, 0.7)).select(key, tx.trim_ws(F.col("reply")).alias("reply"), "error")
    return asked.join(cut_lineage(called), key, "left").select(key, "messages", "reply", F.when(F.col("messages").isNull(), "INVALID_PARAM").otherwise(F.col("error")).alias("error"))
