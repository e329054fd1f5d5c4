"""Contradictions in drafts: keeping the places that a model found, and adopting a side: its place is replaced, the mark goes, and both
the draft's text and the contradiction's state change together or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions import text as tx
from folioforge.operators.versions import Change, Tables
from folioforge.plans.lineage import cut_lineage


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def place(contradictions: DataFrame, variants: DataFrame, located: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a model said about places in drafts, as changes of the tables that keep contradictions.

    ``contradictions`` are (contradiction_id, draft_id, seq), ``variants`` (contradiction_id, variant_id) in the order of the columns ``order``,
    ``located`` (draft_id, nth, seq, quote, merged, replacements), the items of a reply by ``nth``, as ``review.locate`` reads them.
    Returns ``(contradiction_id, quote, merged, in_draft)`` of those that an item names by draft and seq, and ``(variant_id,
    replacement)`` of variants that an item names by their number from 1 on. The last item, or replacement, of several for one stands;
    numbers that nothing has are left out, as is an item without a seq. Of contradictions with one seq in a draft the last by id counts.
    """
    known = contradictions.groupBy("draft_id", "seq").agg(F.max("contradiction_id").alias("contradiction_id"))
    hits = located.select("draft_id", "nth", "seq", F.nullif("quote", F.lit("")).alias("quote"), F.coalesce("merged", F.lit(False)).alias("merged"), "replacements").join(known, ["draft_id", "seq"])
    last = hits.groupBy("contradiction_id").agg(F.max_by(F.struct("quote", "merged"), "nth").alias("x"))
    said = hits.select("contradiction_id", "nth", F.posexplode("replacements").alias("_at", "r")).select("contradiction_id", F.col("r.variant").cast("bigint").alias("_n"), F.struct("nth", "_at").alias("_when"), F.col("r.text").alias("text"))
    numbered = variants.select("contradiction_id", "variant_id", F.row_number().over(Window.partitionBy("contradiction_id").orderBy(*order, "variant_id")).cast("bigint").alias("_n"))
    replaced = said.join(numbered, ["contradiction_id", "_n"]).groupBy("variant_id").agg(F.max_by("text", "_when").alias("replacement"))
    return last.select("contradiction_id", "x.quote", "x.merged", F.col("x.quote").isNotNull().alias("in_draft")), replaced


def revise(drafts: DataFrame, contradictions: DataFrame, variants: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (nr, draft_id, contradiction_id, variant_id) to adopt a variant, those of a draft in the order of ``nr``.

    ``drafts`` are (draft_id, text), ``contradictions`` (contradiction_id, draft_id, seq, status, quote), ``variants`` (contradiction_id,
    variant_id, replacement). Returns ``(nr, draft_id, contradiction_id, variant_id, code)``, with the code of what is wrong or null, and
    ``(draft_id, text)`` of the drafts that change. A request that fails changes nothing, and the next ones see the draft without it.
    """
    c = contradictions.select("contradiction_id", F.col("draft_id").alias("_of"), "seq", "status", "quote")
    v = variants.select("contradiction_id", "variant_id", "replacement", F.lit(True).alias("_there"))
    d = drafts.select("draft_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = requests.join(c, "contradiction_id", "left").join(v, ["contradiction_id", "variant_id"], "left").join(d.select("draft_id", F.lit(True).alias("_drafted")), "draft_id", "left")
    wrong = (
        F.when(~F.coalesce(F.col("_of") == F.col("draft_id"), F.lit(False)) | ~F.coalesce(F.col("status") == "pending", F.lit(False)) | F.col("_there").isNull(), "INVALID_PARAM")
        .when(_empty(F.col("quote")), "EDIT_NO_QUOTE").when(_empty(F.col("replacement")), "EDIT_NO_REPLACEMENT").when(F.col("_drafted").isNull(), "DRAFT_NOT_FOUND")
    )
    rows = cut_lineage(rows.select(*requests.columns, "seq", "quote", "replacement", wrong.alias("_wrong")))
    asked = rows.where("_wrong IS NULL").groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("nr", "contradiction_id", "seq", "quote", "replacement"))).alias("_asked"))
    kinds = {n: requests.schema[n].dataType.simpleString() for n in ("nr", "contradiction_id")}
    start = F.struct(F.col("_text").alias("text"), F.array().cast(f"array<{kinds['contradiction_id']}>").alias("adopted"), F.array().cast(f"array<struct<nr:{kinds['nr']},code:string>>").alias("done"))

    def step(state: Column, e: Column) -> Column:
        code = F.when(F.array_contains(state["adopted"], e["contradiction_id"]), "INVALID_PARAM").when(~F.contains(state["text"], e["quote"]), "EDIT_ANCHOR_NOT_FOUND")
        edited = F.replace(tx.replace_first(state["text"], e["quote"], e["replacement"]), tx.marker(e["seq"]), F.lit(""))
        return F.struct(
            F.when(code.isNull(), edited).otherwise(state["text"]).alias("text"),
            F.when(code.isNull(), F.array_append(state["adopted"], e["contradiction_id"])).otherwise(state["adopted"]).alias("adopted"),
            F.array_append(state["done"], F.struct(e["nr"].alias("nr"), code.alias("code"))).alias("done"),
        )

    folded = cut_lineage(asked.join(d, "draft_id").select("draft_id", F.aggregate("_asked", start, step).alias("s")))
    tried = folded.select(F.inline("s.done")).select("nr", F.col("code").alias("_code"))
    results = rows.join(tried, "nr", "left").select(*requests.columns, F.coalesce("_wrong", "_code").alias("code"))
    return results, folded.where(F.size("s.adopted") > 0).select("draft_id", "s.text")


def adopt(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests carried out on the tables ``drafts``, ``contradictions`` and ``variants``: texts and states become one version of them, so
    a failure leaves both as they were. Returns the requests with their codes."""
    before = tables.version()
    drafts, contradictions, variants = (tables.read(n, before) for n in ("drafts", "contradictions", "variants"))
    results, texts = revise(drafts, contradictions, variants, requests)
    results = cut_lineage(results)
    good = results.where("code IS NULL").select("contradiction_id", F.col("variant_id").alias("_adopted"))
    states = contradictions.join(good, "contradiction_id").withColumns({"status": F.lit("adopted"), "variant_id": F.col("_adopted")}).select(*contradictions.columns)
    changed = drafts.drop("text").join(texts, "draft_id").select(*drafts.columns)
    parts = {"drafts": (changed, "draft_id"), "contradictions": (states, "contradiction_id")}
    tables.commit({n: Change(df, df.select(key)) for n, (df, key) in parts.items()}, expected=before)
    return results
