"""What a model is shown of contradictions and materials: lists and blocks, rendered by key. Instructions around them are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.plans.sizes import broadcast_if_short

#: Names of kinds, headings of blocks, the line before the list of contradictions, marks of a source without a number.
KIND_NAMES = {"data": "数据", "time": "时间", "place": "地点", "fact": "事实经过", "other": "其他"}
FILES, MATERIALS, LIST, DRAFT, HINT = "【文件清单】", "【参考材料】", "【矛盾清单】", "【初稿正文】", "【材料矛盾提示】"
HINT_LINE, UNKNOWN = "生成过程中请注意，以下材料之间对同一史实的记述存在矛盾（矛盾编号与正文标注对应）：", "?"


def _kind_name(kind: Column) -> Column:
    pairs = [x for k, v in KIND_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(kind, F.lit("other"))), F.lit(KIND_NAMES["other"]))


def _in_order(order: list[str], text: Column, mark: str) -> Column:
    """The texts of a group in order, put together."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"]), mark)


def _said_by(known: DataFrame, scope: str, places: bool) -> DataFrame:
    """``(scope, lines)`` of variants with their sources' rows, all of a scope in one task."""
    shown = F.coalesce(F.col("index").cast("string"), F.lit(UNKNOWN)) if places else F.concat(F.lit("《"), F.coalesce("title", "source_id"), F.lit("》"))
    variants = known.groupBy(scope, "seq", "topic", "kind", "variant", "text").agg(_in_order(["_at"], shown, "、").alias("_sources"))
    nth = F.row_number().over(Window.partitionBy(scope, "seq").orderBy("variant")).cast("string")
    said = F.concat(F.lit("说法 "), nth, F.lit("："), "text", F.lit("（来源：#"), "_sources", F.lit("）")) if places else F.concat("text", F.lit("（"), "_sources", F.lit("）"))
    lines = variants.withColumn("_said", said).groupBy(scope, "seq", "topic", "kind").agg(_in_order(["variant"], F.col("_said"), "；").alias("_said"))
    line = F.concat(F.lit("- 矛盾 #"), F.col("seq").cast("string"), F.lit("（"), _kind_name(F.col("kind")), F.lit("）："), "topic", F.lit("——"), "_said")
    return lines.groupBy(scope).agg(_in_order(["seq"], line, "\n").alias("lines"))


def contradiction_lines(groups: DataFrame, refs: DataFrame, scope: str, places: bool = False, by: str | None = None) -> DataFrame:
    """``(scope, lines)``: a line for each contradiction of ``groups`` (scope, seq, topic, kind, variant, text, sources), in order. Sources
    are shown by their title in ``refs`` (scope, source_id, index, title), or with ``places`` variants are numbered and sources are shown
    by their number there; one that isn't in ``refs`` by its id, or as ``?``. A scope's lines are a prompt's worth.

    Where many scopes share a list of sources, ``by`` names it in ``groups`` and ``refs`` instead of the scope, so that a list is there
    once and not once for each scope."""
    by = by or scope
    each = groups.select(*dict.fromkeys([scope, by]), "seq", "topic", "kind", "variant", "text", F.posexplode("sources").alias("_at", "source_id"))
    known = each.join(refs.select(by, "source_id", "index", "title"), [by, "source_id"], "left")
    return _said_by(known.repartition(scope), scope, places)  # one shuffle for all steps


def contradiction_block(groups: DataFrame, refs: DataFrame, scope: str, rules: str = "", by: str | None = None) -> DataFrame:
    """``(scope, block)``: what a draft's writer is told of contradictions, with the caller's rules at the end."""
    block = F.concat(F.lit(f"{HINT}\n{HINT_LINE}\n"), "lines", F.lit(f"\n\n{rules}" if rules else ""))
    return contradiction_lines(groups, refs, scope, by=by).select(scope, block.alias("block"))


def numbered_materials(chunks: DataFrame, refs: DataFrame, scope: str, order: list[str], source: str, title: str, position: str, text: str, by: str | None = None) -> DataFrame:
    """``(scope, files, materials)``: the list of a scope's sources, and its chunks as blocks that name their source's number. With ``by``
    (see :func:`contradiction_lines`) scopes are those of ``chunks``, and the list joins the finished materials, so that it isn't shuffled
    once for each scope."""
    files = refs.groupBy(by or scope).agg(_in_order(["index"], F.concat(F.col("index").cast("string"), F.lit(". 《"), "title", F.lit("》")), "\n").alias("files"))
    numbered = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    known = numbered.join(refs.select(by or scope, F.col("source_id").alias(source), F.col("index").alias("_index")), [by or scope, source], "left")
    index = F.coalesce(F.col("_index").cast("string"), F.lit(UNKNOWN))
    block = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("]（来源编号: #"), index, F.lit("，标题：《"), title, F.lit("》，位置："), position, F.lit("）\n"), text)
    materials = _in_order(["_n"], block, "\n\n").alias("materials")
    if by is None:
        return files.join(known.groupBy(scope).agg(materials), scope, "full_outer")
    shown = known.groupBy(scope).agg(materials, F.first(by).alias(by))
    return shown.join(broadcast_if_short(files, "files"), by, "left").select(scope, "files", "materials")


def scan_prompt(files: Column, materials: Column, note: str) -> Column:
    """The user's part of a scan for contradictions."""
    return F.concat_ws("\n", F.lit(FILES), F.coalesce(files, F.lit("")), F.lit(""), F.lit(MATERIALS), F.coalesce(materials, F.lit("")), F.lit(""), F.lit(note))


def locate_prompt(lines: Column, draft: Column, materials: Column, note: str) -> Column:
    """The user's part of a question where contradictions stand in a draft."""
    parts = [x for head, body in ((LIST, lines), (DRAFT, draft), (MATERIALS, materials)) for x in (F.lit(head), F.coalesce(body, F.lit("")), F.lit(""))]
    return F.concat_ws("\n", *parts, F.lit(note))
