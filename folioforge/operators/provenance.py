"""Where a passage comes from: exact hit, then generation context, then retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions import text as tx
from folioforge.operators import retrieval
from folioforge.plans.lineage import cut_lineage

#: Characters of a selection that count; chunks of the overlap stage, and of the retrieval stage.
SELECTION_CHARS, OVERLAP, FALLBACK = 300, 10, 5


def exact_matches(sources: DataFrame, selection: str, key: str, text: str) -> DataFrame:
    """``(key, position)`` of sources that contain the selection; the paragraph is that of blank-line breaks before the first hit. The
    selection is a constant of the scan."""
    sel = selection.strip()[:SELECTION_CHARS]
    if not sel:
        return sources.select(key, F.lit("").alias("position")).limit(0)
    at = F.call_function("locate", F.lit(sel), F.col(text))
    before = F.substring(F.col(text), F.lit(1), at - 1)
    return sources.where(F.contains(F.col(text), F.lit(sel))).select(key, F.format_string("第 %d 段", F.regexp_count(before, F.lit("\\n{2,}")) + 1).alias("position"))


def ref_tokens(text: Column, valid: Column) -> Column:
    """Numbers of the ``#N`` references in a text that are valid, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit("#([0-9]+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.filter(found, lambda n: F.coalesce(F.array_contains(valid, n), F.lit(False)))


def split_refs(text: Column, valid: Column) -> Column:
    """A text in order as array<struct(ref, text)>: valid ``#N`` references with their number, and what lies between with null."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)#[0-9]+|(?:(?!#[0-9]).)+"), F.lit(0))
    number = lambda x: F.when(x.rlike("^#[0-9]+$"), F.substring(x, 2, 20).try_cast("bigint"))
    marked = F.transform(pieces, lambda x: F.when(F.coalesce(F.array_contains(valid, number(x)), F.lit(False)), F.concat(F.lit("\x01"), x, F.lit("\x01"))).otherwise(x))
    parts = F.filter(F.split(F.array_join(marked, ""), "\x01", -1), lambda x: x != "")
    good = lambda x: F.coalesce(F.array_contains(valid, number(x)), F.lit(False))
    return F.transform(parts, lambda x: F.struct(F.when(good(x), number(x)).alias("ref"), x.alias("text")))


def trace(sources: DataFrame, context: DataFrame, selection: str, key: str, title: str, text: str, client: Callable[[str], list] | None = None) -> DataFrame:
    """``(key, stage)`` of the first stage that finds something: ``exact``, ``context`` (overlap of pairs with the generation's chunks,
    best ten), ``retrieval`` (first five related chunks in reading order), and with a ``client`` that names keys, ``model``. A stage
    runs once, and only if those before it found nothing: the driver sees whether there is a row."""
    kind = sources.schema[key].dataType.simpleString()
    stages = (
        ("exact", lambda: exact_matches(sources, selection, key, text)),
        ("context", lambda: retrieval.overlap_top(context, selection, "chunk", [key, "position"], OVERLAP).where("hits > 0")),
        ("retrieval", lambda: retrieval.lexical(sources, selection[:SELECTION_CHARS], key, title, text).orderBy(key, "paragraph", "piece").limit(FALLBACK)),
        ("model", lambda: sources.sparkSession.createDataFrame([(k,) for k in (client(selection) if client else [])], f"{key} {kind}")),
    )
    for name, stage in stages:
        found = cut_lineage(stage().select(key, F.lit(name).alias("stage")).distinct())
        if not found.isEmpty():
            break
    return found
