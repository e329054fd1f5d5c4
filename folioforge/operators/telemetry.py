"""Model calls as data: replies, errors, estimates, logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from folioforge.functions.text import bound, trim_ws

#: Waits before the next attempts, in milliseconds.
BACKOFF_MS = (800, 2000, 4000)


def json_candidate(reply: Column) -> Column:
    """The JSON text of a model's reply: in a fence, else from the first brace to the last, else from the first bracket to the last; null
    if none is JSON."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when((c != "") & F.call_function("try_parse_json", c).isNotNull() & c.rlike(r"^\s*[{\[]"), F.regexp_replace(c, r"^\s+|\s+$", ""))
    brackets = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.coalesce(good(fenced), good(reply), good(braces), good(brackets))


def draft_output(reply: Column) -> Column:
    """What a writing model's reply is: ``struct(title, content, error)``, all trimmed. An error counts if it is a string with something in
    it, and leaves the others null; else title and content must both be such strings. Null for any other reply."""
    root = F.call_function("try_parse_json", json_candidate(reply))

    def field(v: Column, name: str) -> Column:
        own = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(own) == "STRING", F.nullif(trim_ws(F.try_variant_get(v, f"$.{name}", "string")), F.lit("")))

    none = F.lit(None).cast("string")
    shown = lambda title, content, error: F.struct(title.alias("title"), content.alias("content"), error.alias("error"))
    of = lambda f: F.when(f["error"].isNotNull(), shown(none, none, f["error"])).when(f["title"].isNotNull() & f["content"].isNotNull(), shown(f["title"], f["content"], none))
    return bound(bound(root, lambda v: shown(*[field(v, n) for n in ("title", "content", "error")])), of)


def reply_text(body: Column) -> Column:
    """What a model says in a whole, not streamed, response."""
    return F.get_json_object(body, "$.choices[0].message.content")


def error_message(body: Column) -> Column:
    """At most 200 characters of the message in an error's body; null if there is none."""
    return F.left(F.get_json_object(body, "$.error.message"), F.lit(200))


def delta_text(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """``(key, content)``: the text of a call's stream of ``data:`` lines, in order."""
    data = F.trim(F.regexp_replace(F.col(line), "^data:", ""))
    rows = lines.where(F.startswith(F.col(line), F.lit("data:"))).select(key, order, F.get_json_object(data, "$.choices[0].delta.content").alias("_d")).where("_d IS NOT NULL")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_d"))), lambda x: x["_d"]), "").alias("content"))


def error_code(status: Column) -> Column:
    return F.when(status.isin(401, 403), "LLM_UNAUTHORIZED").when(status == 429, "LLM_RATE_LIMIT").when(status.isNull(), "LLM_NETWORK").when(status >= 400, "LLM_PROVIDER_ERROR")


def retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(True))


def recent_estimate(calls: DataFrame, kind: str, order: Column, ok: Column, millis: str, fallback: dict[str, int], n: int = 5, least: int = 5) -> DataFrame:
    """``(kind, seconds)``: the mean of each kind's last ``n`` good calls, in seconds, rounded, at least ``least``; kinds of ``fallback``
    without a good call have theirs."""
    last = calls.where(ok).withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order.desc())))
    known = last.where(F.col("_n") <= n).groupBy(kind).agg(F.greatest(F.lit(least), F.floor(F.avg(millis) / 1000 + 0.5)).cast("bigint").alias("seconds"))
    rest = calls.sparkSession.createDataFrame(sorted(fallback.items()), f"{kind} string, seconds bigint")
    return known.unionByName(rest.join(known, kind, "left_anti"))


def first_non_empty(attempts: DataFrame, key: str, attempt: str, result: str) -> DataFrame:
    """The result of each key's first attempt that gave one."""
    return attempts.where(F.col(result) != "").groupBy(key).agg(F.min_by(result, attempt).alias(result))


def call_model(
    prompts: DataFrame, key: str, prompt: str, client: Callable[[str, float], str], temperatures: tuple[float, ...] = (0.0, 0.3, 0.7),
    waits: tuple[int, ...] = BACKOFF_MS, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``(key, reply, attempts, error, input_chars, output_chars, elapsed_ms, status)``: an injected client called for each prompt, again at
    the next temperature while it fails or says nothing, after the next wait where it failed. Time limits are the client's own. Rows
    stay where they are; errors are a column, and the last five are the call's telemetry."""
    schema = f"{key} {prompts.schema[key].dataType.simpleString()}, reply string, attempts int, error string, input_chars bigint, output_chars bigint, elapsed_ms bigint, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, p in zip(rows[key], rows[prompt]):
                reply, error, n, began = None, None, 0, time.monotonic()
                for t in temperatures:
                    if error is not None:
                        sleep(waits[min(n, len(waits)) - 1] / 1000)
                    n += 1
                    try:
                        reply, error = client(p, t), None
                    except Exception as e:  # noqa: BLE001  any client's failure is data here
                        error = str(e)[:200]
                    if reply:
                        break
                out.append((k, reply, n, error, len(p or ""), len(reply or ""), int((time.monotonic() - began) * 1000), "error" if error else "ok"))
            yield pd.DataFrame(out, columns=[key, "reply", "attempts", "error", "input_chars", "output_chars", "elapsed_ms", "status"])

    return prompts.select(key, prompt).mapInPandas(run, schema)


def embed(chunks: DataFrame, text: str, model: Callable[[list[str]], list], fallback: Callable[[list[str]], list] | None = None, batch: int = 5) -> DataFrame:
    """``chunks`` with ``vector array<float>``: an injected model called with ``batch`` texts at a time; a batch that fails goes to the
    fallback, and is null, left to the lexical route, if that fails too."""
    schema = StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, out = rows[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                part, found = texts[i : i + batch], None
                for f in filter(None, (model, fallback)):
                    try:
                        found = [[float(x) for x in v] for v in f(part)]
                        break
                    except Exception:  # noqa: BLE001  the next one is tried
                        found = None
                out += found if found is not None else [None] * len(part)
            yield rows.assign(vector=out)

    return chunks.mapInPandas(run, schema)


def summarise(pending: DataFrame, key: str, text: str, client: Callable[[str, float], str], most: int = 10) -> DataFrame:
    """``(key, summary, keywords, entities)`` of sources that have none yet: the client's reply read as JSON, at most ``most`` words each; a
    reply that isn't JSON leaves no row."""
    j = json_candidate(F.col("reply"))
    words = lambda name: F.slice(F.filter(F.coalesce(F.from_json(F.get_json_object(j, f"$.{name}"), "array<string>"), F.array().cast("array<string>")), lambda x: x != ""), 1, most)
    called = call_model(pending, key, text, client)
    return called.where(F.get_json_object(j, "$.summary").isNotNull()).select(key, F.get_json_object(j, "$.summary").alias("summary"), words("keywords").alias("keywords"), words("entities").alias("entities"))


def json_chars(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``(key, n_chars)``: how long the JSON array of each key's rows is, each an object of ``fields`` (name to column). Lengths add up, so no
    array is put together and a long key is no hot group."""
    one = F.length(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()])))
    return rows.groupBy(key).agg((F.sum(one) + F.count("*") + 1).cast("bigint").alias("n_chars"))  # brackets, and a comma between two


def log_pages(lines: DataFrame, by: list[str], order: str, line: str, rows: int = 1_000) -> DataFrame:
    """``(by, page, n, text)``: a log's lines in order, in pages of at most ``rows`` lines from 1 on, each with a header of its own. Lines are
    numbered as a stream; what is put together is one page."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    paged = lines.select(*by, order, line, (F.floor((nth - 1) / rows) + 1).cast("bigint").alias("page"))
    found = paged.groupBy(*by, "page").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(line).alias("_line")))), lambda x: x["_line"]), "\n").alias("_lines"))
    head = F.concat(F.lit("# "), F.concat_ws(" ", *[F.col(c).cast("string") for c in by]), F.lit(" / "), F.col("page").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit("\n"))
    return found.select(*by, "page", "n", F.concat(head, "_lines").alias("text"))


def render_materials(chunks: DataFrame, key: str, order: list[str], source: str, title: str, position: str, text: str) -> DataFrame:
    """``(key, materials)``: the chunks of each task as numbered blocks with their source, title and place."""
    block = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("]（sourceId: "), F.col(source).cast("string"), F.lit("，标题：《"), F.col(title), F.lit("》，位置："), F.col(position), F.lit("）\n"), F.col(text))
    numbered = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    listed = F.array_sort(F.collect_list(F.struct("_n", block.alias("_b"))))
    return numbered.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["_b"]), "\n\n").alias("materials"))


def render_prompt(instruction: Column, skills: Column, materials: Column) -> Column:
    """The user's part of a writing prompt: what is asked, the rules, the materials. The labels are fixed values."""
    none = F.lit("（未匹配到本小节的部类细则规范）")
    last = F.lit("请严格遵守【写作规范】中的部类细则要求，依据以上材料撰写这一小节的连贯志书正文。")
    return F.concat_ws("\n", F.lit("【用户要求】"), instruction, F.lit(""), F.lit("【写作规范】"), F.coalesce(F.nullif(skills, F.lit("")), none), F.lit(""), F.lit("【参考材料】"), materials, F.lit(""), last)
