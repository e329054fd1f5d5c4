"""Operator 9: quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

N-grams are words and pairs of neighbouring words, hashed into a fixed number of bins. Two multinomials over the bins, of
trusted target documents and of the raw corpus, give each bin a log ratio; a document's score is the mean over its n-grams,
and a fixed threshold decides on every document.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import pinned

#: Bins of words, and of pairs of words; what is added to each bin's count.
BINS, SMOOTHING = (1 << 14, 1 << 16), 1.0

#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.13

SYMBOLS = r"[#*$%&|<>]"
BLANK_RUN, WORD_CHAR = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than x20 and x09-x0D; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN, -1), "")


def _up_to(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of every row.

    A null text counts as empty. Repeated words are those in three-word windows that the text holds twice or more: windows are
    sorted by hash and place, and the places of those with an equal neighbour are covered once each.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = pinned(rows, words=words_of(F.col("text")), _lines=F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CHAR)))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.select(
        "key", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(_up_to(F.size("words") - 2), window).alias("_windows"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = pinned(rows, _placed=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).otherwise(none))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_placed", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_placed", i + 1)["h"], F.lit(False))
    rows = pinned(rows, _places=F.sort_array(F.transform(F.filter("_placed", same), lambda x: x["i"])))
    gain = F.transform("_places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - x, F.lit(3))))
    covered = F.aggregate(gain, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return pinned(rows, n_repeat_words=covered).drop("_windows", "_placed", "_places")


def bins_of(words: str, bins: tuple[int, int] = BINS) -> Column:
    """The bins of all n-grams of the column ``words``: its words, then its pairs, of which a lone word has none."""
    word = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(bins[0])).cast("int"))
    pair = lambda i: (F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(bins[1])) + bins[0]).cast("int")
    return F.concat(word, F.transform(_up_to(F.size(words) - 1), pair))


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", bins: tuple[int, int] = BINS) -> list[float]:
    """Each bin's log ratio between the target and the raw multinomial, words and pairs each by themselves.

    ``trusted`` has the keys of target documents, all of which count; the raw counts are of all n-grams of all rows. Rows without
    a key are never trusted and are dealt out by their text. All ratios are 0 if no trusted document has an n-gram. One row for
    each bin reaches the driver.
    """
    keys = trusted.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().withColumns({"_of": F.lit(0).cast("bigint"), "_target": F.lit(1)})
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("_part", F.when(F.col("key").isNull(), F.xxhash64("text")).otherwise(0))
    # by a shuffle at every size: the trusted keys grow with the corpus, so no broadcast holds them
    rows = rows.join(keys.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    marked = pinned(rows.select("_target", "text"), words=words_of(F.col("text"))).select("_target", bins_of("words", bins).alias("_bins"))
    # outer: an inferred filter on the arrays' sizes would evaluate them once more
    grams = marked.select(F.explode_outer("_bins").alias("bin"), F.coalesce("_target", F.lit(0)).alias("target"))
    raw, target = [0] * sum(bins), [0] * sum(bins)
    for r in grams.groupBy("bin").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect():
        if r.bin is not None:
            raw[r.bin], target[r.bin] = r.raw, r.target
    out: list[float] = []
    for part in (slice(0, bins[0]), slice(bins[0], None)):
        p, q = target[part], raw[part]
        if not sum(p):
            out += [0.0] * len(p)
            continue
        base = log(sum(q) + SMOOTHING * len(q)) - log(sum(p) + SMOOTHING * len(p))
        out += [round(log(a + SMOOTHING) - log(b + SMOOTHING) + base, 6) for a, b in zip(p, q)]
    return out


def ratio_score(bins: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams; 0 if there are none."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded into one constant
    total = F.try_divide(F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.get(table, b)), F.size(bins))
    return F.coalesce(total, F.lit(0.0))


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` of every row.

    A document fails the base rules if it has under 50 words or if over half of them are repeated; it is kept if it doesn't
    fail and its score is at least ``threshold``. Null texts count as empty and fail. Repeated rows stay and count each; extra
    columns are left out; an empty table gives an empty result.
    """
    ratios = log_ratios(docs, trusted, key, text)
    rows = pinned(base_counts(docs, key, text), _bins=bins_of("words")).drop("words")  # named twice by the score, made once
    rows = rows.withColumn("score", ratio_score(F.col("_bins"), ratios))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over the whole ``documents`` table; documents labelled as good are the trusted target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
