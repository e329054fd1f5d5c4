"""Filter-style retrieval: lexical score, cosine, their keyed union, summary prefilter, tag suggestions, full text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions import text as tx

#: Cosine from which a chunk counts as related; tag score from which a tag is suggested.
LEAST_COSINE, LEAST_TAG = 0.3, 40

#: BM25 constants of the public SQLite FTS5 documentation.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def lexical(docs: DataFrame, query: str, key: str, title: str, text: str) -> DataFrame:
    """Chunks of ``docs`` with a rounded lexical score over 0. No top-n and no quota: every related chunk stays. One scan, no shuffle."""
    titled = docs.select(F.struct(key, F.col(title).alias("_title")).alias("_row"), text)
    scored = tx.pinned(tx.chunks(titled, "_row", text), score=tx.lexical_score(query, F.col("text"), F.col("_row._title")))
    return scored.where("score > 0").select(F.col(f"_row.{key}").alias(key), F.col("_row._title").alias(title), "paragraph", "piece", "position", "text", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, in double; 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    double = lambda x: F.slice(x, F.lit(1), n).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    square = lambda x: total(F.transform(double(x), lambda y: y * y))
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    return F.when((square(a) == 0) | (square(b) == 0), 0.0).otherwise(dot / (F.sqrt(square(a)) * F.sqrt(square(b))))


def l2_normalised(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, y: s + y * y))
    return F.when(norm == 0, d).otherwise(F.transform(d, lambda x: x / norm))


def mean_pooled(tokens: Column, mask: Column | None = None) -> Column:
    """The mean of token vectors of one length, those that ``mask`` (one number a token) counts, scaled to length 1; null for none."""
    pairs = F.arrays_zip(tokens.cast("array<array<double>>").alias("v"), (mask if mask is not None else F.transform(tokens, lambda _: F.lit(1))).cast("array<double>").alias("m"))
    kept = F.filter(pairs, lambda x: x["m"] > 0)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.transform(F.get(kept, F.lit(0))["v"], lambda x: x * F.get(kept, F.lit(0))["m"]), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b * x["m"]))
    weight = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["m"])
    return F.when(F.size(kept) > 0, tx.bound(F.transform(total, lambda x: x / weight), l2_normalised))


def float_bytes(v: Column) -> Column:
    """A binary of little-endian 32-bit floats from a vector without nulls. Zero, infinities and values below the normal range included."""

    def one(x):
        size = F.abs(x.cast("double"))
        power = F.greatest(F.lit(-126.0), F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))))
        power = F.when(size >= F.pow(F.lit(2.0), power + 1), power + 1).when((size < F.pow(F.lit(2.0), power)) & (power > -126), power - 1).otherwise(power)
        fraction = F.round(size * F.pow(F.lit(2.0), 23.0 - power)).cast("bigint")
        word = F.when(size == 0, 0).when(F.isnan(x), 2143289344).when(size == float("inf"), 2139095040).otherwise(F.when(fraction < 8388608, fraction).otherwise(fraction + (power.cast("bigint") + 126) * 8388608))
        word = word + F.when(x < 0, 2147483648).otherwise(0)
        hexed = F.lpad(F.hex(word.cast("bigint")), 8, "0")
        return F.concat(*[F.substring(hexed, k, 2) for k in (7, 5, 3, 1)])

    return F.unhex(F.array_join(F.transform(v, one), ""))


def float_vector(data: Column) -> Column:
    """``array<float>`` of a binary of little-endian 32-bit floats, put together from sign, exponent and fraction; null unless the length
    is a multiple of four. Infinities and NaN come as such."""
    hexed = F.hex(data)

    def one(i):
        b = lambda k: F.conv(F.substring(hexed, i * 8 + 2 * k + 1, F.lit(2)), 16, 10).cast("bigint")
        word = b(0) + b(1) * 256 + b(2) * 65536 + b(3) * 16777216
        return tx.bound(word, lambda w: _float_of(w))

    return F.when(F.octet_length(data) % 4 == 0, F.when(F.octet_length(data) == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.octet_length(data) / 4) - 1).cast("int")), one)))


def _float_of(w: Column) -> Column:
    sign = F.when(F.shiftright(w, 31) > 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(w, 23).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit(8388607))
    small = fraction * F.pow(F.lit(2.0), F.lit(-149.0))
    normal = (fraction + 8388608) * F.pow(F.lit(2.0), exponent - 150.0)
    special = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
    return (sign * F.when(exponent == 0, small).when(exponent == 255, special).otherwise(normal)).cast("float")


def vector_search(chunks: DataFrame, query: Sequence[float], vector: str, least: float | None = None, limit: int | None = None, tie: str | None = None, model: tuple[str, str] | None = None) -> DataFrame:
    """``chunks`` with ``cosine`` to the query vector, over ``least`` if given, the best ``limit`` if given. With ``model``, a column and the
    name of the model that made the query's vector, only that model's vectors count: those of two models have no angle. The vector is a
    constant of the scan, so there is no join."""
    chunks = chunks.where(F.col(model[0]) == model[1]) if model else chunks
    q = F.array(*[F.lit(float(x)) for x in query])
    found = chunks.withColumn("cosine", cosine(F.col(vector), q))
    if least is not None:
        found = found.where(F.col("cosine") >= least)
    return found.orderBy(F.desc("cosine"), *([tie] if tie else [])).limit(limit) if limit else found


def hybrid(lexical_hits: DataFrame, vector_hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed union: lexical hits, and of the vector hits those that aren't among them, scored by 100 * cosine rounded. Both routes are
    read once and meet by key; null keys are equal."""
    by_word = lexical_hits.select(*keys, "score", F.lit("lexical").alias("route"))
    by_vector = vector_hits.select(*keys, F.floor(F.col("cosine") * 100 + 0.5).cast("bigint").alias("score"), F.lit("vector").alias("route"))
    known = F.max(F.col("route") == "lexical").over(Window.partitionBy(*keys))
    both = by_word.unionByName(by_vector).withColumn("_known", known)
    return both.where((F.col("route") == "lexical") | ~F.col("_known")).drop("_known")


def summary_prefilter(scope: DataFrame, summaries: DataFrame, query: str, key: str) -> DataFrame:
    """Sources of the scope without a summary, or with one that has to do with the query."""
    rel = tx.summary_relevance(F.lit(query), F.col("summary"), F.col("keywords"), F.col("entities"))
    scored = summaries.select(key, rel.alias("_score"))
    return scope.join(scored, key, "left").where(F.col("_score").isNull() | (F.col("_score") > 0)).select(*scope.columns)


def suggest_tags(tags: DataFrame, name: str, query: str, limit: int = 5, least: float = LEAST_TAG) -> DataFrame:
    """Best tags by score, ties by name in binary order."""
    scored = tags.withColumn("score", tx.tag_score(F.col(name), F.lit(query)))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), name).limit(limit)


def _occurrences(terms: str, word: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == word)).cast("double")


def full_text(docs: DataFrame, query: str, key: str, text: str, limit: int = 50) -> DataFrame:
    """Documents with every bare word of the query, best BM25 first, ties by key; none for a query without a word. For a search of texts
    without an index (``fulltext.Index`` is one). A text is cut into words once; lengths and counts are of all documents, in two numbers and one number a word."""
    words = list(dict.fromkeys(w for w in query.lower().split() if w))
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    terms = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    cut = tx.pinned(docs.select(key, text), _terms=terms)
    counted = {f"_tf{i}": _occurrences("_terms", w) for i, w in enumerate(words)}
    rows = tx.pinned(cut, n_terms=F.size("_terms").cast("double"), **counted).drop(text, "_terms")
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_terms").alias("avg_terms"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    found = rows.where(" AND ".join(f"_tf{i} > 0" for i in range(len(words)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / F.col("avg_terms")))
    return found.withColumn("score", score).orderBy(F.desc("score"), key).limit(limit).select(key, "score")


def overlap_top(chunks: DataFrame, selection: str, text: str, order: Sequence[str], limit: int = 10) -> DataFrame:
    """Chunks by how many of their pairs, repeats counted, the selection has; ties in the given order."""
    grams = sorted(set(tx._pairs_of(selection)))
    known = F.array(*map(F.lit, grams)) if grams else tx.none()
    hits = F.size(F.filter(tx.bigrams(F.col(text)), lambda g: F.array_contains(known, g))).cast("bigint")
    return chunks.withColumn("hits", hits).orderBy(F.desc("hits"), *order).limit(limit)
