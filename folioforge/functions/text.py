"""Text expressions: white space, character pairs, similarity, paragraphs, chunks, topic terms, Markdown.

Everything is a Column built of Spark's own functions, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: White space in the sense of Unicode's separators and the byte order mark; Java's ``\s`` and ``trim`` know ASCII only.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The same characters, for functions that take a list instead of a pattern.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Longest chunk in characters; ends of sentences.
CHUNK_CHARS, ENDS = 500, "。！？；;"

#: More words to look for when a topic term contains the key.
DOMAIN_HINTS = {"教育": ["学前", "幼儿园", "幼儿", "保育", "托育", "入园", "幼教"]}

STRINGS, INTS = "array<string>", "array<int>"


def none(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once a row: a generator's output is never copied into the filters, projections and lambdas above
    it, where an array named in a lambda would be made again for each element."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def strip_ws(c: Column) -> Column:
    """Without any white space."""
    return F.translate(c, WS_CHARS, "")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def without_tags(title: Column) -> Column:
    """A title without the ``[tag:...]`` marks in front of it, and trimmed; one without such a start is left as it is."""
    bare = trim_ws(F.regexp_replace(title, rf"^(?:\[tag:[^\]\r\n]+\]{WS}*)+", ""))
    return F.when(F.lower(F.left(title, F.lit(5))) == "[tag:", bare).otherwise(title)


def pairs(c: Column) -> Column:
    """Neighbouring character pairs, repeats kept, those from even places first; none for fewer than two characters."""
    return F.concat(*[F.regexp_extract_all(F.substring(c, i, 2**31 - 1) if i > 1 else c, F.lit("(?s).."), F.lit(0)) for i in (1, 2)])


def bigrams(c: Column) -> Column:
    return pairs(strip_ws(c))


def dice(a: Column, b: Column) -> Column:
    """2 * (elements of ``a``, repeats counted, that ``b`` has) / (sizes); 0 if one is empty. Not symmetric, may exceed 1."""
    hits = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * hits / (F.size(a) + F.size(b)))


def title_like(line: Column) -> Column:
    """Whether a trimmed line looks like a heading: not empty, no closing mark, no digit, and at most 12 characters, or 20 with a
    space."""
    n = F.length(line)
    short = (n <= 12) | ((n <= 20) & F.contains(line, F.lit(" ")))
    return (n > 0) & ~line.rlike("[。！？；：，,;]$") & ~line.rlike("[0-9０-９]") & short


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, paragraph, text)``: trimmed paragraphs that aren't empty, numbered from 1."""
    parts = F.filter(F.transform(F.split(text, "\r?\n+", -1), trim_ws), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("_i", "text")).select(key, (F.col("_i") + 1).cast("bigint").alias("paragraph"), "text")


def packed(paragraph: Column, most: int = CHUNK_CHARS) -> Column:
    """A paragraph in pieces: whole if short, else sentences put together up to ``most`` characters; a longer sentence stays whole."""
    found = F.regexp_extract_all(paragraph, F.lit(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$"), F.lit(0))
    sentences = F.filter(F.transform(found, trim_ws), lambda s: s != "")
    start = F.struct(F.lit("").alias("open"), none().alias("done"))

    def add(acc, s):
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) > most)
        return F.struct(
            F.when(full, s).otherwise(F.concat(acc["open"], s)).alias("open"),
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    folded = F.aggregate(sentences, start, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.length(paragraph) <= most, F.array(paragraph)).otherwise(folded)


def chunks(docs: DataFrame, key: str, text: str, most: int = CHUNK_CHARS) -> DataFrame:
    """``(key, paragraph, piece, position, text)``: paragraphs that aren't headings, long ones in pieces."""
    p = paragraphs(docs, key, text).where(~title_like(F.col("text")))
    parts = p.withColumn("_long", F.length("text") > most).select(key, "paragraph", "_long", F.posexplode(packed(F.col("text"), most)).alias("_k", "text"))
    piece = F.format_string("第%d段（片段%d）", "paragraph", F.col("_k") + 1)
    return parts.select(
        key, "paragraph", (F.col("_k") + 1).cast("bigint").alias("piece"),
        F.when(F.col("_long"), piece).otherwise(F.format_string("第%d段", "paragraph")).alias("position"), "text",
    )


def query_terms(query: str) -> list[str]:
    """Words of a query, lower-cased, for the lexical score."""
    return [w for w in query.lower().split() if w]


def _pairs_of(text: str) -> list[str]:
    text = "".join(text.split())
    return [text[i : i + 2] for i in range(len(text) - 1)]


def lexical_score(query: str, chunk: Column, title: Column) -> Column:
    """Whole query in the chunk 100 + its length, 20 for each word of over one character, 60 times the pairs' Dice, 20 if the title has
    the query; rounded. A pair of the query is in the chunk's pairs if the chunk without white space contains it, so no array of
    the chunk's pairs is built."""
    q = query.strip().lower()
    if not q:
        return F.lit(0).cast("bigint")
    grams = _pairs_of(q)

    def of(t: Column, bare: Column) -> Column:
        n = F.greatest(F.lit(0), F.length(bare) - 1)
        hits = sum((F.contains(bare, F.lit(g)).cast("int") for g in grams), F.lit(0))
        overlap = F.when((n == 0) | F.lit(not grams), 0.0).otherwise(2.0 * hits / (F.lit(len(grams)) + n))
        score = F.when(F.contains(t, F.lit(q)), 100 + len(q)).otherwise(0)
        for w in query_terms(query):
            if len(w) > 1:
                score = score + F.when(F.contains(t, F.lit(w)), 20).otherwise(0)
        score = score + overlap * 60 + F.when(F.contains(F.lower(title), F.lit(q)), 20).otherwise(0)
        return F.when(t == "", 0).otherwise(F.floor(score + 0.5)).cast("bigint")

    return bound(F.lower(trim_ws(chunk)), lambda t: bound(strip_ws(t), lambda bare: of(t, bare)))


def summary_relevance(query: Column, summary: Column, keywords: Column, entities: Column) -> Column:
    """3 for each keyword that contains the query or is in it, 3 for each entity in the query, 1 for each pair of the query, repeats
    counted, in the summary and keywords. The query counts without white space."""
    q = strip_ws(query)
    text = strip_ws(F.concat_ws(" ", summary, F.array_join(keywords, " ")))
    words = F.size(F.filter(keywords, lambda k: (k != "") & (F.contains(q, k) | F.contains(k, q))))
    names = F.size(F.filter(entities, lambda e: (e != "") & F.contains(q, e)))
    grams = F.size(F.filter(pairs(q), lambda g: F.contains(text, g)))
    return (3 * words + 3 * names + grams).cast("bigint")


def tag_score(name: Column, query: Column) -> Column:
    """Four tiers: equal, the name holds the query, the query holds the name, else Jaccard of pairs times 100 (left repeats counted)."""
    n, q = F.lower(trim_ws(name)), F.lower(trim_ws(query))
    a, b = pairs(n), pairs(q)
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    jaccard = F.coalesce(F.try_divide(shared * 100.0, F.size(a) + F.size(b) - shared), F.lit(0.0))
    return F.when(n == q, 1000.0).when(F.contains(n, q), 500.0 + F.length(n)).when(F.contains(q, n), 300.0 + F.length(n)).otherwise(jaccard)


def topic_terms(query: Column) -> Column:
    """Short quoted strings, then the word after a title mark, each once; else the whole query without white space."""
    quoted = F.regexp_extract_all(query, F.lit("[「『“\"']([^」』”\"']{2,20})[」』”\"']"), F.lit(1))
    titled = F.regexp_extract(query, "(?:标题|题目)[为是]?[\\s]*[:：]?[\\s]*[「『“\"'」』”]?([^\\s，。；、,.「『」』“”\"']+)", 1)
    found = F.filter(F.transform(F.concat(quoted, F.array(titled)), trim_ws), lambda t: F.length(t).between(2, 20))
    whole = F.filter(F.array(strip_ws(query)), lambda t: t != "")
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(whole)


def expand_terms(terms: Column, hints: dict[str, Sequence[str]] | None = None) -> Column:
    """Words that the hints add to terms that contain a key."""
    out = none()
    for key, words in (DOMAIN_HINTS if hints is None else hints).items():
        hit = F.exists(terms, lambda t: F.contains(t, F.lit(key)))
        out = F.array_union(out, F.when(hit, F.array(*map(F.lit, words))).otherwise(none()))
    return out


def matches_exact(text: Column, terms: Column) -> Column:
    """Whether the text without white space contains a whole term."""
    return bound(strip_ws(F.coalesce(text, F.lit(""))), lambda bare: (bare != "") & F.exists(terms, lambda t: (t != "") & F.contains(bare, t)))


def matches_any(text: Column, terms: Column) -> Column:
    """As :func:`matches_exact`, or a pair of a term is enough."""
    parts = F.array_union(F.filter(terms, lambda t: t != ""), F.flatten(F.transform(terms, lambda t: bigrams(t))))
    return bound(strip_ws(F.coalesce(text, F.lit(""))), lambda bare: (bare != "") & F.exists(parts, lambda g: F.contains(bare, g)))


def fuzzy_match(name: Column, needle: str, tags: Column | None = None, content: Column | None = None) -> Column:
    """Whether the name or a tag contains the needle, or has its characters in order, or the content contains it; case aside."""
    low, part = needle.lower(), F.lit(needle.lower())
    in_order = ".*".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in low)
    one = lambda c: F.contains(F.lower(c), part) | F.lower(c).rlike(f"(?s){in_order}")
    found = one(name)
    if tags is not None:
        found = found | F.coalesce(F.exists(tags, one), F.lit(False))
    return found if content is None else found | F.coalesce(F.contains(F.lower(content), part), F.lit(False))


def markdown_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ordering, heading, content)``: a line of one to six ``#`` opens a segment; three or more line feeds become two; what has
    neither heading nor content goes. A text is cut in front of its heading lines, in one pass and without a shuffle."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n(?=#[^\n])", -1)

    def segment(x):
        opens = x.rlike("^#[^\n]")
        first = F.regexp_extract(x, "^[^\n]*", 0)
        rest = F.when(opens, F.substring(x, F.length(first) + 2, F.length(x))).otherwise(x)
        heading = F.nullif(F.when(opens, trim_ws(F.regexp_extract(first, "^(#{1,6})\\s*(.+)", 2))), F.lit(""))
        return F.struct(heading.alias("heading"), trim_ws(F.regexp_replace(rest, "\n{3,}", "\n\n")).alias("content"))

    kept = F.filter(F.transform(parts, segment), lambda s: (s["content"] != "") | s["heading"].isNotNull())
    return docs.select(key, F.posexplode(kept).alias("_i", "s")).select(key, F.col("_i").cast("bigint").alias("ordering"), "s.heading", "s.content")


def render_segment(heading: Column, content: Column) -> Column:
    return F.when(heading.isNull(), content).otherwise(F.concat(F.lit("## "), heading, F.lit("\n\n"), content))


def replace_first(text: Column, anchor: Column, replacement: Column) -> Column:
    """The first occurrence replaced; null if there is none."""
    at = F.call_function("locate", anchor, text)
    return F.when((at > 0) & (anchor != ""), F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(anchor), F.length(text))))


def apply_edits(text: Column, edits: Column) -> Column:
    """An ordered array of struct(anchor, replacement) applied one after another, each to its first occurrence; null if one isn't found."""
    return F.aggregate(edits, text, lambda t, e: replace_first(t, e["anchor"], e["replacement"]))


def tag_list(text: Column) -> Column:
    """Tags as typed: cut at commas of either width, enumeration commas and white space."""
    return F.filter(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), "[,，、 ]+", -1), lambda t: t != "")


def marker(seq: Column) -> Column:
    return F.concat(F.lit("【矛盾#"), seq.cast("string"), F.lit("】"))


def marker_numbers(text: Column) -> Column:
    """Numbers over 0 of the contradiction markers, in order; one too long for 64 bits is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit("【矛盾#([0-9]+)】"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.filter(found, lambda n: n > 0)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


#: Names of keys whose values are hidden, anywhere and in any case; levels that are shown; what stands for hidden and for deeper ones.
SECRET_KEYS, SHOWN_LEVELS, HIDDEN, DEEPER = "(?i)key|secret|token|authorization|password", 3, '"***"', '"[…]"'


def masked(json: Column) -> Column:
    """A JSON text with whatever stands under a secret key, a list or an object too, as ``***``, and what lies deeper than
    ``SHOWN_LEVELS`` as ``[…]``. The order of keys stays, white space between goes, numbers are as the parser writes them. Null for what is no
    JSON or repeats a key, so nothing is shown that wasn't looked through."""
    none = lambda value: F.coalesce(value, F.lit("null"))
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")

    def value(text: Column, kind: Column, level: int) -> Column:
        """``text`` is a value as written, a string without its quotes; ``kind`` what the parser calls its type."""
        if level > SHOWN_LEVELS:
            return F.lit(DEEPER)
        nested = F.when(F.startswith(kind, F.lit("OBJECT")), bound(text, lambda t: whole(t, level))).when(F.startswith(kind, F.lit("ARRAY")), bound(text, lambda t: listed(t, level)))
        return none(F.when(kind == "STRING", quoted(text)).when(kind.rlike("^(OBJECT|ARRAY)"), nested).otherwise(text))

    def rows(text: Column, of: str) -> tuple[Column, Column]:
        """Values as written, and their types, in order."""
        return F.from_json(text, of.format("string")), F.from_json(text, of.format("variant"))

    def whole(text: Column, level: int) -> Column:
        texts, kinds = rows(text, "map<string,{}>")
        pairs_of = F.arrays_zip(F.map_keys(texts).alias("k"), F.map_values(texts).alias("t"), F.map_values(kinds).alias("v"))
        one = lambda p: F.concat(quoted(p["k"]), F.lit(":"), F.when(p["k"].rlike(SECRET_KEYS), HIDDEN).otherwise(value(p["t"], F.schema_of_variant(p["v"]), level + 1)))
        return F.concat(F.lit("{"), F.array_join(F.transform(pairs_of, one), ","), F.lit("}"))

    def listed(text: Column, level: int) -> Column:
        texts, kinds = rows(text, "array<{}>")
        one = lambda p: value(p["t"], F.schema_of_variant(p["v"]), level + 1)
        return F.concat(F.lit("["), F.array_join(F.transform(F.arrays_zip(texts.alias("t"), kinds.alias("v")), one), ","), F.lit("]"))

    root = F.call_function("try_parse_json", json)
    return F.when(root.isNotNull(), value(F.when(F.schema_of_variant(root) == "STRING", F.try_variant_get(root, "$", "string")).otherwise(trim_ws(json)), F.schema_of_variant(root), 0))
