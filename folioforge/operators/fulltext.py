"""A positional full-text index: postings by term as tables, searched by words, prefixes, phrases and their combinations.

A posting is one term of one document with its positions. Postings lie in buckets by the beginning of the term, sorted, so a
search scans its terms' buckets and row groups only, and reads positions only if it has a phrase. Documents are put in, changed
and taken out by small parts with the keys that go (``versions.Tables``); counts of documents and tokens follow from the changes.

Words are what the public documentation of SQLite's FTS5 calls the tokenizer unicode61: runs of letters, digits and private
characters, in lower case, without diacritics. Ranks are its BM25. Queries are built from expressions, not parsed from a text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions import text as tx
from folioforge.operators.versions import Change, Tables
from folioforge.plans.lineage import cut_lineage

#: BM25 constants and the least IDF, of the public SQLite FTS5 documentation.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

#: Buckets of terms; characters of a term that choose its bucket; positions between two columns of a document.
BUCKETS, BUCKET_CHARS, COLUMN_GAP = 64, 2, 1 << 32

#: What is no part of a word.
BREAKS = r"[^\p{L}\p{N}\p{Co}]+"


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and what is left of them without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, without marks over or under letters."""
    return F.translate(F.regexp_replace(F.lower(text), "[̀-ͯ]+", ""), *_plain_letters())


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(folded(text), BREAKS), lambda t: t != "")


def words_in(text: str) -> list[str]:
    """The same of a query's text, here and now."""
    text = "".join(c for c in unicodedata.normalize("NFC", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    text = text.translate(str.maketrans(*_plain_letters()))
    kept = lambda c: unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"
    return "".join(c if kept(c) else " " for c in text).split()


class Query:
    """What documents are asked for. ``&`` and ``|`` combine two queries, ``-`` takes the second's documents from the first's."""

    def __and__(self, other: Query) -> Query:
        return Both("and", self, other)

    def __or__(self, other: Query) -> Query:
        return Both("or", self, other)

    def __sub__(self, other: Query) -> Query:
        return Both("not", self, other)


@dataclass(frozen=True)
class Phrase(Query):
    """Words that follow each other in one column; the last one may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both(Query):
    kind: str
    left: Query
    right: Query


def phrase(text: str, prefix: bool = False) -> Phrase:
    """The words of ``text`` in a row, the last one as a prefix if asked. A text without words is an error: nothing could be meant."""
    found = tuple(words_in(text))
    if not found:
        raise ValueError(f"no word in {text!r}")
    return Phrase(found, prefix)


def prefix(text: str) -> Phrase:
    """Words that begin so."""
    return phrase(text, True)


def bare(text: str) -> Query:
    """What a user typed: every part between white space must occur, a part of several words as a phrase."""
    parts = [phrase(t) for t in text.split() if words_in(t)]
    if not parts:
        raise ValueError(f"no word in {text!r}")
    return reduce(lambda a, b: a & b, dict.fromkeys(parts))


def _phrases(query: Query) -> list[Phrase]:
    return [query] if isinstance(query, Phrase) else list(dict.fromkeys(_phrases(query.left) + _phrases(query.right)))


def _holds(query: Query, leaves: list[Phrase]) -> Column:
    if isinstance(query, Phrase):
        return F.col(f"_tf{leaves.index(query)}") > 0
    a, b = _holds(query.left, leaves), _holds(query.right, leaves)
    return a & b if query.kind == "and" else a | b if query.kind == "or" else a & ~b


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.left(term, F.lit(BUCKET_CHARS)).cast("binary")), F.lit(BUCKETS)).cast("int")


def _bucket_of(text: str) -> int:
    return zlib.crc32(text[:BUCKET_CHARS].encode()) % BUCKETS


class Index:
    """The index of a table of documents below a folder: postings ``(term, key, n_terms, tf, positions, bucket)`` and document lengths
    ``(key, n_terms)``. Keys are unique; null is one."""

    def __init__(self, spark, folder: str, key: str = "doc_id"):
        self.key = key
        self.tables = Tables(spark, folder, {"postings": key, "docs": key}, {"postings": ["bucket"]})

    def _parts(self, docs: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of documents: words are cut once, and a document's equal words meet in one shuffle by term and key."""
        n = sum(F.size(f"_w{i}") for i in range(len(columns)))
        cut = tx.pinned(docs.select(self.key, *columns), **{f"_w{i}": F.coalesce(words_of(F.col(c)), tx.none()) for i, c in enumerate(columns)})
        cut = cut.select(self.key, n.cast("int").alias("n_terms"), *[f"_w{i}" for i in range(len(columns))])
        placed = lambda i: F.transform(f"_w{i}", lambda t, at: F.struct(t.alias("term"), (at.cast("bigint") + i * COLUMN_GAP).alias("at")))
        each = cut.select(self.key, "n_terms", F.inline(F.concat(*[placed(i) for i in range(len(columns))])))
        postings = each.groupBy("term", self.key, "n_terms").agg(F.sort_array(F.collect_list("at")).alias("positions"))
        postings = postings.select("term", self.key, "n_terms", F.size("positions").alias("tf"), "positions", bucket(F.col("term")).alias("bucket"))
        return postings.repartitionByRange("bucket", "term", self.key).sortWithinPartitions("bucket", "term", self.key), cut.select(self.key, "n_terms")

    def put(self, docs: DataFrame, *columns: str, gone: DataFrame | None = None) -> None:
        """Documents come, or replace those of their keys; the keys of ``gone`` go. All of it is one change. What is written follows the
        change; of the index it reads the lengths of the documents that go, no postings."""
        docs = docs.select(self.key, *columns)
        keys = docs.select(self.key) if gone is None else docs.select(self.key).union(gone.select(self.key))
        keys = cut_lineage(keys.distinct())
        before = self.tables.version()
        note, old = self.tables.entry(before)["note"], self.tables.read("docs", before)
        lost = (0, 0)
        if old is not None:
            low, high = keys.agg(F.min(self.key), F.max(self.key)).first()
            near = old.where(F.col(self.key).isNull() | F.col(self.key).between(F.lit(low), F.lit(high))) if low is not None else old
            same = F.col(f"o.{self.key}").eqNullSafe(F.col(f"k.{self.key}"))
            lost = near.alias("o").join(keys.alias("k"), same, "left_semi").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        postings, lengths = self._parts(docs, columns)
        lengths = cut_lineage(lengths)
        came = lengths.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        new = {"n": note.get("n", 0) - lost[0] + came[0], "terms": note.get("terms", 0) - lost[1] + came[1]}
        self.tables.commit({"postings": Change(postings, keys), "docs": Change(lengths, keys)}, expected=before, note=new)

    def remove(self, gone: DataFrame) -> None:
        """The documents of these keys go."""
        none = gone.select(self.key, F.lit("").alias("_text")).limit(0)
        self.put(none, "_text", gone=gone)

    def merge(self) -> None:
        """The parts of the index as one each."""
        before = self.tables.version()
        postings, docs = self.tables.read("postings", before), self.tables.read("docs", before)
        changes = {"postings": Change(postings.repartitionByRange("bucket", "term", self.key).sortWithinPartitions("bucket", "term", self.key), anew=True), "docs": Change(docs, anew=True)}
        self.tables.commit(changes, expected=before)

    def postings_of(self, leaves: list[Phrase]) -> DataFrame | None:
        """``(key, n_terms, tf[, positions], term)`` of the terms that phrases name: what is scanned are their buckets and row groups. A
        prefix shorter than what chooses a bucket scans all buckets, for that prefix."""
        whole = {w for p in leaves for w in (p.words[:-1] if p.prefix else p.words)}
        begins = {p.words[-1] for p in leaves if p.prefix}
        tests = [F.col("term").isin(*sorted(whole))] if whole else []
        tests += [F.startswith("term", F.lit(b)) for b in sorted(begins)]
        named = {_bucket_of(w) for w in whole | {b for b in begins if len(b) >= BUCKET_CHARS}}
        narrow = [F.col("bucket").isin(*sorted(named))] if all(len(b) >= BUCKET_CHARS for b in begins) else []
        columns = [self.key, "n_terms", "tf", "term", *(["positions"] if any(len(p.words) > 1 for p in leaves) else [])]
        return self.tables.read("postings", where=lambda df: df.where(reduce(lambda a, b: a & b, narrow + [reduce(lambda a, b: a | b, tests)])).select(*columns))

    def matches(self, query: Query) -> DataFrame | None:
        """``(key, n_terms, _tf0, _tf1, ...)`` of documents with any of the query's phrases: how often each occurs. One shuffle by key."""
        leaves = _phrases(query)
        found = self.postings_of(leaves)
        if found is None:
            return None
        slots = [(i, k, w, p.prefix and k + 1 == len(p.words)) for i, p in enumerate(leaves) for k, w in enumerate(p.words)]
        test = lambda w, begins: F.startswith("term", F.lit(w)) if begins else F.col("term") == w
        aggregates, single = [], {}
        for i, k, w, begins in slots:
            if len(leaves[i].words) == 1:
                single[i] = F.sum(F.when(test(w, begins), F.col("tf")).otherwise(0))
            else:
                shifted = F.when(test(w, begins), F.transform("positions", lambda at: at - k))
                aggregates.append(F.flatten(F.collect_list(shifted)).alias(f"_at{i}_{k}"))
        rows = found.groupBy(self.key, "n_terms").agg(*[c.alias(f"_tf{i}") for i, c in single.items()], *aggregates)
        for i, p in enumerate(leaves):
            if len(p.words) > 1:
                places = reduce(F.array_intersect, [F.col(f"_at{i}_{k}") for k in range(len(p.words))])
                rows = rows.withColumn(f"_tf{i}", F.size(places).cast("bigint"))
        counts = [f"_tf{i}" for i in range(len(leaves))]
        return rows.select(self.key, "n_terms", *counts).where(" OR ".join(f"{c} > 0" for c in counts))

    def search(self, query: Query, limit: int | None = 50) -> DataFrame:
        """``(key, score)`` of the documents that the query asks for, best BM25 first, ties by key; all of them if ``limit`` is None. A
        phrase ranks as a term does: by how many documents have it, and how often this one. An empty index gives none."""
        leaves, note = _phrases(query), self.tables.entry()["note"]
        rows = self.matches(query)
        if rows is None or not note["n"]:
            docs = self.tables.read("docs")
            kind = docs.schema[self.key].dataType.simpleString() if docs is not None else "bigint"
            return self.tables.spark.createDataFrame([], f"`{self.key}` {kind}, score double")
        stats = rows.agg(*[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(leaves))])
        found = rows.where(_holds(query, leaves)).join(F.broadcast(stats))  # one row
        n, mean = float(note["n"]), note["terms"] / note["n"]
        score = F.lit(0.0)
        for i in range(len(leaves)):
            df, tf = F.col(f"_df{i}"), F.col(f"_tf{i}").cast("double")
            idf = F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / mean))
        found = found.select(self.key, score.alias("score")).orderBy(F.desc("score"), self.key)
        return found.limit(limit) if limit else found
