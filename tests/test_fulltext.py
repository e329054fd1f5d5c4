"""The full-text index against a plain search of whole texts."""

import math
import random
import re

import pytest
from folioforge.operators import fulltext as ft
from pyspark.sql import functions as F

W = "alpha beta gamma delta al alp zeta Éta".split()


def plain_words(text):
    return [w.replace("é", "e") for w in re.findall(r"[^\W_]+", (text or "").lower())]


def occurrences(p, columns):
    n = 0
    for words in columns:
        for i in range(len(words) - len(p.words) + 1):
            part = words[i : i + len(p.words)]
            last = part[-1].startswith(p.words[-1]) if p.prefix else part[-1] == p.words[-1]
            n += part[:-1] == list(p.words[:-1]) and last
    return n


def plain_search(docs, query):
    rows = {k: [plain_words(t) for t in texts] for k, texts in docs.items()}
    leaves = ft._phrases(query)
    tf = {k: [occurrences(p, c) for p in leaves] for k, c in rows.items()}
    df = [sum(t[i] > 0 for t in tf.values()) for i in range(len(leaves))]
    size = {k: sum(map(len, c)) for k, c in rows.items()}
    mean = sum(size.values()) / max(1, len(size))

    def holds(q, t):
        if isinstance(q, ft.Phrase):
            return t[leaves.index(q)] > 0
        a, b = holds(q.left, t), holds(q.right, t)
        return (a and b) if q.kind == "and" else (a or b) if q.kind == "or" else (a and not b)

    out = {}
    for k, t in tf.items():
        if holds(query, t):
            idf = [max(math.log((len(rows) - d + 0.5) / (d + 0.5)), 1e-6) for d in df]
            out[k] = sum(i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[k] / mean)) for i, f in zip(idf, t))
    return out


QUERIES = [
    ft.phrase("alpha"), ft.phrase("alpha beta"), ft.phrase("ALPHA, béta gamma"), ft.prefix("al"), ft.prefix("a"), ft.phrase("beta al", prefix=True), ft.phrase("eta"), ft.bare("alpha zeta"), ft.bare("alpha-beta delta"),
    ft.phrase("alpha") | ft.phrase("delta gamma"), ft.phrase("alpha") - ft.phrase("beta"), (ft.prefix("z") | ft.phrase("eta")) & ft.phrase("gamma") - ft.phrase("beta gamma"), ft.phrase("nowhere"), ft.phrase("alpha alpha"),
]


def check(index, docs):
    for q in QUERIES:
        want = plain_search(docs, q)
        got = {r.doc_id: r.score for r in index.search(q, None).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got), q


def frame(spark, docs):
    return spark.createDataFrame([(k, *t) for k, t in docs.items()], "doc_id bigint, title string, text string")


def some(rng):
    line = lambda n: " ".join(rng.choice(W) + rng.choice(["", ",", "."]) for _ in range(n))
    return (rng.choice([None, "", line(3)]), line(rng.randrange(0, 14)))


def test_any_sequence_of_changes_equals_a_new_index(spark, tmp_path):
    rng, docs = random.Random(2), {}
    index = ft.Index(spark, f"{tmp_path}/i")
    assert index.search(ft.phrase("alpha")).count() == 0
    for step in range(5):
        new = {rng.randrange(25): some(rng) for _ in range(8)}
        gone = {rng.randrange(25) for _ in range(3)} - set(new)
        index.put(frame(spark, new), "title", "text", gone=spark.createDataFrame([(k,) for k in gone] or [(-1,)], "doc_id bigint"))
        docs = {k: v for k, v in docs.items() if k not in gone} | new
        if step == 2:
            index.remove(spark.createDataFrame([(k,) for k in list(docs)[:2]], "doc_id bigint"))
            docs = dict(list(docs.items())[2:])
    note = index.tables.entry()["note"]
    assert note == {"n": len(docs), "terms": sum(len(plain_words(t)) for v in docs.values() for t in v)}
    check(index, docs)
    index.merge()
    anew = ft.Index(spark, f"{tmp_path}/j")
    anew.put(frame(spark, docs), "title", "text")
    rows = [sorted(map(repr, x.tables.read("postings").select("term", "doc_id", "n_terms", "tf", "positions").collect())) for x in (index, anew)]
    assert rows[0] == rows[1] and anew.tables.entry()["note"] == note
    check(index, docs)


def test_scans_only_its_terms(spark, data, tmp_path):
    index = ft.Index(spark, f"{tmp_path}/i")
    index.put(spark.read.parquet(f"{data}/documents.parquet"), "text")
    plan = index.postings_of([ft.phrase("the"), ft.prefix("nat")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "In(term" in plan.replace("EqualTo(term", "In(term") and "StringStartsWith(term" in plan
    assert "positions" not in plan.split("ReadSchema")[-1]
    assert "positions" in index.postings_of([ft.phrase("the nation")])._jdf.queryExecution().toString().split("ReadSchema")[-1]


def test_odd_texts_and_queries(spark, tmp_path):
    docs = {1: (None, None), 2: ("", "one\x00two 😀 漢字かな x"), 3: ("x " * 3, "y" * 70_000)}
    index = ft.Index(spark, f"{tmp_path}/i")
    index.put(frame(spark, docs).unionByName(spark.createDataFrame([(None, "n", "one")], "doc_id bigint, title string, text string")), "title", "text")
    found = lambda q: sorted((r.doc_id for r in index.search(q).collect()), key=repr)
    assert found(ft.phrase("one")) == [2, None] and found(ft.phrase("漢字かな")) == [2] and found(ft.prefix("yyyy")) == [3] and found(ft.phrase("x x")) == [3]
    assert found(ft.phrase("x y")) == []  # a phrase doesn't go from one column into the next
    for bad in ("", "  ", "?!", "😀"):
        with pytest.raises(ValueError):
            ft.bare(bad)


def test_queries_words_are_the_texts(spark):
    rows = ["Ünïcode Straße ﬁne ǅ", "a_b-c'd 1½ ٣", "Ἀθῆναι İstanbul", "é é"]
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(ft.words_of(F.col("t"))).collect()]
    assert [ft.words_in(t) for t in rows[:2] + rows[3:]] == found[:2] + found[3:]
