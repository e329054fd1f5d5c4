"""run() against its stages in plain Python on a small table."""

import base64

import corpus_pipeline as cp
import tiktoken
from edge import documents
from folioforge.llm import bpe, mixing
from pyspark.sql import functions as F
from test_linededup import expected as deduped
from test_simhash import components, fingerprint


def test_stages(spark, data):
    docs, got = spark.read.parquet(f"{data}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns
        got[name] = docs.collect()
    texts = lambda rows: sorted((r.doc_id, r.text) for r in rows)
    start = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert texts(got["language_id"]) == texts(start)  # every document has letters and a clear language
    lang = {r.doc_id: r.lang for r in start}
    assert sum(lang[r.doc_id] == r.lang for r in got["language_id"]) >= 0.97 * len(lang)
    lines = deduped(texts(start))
    assert dict(texts(got["line_dedup"])) == lines
    order = sorted(lines.items())
    kept = [k for (k, _), c in zip(order, components([fingerprint(t) for _, t in order])) if order[c][0] == k]
    assert [k for k, _ in texts(got["simhash_near_dedup"])] == kept
    words = {}
    for r in got["mixing"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    plan = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(got["simhash_near_dedup"])).collect() if r.taken}
    assert words == plan


def test_run(spark, data):
    path, pattern = bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = cp.run(spark, data).collect()
    assert rows and all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert all(enc.encode_ordinary(enc.decode(r.ids)) == r.ids for r in rows[:50])


def test_stages_with_odd_rows(spark, data):
    """Null keys and texts, repeated rows, empty tables and names that clash, in every stage."""
    docs = documents(spark)
    docs = docs.withColumns({c: F.lit(7) for c in ("lang_pred", "row", "_row", "_id", "_removed", "_kept", "_doc", "size", "target", "copies", "head", "run", "taken", "n_removed", "key", "id", "pos")})
    columns, left = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), data).count() == 0
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns and {r["_removed"] for r in docs.collect()} == {7} and {r.score for r in docs.collect()} == {1.0}
        left[name] = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert [k for k, _ in left["language_id"]] == [0, 1, 2, 7, 8, 9, 10, 10]  # those without a letter go
    assert [k for k, _ in left["line_dedup"]] == [0, 1, 2, 7, 8, 9, 10, 10] and [t for k, t in left["line_dedup"] if k == 2] == [""]
    assert [k for k, _ in left["simhash_near_dedup"]] == [0, 1, 2, 7, 8, 9, 10]  # 2 and the second 10 are empty now: one group
    assert {k for k, _ in left["mixing"]} <= {0, 1, 7, 8, 9, 10}
    name, last = cp.STAGES[-1]
    rows = last(spark, docs, data).collect()
    assert len(rows) == docs.count() and all(r.exact for r in rows)
    assert last(spark, documents(spark), data).count() == 12 and last(spark, docs.limit(0), data).count() == 0


def test_nothing_goes_without_a_known_language(spark, data):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert cp.identify_language(spark, docs, data).count() == 12


def test_dedup_keeps_rows_that_share_an_id(spark, data):
    texts = [" ".join(f"w{(i * 7919 + j * j) % 10007}" for j in range(60)) for i in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(3, t) for t in texts[5:9]] + [(9, texts[0]), (3, texts[8]), (8, texts[9]), (8, texts[9])]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.text, r.doc_id) for r in cp.dedup_documents(spark, docs, data).collect())
    want = [(t, None) for t in texts[1:5]] + [(t, 3) for t in texts[5:9]] + [(texts[0], 9), (texts[9], 8)]
    assert kept == sorted(want)
    mixed = {r.text.split()[0] for r in cp.mix_sources(spark, cp.dedup_documents(spark, docs, data), data).collect()}
    assert len(mixed) == 10
