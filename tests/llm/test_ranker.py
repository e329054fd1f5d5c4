import math

import numpy as np
from edge import documents
from folioforge.llm import quality_ranker as qk
from pyspark.sql import functions as F


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.01"
    rows = qk.op10_quality_ranker(spark, folder).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    good, bad = ([s for q, s, _ in held if q == k] for k in (1, 0))
    assert len(rows) == 1000 and len(bad) > 10
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([q == p for q, _, p in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def plain_features(text):
    """The features by their definitions, one by one."""
    words, k = text.split(), len(qk.CLASSES)
    if not words:
        return np.zeros(qk.N_FEATURES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kind = [next((i for i, g in enumerate(qk.CLASSES.values()) if b in g), k) for b in text]
    out = [kind.count(i) / len(text) for i in range(k)]
    out += [math.log(1 + len(words)) / 10, min(len(text) / len(words), 40) / 10, len(set(words)) / len(words)]
    out += [sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / len(words), len(set(lines)) / len(lines), math.log(1 + len(words) / len(lines)) / 5]
    out += [sum(kind[i] != kind[i + 1] for i in range(len(text) - 1)) / len(text), sum(w.isupper() for w in words) / len(words)]
    m = 1 << 64

    def mixed(h):
        h = (h ^ (h >> 31)) * 0x7FB5D329728EA185 % m
        return h ^ (h >> 29)

    h = [mixed(sum((b + 1) * pow(qk._BASE, i, m) for i, b in enumerate(w)) % m) for w in words]
    pairs = [((a * 0x9E3779B97F4A7C15 % m) ^ b) * 0x7FB5D329728EA185 % m for a, b in zip(h, h[1:])]
    for x in (h, pairs):
        out += [sum((v >> 40) % qk.BINS == i for v in x) / max(1, len(x)) for i in range(qk.BINS)]
    return np.array(out)


def test_features_against_their_definitions():
    texts = [b"", b" \n\t", b"one", "Ärger und Über\nund und 12 (x) \"q\"\r\n\nLAST LINE!! ###".encode(), b"a b a b\na b", bytes(range(1, 128))]
    assert np.abs(qk.text_features(texts) - np.array([plain_features(t) for t in texts])).max() < 1e-12


def test_fit_minimises_the_pairwise_loss_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    better, worse = rng.normal(0.8, 1, (300, 3)), rng.normal(-0.8, 1, (100, 3))
    model = qk.fit(better, worse, 0.25, steps=600)
    unit = lambda x: np.clip((x - model.mean) / model.scale, -8, 8)

    def loss(w):
        z = (unit(better) @ w)[:, None] - (unit(worse) @ w)[None]
        return np.log1p(np.exp(-z)).mean() + 0.001 * (w @ w)

    at = loss(model.weights)
    assert all(loss(model.weights + d) > at - 2e-4 for d in 0.2 * np.vstack([np.eye(3), -np.eye(3)]))
    s = np.concatenate([model.strengths(worse), model.strengths(better)])
    assert abs((s < model.edge).mean() - 0.25) <= 0.01  # all labelled rows are here, so shares need no weights
    assert np.array_equal(model.scores(np.vstack([worse, better])) >= qk.THRESHOLD, s >= model.edge)


def test_names_that_clash(spark):
    docs = documents(spark).withColumns({c: F.lit(1) for c in ("_key", "_label", "_nth", "_doc", "_text", "predicted", "x")})
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), "_key")
    assert qk.score(docs, qk.train(docs, labels)).count() == 12


def test_edges(spark):
    docs = documents(spark)
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = qk.train(docs, labels)
    rows = qk.score(docs, model).collect()
    assert len(rows) == 12 and len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert qk.train(docs, labels.where("quality = 1")) is None and qk.train(docs, labels.limit(0)) is None
    assert {r.score for r in qk.score(docs, None).collect()} == {0.5}
    assert qk.score(docs.limit(0), model).count() == 0


def test_a_key_with_many_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(qk, "fit", lambda better, worse, share: seen.append((len(better), len(worse), share)))
    many = spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.when(F.col("id") < 15_000, F.lit("one text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(i, f"bad {i}") for i in range(2, 21)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), *[(i, 0) for i in range(2, 21)]], "doc_id long, quality int")
    qk.train(docs, labels, per_label=300)
    assert seen == [(300, 19, 19 / 21)]
    qk.train(docs, labels, per_label=6000)
    assert seen[-1] == (5001, 19, 19 / 21)


def test_every_labelled_document_teaches(spark):
    good = [(i, f"a fine text of number {i} with {i % 7} words, and more to read. " * (1 + i % 3)) for i in range(1500)]
    bad = [(i, f"BUY {i} now!!! $$$ {'x ' * (i % 5)} fine {i % 11}") for i in range(1500, 2700)]
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(2700)], "doc_id long, quality int").repartition(3)
    own = spark.createDataFrame(good + bad, "doc_id long, text string").repartition(3)
    copies = spark.range(4000).select(F.lit(2699).cast("bigint").alias("doc_id"), F.lit(bad[-1][1]).alias("text"))  # one text of a key
    found = qk.train(own.unionByName(copies).unionByName(spark.createDataFrame([(None, "x"), (5000, "y")], "doc_id long, text string")), labels)
    x = [qk.text_features([t.encode() for _, t in rows]).astype(np.float32).astype(float) for rows in (good, bad)]
    want = qk.fit(*x, 1200 / 2700)
    assert np.allclose(found.mean, np.concatenate(x).mean(0), atol=1e-6) and np.allclose(found.weights, want.weights, atol=1e-4)
    assert abs(found.edge - want.edge) < 1e-3 and abs(found.width - want.width) < 1e-3


def test_sums_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, good = rng.normal(0, 1, (300, 4)), np.arange(300) < 200
    x[good] += 0.5
    model = qk.PairwiseRanker(x.mean(0), x.std(0), np.array([1.0, -2, 0.5, 30]))
    loss, curves = qk.pair_loss(qk.counts(x, good, model))
    s, u = model.strengths(x), model.unit(x)
    z = s[good][:, None] - s[~good][None]
    p = 1 / (1 + np.exp(z))
    assert np.abs(s).max() > qk.REACH and abs(loss - np.logaddexp(0, -np.clip(s[good], -64, 64)[:, None] + np.clip(s[~good], -64, 64)[None]).mean()) < 1e-3
    found = qk.slopes(x, good, model, curves, np.array([100, 200]))
    g, a, v = np.split(found[:18].reshape(2, -1), [4, 5], axis=1)
    assert np.allclose(g[1], (p.mean(1)[:, None] * u[good]).mean(0), atol=2e-3) and np.allclose(g[0], (p.mean(0)[:, None] * u[~good]).mean(0), atol=2e-3)
    assert abs(a[1, 0] - (p * (1 - p)).mean()) < 1e-3 and abs(a[0, 0] - a[1, 0]) < 1e-3 and len(found) == 18 + 10
    assert abs(found[18] - sum(((p * (1 - p)).mean(k) * u[y, 0] ** 2).mean() for k, y in ((0, ~good), (1, good)))) < 1e-2


def test_labels_meet_their_documents_by_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id int, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)], "_key int, _label int")
    rows = qk.labelled_features(docs, known, "doc_id", "text")
    assert sorted(r._key for r in rows.select("_key").collect()) == list(range(0, 20, 2))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
