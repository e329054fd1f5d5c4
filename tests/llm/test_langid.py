import numpy as np
from edge import documents
from folioforge.llm import langid


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = langid.op5_langid(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 1000 and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_windows_hold_every_byte():
    texts = [b"", b"a" * 300, b"xyz"]
    x, owner, size = langid.windows_of(texts, 128)
    assert owner.tolist() == [1, 1, 1, 2] and size.tolist() == [128, 128, 44, 3]
    assert x[3][:4].tolist() == [120, 121, 122, 0] and (x[:3] == 97).sum() == 300


def plain_pooled(model, window):
    """Filter maxima by the definition of a convolution."""
    p, found = model.params, []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            at = [sum(p["emb"][window[i + k]] @ p[f"conv{w}"][k][:, f] for k in range(w)) + p[f"off{w}"][f] for i in range(len(window) - w + 1)]
            found.append(max(0.0, max(at)))
    return np.array(found)


def loss(model, x, y):
    z = np.array([plain_pooled(model, row) for row in x]) @ model.params["out"] + model.params["bias"]
    return -np.log(langid.softmax(z)[np.arange(len(y)), y]).mean()


def small_model():
    texts = [b"the cat sat on the mat and the dog", "der Hund über die Straße geht nicht".encode(), "le chat est sur la table à côté".encode()] * 4
    return langid.ByteCnn(["a", "b", "c"]).fit(texts, ["a", "b", "c"] * 4, epochs=2), texts


def test_forward_pass_against_a_plain_convolution():
    model, texts = small_model()
    x, _, _ = langid.windows_of(texts[:3], 40)
    got = model.probabilities(x, model.tables())
    want = langid.softmax(np.array([plain_pooled(model, row) for row in x]) @ model.params["out"] + model.params["bias"])
    assert np.abs(got - want).max() < 1e-5


def test_gradients_against_finite_differences():
    model, texts = small_model()
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x, _, _ = langid.windows_of(texts[:3], 24)
    x, y = x[:3], np.array([0, 1, 2])
    grads = model._gradients(x, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        flat = model.params[name].reshape(-1)
        some = np.flatnonzero(g.reshape(-1)) if name == "emb" else np.arange(len(flat))
        for i in rng.choice(some, 4, replace=len(some) < 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss(model, x, y)
            flat[i] = old - 1e-5
            down = loss(model, x, y)
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-4


def test_long_texts_come_in_pieces():
    model, texts = small_model()
    long = b" ".join(texts) * 40
    whole = model.scores([b"", long, texts[0]], model.tables())
    piece, langid.PIECE = langid.PIECE, 256
    try:
        assert np.abs(model.scores([b"", long, texts[0]], model.tables()) - whole).max() < 1e-9
    finally:
        langid.PIECE = piece


def test_names_that_clash(spark):
    docs = documents(spark)
    every = langid.predicted(docs.withColumn("lang_pred", docs.lang), langid.train(docs), [*docs.columns, "lang_pred"]).collect()
    assert len(every) == 12 and {r.row.score for r in every} == {1.0} and {r.row.text for r in every} == {r.text for r in docs.collect()}


def test_edges(spark):
    docs = documents(spark)
    model = langid.train(docs)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 6}
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert langid.train(docs.limit(0)) is None
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, None).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"wort{i % 300} text{i % 300} " * 5, f"lang{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, texts, langs: taken.append(langs) or self)
    assert len(langid.train(docs).langs) == 300 and len(taken[-1]) == 900
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 600)
    assert len(langid.train(docs).langs) == 300 and len(taken[-1]) == 600
