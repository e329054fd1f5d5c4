import math
import re
import time
from collections import Counter

from edge import documents
from folioforge.functions.text import pinned
from folioforge.llm import quality_rules as qr
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORDS.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    count, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_and_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in qr.op9_quality_rules(spark, folder).collect()}
    for k, t in docs.items():
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = [(r.quality, rows[r.doc_id].kept) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if not rows[r.doc_id].base_failed]
    assert sum(k for q, k in good if q == 1) > 0.98 * sum(q == 1 for q, _ in good)
    assert sum(k for q, k in good if q == 0) < 0.1 * sum(q == 0 for q, _ in good)


def test_no_python_on_the_executors(spark, data):
    plan = qr.op9_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_edges(spark):
    docs = documents(spark)
    rows = qr.judge(docs, docs.select("doc_id")).collect()
    assert len(rows) == 12 and {(r.n_words, r.kept) for r in rows if r.doc_id in (3, 4, 5)} == {(0, False)}
    assert qr.judge(docs, docs.select("doc_id").limit(0)).where("score <> 0").count() == 0
    assert qr.judge(docs.limit(0), docs.select("doc_id")).count() == 0


def test_filters_stay_linear(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))), (2, "short")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    began = time.time()
    found = qr.judge(docs, docs.select("doc_id"))
    assert found.where("kept").count() + found.where("score <> 0").count() + found.where("n_repeat_words > 1").count() == 1
    assert time.time() - began < 30


def test_score_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    docs, good, bins = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), {1, 8, 9}, (64, 128)
    grams = {}
    words = {k: WORDS.findall(t or "") for k, t in texts.items()}
    every = sorted({x for w in words.values() for x in w}) + sorted({p for w in words.values() for p in zip(w, w[1:])}, key=str)
    rows = [(i, *(x if isinstance(x, tuple) else (x, None)), isinstance(x, tuple)) for i, x in enumerate(every)]
    hashed = spark.createDataFrame(rows, "i int, a string, b string, pair boolean").selectExpr("i", f"pmod(if(pair, xxhash64(a, b), xxhash64(a)), if(pair, {bins[1]}, {bins[0]})) + if(pair, {bins[0]}, 0) AS bin")
    at = {every[r.i]: r.bin for r in hashed.collect()}
    for k, w in words.items():
        grams[k] = [at[x] for x in w] + [at[p] for p in zip(w, w[1:])]
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for k in good for b in grams[k])
    want = []
    for lo, hi in ((0, bins[0]), (bins[0], sum(bins))):
        p, q = sum(target[b] for b in range(lo, hi)), sum(raw[b] for b in range(lo, hi))
        want += [math.log((target[b] + 1) / (p + hi - lo)) - math.log((raw[b] + 1) / (q + hi - lo)) for b in range(lo, hi)]
    ratios = qr.log_ratios(docs, docs.where(docs.doc_id.isin(*good)).select("doc_id"), bins=bins)
    assert max(abs(a - b) for a, b in zip(ratios, want)) < 1e-5 and len(ratios) == len(want)
    scored = pinned(pinned(docs, words=qr.words_of(docs.text)), score=qr.ratio_score(qr.bins_of("words", bins), ratios)).collect()
    for r in scored:
        g = grams[r.doc_id]
        assert abs(r.score - (sum(want[b] for b in g) / len(g) if g else 0)) < 1e-5


def test_every_trusted_document_counts(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id % 50) AS text")
    assert set(qr.log_ratios(docs, docs.select("doc_id"))) == {0.0}  # all are trusted, so both multinomials are the same


def test_the_score_makes_no_struct_for_each_ngram(spark):
    rows = spark.sql("SELECT explode(array(array(1, 0, 1), array(), null)) AS b").select(qr.ratio_score(F.col("b"), [0.5, 2.0]).alias("s"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "struct(" not in plan
    assert [r.s for r in rows.collect()] == [1.5, 0.0, 0.0]
