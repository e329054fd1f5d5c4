"""Operator 10: quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. All preference pairs (a better and a worse document) of all
labelled documents teach the weights by logistic loss on feature differences; the score is a logistic curve of the strength, set so that the strength
below which the share of worse documents lies, a quantile of the training strengths, scores exactly the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.llm.batches import as_bytes, slices

#: Strengths at which rows of the other label are summed up while weights are learnt; the ridge of the loss.
REACH, STEP, RIDGE = 64.0, 1 / 32, 0.002
GRID = np.arange(-REACH, REACH, STEP)

#: Tasks over which the rows of one key are dealt; labelled rows for each task that sums up, so that its sums (0.3 MB) are small beside them.
SPREAD, ROWS_PER_SUM = 8, 8192

#: Score from which a document is predicted to be good.
THRESHOLD = 0.7

#: Groups of bytes whose shares are features: what a text is made of, beyond words.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "mark": b"#*$%&@^~=+_",
    "bracket": b"<>|{}[]()/\\",
    "quote": b"'\"`-",
    "high": bytes(range(128, 256)),
}

#: Bins of hashed words, and as many of pairs of neighbouring words, whose shares are features too.
BINS = 128

N_FEATURES = len(CLASSES) + 8 + 2 * BINS

_BASE = 0x100000001B3


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order: a polynomial of its bytes, mixed."""
    code = np.frombuffer(text, np.uint8)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    most = int(size.max())
    power = np.ones(most, np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    first = np.cumsum(size) - size
    h = np.add.reduceat((code[~blank].astype(np.uint64) + np.uint64(1)) * power[np.arange(size.sum()) - np.repeat(first, size)], first)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def hashed_shares(text: bytes) -> np.ndarray:
    """Shares of the text's words in each bin, then of its pairs of neighbouring words."""
    h = word_hashes(text)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pairs = pairs * np.uint64(0x7FB5D329728EA185)
    count = [np.bincount((x >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS) / max(1, len(x)) for x in (h, pairs)]
    return np.concatenate(count)


def text_features(texts: list[bytes]) -> np.ndarray:
    """(texts, features): shares of the byte classes, logs and ratios of words and lines, and shares of hashed words and pairs. An
    empty text has zeros."""
    table = np.full(256, len(CLASSES), np.uint8)
    for i, group in enumerate(CLASSES.values()):
        table[np.frombuffer(group, np.uint8)] = i
    out = np.zeros((len(texts), N_FEATURES))
    for row, t in zip(out, texts):
        words = t.split()
        if not words:
            continue
        code = table[np.frombuffer(t, np.uint8)]
        n, k = len(words), len(CLASSES)
        row[:k] = np.bincount(code, minlength=k + 1)[:k] / len(t)
        lines = [x for x in t.split(b"\n") if x.strip()]
        row[k + 8 :] = hashed_shares(t)
        row[k : k + 8] = (
            np.log1p(n) / 10,
            min(len(t) / n, 40) / 10,
            len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 5,
            np.count_nonzero(np.diff(code)) / len(t),
            sum(w.isupper() for w in words) / n,
        )
    return out


@dataclass
class PairwiseRanker:
    """Weights over standardised features, and the curve that turns a strength into a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edge: float = 0.0
    width: float = 1.0
    threshold: float = THRESHOLD

    def unit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (self.unit(x) * self.weights).sum(1)  # row by row alike, whatever the batch

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and ``threshold`` at the edge."""
        z = (self.strengths(x) - self.edge) / self.width + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rounded(x):
    """To 24 bits: sums in another order give the same."""
    return np.float64(np.float32(x))


@dataclass
class Curves:
    """What all rows of the other label mean to a row by its strength, at the points of ``GRID``: for worse (0) and better (1) rows the
    mean chance that their pair is ordered wrongly, and the mean slope of that chance."""

    wrong: np.ndarray
    slope: np.ndarray


def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each label its rows, and the sums of the features and of their squares."""
    return np.concatenate([np.concatenate([[len(v)], v.sum(0), (v * v).sum(0)]) for v in (x[~good], x[good])])


def counts(x: np.ndarray, good: np.ndarray, model: PairwiseRanker, lo: float = -REACH, hi: float = REACH, n: int = len(GRID)) -> np.ndarray:
    """(2, labels, n), flat: rows of either label, and the sum of their strengths, in ``n`` equal bins from ``lo`` to below ``hi``. Those
    beyond ``REACH``, where the loss is a line or nothing, count there."""
    s = np.clip(model.strengths(x), -REACH, np.nextafter(REACH, 0))
    at = np.flatnonzero((s >= lo) & (s < hi))
    bin = np.minimum(((s[at] - lo) / (hi - lo) * n).astype(np.int64), n - 1) + n * good[at]
    return np.concatenate([np.bincount(bin, minlength=2 * n), np.bincount(bin, s[at], 2 * n)])


def slopes(x: np.ndarray, good: np.ndarray, model: PairwiseRanker, curves: Curves, n: np.ndarray) -> np.ndarray:
    """Of either label, over its ``n`` rows, the means of the chance to be ordered wrongly times the features, of the slope, and of the
    slope times the features; then of both labels the slope times the features' products (one triangle)."""
    u, s, k = model.unit(x), model.strengths(x), good.astype(np.int64)
    wrong, slope = (np.where(good, np.interp(s, GRID, c[1]), np.interp(s, GRID, c[0])) / n[k] for c in (curves.wrong, curves.slope))
    means = [v for mine in (~good, good) for v in (wrong[mine] @ u[mine], [slope[mine].sum()], slope[mine] @ u[mine])]
    products = (u * slope[:, None]).T @ u
    return np.concatenate([*means, products[np.triu_indices(len(products))]])


def nearest(x: np.ndarray, good: np.ndarray, model: PairwiseRanker, edge: float) -> np.ndarray:
    """The greatest strength below ``edge``, and the least of the others, negated."""
    s = model.strengths(x)
    return np.array([s[s < edge].max(initial=-np.inf), -s[s >= edge].min(initial=np.inf)])


def pair_loss(count: np.ndarray) -> tuple[float, Curves]:
    """Mean logistic loss of all pairs of a better and a worse row, from their strengths by bins, and the curves."""
    n, total = count.reshape(2, 2, -1)
    some = [np.flatnonzero(n[k]) for k in (0, 1)]
    share, at = [n[k][i] / n[k].sum() for k, i in enumerate(some)], [total[k][i] / n[k][i] for k, i in enumerate(some)]
    # a bin of better rows at a time against all of worse ones: no table of all pairs of bins
    loss = sum(w * (share[0] @ np.logaddexp(0, at[0] - t)) for w, t in zip(share[1], at[1]))
    wrong, slope = np.zeros((2, len(GRID))), np.zeros((2, len(GRID)))
    for k, sign in ((0, 1), (1, -1)):
        for w, t in zip(share[1 - k], at[1 - k]):
            p = 1 / (1 + np.exp(-sign * (GRID - t)))
            wrong[k] += w * p
            slope[k] += w * p * (1 - p)
    return float(loss), Curves(wrong, slope)


def fit_by(total: Callable[..., np.ndarray], share_worse: float, steps: int = 50) -> PairwiseRanker:
    """A ranker by Newton steps on the mean logistic loss of all pairs of a better and a worse row, with a small ridge.

    ``total(part, *args, join=np.add)`` joins ``part(x, good, *args)`` over blocks of all rows, wherever they are. All pairs count
    though none is made: rows of the other label meet a row as a curve over its strength (bins of 1/32, each at its rows' mean
    strength; the curve is off by 1e-5 at most). ``share_worse`` is the share of worse documents among all labelled ones, the
    quantile at which the edge lies once rows are weighted to that share.
    """
    first = total(sums).reshape(2, -1)
    n, d = first[:, 0], first.shape[1] // 2
    mean, square = first[:, 1 : d + 1].sum(0) / n.sum(), first[:, d + 1 :].sum(0) / n.sum()
    model = PairwiseRanker(rounded(mean), rounded(np.sqrt(np.maximum(0, square - mean**2)) + 1e-6), np.zeros(d))
    loss, curves = pair_loss(total(counts, model))
    triangle = np.triu_indices(d)
    for _ in range(steps):
        found = total(slopes, model, curves, n)
        g, a, v = np.split(found[: 4 * d + 2].reshape(2, -1), [d, d + 1], axis=1)
        down = g[0] - g[1] + RIDGE * model.weights
        upper = np.zeros((d, d))
        upper[triangle] = found[4 * d + 2 :]
        # of pairs of rows only the sums over each row's partners are known: they count as if independent, which changes the way alone
        mixed = np.outer(v[0], v[1]) / max(float(a.mean()), 1e-300)
        hessian = upper + np.triu(upper, 1).T - mixed - mixed.T + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, down)
        gain, part = float(down @ step), 1.0
        if gain < 1e-7:
            break
        while part > 1e-6:
            tried = replace(model, weights=model.weights - part * step)
            now, then = pair_loss(total(counts, tried))
            now += RIDGE / 2 * float(tried.weights @ tried.weights)
            if now <= loss - 1e-4 * part * gain:
                break
            part /= 4
        else:
            break
        model, loss, curves = tried, now, then
    model.weights = rounded(model.weights)
    lo, hi, below = -REACH, REACH, 0.0
    for _ in range(3):  # down to a bin of 1e-9
        found = total(counts, model, lo, hi)[: 2 * len(GRID)].reshape(2, -1)
        if lo == -REACH:
            at = (np.arange(len(GRID)) + 0.5) * STEP - REACH
            rows = found.sum(0) / n.sum()
            model.width = float(rounded(max(1e-3, np.sqrt(rows @ (at - rows @ at) ** 2) / 4)))
        up_to = below + np.cumsum(share_worse * found[0] / n[0] + (1 - share_worse) * found[1] / n[1])
        k = min(int(np.searchsorted(up_to, share_worse - 1e-12)), len(GRID) - 1)
        below = up_to[k - 1] if k else below
        lo, hi = lo + (hi - lo) * k / len(GRID), lo + (hi - lo) * (k + 1) / len(GRID)
    under, over = total(nearest, model, hi, join=np.maximum) * [1, -1]
    model.edge = float(rounded((under + over) / 2 if np.isfinite([under, over]).all() else under if np.isfinite(under) else over))
    return model


def fit(better: np.ndarray, worse: np.ndarray, share_worse: float, steps: int = 50) -> PairwiseRanker:
    """:func:`fit_by` over features of better and worse documents that are here."""
    x, good = np.concatenate([better, worse]), np.arange(len(better) + len(worse)) < len(better)
    return fit_by(lambda part, *args, join=np.add: part(x, good, *args), share_worse, steps)


def labelled_features(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """``(_doc, _pick, x, _key, _label, _part, _of)``: features of each text of a key once, for each of its labels in ``known`` (_key, _label).

    The join is by shuffle at any size: labels are short rows, so a file that Spark takes for small enough to send around would be
    ``SPREAD`` times millions of rows in the driver."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, "_text"):
            batch = batch.filter(pa.array([not (p in seen or seen.add(p)) for p in batch.column("_pick").to_pylist()], pa.bool_()))
            x = text_features(as_bytes(batch, "_text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_pick"), pa.array([v.tobytes() for v in x], pa.binary())], names=["_doc", "_pick", "x"])

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.xxhash64(key, text).alias("_pick"), F.col(text).alias("_text"))
    made = own.mapInArrow(run, f"_doc {own.schema['_doc'].dataType.simpleString()}, _pick bigint, x binary").withColumn("_part", F.pmod("_pick", F.lit(SPREAD)))
    known = known.distinct().withColumn("_of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    return made.join(known.hint("merge"), (F.col("_doc") == F.col("_key")) & (F.col("_part") == F.col("_of"))).dropDuplicates(["_key", "_of", "_label", "_pick"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int | None = None) -> PairwiseRanker | None:
    """A ranker from all labels 0 and 1 of ``labels`` and the documents they meet, each text of a key once. Null keys and labels take no
    part; None if either label meets no document.

    Features are made where the texts are and travel instead of them; the labelled ones are kept by Spark while passes over them sum
    up what a step needs. A key with many rows is dealt over ``SPREAD`` tasks. With ``per_label`` at most so many documents of each
    label train, chosen by a hash of key and text; without it, all."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    count = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(count) < 2:
        return None
    rows = labelled_features(docs, known, key, text)
    if per_label is not None:
        place = F.row_number().over(Window.partitionBy("_label").orderBy(F.pmod("_pick", F.lit(1 << 30)), "_pick", "_key"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= per_label)
        found = rows.orderBy("_label", "_key", "_pick").select("_label", "x").collect()  # two times ``per_label`` rows
        x, y = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float64), np.array([r["_label"] for r in found])
        return fit(x[y == 1], x[y == 0], count[0] / (count[0] + count[1])) if 0 < y.sum() < len(y) else None
    rows = rows.select("_label", "x").persist(StorageLevel.MEMORY_AND_DISK)
    tasks = 1 + sum(count.values()) // ROWS_PER_SUM

    def total(part, *args, join=np.add):
        def each(batches):
            out = None
            for batch in batches:
                for block in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    x = np.frombuffer(b"".join(block.column("x").to_pylist()), np.float32).reshape(block.num_rows, -1).astype(np.float64)
                    got = part(x, block.column("_label").to_numpy() == 1, *args)
                    out = got if out is None else join(out, got)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(out, np.float64).tobytes()], pa.binary())], names=["sums"])

        return rows.coalesce(tasks).mapInArrow(each, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums)).treeReduce(join)

    try:
        if rows.select("_label").distinct().count() < 2:
            return None
        return fit_by(total, count[0] / (count[0] + count[1]))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: PairwiseRanker | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, predicted)`` of every row, from its whole text.

    Null and empty texts have the features of an empty text and a score like any other; without a model every score is 0.5.
    Repeated rows stay; other columns are left out; there is no shuffle.
    """

    def run(batches):
        for batch in slices(batches, text):
            texts = as_bytes(batch, text)
            s = model.scores(text_features(texts)) if model else np.full(len(texts), 0.5)
            good = pa.array((s >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(s), good], names=[key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def held_out(key: str = "doc_id"):
    """True for the quarter of the keys that training never sees; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op10_quality_ranker(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over the whole ``documents`` table, learnt from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_ranker": op10_quality_ranker}
ORACLES: dict[str, str] = {}
