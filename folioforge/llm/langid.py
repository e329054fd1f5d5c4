"""Operator 5: language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each filter's maximum over the window is kept, and a
softmax layer turns the maxima into languages. The network is trained in numpy on a bounded sample of labelled windows
and applied to every window of every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folioforge.llm.batches import as_bytes, slices
from folioforge.llm.sampling import thinned
from folioforge.plans.sizes import broadcast_if_small

#: Bytes of a window; filter widths; filters of each width; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 8, 8

#: Training rows of each language at most, one window of each; and of all languages together, of which each has one at least.
SAMPLE_PER_LANG, SAMPLE_ROWS = 800, 200_000

#: Bytes of text whose windows are worked on at once; longer texts come in pieces.
PIECE = WINDOW << 13

UNKNOWN = "und"


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows padded with zero bytes: the windows, the text of each, and its bytes before padding."""
    length = np.array([len(t) for t in texts], np.int64)
    count = -(-length // size)
    flat = np.zeros(int(count.sum()) * size, np.uint8)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    shift = np.cumsum(count * size) - count * size - (np.cumsum(length) - length)
    flat[np.arange(len(raw)) + np.repeat(shift, length)] = raw
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return flat.reshape(-1, size), owner, np.minimum(size, length[owner] - nth * size)


@dataclass
class ByteCnn:
    """The network's weights. ``fit`` makes them; ``scores`` applies them."""

    langs: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def fit(self, texts: list[bytes], langs: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Adam on the cross entropy of one window a text."""
        rng, n_out = np.random.default_rng(seed), len(self.langs)
        p = {"emb": rng.normal(0, 0.3, (256, DIM)), "out": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n_out)), "bias": np.zeros(n_out)}
        for w in WIDTHS:
            p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS))
            p[f"off{w}"] = np.zeros(FILTERS)
        self.params = p = {k: v.astype(np.float32) for k, v in p.items()}
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        x, owner, _ = windows_of([t[:WINDOW] for t in texts])
        y = np.array([self.langs.index(langs[i]) for i in owner])
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                grads = self._gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        e, rows = p["emb"][x], np.arange(n)[:, None]
        pooled, at = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            z = sum(e[:, k : k + span] @ p[f"conv{w}"][k] for k in range(w)) + p[f"off{w}"]
            at.append(z.argmax(1))
            pooled.append(z.max(1))
        h = np.maximum(np.concatenate(pooled, 1), 0)
        prob = softmax(h @ p["out"] + p["bias"])
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"out": h.T @ prob, "bias": prob.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (prob @ p["out"].T) * (h > 0)
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"off{w}"], g[f"conv{w}"] = d.sum(0), np.zeros_like(p[f"conv{w}"])
            for k in range(w):
                byte = x[rows, at[j] + k]
                g[f"conv{w}"][k] = np.einsum("nf,nfd->df", d, p["emb"][byte])
                np.add.at(g["emb"], byte, d[:, :, None] * p[f"conv{w}"][k].T[None])
        return g

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, what each pair of neighbouring bytes (or a last single byte) adds to the filters."""
        p, found = self.params, {}
        for w in WIDTHS:
            one = [p["emb"] @ p[f"conv{w}"][k] for k in range(w)]
            one[0] = one[0] + p[f"off{w}"]
            pairs = [(one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            found[w] = pairs + [one[-1]] * (w % 2)
        return found

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of each language, for each window."""
        out = np.zeros((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), 256):
            byte = x[i : i + 256]
            pair = byte[:, :-1].astype(np.int32) * 256 + byte[:, 1:]
            pooled = []
            for w in WIDTHS:
                span, t = x.shape[1] - w + 1, tables[w]
                z = t[0][pair[:, :span]]
                if w > 2:
                    z += t[1][pair[:, 2 : 2 + span]] if w == 4 else t[1][byte[:, 2 : 2 + span]]
                pooled.append(z.max(1))
            out[i : i + 256] = softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.params["out"] + self.params["bias"])
        return out

    def scores(self, texts: list[bytes], tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of each language, for each text: the geometric mean over its windows, weighted by their bytes, so windows that say little
        (one word over and over) don't outvote those that do. An empty text gives each language the same."""
        total = np.zeros((len(texts), len(self.langs)))
        pieces = [(i, t[j : j + PIECE]) for i, t in enumerate(texts) for j in range(0, len(t), PIECE)]
        group, held = [], 0
        for n, (i, piece) in enumerate(pieces, 1):
            group.append((i, piece))
            held += len(piece)
            if held >= PIECE or n == len(pieces):
                x, owner, size = windows_of([p for _, p in group])
                at = np.array([i for i, _ in group])[owner]
                np.add.at(total, at, np.log(np.maximum(self.probabilities(x, tables), 1e-4)) * size[:, None])
                group, held = [], 0
        return softmax(total / np.maximum(1, [[len(t)] for t in texts]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> ByteCnn | None:
    """A network for the languages of ``labelled``, from at most ``per_lang`` rows of each, chosen by a hash of the key and
    the text; of each, one window that starts anywhere in the text. Every language is learned: where there are many, each has fewer rows,
    so that all have ``SAMPLE_ROWS`` together. Null texts, keys and languages take no part; None if nothing is left."""
    pick = F.xxhash64(key, text)
    start = (F.pmod(pick, F.greatest(F.lit(1), F.length(text) - WINDOW)) + 1).cast("int")
    rows = labelled.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), pick.alias("pick"), F.substring(F.col(text), start, F.lit(WINDOW)).alias("part"))
    size = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")).where("_lang IS NOT NULL")
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(1, size.count())))
    rows = rows.join(broadcast_if_small(size), F.col("lang") == F.col("_lang")).where(thinned(F.col("pick"), per_lang, F.col("_n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("pick", F.lit(1 << 30)), "pick", "part"))
    found = rows.withColumn("nth", nth).where(F.col("nth") <= per_lang).orderBy("lang", "nth").collect()
    if not found:
        return None
    return ByteCnn(sorted({r.lang for r in found})).fit([r.part.encode() for r in found], [r.lang for r in found])


def predicted(docs: DataFrame, model: ByteCnn | None, columns: list[str], text: str = "text") -> DataFrame:
    """``(row, lang_pred, score)`` of every row, from all bytes of its text; ``row`` is a struct of ``columns``, so no name can clash.

    A null text, one without a letter, and every text if there is no model get language ``und`` and score 0. Repeated rows
    stay; there is no shuffle.
    """
    inside = text in columns  # then the text travels once
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    source = docs.select(F.struct(*columns).alias("row"), letters, *([] if inside else [F.col(text).alias("text")]))

    def run(batches):
        tables = model.tables() if model else {}
        whole = (pa.RecordBatch.from_arrays([b.column("row"), b.column("letters"), b.column("row").field(columns.index(text)) if inside else b.column("text")], names=["row", "letters", "text"]) for b in batches)
        for batch in slices(whole, "text"):
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model:
                p = model.scores(as_bytes(batch, "text"), tables)
                best = p.argmax(1)
                lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, StructType([source.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predict(docs: DataFrame, model: ByteCnn | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` of every row: see :func:`predicted`."""
    return predicted(docs, model, [key], text).select(F.col("row").getField(key).alias(key), "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """True for the fifth of the keys that training never sees; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over the whole ``documents`` table, learnt from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_langid": op5_langid}
ORACLES: dict[str, str] = {}
