"""Operator 13: alignment of two tokenizers' tokens.

Both tokenizers encode a text to the same bytes. The texts of a whole Arrow batch are put one after another with their byte
offsets; the ends of all tokens of either side are counted by byte, once; where both have one the batch is cut into groups. A
text's end is such a place, so groups never span two texts, and per-text numbers are differences of running sums.

Texts are encoded once. What a text links is written to the shared folder as distinct pairs of ids with how often each occurs;
how many texts hold a pair is counted by Spark from there. The most widespread pairs, a table with a fixed bound, go to all
tasks; the texts' other pairs, each held by fewer texts than those, meet their counts by a shuffle join.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioforge.llm.batches import as_strings, slices
from folioforge.llm.bpe import byte_table, pieces_of
from folioforge.plans.lineage import cut_lineage, shared_folder

#: Pairs whose counts are sent to all tasks, at most: the rest are joined by a shuffle.
COMMON_PAIRS = 1 << 20

#: A pair of ids is one number: the first tokenizer's id above this many bits of the second's.
SHIFT = 32

#: Links expanded at once; from so many links on a group's tokens are first counted by id; pairs of a text in one row.
BLOCK_LINKS, LARGE_GROUP, ROW_PAIRS = 1 << 21, 256, 1 << 20

#: Characters after which a long text is encoded in pieces.
PIECE_CHARS = 50_000

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and start of each token, and all bytes."""
    n = np.array([len(t) for t in tokens], np.int64)
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(tokens), np.uint8)


class Side:
    """One tokenizer: ids of texts, and the bytes behind its ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length, self._start, self._bytes = _table(tokens)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self._bytes[np.repeat(self._start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class ByteSide(Side):
    """A byte-level BPE of the ``tokenizers`` library; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_table())}
        names = [self._tokenizer.id_to_token(i) or "" for i in range(self._tokenizer.get_vocab_size())]
        super().__init__([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text. Long texts go in pieces, cut where the splitting pattern cuts too."""
        pieces = [pieces_of(" " + t, PIECE_CHARS) for t in texts]
        flat = iter(self._tokenizer.encode_batch_fast([p for x in pieces for p in x], add_special_tokens=False))
        return [next(flat).ids if len(x) == 1 else [i for _ in x for i in next(flat).ids] for x in pieces]


class PieceSide(Side):
    """A BPE of the ``sentencepiece`` library, which puts the space in front itself."""

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self._cuts = not any(self.SPACE in t.lstrip(self.SPACE) for t in names)  # no piece goes from a word into a space
        super().__init__([bytes([int(t[3:5], 16)]) if m.is_byte(i) else t.replace(self.SPACE, " ").encode() for i, t in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. A long text goes in pieces that begin at a lone space, which the library adds again."""
        pieces = [pieces_of(t, PIECE_CHARS) if self._cuts else [t] for t in texts]
        flat = iter(self._model.encode([p[k > 0 :] for x in pieces for k, p in enumerate(x)], num_threads=1))
        return [next(flat) if len(x) == 1 else [i for _ in x for i in next(flat)] for x in pieces]


@lru_cache(4)
def byte_side(path: str) -> ByteSide:
    return ByteSide(path)


@lru_cache(4)
def piece_side(path: str) -> PieceSide:
    return PieceSide(path)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``edges``, as differences of one running sum."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[edges[1:]] - run[edges[:-1]]


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(4)
def _written(size_a: int, size_b: int) -> list[str]:
    """Decimal ids with the mark that follows: of the first tokenizer with ``,`` then with ``|``, of the second with ``,`` and ``;``."""
    return [f"{i}{mark}" for size, last in ((size_a, "|"), (size_b, ";")) for mark in (",", last) for i in range(size)]


class Batch:
    """The groups of a batch of texts: ids and ends of both sides, put one after another."""

    def __init__(self, a: Side, b: Side, texts: list[str]):
        n = len(texts)
        ids = [s.encode(texts) for s in (a, b)]
        whole = [(" " + t).encode() if t else b"" for t in texts]
        self.kept = np.array([bool(w) for w in whole])
        tokens, sizes = [], []
        for side, each in zip((a, b), ids):
            sizes.append(np.array([len(x) for x in each], np.int64) * self.kept)
            tokens.append(np.fromiter((i for x, k in zip(each, self.kept) if k for i in x), np.int64, int(sizes[-1].sum())))
        size = np.array([len(w) for w in whole], np.int64)
        for k, side in enumerate((a, b)):  # texts whose bytes a side doesn't give back have no tokens
            got, edges = side.bytes_of(tokens[k]), None
            if len(got) != size.sum() or not np.array_equal(got, np.frombuffer(b"".join(whole), np.uint8)):
                edges = _edges(_sums(side.length[tokens[k]], _edges(sizes[k])))
                self.kept &= np.array([got[edges[i] : edges[i + 1]].tobytes() == whole[i] for i in range(n)], bool)
        for k in (0, 1):
            tokens[k] = tokens[k][np.repeat(self.kept, sizes[k])]
            sizes[k] = sizes[k] * self.kept
        size = size * self.kept
        self.n, self.a, self.b = n, tokens[0], tokens[1]
        self.edges_a, self.edges_b = _edges(sizes[0]), _edges(sizes[1])
        ends = [np.cumsum(side.length[t]) for side, t in zip((a, b), tokens)]
        total = int(size.sum())
        cut = np.logical_and(*[np.bincount(e, minlength=total + 1) > 0 for e in ends]) if total else np.zeros(1, bool)
        before = np.cumsum(cut)  # cuts up to a byte
        self.group_a, self.group_b = (before[e] - cut[e] for e in ends)
        self.groups = int(before[-1])
        self.in_a, self.in_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        self.edges_g = np.concatenate([[0], before[np.cumsum(size)]]) if n else np.zeros(1, np.int64)  # groups of each text
        self._size = a.size, b.size

    def digests(self) -> list[str]:
        """The SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        size_a, size_b = self._size
        text = _written(size_a, size_b)
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        before_a, before_b = _edges(self.in_a), _edges(self.in_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[before_a[1:] - 1] = last_b[before_b[1:] - 1] = True
        merged[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + size_a * last_a
        merged[np.arange(len(self.b)) + before_a[self.group_b + 1]] = self.b + size_b * last_b + 2 * size_a
        edges, out = self.edges_a + self.edges_b, []
        for i, j in zip(edges, edges[1:]):
            out.append(hashlib.sha256("".join(map(text.__getitem__, merged[i:j].tolist()))[:-1].encode()).hexdigest() if j > i else "")
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, pair, links)``: each text's distinct linked pairs of ids, and its links of each. Groups with many links count their
        tokens by id first; links are expanded block by block, and each block's pairs are counted before the next."""
        large = self.in_a * self.in_b >= LARGE_GROUP
        sides = []
        for ids, group in ((self.a, self.group_a), (self.b, self.group_b)):
            big = large[group] if len(group) else np.zeros(0, bool)
            key, times = np.unique(group[big] << SHIFT | ids[big], return_counts=True)
            g = np.concatenate([group[~big], key >> SHIFT])
            order = np.argsort(g, kind="stable")
            sides.append((g[order], np.concatenate([ids[~big], key & ((1 << SHIFT) - 1)])[order], np.concatenate([np.ones((~big).sum(), np.int64), times])[order]))
        (ga, ia, ta), (gb, ib, tb) = sides
        in_b = np.bincount(gb, minlength=self.groups)
        first_b, text_of = _edges(in_b), np.repeat(np.arange(self.n), np.diff(self.edges_g))
        run = _edges(in_b[ga])  # links before each id of the first side
        parts, at = [], 0
        while at < len(ga):
            to = max(at + 1, int(np.searchsorted(run, run[at] + BLOCK_LINKS, "right")) - 1)
            n = in_b[ga[at:to]]
            left = np.repeat(np.arange(at, to), n)
            right = np.repeat(first_b[ga[at:to]] - (run[at:to] - run[at]), n) + np.arange(n.sum())
            parts.append(_counted(text_of[ga[left]], ia[left] << SHIFT | ib[right], ta[left] * tb[right]))
            at = to
        return _counted(*[np.concatenate(x) for x in zip(*parts)]) if len(parts) > 1 else parts[0] if parts else (np.zeros(0, np.int64),) * 3


def _counted(text: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, pair) put together, in their order, links added up."""
    order = np.lexsort((pair, text))
    text, pair, links = text[order], pair[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(pair) != 0)])) if len(text) else np.zeros(0, np.int64)
    return text[first], pair[first], np.add.reduceat(links, first) if len(first) else links


def _nested(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, groups)``: each text's groups in order, the ids of either side, ``array<struct<a: array<int>, b: array<int>>>``.

    A null or empty text has no groups, nor has one whose bytes a side doesn't give back. A row for each row; other columns are left
    out; no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(a_path), piece_side(b_path)
        for batch in slices(batches, text, 1 << 18):
            x = Batch(a, b, as_strings(batch, text))
            sides = [_nested(_edges(n), pa.array(ids, pa.int32())) for n, ids in ((x.in_a, x.a), (x.in_b, x.b))]
            groups = _nested(x.edges_g, pa.StructArray.from_arrays(sides, names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([batch.column(key), groups], names=[key, "groups"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def linked(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_id, key, part, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links)``: of each row its numbers, its distinct linked pairs
    of ids (``a << 32 | b``) and its links of each. More than ROW_PAIRS pairs take further rows, of parts from 1 on, each its own pairs."""
    kind = docs.schema[key].dataType.simpleString()
    schema = "_id bigint, key " + kind + ", part int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, links array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(a_path), piece_side(b_path)
        for batch in slices(batches, "_text", 1 << 18):
            x = Batch(a, b, as_strings(batch, "_text"))
            own, pair, links = x.pairs()
            edges = np.searchsorted(own, np.arange(x.n + 1))
            rows = [(i, k, at, min(at + ROW_PAIRS, edges[i + 1])) for i in range(x.n) for k, at in enumerate(range(edges[i], max(edges[i + 1], edges[i] + 1), ROW_PAIRS))]
            at = pa.array([r[0] for r in rows])
            cuts = np.array([r[2] for r in rows] + [len(pair)])
            numbers = (np.diff(x.edges_a), np.diff(x.edges_b), np.diff(x.edges_g), _sums(x.in_a * x.in_b, x.edges_g))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(at), batch.column("_key").take(at), pa.array([r[1] for r in rows], pa.int32()), *[pa.array(n).take(at) for n in numbers],
                    pa.array(x.digests(), pa.string()).take(at), _nested(cuts, pa.array(pair)), _nested(cuts, pa.array(links)),
                ],
                names=["_id", "key", "part", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema)


def pair_counts(written: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, n_docs, best)`` of rows of :func:`linked` that were written: how many texts hold each linked pair, and whether
    that is the highest count of its first id. The highest counts are a row for each entry of a vocabulary, which bounds the broadcast."""
    counts = written.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = cut_lineage(counts).withColumn("a_id", F.shiftright("pair", SHIFT))
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    found = counts.join(F.broadcast(most), "a_id")
    return found.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b_id"), "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def common_from(counts: DataFrame, most: int = COMMON_PAIRS) -> tuple[int, bool]:
    """The least count from which pairs are common, so that at most ``most`` are, and whether there are others. Counts are looked at by
    quarters of powers of two, a table of a few hundred rows."""
    level = F.floor(F.log2("n_docs") * 4)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("n_docs").alias("least")).collect(), key=lambda r: -r.level)
    held, least = 0, 1 << 62
    for r in levels:
        held += r.n
        if held > most:
            return least, True
        least = r.least
    return least, False


def digest(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", common: int = COMMON_PAIRS) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    A link is an occurrence of a token of either side in one group; a pair's count is the number of rows that hold it linked, repeated
    rows each; ``n_best`` are the links whose count is the highest of their first id, ties included; ``count_sum`` adds the counts of all
    links. Texts without tokens have zeros and ''. Null and repeated keys stay, a row for each row; other columns are left out; a key
    named like a result is an error. What is linked is written below ``spark.checkpoint.dir`` and read by the result, so that folder's
    owner clears it.
    """
    if key in RESULTS:
        raise ValueError(f"the key column {key} is named like a result")
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    linked(docs, a_path, b_path, key, text).write.option("compression", "zstd").parquet(place)
    written = spark.read.parquet(place)
    counts = pair_counts(written)
    least, others = common_from(counts, common)
    known = counts.select("pair", "n_docs", "best")
    each = written.select("_id", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("links"))))
    near = each.join(F.broadcast(known.where(F.col("n_docs") >= least)), "pair", "left")  # at most ``common`` rows
    if others:
        far = near.where("n_docs IS NULL").drop("n_docs", "best").join(known.where(F.col("n_docs") < least), "pair")
        near = near.where("n_docs IS NOT NULL").unionByName(far)
    totals = near.groupBy("_id").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("n_docs") * F.col("links")).alias("count_sum"))
    own = written.where("part = 0").drop("part", "pairs", "links")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(totals, "_id", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")


def public_pair() -> tuple[str, str]:
    """Places of the byte-level vocabulary and of the model with pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Operator 13 over the whole ``documents`` table."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_pair())


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
