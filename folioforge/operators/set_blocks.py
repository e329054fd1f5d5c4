"""All pairs of alike sets, block by block: exact, with memory bounded by two blocks of sets in a task, and no table of candidates.

Sets are ordered by size and put into blocks of ``BLOCK`` rows. Two blocks whose sizes can have the Dice meet in a task as they are,
read from the checkpoint where they lie, without a shuffle. Within a pair of blocks the elements that many sets hold are counted for all
pairs by a product of matrices; what the others could add at most tells which pairs are counted in full. So the work is that of all
pairs of similar size (50 ns a pair, measured), and grows with the square of the sources.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioforge.plans.lineage import cut_lineage, shared_folder

#: Sets of a block, and their elements at most; elements that are counted by a product of matrices; pairs that are counted in full at once.
BLOCK, ELEMENTS, DENSE, CHUNK = 2048, 1 << 21, 640, 1 << 15

#: Bits of a block's other elements up to which each set has a bit for each of them; beyond, they are looked up.
BITS = 1 << 25

#: Sources of a part, one side of a task, and the fewest and the most parts.
PART, LEAST_PARTS, MOST_PARTS = 16_384, 8, 64


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as zstd Parquet in the shared folder, far smaller than a checkpoint of the same arrays."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.parquet(place)


class Block:
    """Sets in a block: its elements (sorted codes), for each set the elements' places among them, and how many sets have each."""

    def __init__(self, data: bytes, sizes: bytes, codes: bytes):
        self.n, self.codes = np.frombuffer(sizes, np.int32), np.frombuffer(codes, np.int64)
        kind = np.uint16 if len(self.codes) < 1 << 16 else np.uint32
        self.at = np.frombuffer(data, kind).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.df = np.bincount(self.at, minlength=len(self.codes))

    @staticmethod
    def packed(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
        codes, at = np.unique(np.concatenate(sets), return_inverse=True)
        return at.astype(np.uint16 if len(codes) < 1 << 16 else np.uint32).tobytes(), np.array([len(s) for s in sets], np.int32).tobytes(), codes.astype(np.int64).tobytes()

    def placed(self, places: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns, from 0, of the elements whose place is from ``lo`` to below ``hi``."""
        column = places[self.at]
        kept = (column >= lo) & (column < hi)
        return self.row[kept], column[kept] - lo


class Others:
    """The elements outside the product of a pair of blocks: by bits where few are in both, else by lookup in a sorted list."""

    def __init__(self, a: tuple, b: tuple, rows: tuple[int, int], width: int):
        self.width, self.own, self.ends = width, a, np.searchsorted(a[0], np.arange(rows[0] + 1))
        self.bits = [self.packed(*x, n) for x, n in zip((a, b), rows)] if width * max(rows) <= BITS else None
        self.there = None if self.bits else np.sort(b[0] * width + b[1])

    def packed(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        flat = np.zeros((n, -(-self.width // 64) * 64), bool)
        flat[row, column] = True
        return np.packbits(flat, axis=1).view(np.uint64)

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.bits:
            return np.bitwise_count(self.bits[0][x] & self.bits[1][y]).sum(1, dtype=np.int64)
        size = self.ends[x + 1] - self.ends[x]
        pair = np.repeat(np.arange(len(x)), size)
        column = self.own[1][np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + self.ends[x][pair]]
        asked = y[pair] * self.width + column
        found = np.searchsorted(self.there, asked)
        hit = self.there[np.minimum(found, len(self.there) - 1)] == asked if len(self.there) else np.zeros(len(pair), bool)
        return np.bincount(pair[hit], minlength=len(x))


def alike(a: Block, b: Block, least: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``a``, rows of ``b`` and the Dice of all pairs that have at least ``least``; of one block (``same``) each pair once."""
    both, in_a, in_b = np.intersect1d(a.codes, b.codes, assume_unique=True, return_indices=True)
    if not len(both):
        return
    common = np.argsort(-(a.df[in_a].astype(np.float64) * b.df[in_b]), kind="stable")
    dense = min(DENSE, len(common))
    wide, others, rest = [], [], []
    for x, mine in ((a, in_a), (b, in_b)):
        places = np.full(len(x.codes), -1)
        places[mine[common]] = np.arange(len(common))
        m = np.zeros((len(x.n), dense + 2), np.float32)
        m[x.placed(places, 0, dense)] = 1
        wide.append(m)
        others.append(x.placed(places, dense, len(common)))
        rest.append(np.bincount(others[-1][0], minlength=len(x.n)).astype(np.float32))
    # what a pair must share at least, as two more columns of the product: shared - least / 2 * (size + size)
    wide[0][:, dense], wide[0][:, dense + 1] = -least / 2 * a.n, 1
    wide[1][:, dense], wide[1][:, dense + 1] = 1, -least / 2 * b.n
    over = wide[0] @ wide[1].T
    i, j = np.nonzero(over + np.minimum(rest[0][:, None], rest[1][None]) >= -0.01 - 1e-6 * float(a.n.max() + b.n.max()))
    if same:
        i, j = i[i < j], j[i < j]
    outside = Others(*others, (len(a.n), len(b.n)), len(common) - dense)
    for k in range(0, len(i), CHUNK):
        x, y = i[k : k + CHUNK], j[k : k + CHUNK]
        n = (a.n[x] + b.n[y]).astype(np.float64)
        shared = np.rint(over[x, y] + least / 2 * n) + outside.shared(x, y)
        dice = 2.0 * shared / n
        kept = dice >= least
        if kept.any():
            yield x[kept], y[kept], dice[kept]


def united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known node) once ``u`` and ``v`` are linked."""
    while len(u):
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


def element_codes(words: list[str]) -> np.ndarray:
    """A number for each word: up to two characters as they are, longer ones (negative) by a hash of 63 bits."""
    short = lambda w: sum((ord(c) + 1) << (21 * i) for i, c in enumerate(w))
    return np.array([short(w) if len(w) <= 2 else -1 - (int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) >> 1) for w in words], np.int64)


def blocks(sets: DataFrame, key: str, elements: str, least_parts: int = LEAST_PARTS) -> DataFrame:
    """``(block, lo, hi, keys, sizes, codes, data)`` of ``sets`` (key, array of distinct strings), by size; none for null keys or empty sets."""
    some = sets.where(F.col(key).isNotNull() & (F.size(elements) > 0)).select(key, F.col(elements).alias("_elements"), F.size(elements).alias("_size"))
    parts = min(MOST_PARTS, max(least_parts, -(-some.count() // PART)))
    dealt = some.repartitionByRange(parts, "_size", key).sortWithinPartitions("_size", key).withColumn("_part", F.spark_partition_id().cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr, part, keys, sets_, held = 0, 0, [], [], 0

        def out():
            nonlocal nr
            data, sizes, codes = Block.packed(sets_)
            n = [len(x) for x in sets_]
            nr += 1
            made = pa.chunked_array(keys).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + nr]), pa.array([min(n)]), pa.array([max(n)]), pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made), *[pa.array([x], pa.binary()) for x in (sizes, codes, data)]], names=["block", "lo", "hi", "keys", "sizes", "codes", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            lists = batch.column("_elements")
            word = lists.flatten().dictionary_encode()
            code = element_codes(word.dictionary.to_pylist())[word.indices.to_numpy()]
            ends = np.cumsum(batch.column("_size").to_numpy())
            for i, s in enumerate(np.split(code, ends[:-1])):
                if sets_ and (len(sets_) >= BLOCK or held + len(s) > ELEMENTS):
                    yield out()
                    keys, sets_, held = [], [], 0
                keys.append(batch.column(key).slice(i, 1))
                sets_.append(s)
                held += len(s)
        if sets_:
            yield out()

    kind = some.schema[key].dataType.simpleString()
    return cut_lineage(dealt.mapInArrow(run, f"block bigint, lo bigint, hi bigint, keys array<{kind}>, sizes binary, codes binary, data binary"))


def _pairs(made: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """Every two blocks, and each with itself, whose sizes can have this Dice, or every block with those of ``others``: a Cartesian
    product of partitions, each read where it lies."""
    a, b = (x.select(*[F.col(c).alias(f"{c}_{n}") for c in x.columns]) for n, x in (("a", made), ("b", made if others is None else others)))
    near = F.greatest("lo_a", "lo_b") * least <= F.least("hi_a", "hi_b") * (2 - least) + 1e-6
    return a.join(b.hint("shuffle_replicate_nl"), near if others is not None else (F.col("block_a") <= F.col("block_b")) & near)


def _blocks_of(row: dict, names: str = "ab") -> list[Block]:
    return [Block(row[f"data_{n}"], row[f"sizes_{n}"], row[f"codes_{n}"]) for n in names]


def alike_pairs(sets: DataFrame, key: str, elements: str, least: float) -> DataFrame:
    """``(a, b, dice)``, a < b: all pairs of sets with at least this Dice."""
    made = blocks(sets, key, elements)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names if not c.startswith("keys")}
                keys = [batch.column(f"keys_{n}")[r].values for n in "ab"]
                for x, y, dice in alike(*_blocks_of(row), least, row["block_a"] == row["block_b"]):
                    yield pa.RecordBatch.from_arrays([keys[0].take(pa.array(x)), keys[1].take(pa.array(y)), pa.array(dice)], names=["x", "y", "dice"])

    kind = sets.schema[key].dataType.simpleString()
    return _pairs(made, least).mapInArrow(run, f"x {kind}, y {kind}, dice double").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dice")


def alike_links(sets: DataFrame, key: str, elements: str, least: float, every: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: links that have the components of all pairs of sets with at least this Dice, or of ``sets`` with those of ``every``; of
    a task's pairs those of a forest only."""
    made, others = blocks(sets, key, elements, 1 if every is not None else LEAST_PARTS), blocks(every, key, elements) if every is not None else None
    two = every is not None
    side = {n: i if two else 0 for i, n in enumerate("ab")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, keys, label = {}, [], np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names if not c.startswith("keys")}
                for n in "ab":
                    if (side[n], row[f"block_{n}"]) not in first:
                        first[side[n], row[f"block_{n}"]] = len(label)
                        keys.append(batch.column(f"keys_{n}")[r].values)
                        label = np.concatenate([label, np.arange(len(label), len(label) + len(keys[-1]))])
                at = [first[side[n], row[f"block_{n}"]] for n in "ab"]
                for x, y, _ in alike(*_blocks_of(row), least, not two and row["block_a"] == row["block_b"]):
                    label = united(label, at[0] + x, at[1] + y)
        if keys:
            every, linked = pa.chunked_array(keys).combine_chunks(), np.flatnonzero(label != np.arange(len(label)))
            for k in range(0, len(linked), 1 << 16):
                u = linked[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([every.take(pa.array(label[u])), every.take(pa.array(u))], names=["a", "b"])

    kind = sets.schema[key].dataType.simpleString()
    return _pairs(made, least, others).mapInArrow(run, f"a {kind}, b {kind}")
