"""Operator 4: SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most 4 differing bits agree in at least 4 of their 8 bytes. A posting list of the index is
the fingerprints that hold the same bytes at the same three positions; 20 triples of positions are enough for any two
fingerprints with four shared bytes to meet. For each pair that meets, the shared positional bytes are tallied, pairs
that reach the guaranteed minimum are retained, and those are verified by their differing bits. (Lists of single bytes
would hold 1/256 of the corpus each, so the pairs to tally would grow with its square.)
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioforge.llm.batches import as_bytes, slices
from folioforge.operators.components import connected_components
from folioforge.plans.lineage import cut_lineage

#: Differing bits up to which fingerprints link, and words of a shingle.
MAX_BITS, SHINGLE_WORDS = 4, 4

#: Bytes of a posting list's key. Lists of fingerprints at random hold their number / 2^24; with four bytes there are 70 lists
#: for each fingerprint instead of 20, each 256 times shorter, which is better from some 10^9 fingerprints on.
KEY_BYTES = 3

#: Entries of a posting list that one task compares at once; of a longer list every two blocks make a task of their own.
BLOCK = 16_384


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = 42) -> list[int]:
    """XXH64 of every word shingle of a UTF-8 text, A-Z lower-cased; a shorter text is one shingle, a blank one none."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: A-Z, and white space x20 x09-x0D
    if len(parts) <= words:
        return [xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    line, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends - [len(p) for p in parts]
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())]


def simhash(hashes: list[int]) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half the hashes; signed, as Spark's bigint."""
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65536):  # bounded memory for long texts
        bits = np.unpackbits(raw[i : i + 65536], axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp bigint)`` of every whole text; a null, empty or blank text has fingerprint 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text):
            fps = [simhash(shingle_hashes(t)) for t in as_bytes(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fps, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def posting_places(shared: int, width: int = KEY_BYTES, n: int = 8) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` of the ``n`` positions hold one of them. For threes among any four it
    is Turan's: positions in three groups, all threes of one group, and those with two of one group and one of the next. Others are
    chosen greedily."""
    width = min(width, shared)
    if (shared, width) == (4, 3):
        of = lambda c: sorted(i % 3 for i in c)
        return [c for c in combinations(range(n), 3) if of(c) in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2])]
    left, found = set(combinations(range(n), shared)), []
    while left:
        best = max(combinations(range(n), width), key=lambda c: sum(set(c) <= set(x) for x in left))
        found.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return found


def posting_keys(fp: Column, shared: int = 8 - MAX_BITS, width: int = KEY_BYTES) -> Column:
    """The index entries of a fingerprint: one key for each set of byte positions."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for n, places in enumerate(posting_places(shared, width)):
        key = F.lit(n).cast("bigint")
        for i in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    return F.array(*keys)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their 8 positional bytes two arrays of fingerprints share."""
    x, low = (a ^ b).view(np.uint64), np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count((((x & low) + low) | x) & ~low)  # the high bit of every byte that isn't zero


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs link: those whose tally of shared bytes reaches the minimum are verified by their differing bits."""
    found = shared_bytes(a, b) >= 8 - max_bits
    at = np.nonzero(found)
    a, b = np.broadcast_arrays(a, b)
    found[at] = np.bitwise_count((a[at] ^ b[at]).view(np.uint64)) <= max_bits
    return found


def links_within(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within some fingerprints: a spanning tree of each of their components, found breadth
    first, so a fingerprint that is reached is compared no more and copies don't become pairs."""
    left, src, dst = np.arange(1, len(fps)), [], []
    wave = np.array([0])
    while len(left):
        found = np.zeros(len(left), bool)
        parent = np.zeros(len(left), np.int64)
        step = max(1, (1 << 20) // len(left))
        for i in range(0, len(wave), step):
            rest = np.flatnonzero(~found)
            near = linked(fps[wave[i : i + step], None], fps[left[rest]], max_bits)
            hit = near.any(0)
            found[rest[hit]], parent[rest[hit]] = True, wave[i : i + step][near[:, hit].argmax(0)]
        src.append(parent[found])
        dst.append(left[found])
        wave, left = left[found], left[~found]
        if not len(wave) and len(left):
            wave, left = left[:1], left[1:]
    return np.concatenate([*src, np.zeros(0, np.int64)]), np.concatenate([*dst, np.zeros(0, np.int64)])


def posting_lists(batches, key: str, value: str, block: int = BLOCK):
    """Posting lists from rows sorted by ``key``. Lists of two to ``block`` entries come together, as (values, starts, sizes), once for
    each Arrow batch; a longer one comes in blocks as it is read, as (key, number, values), so no list is held whole."""
    pieces: list[np.ndarray] = []
    open_key, held, number = None, 0, 0

    def cut(end: bool):
        nonlocal pieces, held, number
        if held > block or (end and number):
            values = np.concatenate(pieces)
            full = len(values) if end else (held - 1) // block * block  # something stays, so that the end is seen
            for i in range(0, full, block):
                yield open_key, number, values[i : min(i + block, full)]
                number += 1
            pieces, held = [values[full:]], len(values) - full

    def close():
        nonlocal pieces, held, number
        yield from cut(True)
        if held > 1:
            yield np.concatenate(pieces), np.array([0]), np.array([held])
        pieces, held, number = [], 0, 0

    for batch in batches:
        keys, values = batch.column(key).to_numpy(), batch.column(value).to_numpy()
        if not len(keys):
            continue
        starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        if open_key is not None and keys[0] != open_key:
            yield from close()
        for n, i in enumerate((0, starts[-1]) if len(starts) > 1 else (0,)):  # the first and the last list may run on
            end = len(keys) if i == starts[-1] else starts[1]
            if n:
                yield from close()
                sizes = np.diff(starts)[1:]
                small = (sizes > 1) & (sizes <= block)
                if small.any():
                    yield values, starts[1:-1][small], sizes[small]
                for a, size in zip(starts[1:-1][sizes > block].tolist(), sizes[sizes > block].tolist()):
                    yield from ((int(keys[a]), j, values[a + j * block : a + min(size, (j + 1) * block)]) for j in range(-(-size // block)))
            open_key = int(keys[i])
            pieces.append(values[i:end])
            held += end - i
            yield from cut(False)
    if open_key is not None:
        yield from close()


def fingerprint_links(fps: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, key_bytes: int = KEY_BYTES, block: int = BLOCK) -> DataFrame:
    """``(src, dst)`` links between distinct fingerprints: what is reachable by links of at most ``max_bits`` differing bits
    is reachable by these. Null fingerprints take no part.

    A task holds one block of a posting list, or two of a list that has more than one; every two blocks of such a list meet in a
    task of their own, so its size doesn't bound what a task holds.
    """
    # a fixed number of partitions: distinct fingerprints are small, their index entries are not
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = fps.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct().repartition(parts, "fp")
    index = index.select(F.explode(posting_keys(F.col("fp"), 8 - max_bits, key_bytes)).alias("key"), "fp")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("key", pa.int64()), ("block", pa.int32())])

    def run(batches):
        for found in posting_lists(batches, "key", "fp", block):
            if isinstance(found[0], int):  # a block of a long list, for later
                n = len(found[2])
                yield pa.RecordBatch.from_arrays([pa.array(found[2]), pa.nulls(n, pa.int64()), pa.array(np.full(n, found[0])), pa.array(np.full(n, found[1], np.int32))], schema=schema)
                continue
            values, starts, sizes = found
            a = values[starts[sizes == 2]]
            b = values[starts[sizes == 2] + 1]
            near = linked(a, b, max_bits)
            src, dst = [a[near]], [b[near]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = values[start : start + size]
                i, j = links_within(own, max_bits)
                src.append(own[i])
                dst.append(own[j])
            src, dst = np.concatenate(src), np.concatenate(dst)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.nulls(len(src), pa.int64()), pa.nulls(len(src), pa.int32())], schema=schema)

    found = cut_lineage(index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "src bigint, dst bigint, key bigint, block int"))
    links = found.where("dst IS NOT NULL").select("src", "dst")
    long = found.where("dst IS NULL").select("key", "block", F.col("src").alias("fp"))
    if not long.isEmpty():
        links = links.union(block_pairs(long, "key", "block").groupBy("key", "i", "j").applyInArrow(_links_of_blocks(max_bits), "src bigint, dst bigint"))
    return links.distinct()


def block_pairs(rows: DataFrame, key: str, block: str) -> DataFrame:
    """``rows`` once for each two blocks of their list, numbered i < j, that their own belongs to."""
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.max(block).alias("_last"))
    others = F.filter(F.sequence(F.lit(0), "_last"), lambda x: x != F.col(block))
    each = rows.join(n, F.col(key) == F.col("_key")).withColumn("_other", F.explode(others))
    return each.withColumns({"i": F.least(block, "_other"), "j": F.greatest(block, "_other")}).drop("_key", "_last", "_other")


def _links_of_blocks(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy()
        i, j = links_within(fps, max_bits)
        return pa.table([pa.array(fps[i]), pa.array(fps[j])], names=["src", "dst"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(key, fp, component_id)`` of every row: the smallest key that is reachable over links, the row's own included.

    Exact copies and blank texts share a fingerprint, and one fingerprint enters the index once, so groups of copies cost
    one entry. A null key stays in the result and never names a component unless no other key is reachable. Repeated rows
    stay; an empty table gives an empty result; other columns are left out.
    """
    fps = cut_lineage(fingerprints(docs, key, text))
    least = fps.groupBy("fp").agg(F.min(key).alias("own"))
    linked = connected_components(fingerprint_links(least, "fp", max_bits)).withColumnRenamed("node", "fp")
    known = least.join(linked, "fp", "left").select("fp", "own", F.coalesce("component", "fp").alias("root"))
    known = cut_lineage(known)
    of_root = known.groupBy("root").agg(F.min("own").alias("component_id"))
    of_fp = known.join(of_root, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(key, "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over the whole ``documents`` table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
