"""Operator 6: fuzzy line deduplication by MinHash.

Each distinct line gets a signature over its character shingles; bands of the signature propose groups of lines, exact
Jaccard similarity verifies links within a group, and connected components over the links keep one occurrence of each
component: the one in the smallest document, then the first line.

Between steps only hashes travel: (band, line) pairs, then the few groups that hold two or more different lines. The text
of a line is read again only if a fixed-size bit filter says that the line may be in a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.functions.text import pinned
from folioforge.llm.batches import as_strings, slices
from folioforge.llm.simhash import block_pairs
from folioforge.operators.components import connected_components
from folioforge.plans.lineage import cut_lineage

#: Characters of a shingle; Jaccard similarity from which lines link.
SHINGLE_CHARS, SIMILARITY = 8, 0.8

#: Signature: a pair at the threshold meets in a band with probability 1 - (1 - 0.8^4)^9 = 0.991, one at 0.9 with 0.99993.
BANDS, BAND_ROWS = 9, 4

#: Bits of the filter for each line in a group, and of the whole filter at most (32 MB). A fuller one lets more lines pass, which the
#: later join drops.
NODE_BITS, FILTER_BITS = 16, 1 << 28

#: Lines, and characters, of a group that one task compares at once; of a larger group every two blocks make a task of their own.
BLOCK_LINES, BLOCK_CHARS = 2_048, 1 << 20

#: Characters of a line that are hashed at once.
PIECE = 1 << 16

#: Line hashes that a task remembers, so that a very common line leaves it once.
REMEMBERED = 200_000

BLANKS = " \t\n\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pieces(line: str, chars: int) -> list[str]:
    """A line in parts that together have its shingles, and no others; one shorter than a shingle is filled up with U+0000."""
    line = line.ljust(chars, "\0")
    return [line[i : i + PIECE + chars - 1] for i in range(0, len(line) - chars + 1, PIECE)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rolled(h: np.ndarray, factor: int, chars: int) -> np.ndarray:
    """Polynomial hashes of all spans of ``chars`` values (a power of two), modulo the type's size."""
    bits, span = h.dtype.itemsize * 8, 1
    for _ in range(chars.bit_length() - 1):
        h = h[: len(h) - span] * h.dtype.type(pow(factor, span, 1 << bits)) + h[span:]
        span *= 2
    return h


def _minima(pieces: list[str], chars: int, n: int) -> np.ndarray:
    """For each piece the least of ``n`` hash functions over its shingles."""
    size = np.array([len(x) for x in pieces], np.int64)
    count = size - chars + 1
    first = np.cumsum(count) - count
    h = _rolled(_codes("".join(pieces)) * np.uint32(0x9E3779B1), 0x01000193, chars)
    h = h[np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - first, count)]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    rng = np.random.default_rng(1)
    factor = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    out = np.empty((n, len(pieces)), np.uint32)
    for j in range(n):
        v = h * factor[j] + shift[j]
        out[j] = np.minimum.reduceat(v ^ (v >> np.uint32(16)), first)
    return out


def band_keys(lines: list[str], chars: int = SHINGLE_CHARS, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """An array (line, band) of 64-bit keys. Long lines are hashed piece by piece."""
    parts = [_pieces(x, chars) for x in lines]
    pieces, found, at = [p for ps in parts for p in ps], [], 0
    size = np.cumsum([len(p) for p in pieces])
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 16 * PIECE, "right")))
        found.append(_minima(pieces[at:to], chars, bands * rows))
        at = to
    least = np.minimum.reduceat(np.concatenate(found, 1), np.cumsum([0] + [len(ps) for ps in parts[:-1]]), axis=1)
    keys = np.empty((len(lines), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(lines), b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            key = _mix(key ^ least[j])
        keys[:, b] = key
    return keys


def shingles(line: str, chars: int = SHINGLE_CHARS) -> np.ndarray:
    """The set of a line's character shingles, as sorted 64-bit hashes."""
    one = lambda x: np.unique(_mix(_rolled(_codes(x).astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, chars)))
    found = [one(x) for x in _pieces(line, chars)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _hashed_lines(batches, text: str):
    """For each slice the lines with a word that this task hasn't met lately, and their hashes as signed integers."""
    from xxhash import xxh64_intdigest

    seen: set[int] = set()
    for batch in slices(batches, text):
        found: dict[int, str] = {}
        for t in as_strings(batch, text):
            for line in t.split("\n"):
                if line.strip(BLANKS):
                    h = xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if h not in seen:
                        found[h] = line
        seen = set() if len(seen) + len(found) > REMEMBERED else seen
        seen.update(found)
        if found:
            yield np.array(list(found), np.uint64).view(np.int64), list(found.values())


def candidate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(grp, node)``: the different lines, by hash, that meet in a band. A group is named by its smallest line, so what meets the
    same line in several bands is compared with it once."""

    def to_bands(batches):
        for nodes, lines in _hashed_lines(batches, text):
            keys = band_keys(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(nodes, keys.shape[1]))], names=["key", "node"]
            )

    def to_groups(batches):
        open_key, first, last = None, 0, 0  # of the list that runs on into the next batch: its smallest line, and the latest
        for batch in batches:
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(keys):
                continue
            opens, new = np.ones(len(keys), bool), np.ones(len(keys), bool)
            opens[1:] = keys[1:] != keys[:-1]
            new[1:] = nodes[1:] != nodes[:-1]
            opens[0], new[0] = keys[0] != open_key, nodes[0] != last
            at = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), -1))
            of = np.where(at < 0, first, nodes[at])
            hit = new & ~opens  # lists are sorted: another line than the one before, in a list that has one
            open_key, first, last = keys[-1], of[-1], nodes[-1]
            if hit.any():
                head = np.unique(of[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(of[hit], head)), pa.array(np.append(nodes[hit], head))], names=["grp", "node"])

    pairs = docs.select(text).mapInArrow(to_bands, "key bigint, node bigint")
    pairs = pairs.repartition("key").sortWithinPartitions("key", "node")
    return pairs.mapInArrow(to_groups, "grp bigint, node bigint").distinct()


def bit_filter(nodes: DataFrame) -> np.ndarray:
    """A bit set, sized by the number of ``nodes`` up to FILTER_BITS, with the bit of every node; it reaches the driver packed."""
    n = nodes.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (NODE_BITS * n).bit_length()))
    chunk = min(bits, 1 << 19)
    at = F.pmod("node", F.lit(bits))

    def pack(table: pa.Table) -> pa.Table:
        found = np.zeros(chunk, np.uint8)
        found[table["at"].to_numpy()] = 1
        return pa.table([table["chunk"][:1], pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    rows = nodes.select(F.floor(at / chunk).cast("int").alias("chunk"), F.pmod(at, F.lit(chunk)).alias("at")).distinct()
    found = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").toArrow().to_pylist():
        found[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return found.view("<u8")


def lines_of(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """``(node, line)`` of every line hash in ``nodes``."""
    nodes = nodes.select("node").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes))

    def run(batches):
        bits = sent.value
        for hashes, lines in _hashed_lines(batches, text):
            at = hashes % (len(bits) * 64)
            hit = np.flatnonzero(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[hit]), pa.array([lines[i] for i in hit.tolist()], pa.string())], names=["node", "line"]
                )

    found = docs.select(text).mapInArrow(run, "node bigint, line string").join(nodes, "node", "left_semi")
    return found.groupBy("node").agg(F.min("line").alias("line"))


def tree_links(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that span every component of some lines: what is reached already is compared no more. Similarity is the exact
    Jaccard similarity of the shingle sets."""
    if len(sets) == 2:
        a, b = sets
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            return []
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if shared >= least * (len(a) + len(b) - shared) else []
    size, found = np.array([len(x) for x in sets]), []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(ids.max()) + 1, bool)
    left = np.arange(len(sets))  # unreached lines, and their shingles one after another
    own, starts = ids, ends - size
    while len(left) > 1:
        wave = [int(left[0])]
        gone = np.zeros(len(left), bool)
        gone[0] = True
        while wave and not gone.all():
            a = wave.pop()
            mark[ids[ends[a] - size[a] : ends[a]]] = True
            shared = np.add.reduceat(mark[own], starts, dtype=np.int64)
            mark[ids[ends[a] - size[a] : ends[a]]] = False
            near = ~gone & (shared >= least * (size[a] + size[left] - shared))
            found += [(a, int(b)) for b in left[near]]
            wave += left[near].tolist()
            gone |= near
        rest = np.repeat(~gone, size[left])
        left, own = left[~gone], own[rest]
        starts = np.cumsum(size[left]) - size[left]
    return found


def _links(nodes: list[int], lines: list[str], least: float) -> list[tuple[int, int]]:
    return [(nodes[a], nodes[b]) for a, b in tree_links([shingles(x) for x in lines], least)]


def line_links(docs: DataFrame, text: str = "text", least: float = SIMILARITY, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(src, dst)``: hashes of different lines whose shingle sets have a Jaccard similarity of at least ``least``.

    A task holds one block of a group, or two of a group that has more than one; every two blocks of such a group meet in a task of
    their own, so the size of a group doesn't bound what a task holds.
    """
    groups = cut_lineage(candidate_groups(docs, text))
    rows = groups.join(lines_of(docs, groups, text), "node")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("grp", pa.int64()), ("block", pa.int32()), ("line", pa.string())])

    def out(pairs, grp=None, block=None, lines=None):
        n = len(pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([grp] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array(lines or [None] * n, pa.string())],
            schema=schema,
        )

    def run(batches):
        grp, block, chars, nodes, lines, found = None, 0, 0, [], [], []
        for batch in batches:
            for g, n, x in zip(*(batch.column(c).to_pylist() for c in ("grp", "node", "line"))):
                full = len(nodes) >= block_lines or (nodes and chars + len(x) > block_chars)
                if g != grp or full:
                    if block or (g == grp and full):  # a block of a large group, for later
                        yield out([(k, None) for k in nodes], grp, block, lines)
                        block = block + 1 if g == grp else 0
                    else:
                        found += _links(nodes, lines, least) if len(nodes) > 1 else []
                    grp, chars, nodes, lines = g, 0, [], []
                nodes.append(n)
                lines.append(x)
                chars += len(x)
            yield out(found)
            found = []
        if block:
            yield out([(k, None) for k in nodes], grp, block, lines)
        elif len(nodes) > 1:
            yield out(_links(nodes, lines, least))

    def run_two(table: pa.Table) -> pa.Table:
        pairs = _links(table["src"].to_pylist(), table["line"].to_pylist(), least)
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    sorted_rows = rows.select("grp", "node", "line").repartition("grp").sortWithinPartitions("grp", "node")
    found = cut_lineage(sorted_rows.mapInArrow(run, "src bigint, dst bigint, grp bigint, block int, line string"))
    links, large = found.where("dst IS NOT NULL").select("src", "dst"), found.where("dst IS NULL")
    if not large.isEmpty():
        pairs = block_pairs(large.drop("dst"), "grp", "block").select("src", "line", "grp", "i", "j")
        links = links.union(pairs.groupBy("grp", "i", "j").applyInArrow(run_two, "src bigint, dst bigint"))
    return links.distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` less the lines that repeat or resemble an earlier one, and the added
    columns ``n_lines`` and ``n_removed`` (any columns of these names are replaced).

    A line without a word is never removed. Every row is a document of its own, told apart by key and text; the key orders
    documents, null first. Rows alike in both share their lines, so the first of them keeps what is theirs and the others only
    lines without a word. A null text stays null with 0 lines; a document whose lines are all elsewhere keeps its row with an
    empty text.
    """
    nodes = connected_components(line_links(docs, text, least))
    # the caller's columns stay in one, so that none of their names can clash
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(key, text).alias("row1"), F.hash(key, text).alias("row2"))
    body = F.col("row").getField(text)
    lines = own.select(F.col("row").getField(key).alias("doc"), "row1", "row2", F.posexplode(F.split(body, "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(HAS_WORD))
    place = ("doc", "row1", "row2", "pos")
    lines = lines.select(*place, F.xxhash64("line").alias("node"), F.hash("line").alias("check"))
    lines = lines.join(nodes, "node", "left").select(
        *place, F.coalesce("component", "node").alias("root"), F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("check")
    )
    kept = lines.groupBy("root", "check").agg(F.min(F.struct(*place)).alias("kept"), F.count("*").alias("n")).where("n > 1")
    removed = lines.join(kept, ["root", "check"]).where("NOT (struct(doc, row1, row2, pos) <=> kept)")
    removed = removed.groupBy("row1", "row2").agg(F.collect_set("pos").alias("removed"))
    nth = F.row_number().over(Window.partitionBy("row1", "row2").orderBy("every"))
    found = own.withColumn("every", F.xxhash64("row.*")).withColumn("nth", nth).join(removed, ["row1", "row2"], "left")
    cut = F.col("removed").isNotNull() | (F.col("nth") > 1)  # other texts stay as they are, and are never split
    found = pinned(found.select("row", "nth", "removed"), lines=F.when(cut, F.split(body, "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")  # by hash, in order: linear
    left = F.when(F.col("nth") > 1, F.filter("lines", lambda x: ~x.rlike(HAS_WORD))).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    found = found.withColumn("left", F.when(F.col("lines").isNotNull(), left))
    new = {
        "n_lines": F.coalesce(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint"),
        "n_removed": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("bigint"),
        text: F.when(F.col("lines").isNull(), body).otherwise(F.array_join("left", "\n")),
    }
    kept_columns = [(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return found.select(*kept_columns, *[v.alias(c) for c, v in new.items() if c not in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over the whole ``documents`` table."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES: dict[str, str] = {}
