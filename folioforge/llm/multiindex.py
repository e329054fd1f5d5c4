"""Operator 7: approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, so that ``k`` centroids a half make ``k * k`` cells. A query goes through
pairs of centroids by summed distance with a heap, until the cells it has seen hold enough entries; those entries are
reranked by the exact distance.

The inverted lists are dealt by their first centroid: entries lie by (first centroid, part), where a large list has several
parts, and travel once; a query goes to the parts of the first centroids that it visits, with a bit for each second centroid.
Within a task a part's entries come first and its queries stream past them, so a task holds one part and a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.plans.lineage import cut_lineage

#: Centroids of each half; vectors that the centroids are learnt from, at most.
CENTROIDS, SAMPLE_ROWS = 32, 20_000

#: A query sees cells until they hold this share of all entries, and this many at least. On vectors without clusters the ten
#: nearest of 50,000 are spread over a third to half of all cells; see README for recall by share.
SHARE, LEAST = 0.6, 2_000

#: Entries of a part, about; queries worked on at once; lengths of vectors from which on each one's result is kept by a checkpoint.
ENTRY_BLOCK, QUERY_BLOCK, LENGTHS = 32_768, 4_096, 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, (len(a), len(b))."""
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids from distinct starting rows; fewer than ``k`` if there are fewer different rows."""
    if not x.shape[1]:  # half of a vector of one component
        return np.zeros((1, 0))
    x_unique = np.unique(x, axis=0)
    c = x_unique[np.random.default_rng(seed).permutation(len(x_unique))[:k]].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class MultiIndex:
    """Centroids of both halves, and how many entries each cell holds."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray | None = None

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        a, b = squared(x[:, : self.cut], self.first), squared(x[:, self.cut :], self.second)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visit(self, q: np.ndarray, enough: int) -> list[int]:
        """Cells in order of summed distance until they hold ``enough`` entries: a heap over the two sorted lists of centroids,
        where a pair enters once both pairs before it have left."""
        a = squared(q[None, : self.cut], self.first)[0]
        b = squared(q[None, self.cut :], self.second)[0]
        u, v = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[u].tolist(), b[v].tolist()
        heap, left, seen, held = [(a[0] + b[0], 0, 0)], set(), [], 0
        while heap and held < enough:
            _, i, j = heappop(heap)
            left.add((i, j))
            cell = int(u[i]) * len(self.second) + int(v[j])
            seen.append(cell)
            held += int(self.sizes[cell])
            if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in left):
                heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in left):
                heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return seen


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, v array<double>)`` of the rows that take part. Left out: null keys and vectors, zero vectors, and vectors with a
    component that is null or not finite."""
    v = F.col("v")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & v.isNotNull() & good)


def fit(rows: DataFrame, dim: int, centroids: int = CENTROIDS, sample: int = SAMPLE_ROWS) -> MultiIndex:
    """An index for ``rows`` (of :func:`usable`): centroids from at most ``sample`` rows by a hash of the key, sizes from all."""
    x = _vectors(rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()["v"], dim) if dim else np.zeros((0, 0))
    index = MultiIndex(k_means(x[:, : dim // 2], centroids), k_means(x[:, dim // 2 :], centroids))
    index.sizes = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in with_cells(rows, index, dim).groupBy("cell").count().collect():
        index.sizes[r.cell] = r["count"]
    return index


def with_cells(rows: DataFrame, index: MultiIndex, dim: int) -> DataFrame:
    """``rows`` with the ``cell`` of each."""
    cut_at = index.cut, index.first, index.second

    def run(batches):
        own = MultiIndex(*cut_at[1:])
        for batch in batches:
            if batch.num_rows:
                cell = pa.array(own.cells(_vectors(batch.column("v"), dim)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), cell], names=["key", "v", "cell"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, cell int")


def with_visits(queries: DataFrame, index: MultiIndex, enough: int, dim: int) -> DataFrame:
    """``(key, v, first, seen)``: for each first centroid that a query visits a row, with a bit for each second centroid."""

    def run(batches):
        n = len(index.second)
        for batch in batches:
            for i, q in enumerate(_vectors(batch.column("v"), dim)):  # a query's visits are a batch: bounded by the centroids
                bits = np.zeros((len(index.first), n), bool)
                bits.reshape(-1)[index.visit(q, enough)] = True
                first = np.flatnonzero(bits.any(1))
                seen = [np.packbits(x).tobytes() for x in bits[first]]
                at = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("v").take(at), pa.array(first.astype(np.int32)), pa.array(seen, pa.binary())], names=["key", "v", "first", "seen"])

    return queries.mapInArrow(run, f"key {queries.schema['key'].dataType.simpleString()}, v array<double>, first int, seen binary")


def nearest_in_block(x_ids, x, x_cells, q_ids, q, visits, k: int) -> tuple[list, list, list]:
    """The ``k`` nearest entries of each query among the cells it visits (a row of flags each): a product of matrices for each cell
    finds those up to rounding, their exact distances rank them; ties go to the smaller id."""
    order = np.argsort(x_cells, kind="stable")
    x_ids, x, x_cells = x_ids[order], x[order], x_cells[order]
    starts = np.flatnonzero(np.diff(x_cells, prepend=-1))
    ends = np.append(starts[1:], len(x))
    x2, out = (x**2).sum(1), ([], [], [])
    rounding = 4e-16 * (x.shape[1] + 8)  # of a squared distance, by the size of what it is the difference of
    for i in range(0, len(q), 64):
        part, bits = q[i : i + 64], visits[i : i + 64]
        q2 = (part**2).sum(1)
        far = np.full((len(part), len(x)), np.inf)
        for a, b in zip(starts, ends):
            who = np.flatnonzero(bits[:, x_cells[a]])
            if len(who):
                far[who, a:b] = q2[who, None] + x2[a:b] - 2 * part[who] @ x[a:b].T
        far[x_ids[None] == q_ids[i : i + 64, None]] = np.inf
        for j, row in enumerate(far):
            edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            near = np.flatnonzero(row <= edge + 4 * rounding * (x2.max() + q2[j])) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
            d = np.sqrt(((x[near] - part[j]) ** 2).sum(1))
            best = np.lexsort((x_ids[near], d))[:k]
            out[0].extend([q_ids[i + j]] * len(best))
            out[1].extend(x_ids[near[best]].tolist())
            out[2].extend(d[best].tolist())
    return out


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
    centroids: int = CENTROIDS, sample: int = SAMPLE_ROWS, share: float = SHARE, least: int = LEAST, entry_block: int = ENTRY_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found, nearest first.

    Keys are integers; rows with the query's own key are no candidates. Rows that :func:`usable` leaves out take no part on either
    side; repeated rows are candidates each. Between vectors of different lengths there is no distance: each length is a search of
    its own, with an index of its own, one after another. An empty side gives an empty result; extra columns are left out.
    """
    rows, wanted = usable(vectors, key, vector), usable(queries, key, vector)
    dims = sorted(r.n for r in wanted.select(F.size("v").alias("n")).distinct().collect())
    kept = cut_lineage if len(dims) > LENGTHS else lambda df: df
    found = [kept(_search(rows.where(F.size("v") == n), wanted.where(F.size("v") == n), n, k, centroids, sample, share, least, entry_block, query_block)) for n in dims]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = reduce(DataFrame.union, found)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, wanted: DataFrame, dim: int, k: int, centroids: int, sample: int, share: float, least: int, entry_block: int, query_block: int) -> DataFrame:
    schema = "query_id bigint, vec_id bigint, score double"
    index = fit(rows, dim, centroids, sample)
    if not index.sizes.sum():
        return rows.sparkSession.createDataFrame([], schema)
    n_second = len(index.second)
    lists = index.sizes.reshape(-1, n_second).sum(1)  # entries by first centroid
    parts = [max(1, -(-int(n) // entry_block)) for n in lists]
    of_first = lambda c: F.get(F.array(*map(F.lit, parts)), c)
    entries = with_cells(rows, index, dim).withColumn("first", F.floor(F.col("cell") / n_second).cast("int"))
    entries = entries.select("first", F.pmod(F.xxhash64("key"), of_first("first")).cast("int").alias("part"), F.lit(0).alias("asks"), "key", "v", (F.col("cell") % n_second).alias("second"), F.lit(None).cast("binary").alias("seen"))
    visits = with_visits(wanted.repartition("key"), index, max(least, int(share * index.sizes.sum())), dim)
    visits = visits.select("first", F.explode(F.sequence(F.lit(0), of_first("first") - 1)).alias("part"), F.lit(1).alias("asks"), "key", "v", F.lit(None).cast("int").alias("second"), "seen")
    both = entries.unionByName(visits).repartition("first", "part").sortWithinPartitions("first", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, part = None, [], None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("first", "part", "asks")])
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                rows, (first, nth, asks) = batch.slice(a, b - a), group[:, a].tolist()
                if (first, nth) != here:
                    here, held, part = (first, nth), [], None
                if not asks:
                    held.append((rows.column("key").to_numpy(), _vectors(rows.column("v"), dim), rows.column("second").to_numpy()))
                    continue
                if not held:  # the part is empty
                    continue
                part = part or tuple(np.concatenate(x) for x in zip(*held))
                for i in range(0, rows.num_rows, query_block):
                    q = rows.slice(i, query_block)
                    bits = np.unpackbits(np.array([np.frombuffer(x, np.uint8) for x in q.column("seen").to_pylist()]), axis=1).astype(bool)
                    found = nearest_in_block(*part, q.column("key").to_numpy(), _vectors(q.column("v"), dim), bits, k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(run, schema)


def op7_multi_index(spark, sf_dir: str) -> DataFrame:
    """Operator 7: every hundredth vector of ``embeddings`` against all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op7_multi_index": op7_multi_index}
ORACLES: dict[str, str] = {}
