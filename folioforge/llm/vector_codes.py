"""Operator 12: codes for vectors by product quantisation, assigned by partial-distance search.

Vectors become integers and are cut into four parts; each part has a codebook of 256 entries that a few rounds of assignment
and averaging improve. Entries are searched dimension by dimension, those where the codebook varies most first; an entry goes
once its accumulated integer distance exceeds the best complete distance known, so most entries see a few dimensions only.

A round is one job: tasks add up their parts by entry, Spark adds up the tasks, and what reaches the driver is a codebook. All
arithmetic is in integers, so results don't depend on how rows are laid out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioforge.plans.lineage import cut_lineage
from folioforge.plans.sizes import broadcast_if_small

#: Integer steps of one; parts of a vector; entries of a codebook; rounds that improve it.
STEPS, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4

#: Vectors searched at once; dimensions between two sievings of a search.
ROWS, STRIDE = 2_048, 4

RESULTS = ("code", "error", "label_error", "codebooks_sha256")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def most_steps(dim: int) -> int:
    """The largest component, in steps, with which a vector's distance still fits 63 bits."""
    return int((2**62 / max(1, dim)) ** 0.5) // 2


def whole_steps(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as integers, rounded down; beyond ``most_steps`` a component stays at that limit."""
    if not dim:
        return np.zeros((len(column), 0), np.int64)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * STEPS)
    return np.clip(x, -most_steps(dim), most_steps(dim)).astype(np.int64)


def cut(dim: int, parts: int = PARTS) -> list[slice]:
    """Equal consecutive parts; if the length can't be cut so, the first ones are longer by one."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [slice(a, b) for a, b in zip(at, at[1:])]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, distance)`` of the entry of ``book`` nearest to each row by squared distance, ties to the lower index.

    Dimensions come in the order of the codebook's variance. After some of them each row's best entry so far is measured whole;
    from then on an entry whose accumulated distance is strictly greater than the best complete one of its row is dropped.
    """
    n, k = len(x), len(book)
    if not n or not book.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    top = int(max(np.abs(x).max(), np.abs(book).max()))
    kind = np.int32 if 4 * top * top * book.shape[1] < 2**31 else np.int64
    x, book = np.ascontiguousarray(x[:, order], kind), np.ascontiguousarray(book[:, order], kind)
    dim = book.shape[1]
    far = np.zeros((n, k), kind)
    for j in range(min(2 * STRIDE, dim)):
        step = x[:, j, None] - book[:, j]
        far += step * step
    guess = far.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1, dtype=kind)
    row, entry = np.nonzero(far <= best[:, None])
    far = far[row, entry]
    for j in range(min(2 * STRIDE, dim), dim):
        step = x[row, j] - book[entry, j]
        far += step * step
        if (j + 1) % STRIDE == 0:
            left = far <= best[row]
            row, entry, far = row[left], entry[left], far[left]
    first = np.flatnonzero(np.diff(row, prepend=-1))  # the guess stays, so every row is there, its entries in order
    best = np.minimum.reduceat(far, first)
    hit = np.flatnonzero(far == best[row])
    index = entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
    return index.astype(np.int64), best.astype(np.int64)


def _rows(rows: DataFrame, dim: int, work, schema: str) -> DataFrame:
    """``work(batch, integers)`` of blocks of rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield from work(part, whole_steps(part.column("v"), dim))

    return rows.mapInArrow(run, schema)


def summed(rows: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``(part, entry, place, total)``: of each entry how many parts it is nearest to (place 0) and their sum by component (from 1 on).
    A task gives one number for each of these, however many rows it has."""
    cuts = cut(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                x = whole_steps(batch.slice(i, ROWS).column("v"), dim)
                for at, book, total in zip(cuts, books, totals):
                    np.add.at(total, nearest(x[:, at], book)[0], np.concatenate([np.ones((len(x), 1), np.int64), x[:, at]], 1))
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            width = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * width, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(total[used].ravel())],
                names=["part", "entry", "place", "total"],
            )

    found = rows.select("v").mapInArrow(run, "part int, entry int, place int, total bigint")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def train(rows: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks for ``rows`` (key, v) of one length: the parts of the first vectors by key (ties by components, null keys last), then
    in each round every entry the average, rounded down, of the parts nearest to it; an entry without parts stays."""
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    x = whole_steps(first, dim)
    books = [x[:, at].copy() for at in cut(dim)]
    for _ in range(rounds if dim else 0):
        found = summed(rows, dim, books).toArrow()  # a number for each component of the codebooks
        part, entry, place, total = (found[c].to_numpy() for c in ("part", "entry", "place", "total"))
        for p, book in enumerate(books):
            table = np.zeros((len(book), book.shape[1] + 1), np.int64)
            table[entry[part == p], place[part == p]] = total[part == p]
            used = table[:, 0] > 0
            book[used] = table[used, 1:] // table[used, :1]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``(key, label, code, error)`` of ``rows`` (key, label, v) of one length."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}

    def work(batch, x):
        found = [nearest(x[:, at], book) for at, book in zip(cut(dim), books)]
        codes = np.stack([i for i, _ in found], 1)
        text = [c.hex() for c in map(bytes, codes.astype(np.uint8))]
        error = np.sum([d for _, d in found], 0)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.astype(np.int64))], names=["key", "label", "code", "error"])

    return _rows(rows, dim, work, f"key {kinds['key']}, label {kinds['label']}, code string, error bigint")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """``(key, code, error, label_error, codebooks_sha256)`` of every row whose vector is there and has finite components only.

    ``code`` has two hex digits for each part; ``error`` is the vector's squared distance from its code, in steps; ``label_error`` adds
    that up over the rows of a label, null being one. Null and repeated keys stay; other columns are left out. Vectors of each length are
    a table of their own, trained one after another. A length that four doesn't divide has longer first parts; a vector without
    components has code 0 and no error. Components beyond 2**62 / length, halved and in steps squared, count as that limit. An empty table
    gives none.
    """
    if entries > 256 or key in RESULTS:
        raise ValueError(f"two hex digits hold 256 entries, not {entries}" if entries > 256 else f"the key column {key} is named like a result")
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    dims = sorted(r.n for r in rows.groupBy(F.size("v").alias("n")).count().select("n").collect())
    done = []
    for dim in dims:
        own = rows.where(F.size("v") == dim)
        books = train(own, dim, rounds, entries)
        done.append(encode(own, dim, books).withColumn("codebooks_sha256", F.lit(books_sha256(books))))
    if not done:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}
        done = [vectors.sparkSession.createDataFrame([], f"key {kinds['key']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string")]
    found = cut_lineage(reduce(DataFrame.union, done))
    totals = broadcast_if_small(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    both = found.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return both.select(F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over the whole ``embeddings`` table."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(before: str, after: str) -> str:
    return f"""
a{after} AS MATERIALIZED (
  SELECT rid, part, min((p.xx - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c))::BIGINT * {ENTRIES} + entry) AS best FROM p JOIN b{before} b USING (part) GROUP BY rid, part
), m{after} AS (
  SELECT part, best % {ENTRIES} AS entry, pos, floor(sum(p.x[pos]) / count(*)) AS c FROM p JOIN a{after} USING (rid, part), LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS pos) GROUP BY ALL
), b{after} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.c, b.c) AS c FROM b{before} b LEFT JOIN (SELECT part, entry, list(c ORDER BY pos) AS c FROM m{after} GROUP BY part, entry) n USING (part, entry)
), """


SQL = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, vec_id, part, x, list_dot_product(x, x) AS xx
  FROM (SELECT rid, vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM e, LATERAL (SELECT unnest(range({PARTS})) AS part))
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES}
), {"".join(_round_sql(str(i), str(i + 1)) for i in range(ROUNDS + 1))}
f AS (
  SELECT e.vec_id, e.label, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error
  FROM a{ROUNDS + 1} JOIN e USING (rid) GROUP BY rid, e.vec_id, e.label
), s AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS pos FROM b{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, s
"""

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": SQL}
