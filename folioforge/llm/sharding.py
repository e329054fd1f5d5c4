"""Operator 11 [native]: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get the numbers 0 to N - 1 in an order that their content alone decides; a keyed Feistel network permutes the numbers,
and walks on where it leaves the range; a permuted number's remainder is the shard, its quotient the slot. So any row's place
follows from its number, and any place's number from the inverse, without a sort of the corpus.

Numbers come from counts: rows go to buckets by a hash, a table of fixed length says how many rows lie in front of each bucket,
and rows are numbered within theirs. Equal rows are counted first and numbered as runs, which are cut and dealt to buckets of
their own, so copies never gather in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions.text import bound
from folioforge.llm.batches import identified, unpacked
from folioforge.plans.lineage import cut_lineage

#: Shards; buckets of the numbering; copies of a row that are numbered as one run, at most.
SHARDS, BUCKETS, RUN = 8, 16_384, 4_096

#: Rounds of the network and the prime in which they reckon; the seed names the permutation.
ROUNDS, PRIME, SEED = 8, 2**31 - 1, "shards"

RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def round_keys(seed: str, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round: what is added, what multiplies, what is added again."""
    digest = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(rounds)]
    return [tuple(int.from_bytes(d[k : k + 8], "big") % (PRIME - 1) + 1 for k in (0, 8, 16)) for d in digest]


def _mixed(half: Column, key: Column) -> Column:
    """A round's function of one half: a cube between two steps of adding and multiplying, in PRIME."""
    t = (half + key["a"]) % PRIME
    return (((t * t) % PRIME * t) % PRIME * key["b"] + key["c"]) % PRIME


def _keys(seed: str, backwards: bool) -> Column:
    rows = [F.struct(F.lit(i % 2 == 0).alias("left"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip("abc", k)]) for i, k in enumerate(round_keys(seed))]
    return F.array(*(rows[::-1] if backwards else rows))


def _network(x: Column, n: Column, seed: str, backwards: bool) -> Column:
    """One pass of the network over pairs (x div right, x mod right) of about equal halves, left * right >= n."""
    left, right = halves(n)

    def step(x: Column, key: Column) -> Column:
        a, b = F.floor(x / right), x % right  # numbers stay far below 2**53
        move = lambda half, other, size: F.pmod(half - _mixed(other, key) if backwards else half + _mixed(other, key), size)
        return F.when(key["left"], move(a, b, left) * right + b).otherwise(a * right + move(b, a, right)).cast("bigint")

    return F.aggregate(_keys(seed, backwards), x.cast("bigint"), step)


def halves(n: Column) -> tuple[Column, Column]:
    """Sizes of both halves: ``right`` is the root of n rounded up, ``left`` as many as n needs then."""
    right = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("bigint")
    return F.greatest(F.ceil(n / right), F.lit(1)).cast("bigint"), right


def permuted(number: Column, n: Column, seed: str = SEED, backwards: bool = False) -> Column:
    """The place of a row number below ``n`` in the seed's permutation of 0 to n - 1, or with ``backwards`` the number at a place.

    Fewer than a root of n values of the network lie beyond n; a number that meets one walks on until it is below n, which takes at
    most as many steps as there are such values. Few numbers walk, so a walk's steps, made for them alone, are one on average.
    """
    left, right = halves(n)
    walk = lambda x: F.aggregate(F.sequence(F.lit(0).cast("bigint"), left * right - n), x, lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, backwards)))
    return bound(_network(number, n, seed, backwards), lambda x: F.when(x < n, x).otherwise(walk(x)))


def numbered(rows: DataFrame, by: list[str], buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``(by, number, n_rows)``, a row for each row: global numbers from 0 on in an order given by the columns ``by`` alone, which are
    all of ``rows``; equal rows have neighbouring numbers but for cuts of long runs. Nulls are values. The bucket is the MD5's
    beginning of the columns as text, so the order can be repeated anywhere."""
    n = F.count("*").alias("_n")
    copies = F.floor((F.col("_n") - 1) / run)
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by], F.col("_run").cast("string"))
    runs = rows.select(*by).groupBy(*by).agg(n).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
    runs = runs.withColumn("_n", F.least(F.lit(run), F.col("_n") - F.col("_run") * run))
    runs = cut_lineage(runs.withColumn("_bucket", F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint") % buckets))
    table = runs.groupBy("_bucket").agg(F.sum("_n").alias("_held"))  # at most ``buckets`` rows
    before = F.sum("_held").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_held")
    every = F.sum("_held").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = table.select("_bucket", before.alias("_before"), every.alias("n_rows"))
    within = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by], "_run")
    first = F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    found = runs.withColumn("_first", first).join(F.broadcast(table), "_bucket")
    start = F.col("_before") + F.col("_first")
    return found.select(*by, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("number"), "n_rows")


def placed(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(by, shard, slot)``, a row for each row: shards hold equally many rows, or one more, in slots from 0 on without gaps."""
    at = numbered(rows, by).withColumn("_at", permuted(F.col("number"), F.col("n_rows"), seed))
    return at.select(*by, (F.col("_at") % shards).cast("int").alias("shard"), F.floor(F.col("_at") / shards).cast("bigint").alias("slot"))


def number_at(shard: Column, slot: Column, n: Column, shards: int = SHARDS, seed: str = SEED) -> Column:
    """The global row number that lies in a slot of a shard, of ``n`` rows."""
    return permuted(slot * shards + shard, n, seed, backwards=True)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(row, shard, slot)``: every whole row in a struct, with its place. Any columns that a hash can read will do; rows equal in all of
    them are copies, each with a place of its own; an empty table gives none."""
    rows = identified(docs)
    at = placed(rows.select("_row", "_row2"), ["_row", "_row2"], shards, seed)
    return rows.dropDuplicates(["_row", "_row2"]).join(at, ["_row", "_row2"]).select("row", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: str = SEED, files: int = 1) -> None:
    """The rows of ``docs`` as Parquet below ``folder``, a folder for each shard with about ``files`` files, each a run of slots in order.
    A column of ``docs`` named shard or slot is an error, since the folders and files have these."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("docs has a column shard or slot")
    dealt = shard_rows(docs, shards, seed).repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "shard", "slot").write.partitionBy("shard").parquet(folder)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` of every row, by the law ``rows``: shards differ by one row at most.

    ``size`` is the text's bytes in UTF-8 and one; a null text has none, like an empty one. Null and repeated keys are rows like others.
    Rows alike in key, size and checksum are copies here. Other columns are left out; a key named like a result is an error. No place
    depends on how rows are laid out, so reruns agree; with one more row, or shard, all places change, so ``grown_shard`` is null.
    """
    if key in RESULTS:
        raise ValueError(f"the key column {key} is named like a result")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    found = placed(rows, ["key", "size", "text_crc32"], shards, seed)
    return found.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over the whole ``documents`` table."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_KEY_ROWS = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(round_keys(SEED)))


def _mixed_sql(half: str) -> str:
    t = f"(({half} + k.a) % {PRIME})"
    return f"(((({t} * {t}) % {PRIME} * {t}) % {PRIME} * k.b + k.c) % {PRIME})"


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS MATERIALIZED (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), e AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {RUN} AS run FROM d
), f AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), size, text_crc32, run)), 1, 8))::BIGINT % {BUCKETS} AS bucket FROM e
), g AS MATERIALIZED (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, run) - 1 AS number FROM f
), s AS MATERIALIZED (
  SELECT n, r, greatest(ceil(n / r), 1)::BIGINT AS l FROM (SELECT count(*) AS n, greatest(ceil(sqrt(count(*))), 1)::BIGINT AS r FROM d)
), keys(i, a, b, c) AS (VALUES {_KEY_ROWS}), walk(number, x, i) AS (
  SELECT number, number, 0::BIGINT FROM g
  UNION ALL
  SELECT w.number, CASE WHEN k.i % 2 = 0 THEN (x // s.r + {_mixed_sql("(x % s.r)")}) % s.l * s.r + x % s.r ELSE x // s.r * s.r + (x % s.r + {_mixed_sql("(x // s.r)")}) % s.r END, w.i + 1
  FROM walk w, s, keys k WHERE k.i = w.i % {ROUNDS} AND (w.i = 0 OR w.i % {ROUNDS} <> 0 OR x >= s.n)
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM g JOIN walk USING (number), s WHERE walk.i > 0 AND walk.i % {ROUNDS} = 0 AND x < s.n
"""

QUERIES = {"op11_sharding": op11_sharding}
ORACLES = {"op11_sharding": SQL}
