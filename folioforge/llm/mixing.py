"""Operator 8: mixing sources to target weights by Sainte-Lague apportionment.

Sources share a budget of words by weight, each up to a limit of repeats. Equal-token blocks are apportioned to sources,
and within a source to its shards, by highest quotients target / (2k + 1). A shard is a hashed part of a source's documents
in a seeded order; its quota of blocks is a run from a seeded block on, which wraps around and then repeats. So most
documents are taken whole, and what a document gives follows from sums, without a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.llm.batches import identified, unpacked
from folioforge.plans.lineage import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"

#: Share of all words that the mix takes; most times a source is taken; weights of the sources in order, repeating.
BUDGET, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)

#: Words of a block; documents of a shard, about; equal rows that keep together, at most; name of the seeded order.
BLOCK, SHARD_DOCS, RUN, SEED = 16, 50_000, 4_096, "mix"

#: Rows up to which the table of shards is sent to all tasks instead of being joined by a shuffle.
BROADCAST_ROWS = 50_000


def _number(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _label(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def source_targets(sized: DataFrame, budget: float = BUDGET, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, n_docs, rank, target)`` of ``sized`` rows (source, size, n) that stand for ``n`` documents. Sources are ordered by code point, null last, and take ``weights`` in
    turn. A target stops at ``most`` times its source's size; the excess is shared by weight until none is above. That is the
    level ``max over k of (budget - first k limits) / (weights of the rest)``, sources in order of limit by weight."""
    w = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight"))
    return w.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` (one number in each group of ``within``) by highest quotients votes / (2k + 1), ties to
    the smaller ``party``. A party's seats lie near votes by the mean divisor, so only the quotients around it are ranked."""
    group, order = Window.partitionBy(*within), Window.partitionBy(*within).orderBy(F.desc("quotient"), party)
    p = parties.withColumn("_share", F.try_divide(F.col(votes), F.sum(votes).over(group)))
    p = p.withColumn("_near", F.coalesce(F.floor(F.col(seats) * F.col("_share") + 0.5), F.lit(0)))
    off = F.count("*").over(group) + F.abs(F.col(seats) - F.sum("_near").over(group))
    p = p.withColumn("_reach", F.coalesce(F.ceil(off * F.col("_share")), F.lit(0)) + 2)
    p = p.withColumn("_base", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")))
    p = p.withColumn("_open", F.col(seats) - F.sum("_base").over(group))
    near = p.select(*within, party, votes, "_open", F.explode(F.sequence("_base", F.col("_near") + F.col("_reach"))).alias("k"))
    near = near.where(F.col(votes) > 0).withColumn("quotient", F.col(votes) / (2 * F.col("k") + 1))
    won = near.withColumn("nth", F.row_number().over(order)).where("nth <= _open").groupBy(*within, party).agg(F.count("*").alias("_won"))
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*within, party)]
    found = p.alias("p").join(won.alias("w"), keys, "left")
    return found.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p._base") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, most: int = MOST,
    weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED,
    row: tuple[str, ...] = (), together: int = RUN,
) -> DataFrame:
    """``(key, size, source_size, target, taken, copies, head, tail, run)`` of every row, and the columns ``row``.

    ``taken`` words are ``copies`` whole copies, then the first ``head`` words and those from word ``tail`` on, once more. A null,
    empty or blank text has size 0 and gives nothing; null is a source of its own. Every row is a document, placed in the seeded order by
    key, size and the columns ``row`` (none of them null). Rows alike in all of these and the source are counted first and dealt to shards
    in runs of about ``together``, so neither rows that share a key nor copies gather in one task. An empty table gives an empty result.
    Nothing depends on how rows are laid out, so reruns agree.
    """
    sized = docs.select(*row, F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    copies = F.floor((F.col("n") - 1) / together)
    sized = sized.groupBy(*row, "key", "source", "size").agg(F.count("*").alias("n")).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
    sized = cut_lineage(sized.withColumn("n", F.least(F.lit(together), F.col("n") - F.col("_run") * together)))
    if row:  # rows that differ share a key and a size: many of these are dealt by hash
        alike = _small(sized.groupBy("key", "source", "size").agg(F.sum("n").alias("_alike")).where(F.col("_alike") > together))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("key", "source", "size")]
        part = F.coalesce(F.pmod(F.xxhash64(*row), F.ceil(F.col("_alike") / together)), F.lit(0))
        sized = sized.alias("s").join(alike.alias("h"), same, "left").select("s.*", part.alias("_part")).withColumn("_run", F.col("_run") + F.col("_part")).drop("_part")
    plan = source_targets(sized, budget, most, weights)
    total = F.sum("target").over(Window.partitionBy("_all"))
    plan = plan.withColumn("_all", F.lit(1)).withColumn("_seats", F.round(total / block).cast("bigint"))
    plan = apportion(plan, ["_all"], "rank", "target", "_seats").withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs))
    plan = cut_lineage(plan.select("source", "source_size", "target", "n_shards", F.col("quota").alias("_seats")))

    own = F.coalesce(F.col("key").cast("string"), F.concat_ws(":", *[F.col(c).cast("string") for c in row]) if row else F.lit(""))
    name = F.concat_ws(":", F.lit(seed), own, F.col("size").cast("string"), F.col("_run").cast("string"))
    rows = sized.alias("s").join(_small(plan).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    rows = rows.select(*row, "key", "s.source", "size", "n", "_run", "source_size", "target", "_seats", F.md5(name).alias("_at"), (_number(F.concat(name, F.lit(":shard"))) % F.col("n_shards")).alias("shard"))

    shards = rows.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"), *[F.first(c).alias(c) for c in ("source_size", "target", "_seats")])
    shards = shards.withColumn("_votes", F.coalesce(F.try_divide(F.col("target") * F.col("shard_size"), F.col("source_size")), F.lit(0.0)))
    shards = apportion(shards, ["source"], "shard", "_votes", "_seats").withColumn("n", F.ceil(F.col("shard_size") / block))
    shards = shards.withColumn("quota", F.least("quota", most * F.col("n")))
    start = F.coalesce(F.try_mod(_number(F.concat_ws(":", F.lit(seed), _label(F.col("source")), F.col("shard").cast("string"))), F.col("n")), F.lit(0))
    shards = shards.select("source", "shard", "shard_size", "n", start.alias("start"), F.coalesce(F.floor(F.try_divide("quota", "n")), F.lit(0)).alias("copies"), F.coalesce(F.try_mod("quota", "n"), F.lit(0)).alias("extra"))
    shards = shards.select(
        "source", "shard", "copies",
        (F.col("start") * block).alias("run_from"),
        F.least("shard_size", (F.col("start") + F.col("extra")) * block).alias("run_to"),
        F.greatest(F.lit(0), (F.col("start") + F.col("extra") - F.col("n")) * block).alias("wrap_to"),
    )
    shards = _small(cut_lineage(shards))
    order = Window.partitionBy("source", "shard").orderBy("_at", "key", "size", *row, "_run").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum(F.col("size") * F.col("n")).over(order)).withColumn("_left", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    rows = rows.withColumn("b", F.col("_end") - F.col("_left") * F.col("size")).withColumn("a", F.col("b") - F.col("size")).drop("n")
    found = rows.alias("r").join(shards.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.shard") == F.col("q.shard")))
    inside = lambda lo, hi: F.greatest(F.lit(0), F.least(hi, F.col("b")) - F.greatest(lo, F.col("a")))
    head, run = inside(F.lit(0), F.col("wrap_to")), inside(F.col("run_from"), F.col("run_to"))
    tail = F.greatest(F.lit(0), F.col("run_from") - F.col("a"))  # the run's words in this document: from here, ``run`` of them
    return found.select(
        *row, F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size") + head + run).alias("taken"),
        "copies", head.alias("head"), F.when(run > 0, tail).otherwise(F.col("size")).alias("tail"), run.alias("run"),
    )


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, and for a document at the end of a run a row with the part of
    its text that was taken (of a part in two pieces, the later follows on a line of its own). Every row is mixed, whatever its
    key; of rows equal in all columns one stands for each in turn."""
    rows = identified(docs)
    own = {name: F.col("row").getField(c).alias(name) for name, c in (("key", key), ("text", text), ("source", settings.pop("source", "source")))}
    plan = mix(rows.select("_row", "_row2", *own.values()), "key", row=("_row", "_row2"), **settings).where("taken > 0").drop("key")
    rows = rows.dropDuplicates(["_row", "_row2"]).join(plan, ["_row", "_row2"]).withColumn("text", own["text"])
    part, whole = F.col("head") + F.col("run"), F.col("size")
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(1), (F.col("copies") + F.when(part > 0, 1).otherwise(0)).cast("int"))))
    words = F.regexp_extract_all("text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    piece = lambda a, n: F.rtrim(F.array_join(F.slice(words, (a + 1).cast("int"), n.cast("int")), ""))
    cut = F.concat_ws("\n", F.when(F.col("head") > 0, piece(F.lit(0), F.col("head"))), F.when(F.col("run") > 0, piece(F.col("tail"), F.col("run"))))
    return unpacked(rows, docs, **{text: F.when((F.col("_nth") <= F.col("copies")) | (part >= whole), F.col("text")).otherwise(cut)})


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over the whole ``documents`` table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0
), s2 AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM s1
), s3 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s2
), s AS (
  SELECT source, rank, source_size, n_docs, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM s3
), won AS (
  SELECT rank FROM (
    SELECT rank, target / (2 * k + 1) AS q FROM s, LATERAL (SELECT unnest(range(0, (target / {BLOCK})::BIGINT + 5)) AS k) WHERE target > 0
  ) ORDER BY q DESC, rank LIMIT (SELECT round(sum(target) / {BLOCK})::BIGINT FROM s)
), sq AS (
  SELECT s.*, (SELECT count(*) FROM won w WHERE w.rank = s.rank) AS seats, ceil(n_docs / {SHARD_DOCS})::BIGINT AS n_shards FROM s
), u AS (
  SELECT *, concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), size, (row_number() OVER (PARTITION BY doc_id, source, size) - 1) // {RUN}) AS name FROM d
), r AS (
  SELECT doc_id, size, sq.*, md5(name) AS place, ('0x' || substr(md5(name || ':shard'), 1, 8))::BIGINT % n_shards AS shard FROM u JOIN sq ON u.source IS NOT DISTINCT FROM sq.source
), h0 AS (
  SELECT rank, shard, any_value(source) AS source, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats,
    any_value(target) * sum(size)::BIGINT / any_value(source_size) AS votes, ceil(sum(size) / {BLOCK})::BIGINT AS n
  FROM r GROUP BY rank, shard
), hw AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT rank, shard, seats, row_number() OVER (PARTITION BY rank ORDER BY votes / (2 * k + 1) DESC, shard) AS nth
    FROM h0, LATERAL (SELECT unnest(range(0, (votes / {BLOCK})::BIGINT + 5)) AS k) WHERE votes > 0
  ) WHERE nth <= seats GROUP BY rank, shard
), h AS (
  SELECT h0.*, least(coalesce(quota, 0), 2 * n) AS quota,
    coalesce(('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n') || ':' || shard), 1, 8))::BIGINT % nullif(n, 0), 0) AS start
  FROM h0 LEFT JOIN hw USING (rank, shard)
), g AS (
  SELECT rank, shard, coalesce(quota // nullif(n, 0), 0) AS copies, start * {BLOCK} AS run_from,
    least(shard_size, (start + coalesce(quota % nullif(n, 0), 0)) * {BLOCK}) AS run_to,
    greatest(0, (start + coalesce(quota % nullif(n, 0), 0) - n) * {BLOCK}) AS wrap_to
  FROM h
), p AS (
  SELECT *, (sum(size) OVER (PARTITION BY rank, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS b FROM r
)
SELECT doc_id, size, source_size, target,
  (copies * size + greatest(0, least(wrap_to, b) - (b - size)) + greatest(0, least(run_to, b) - greatest(run_from, b - size)))::BIGINT AS taken
FROM p JOIN g USING (rank, shard)
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": SQL}
