import math

from conftest import same
from edge import documents
from folioforge.llm import mixing as mx
from pyspark.sql import functions as F


def test_query_is_the_sql(spark, duck, data):
    same(mx.op8_mixing, mx.SQL, spark, duck, data)


def test_sources_come_near_their_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mx.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.k - r.t) <= 2 * mx.BLOCK and r.over <= 0
    texts = mx.mixed_texts(docs)
    words = texts.agg(F.sum(F.regexp_count("text", F.lit(mx.WORD)))).first()[0]
    assert words == rows.agg(F.sum("taken")).first()[0] and texts.columns == docs.columns


def test_apportion_gives_to_the_highest_quotients(spark):
    votes = [53000, 24000, 23000, 0, 700, 700, 12]
    df = spark.createDataFrame([(1, i, float(v), 31) for i, v in enumerate(votes)], "g int, p int, v double, s int")
    seats = [0] * len(votes)
    for _ in range(31):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[i] += 1
    assert [r.quota for r in mx.apportion(df, ["g"], "p", "v", "s").orderBy("p").collect()] == seats


def test_edges(spark):
    rows = mx.mix(documents(spark)).collect()
    assert len(rows) == 12 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id for r in rows if r.size == 0} == {3, 4, 5}
    assert not any(math.isnan(r.target) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mx.mix(documents(spark).repartition(3)).collect()))
    assert mx.mix(documents(spark).limit(0)).count() == 0


def test_rows_that_share_a_key_are_all_mixed(spark):
    rows = [(None, f"without key {i} " * (i + 1), "a") for i in range(20)] + [(5, f"one key {i} " * (i + 1), "a") for i in range(20)] + [(6, "equal rows", "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = sorted(r.text for r in mx.mixed_texts(docs, budget=1.0, most=1).collect())
    assert texts == sorted(t for _, t, _ in rows)


def test_a_key_with_half_of_all_rows_is_dealt_out(spark):
    key = F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).cast("bigint")
    docs = spark.range(40_000).select(key.alias("doc_id"), F.when(F.col("id") < 10_000, F.lit("one two")).otherwise(F.repeat(F.lit("w "), (F.col("id") % 50).cast("int"))).alias("text"), F.lit("a").alias("source"))
    seen = {}
    plain = mx.apportion

    def spy(parties, within, *a):
        if within == ["source"]:
            seen.update(n=parties.count(), largest=parties.agg(F.max("shard_size")).first()[0], total=parties.agg(F.sum("shard_size")).first()[0])
        return plain(parties, within, *a)

    mx.apportion = spy
    try:
        found = mx.mix(docs, shard_docs=1000, together=32)
    finally:
        mx.apportion = plain
    rows = found.agg(F.count("*"), F.sum("taken"), F.sum("size"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    assert rows[0] == 40_000 and abs(rows[1] - 1.5 * rows[2]) <= 40 * mx.BLOCK and rows[3] <= 0  # a block of each shard
    assert seen["n"] == 40 and seen["largest"] < 3 * seen["total"] / 40


def test_copies_take_their_turns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 7 + [(2, "d e", "s")] * 3, "doc_id long, text string, source string")
    found = sorted((r.doc_id, r.size, r.taken) for r in mx.mix(docs, budget=0.5, block=1, together=2).collect())
    assert len(found) == 10 and abs(sum(t for *_, t in found) - 0.5 * 27) <= 1
    texts = [r.text for r in mx.mixed_texts(docs, budget=0.5, block=1).collect()]
    assert sum(len(t.split()) for t in texts) == sum(t for *_, t in found)
