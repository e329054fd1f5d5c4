"""Operator 11: the permutation is one, places are reproducible, shards are even and whole."""

import zlib
from collections import Counter

import pytest
from conftest import same
from edge import documents
from folioforge.llm import sharding
from pyspark.sql import functions as F


def test_oracle(spark, duck, data):
    same(sharding.op11_sharding, sharding.SQL, spark, duck, data)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 63, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    at = sharding.permuted(F.col("id"), F.lit(n).cast("bigint"))
    rows = spark.range(n).select("id", at.alias("at")).withColumn("back", sharding.permuted(F.col("at"), F.lit(n).cast("bigint"), backwards=True)).collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_permutation_of_many_numbers(spark):
    n = F.lit(10**12 + 39).cast("bigint")
    rows = spark.range(0, 10**12, 10**9).select("id", sharding.permuted(F.col("id"), n).alias("at")).withColumn("back", sharding.permuted(F.col("at"), n, backwards=True)).collect()
    assert all(r.back == r.id and 0 <= r["at"] < 10**12 + 39 for r in rows) and len({r["at"] for r in rows}) == 1000
    assert 340 < sum(r["at"] < 4 * 10**11 for r in rows) < 460


def test_seed_names_the_shuffle(spark):
    n = F.lit(500).cast("bigint")
    a, b = ([r[0] for r in spark.range(500).select(sharding.permuted(F.col("id"), n, s)).collect()] for s in ("one", "two"))
    assert sum(x == y for x, y in zip(a, b)) < 15 and a != sorted(a)


def check(rows, n, shards=8):
    count = Counter(r.shard for r in rows)
    assert len(rows) == n and max(count.values()) - min((count.get(s, 0) for s in range(shards))) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count.get(s, 0)))


def test_odd_rows_in_any_layout(spark):
    docs = documents(spark)
    found = sharding.assign(docs)
    rows = found.collect()
    assert found.columns == ["doc_id", *sharding.RESULTS] and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    check(rows, docs.count())
    texts = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == texts
    again = sharding.assign(docs.orderBy(F.rand(3)).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_copies_are_numbered_in_runs(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).cast("bigint").alias("k"))
    found = sharding.numbered(rows, ["k"], buckets=16, run=64)
    got = found.collect()
    assert sorted(r.number for r in got) == list(range(3000)) and {r.n_rows for r in got} == {3000}
    hot = sorted(r.number for r in got if r.k == 5)
    assert len(hot) == 2000 and hot[-1] - hot[0] > 2100  # not one run
    assert sorted(map(repr, sharding.numbered(rows.repartition(9), ["k"], 16, 64).collect())) == sorted(map(repr, got))


def test_number_at_a_place(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    at = sharding.numbered(rows, ["k"]).withColumn("at", sharding.permuted(F.col("number"), F.col("n_rows")))
    back = sharding.number_at(F.col("at") % 8, F.floor(F.col("at") / 8), F.col("n_rows"))
    assert at.where(back != F.col("number")).count() == 0


def test_shards_hold_whole_rows(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, f"{tmp_path}/out", shards=3, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    check(back.collect(), docs.count(), 3)
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("slot", F.lit(1)), f"{tmp_path}/no")


def test_empty_and_clashing_key(spark):
    docs = documents(spark)
    assert sharding.assign(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs.withColumnRenamed("doc_id", "slot2").withColumnRenamed("slot2", "slot"), key="slot")


def test_the_plan_stays_in_the_jvm(spark, data):
    plan = sharding.op11_sharding(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
