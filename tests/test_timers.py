"""State with timers: bursts, late and repeated changes, restarts, vanished files."""

import datetime as dt

import pytest
from folioforge.streaming import timers
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.with_timers(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def runner(spark, tmp_path, schema, job):
    """Puts rows in as one batch and returns all that came out so far; each call is a restart from the checkpoint."""
    out = f"{tmp_path}/out"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = job(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/{n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.option("recursiveFileLookup", True).parquet(out).collect()

    return run


def ms(x):
    return T0 + dt.timedelta(milliseconds=x)


def test_bursts_over_restarts(spark, tmp_path):
    run = runner(spark, tmp_path, "path string, at timestamp", lambda s: timers.debounced(s, "path", "at", 500))
    told = lambda rows: sorted((r.path, r.n, (r.last - T0) // dt.timedelta(milliseconds=1)) for r in rows)
    first = run([("a", ms(0)), ("a", ms(100)), ("b", ms(50))])
    assert told(first) == []
    second = run([("a", ms(400)), ("b", ms(2000)), ("z", ms(2000))])
    assert told(second) in ([("a", 3, 400), ("b", 1, 50)], [("b", 1, 50)])
    third = run([("z", ms(10_000)), ("a", ms(1))])  # the second is too late by now
    assert told(third) == [("a", 3, 400), ("b", 1, 50), ("b", 1, 2000), ("z", 1, 2000)]


def test_a_vanished_file(spark, tmp_path):
    run = runner(spark, tmp_path, "folder string, path string, hash string, seen timestamp", lambda s: timers.presence(s, "folder", 1000))
    told = lambda rows: sorted((r.path, r.change) for r in rows)
    assert told(run([("f", "x", "1", ms(0)), ("f", "y", "1", ms(0))])) == [("x", "added"), ("y", "added")]
    assert told(run([("f", "x", "1", ms(600)), ("f", "x", "2", ms(700))])) == [("x", "added"), ("x", "changed"), ("y", "added")]
    run([("f", "x", "2", ms(1500))])
    rows = run([("f", "x", "2", ms(2400)), ("g", "q", "1", ms(2400))])
    assert told(rows) == [("q", "added"), ("x", "added"), ("x", "changed"), ("y", "added"), ("y", "removed")]
    rows = run([("g", "q", "1", ms(9000))])
    assert told(rows)[-2:] == [("y", "added"), ("y", "removed")] and ("x", "removed") in told(rows)
