"""Tables that change together: all or nothing, small changes small, equal to tables changed in plain Python."""

import os
import random

import pytest
from folioforge.operators.versions import Change, Conflict, Tables, cascade
from pyspark.sql import functions as F


def tables_of(spark, tmp_path, **keys):
    return Tables(spark, f"{tmp_path}/t", keys)


def frame(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def written(path, kind):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and kind in d)


def test_random_changes_equal_a_dict(spark, tmp_path):
    t, rng, want = tables_of(spark, tmp_path, a="k"), random.Random(4), {}
    assert t.read("a") is None and t.version() == 0
    for step in range(8):
        new = {rng.randrange(30): f"{step}" for _ in range(6)}
        gone = {rng.randrange(30) for _ in range(4)} - set(new)
        t.upsert("a", frame(spark, list(new.items())), frame(spark, [(k,) for k in gone] or [(-1,)], "k int"))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert rows_of(t.read("a")) == sorted(want.items(), key=repr)
        if step == 4:
            t.compact()
            assert rows_of(t.read("a")) == sorted(want.items(), key=repr) and len(t.entry()["tables"]["a"]) == 1
    assert rows_of(t.read("a", 1)) != rows_of(t.read("a"))


def test_null_and_repeated_keys(spark, tmp_path):
    t = tables_of(spark, tmp_path, a="k")
    t.commit({"a": Change(frame(spark, [(1, "x"), (1, "y"), (None, "z"), (2, None)]))})
    t.upsert("a", frame(spark, [(None, "new"), (3, "w")]))
    assert rows_of(t.read("a")) == sorted([(1, "x"), (1, "y"), (None, "new"), (2, None), (3, "w")], key=repr)


def test_a_change_writes_what_changes(spark, tmp_path):
    t = tables_of(spark, tmp_path, a="k")
    t.commit({"a": Change(spark.range(200_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))})
    whole = written(f"{tmp_path}/t/data", "")
    t.upsert("a", frame(spark, [(5, "five")]))
    assert written(f"{tmp_path}/t/data", "") - whole < whole / 1000
    assert t.read("a").where("k = 5").collect()[0].v == "five" and t.read("a").count() == 200_000


@pytest.mark.parametrize("stop", ["write", "publish"])
def test_a_crash_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch, stop):
    t = tables_of(spark, tmp_path, a="k", b="k")
    t.commit({"a": Change(frame(spark, [(1, "a1")])), "b": Change(frame(spark, [(1, "b1")]))})

    def crash(*_, **__):
        raise OSError("power cut")

    bad = frame(spark, [(2, "b2")]) if stop == "publish" else frame(spark, [(2, "b2")]).withColumn("v", F.raise_error(F.lit("power cut")))
    with monkeypatch.context() as m, pytest.raises(Exception, match="power cut"):
        if stop == "publish":
            m.setattr(Tables, "_publish", crash)
        t.commit({"a": Change(frame(spark, [(2, "a2")])), "b": Change(bad)})
    assert rows_of(t.read("a")) == [(1, "a1")] and rows_of(t.read("b")) == [(1, "b1")] and t.version() == 1
    t.commit({"a": Change(frame(spark, [(2, "a2")])), "b": Change(frame(spark, [(2, "b2")]))})
    assert (t.read("a").count(), t.read("b").count()) == (2, 2)


def test_the_second_of_two_changes_conflicts(spark, tmp_path):
    t = tables_of(spark, tmp_path, a="k")
    at = t.commit({"a": Change(frame(spark, [(1, "x")]))})
    t.commit({"a": Change(frame(spark, [(2, "y")]))}, expected=at)
    with pytest.raises(Conflict):
        t.commit({"a": Change(frame(spark, [(3, "z")]))}, expected=at)
    assert rows_of(t.read("a")) == [(1, "x"), (2, "y")]


def test_cascade_over_four_tables(spark, tmp_path, monkeypatch):
    t = tables_of(spark, tmp_path, p="id", c="id", g="id", n="id")
    t.commit({
        "p": Change(frame(spark, [(1,), (2,)], "id int")), "c": Change(frame(spark, [(10, 1), (11, 2)], "id int, p_id int")),
        "g": Change(frame(spark, [(20, 10), (21, 11)], "id int, c_id int")), "n": Change(frame(spark, [(5, 1, 10, "x"), (6, 2, 10, "y"), (7, 2, 11, "z")], "id int, p_id int, c_id int, t string")),
    })
    edges = [("p", "id", "c", "p_id", "cascade"), ("c", "id", "g", "c_id", "cascade"), ("p", "id", "n", "p_id", "set null"), ("c", "id", "n", "c_id", "set null")]
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Tables, "_publish", lambda *_: (_ for _ in ()).throw(OSError()))
        cascade(t, edges, "p", frame(spark, [(1,)], "id int"))
    assert [t.read(n).count() for n in "pcgn"] == [2, 2, 2, 3]
    cascade(t, edges, "p", frame(spark, [(1,)], "id int"))
    assert rows_of(t.read("p")) == [(2,)] and rows_of(t.read("c").select("id")) == [(11,)] and rows_of(t.read("g").select("id")) == [(21,)]
    assert rows_of(t.read("n").select("id", "p_id", "c_id", "t")) == [(5, None, None, "x"), (6, 2, None, "y"), (7, 2, 11, "z")]
