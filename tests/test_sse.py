"""Transcripts as a stream: whole lines once, over restarts, into the field of a reply."""

import json
import os

import pytest
from folioforge.operators import telemetry
from folioforge.sources import sse
from folioforge.streaming import jobs
from pyspark.sql import functions as F


def say(folder, call, text, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{call}", "a") as f:
        f.write(text + end)


def delta(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def test_lines_come_once_over_restarts(spark, tmp_path):
    sse.register(spark)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.format("sse").option("path", folder).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.call, r["at"], r.line) for r in spark.read.parquet(out).collect())

    say(folder, "a", "one\r")
    say(folder, "a", "half", "")
    say(folder, "b", "βeta")
    assert run() == [("a", 0, "one"), ("b", 0, "βeta")]
    say(folder, "a", " a line")
    say(folder, "c", "")
    say(folder, "_hidden", "x")
    assert run() == [("a", 0, "one"), ("a", 5, "half a line"), ("b", 0, "βeta"), ("c", 0, "")]
    assert len(run()) == 4
    say(folder, "b", "more")
    assert ("b", 6, "more") in run()


def test_a_replys_field_grows(spark, tmp_path):
    sse.register(spark)
    folder, found = f"{tmp_path}/in", []

    def run():
        lines = spark.readStream.format("sse").option("path", folder).load()
        data = F.trim(F.regexp_replace("line", "^data:", ""))
        pieces = lines.where(F.startswith("line", F.lit("data:"))).select("call", "at", F.get_json_object(data, "$.choices[0].delta.content").alias("piece")).where("piece IS NOT NULL")
        stream = jobs.stream_field(pieces, "call", "at", "piece", "content")
        stream.writeStream.outputMode("append").foreachBatch(lambda df, n: found.extend((r.call, r.delta) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    say(folder, "a", delta('{"title": "T", "cont'))
    say(folder, "a", ": ping")
    say(folder, "a", delta('ent": "He'))
    run()
    say(folder, "a", delta('llo \\"you'))
    say(folder, "b", delta('{"content": "b"}'))
    run()
    say(folder, "a", delta('\\""}'))
    say(folder, "a", "data: [DONE]")
    run()
    assert "".join(d for c, d in found if c == "a") == 'Hello "you"' and "".join(d for c, d in found if c == "b") == "b"
    lines = spark.read.format("sse").option("path", folder).load()
    assert telemetry.delta_text(lines, "call", "at", "line").where("call = 'a'").first().content == '{"title": "T", "content": "Hello \\"you\\""}'


def test_filters_pick_files(spark, tmp_path):
    sse.register(spark)
    for c in "abc":
        say(f"{tmp_path}/in", c, f"line of {c}")
    say(f"{tmp_path}/in", "a", "no end", "")
    df = spark.read.format("sse").option("path", f"{tmp_path}/in").load()
    assert df.count() == 4 and [r.line for r in df.where("call = 'b'").collect()] == ["line of b"]
    assert df.where(F.col("call").isin("a", "c")).rdd.getNumPartitions() == 2 and df.where("call = 'a' AND at > 3").count() == 1
    with pytest.raises(Exception, match="needs the option path"):
        spark.read.format("sse").load().count()
    assert spark.read.format("sse").option("path", f"{tmp_path}/none").load().count() == 0


def test_long_lines_in_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sse, "RANGE", 5)
    monkeypatch.setattr(sse, "BLOCK", 3)
    say(f"{tmp_path}", "f", "a" * 23 + "\n\nbc\nrest", "")
    size = os.path.getsize(f"{tmp_path}/f")
    end = sse._whole(str(tmp_path), "f", 0, size)
    assert end == 28 and sse._whole(str(tmp_path), "f", end, size) == end
    assert list(sse._lines(str(tmp_path), sse.Bytes("f", 0, end))) == [("f", 0, "a" * 23), ("f", 24, ""), ("f", 25, "bc")]
