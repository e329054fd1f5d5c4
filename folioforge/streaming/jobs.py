"""Streams: changed files, model replies as they come, states of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators import cdc, library
from folioforge.operators.versions import Change, Tables
from folioforge.plans.lineage import cut_lineage
from folioforge.sources import files


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they appear or change; vanished ones show only in a snapshot's difference (``cdc.diff``)."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(folder)
    return files.where(~cdc.ignored(F.col("path"))).select("path", F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))


def merge_batches(changes: DataFrame, table: str, key: str, order: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, deleted: str | None = None, content: str | None = None):
    """Each micro-batch of changes, the last of a key, is merged into the Parquet table; a repeated batch gives the same table.

    With ``deleted``, a flag, what exists is merged first and what is gone is removed then. With ``content``, a hash, a new key whose
    content another key of the table has already isn't added. ``then`` gets the rows that were merged, each key once: what to index.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = library.latest_per_key(batch, key, F.desc(order))
        gone = last.where(F.col(deleted)) if deleted else last.limit(0)
        live = last.where(~F.col(deleted)).drop(deleted) if deleted else last
        base = spark.read.parquet(table) if library.recover(spark, table) else live.limit(0)
        base = library.delete_keys(base, gone, key)
        if content:
            known = live.join(base.select(key), key, "left_semi")
            fresh = library.latest_per_key(live.join(base.select(key), key, "left_anti"), content, F.asc(key))
            live = known.unionByName(fresh.join(base.select(content), content, "left_anti").select(*live.columns))
        live = cut_lineage(live)  # it may come from the files that the swap replaces
        library.save_next(library.upsert(base, live, [key]), table)
        if then:
            then(live)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_changes(changes: DataFrame, tables: Tables, name: str, order: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, deleted: str | None = None, content: str | None = None):
    """As :func:`merge_batches`, into a table of ``tables``: a batch writes its own rows and keys, one change of the table; a batch that
    comes again after a restart is known by its number and changes nothing. Where parts have become many, ``tables.compact``."""
    key = tables.keys[name]

    def merge(batch: DataFrame, number: int) -> None:
        before = tables.version()
        note = tables.entry(before)["note"]
        if note.get(checkpoint, -1) >= number:
            return
        last = library.latest_per_key(batch, key, F.desc(order))
        gone = last.where(F.col(deleted)) if deleted else last.limit(0)
        live = last.where(~F.col(deleted)).drop(deleted) if deleted else last
        base = tables.read(name, before)
        if content:
            left = live.limit(0) if base is None else library.delete_keys(base, gone, key)
            known = live.join(left.select(key), key, "left_semi")
            fresh = library.latest_per_key(live.join(left.select(key), key, "left_anti"), content, F.asc(key))
            live = known.unionByName(fresh.join(left.select(content), content, "left_anti").select(*live.columns))
        live = cut_lineage(live)
        tables.commit({name: Change(live, gone.select(key).union(live.select(key)))}, expected=before, note=note | {checkpoint: number})
        if then:
            then(live)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_folder(spark: SparkSession, folder: str, tables: Tables, name: str, then: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Bring a table (path, mtime, size, hash) of ``tables`` in step with a folder, and return what was done, ``(change, n)``. Only files
    that are new or touched are opened, only rows that change are written; ``then`` gets the new and changed files with their content."""
    before = tables.version()
    changes, opened = files.screened(spark, folder, tables.read(name, before))
    changes = cut_lineage(changes)
    of = lambda *kinds: changes.where(F.col("change").isin(*kinds))
    came = opened.join(of("added", "changed", "touched").select(F.col("new_path").alias("path")), "path", "left_semi")
    known = tables.read(name, before)
    lost = known.join(of("removed", "changed", "touched").select(F.col("path").alias("_p")), cdc.norm_path(F.col("path")) == F.col("_p"), "left_semi").select("path") if known is not None else None
    tables.commit({name: Change(came.select("path", "mtime", "size", "hash"), lost)}, expected=before)
    if then:
        then(came.join(of("added", "changed").select(F.col("new_path").alias("path")), "path", "left_semi"))
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def reconcile(snapshot: DataFrame, table: str, path: str = "path", content: str = "hash") -> DataFrame:
    """Bring a Parquet table in step with a whole snapshot of its folder, and return what was done, ``(change, n)``. It is what a stream of
    changes falls back to: paths that are gone leave the table, changed and new ones are replaced, the others keep their rows."""
    spark = snapshot.sparkSession
    base = spark.read.parquet(table) if library.recover(spark, table) else snapshot.limit(0)
    changes = cut_lineage(cdc.diff(base, snapshot, path, content))
    name = cdc.norm_path(F.col(path))
    of = lambda df, *kinds: df.join(changes.where(F.col("change").isin(*kinds)).select(F.col("path").alias("_p")), name == F.col("_p"), "left_semi")
    after = of(base, "same").unionByName(of(snapshot, "added", "changed").select(*[c for c in snapshot.columns if c in base.columns]), allowMissingColumns=True)
    library.save_next(after, table)
    return changes.groupBy("change").agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Tells ``say(query, batch, rows, millis)`` after every micro-batch; an error ends as ``say(query, -1, 0, 0)``."""

    def __init__(self, say: Callable[[str, int, int, int], None]):
        self.say = say

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.say(p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.say(str(event.id), -1, 0, 0)


def debounced(changes: DataFrame, path: str, time: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of changes of a path: a session that ends when nothing comes for ``gap``."""
    return changes.withWatermark(time, late).groupBy(path, F.session_window(time, gap).alias("burst")).agg(F.count("*").alias("n"), F.max(time).alias("last"))


_MARK = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def json_field_step(field: str, buffer: str, piece: str) -> tuple[str, str]:
    """What more of a JSON text's string field is known after ``piece``: the new characters, and the state for the next call.

    The state is what hasn't been used: before the field its possible beginning, within it a broken escape.
    """
    inside = buffer.startswith("\x01")
    text = buffer.lstrip("\x01") + piece
    if buffer == "\x02":
        return "", buffer
    if not inside:
        mark = f'"{field}"'
        at = text.find(mark)
        rest = text[at + len(mark) :].lstrip() if at >= 0 else ""
        if at < 0:
            return "", text[-len(mark) :]
        if not rest or rest == ":" or (rest[0] == ":" and not rest[1:].lstrip()):
            return "", text[at:]
        rest = rest[1:].lstrip()
        if rest[0] != '"':
            return "", "\x02"
        text = rest[1:]
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            return "".join(out), "\x02"
        if c == "\\":
            need = 6 if text[i + 1 : i + 2] == "u" else 2
            if i + need > len(text):
                break
            e = text[i + 1]
            out.append(chr(int(text[i + 2 : i + 6], 16)) if e == "u" else _MARK.get(e, e))
            i += need
            continue
        out.append(c)
        i += 1
    return "".join(out), "\x01" + text[i:]


def stream_field(pieces: DataFrame, key: str, order: str, piece: str, field: str) -> DataFrame:
    """``(key, delta)``: the field's new characters of each call, batch by batch, with state between batches."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = state.get[0] if state.exists else ""
        new = []
        for row in pd.concat(list(rows)).sort_values(order, kind="stable")[piece]:
            more, buffer = json_field_step(field, buffer, row)
            new.append(more)
        state.update((buffer,))
        yield pd.DataFrame({key: [k[0]], "delta": ["".join(new)]})

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, delta string", "buffer string", "append", GroupStateTimeout.NoTimeout)


def index_states(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """``(key, state)`` after each batch: pending, indexing, ready or failed; an event that the state doesn't allow is passed over."""
    after = {("pending", "start"): "indexing", ("indexing", "done"): "ready", ("indexing", "error"): "failed", ("failed", "start"): "indexing", ("ready", "change"): "pending", ("failed", "change"): "pending"}

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "pending"
        for e in pd.concat(list(rows)).sort_values(order, kind="stable")[event]:
            now = after.get((now, e), now)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "state": [now]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)
