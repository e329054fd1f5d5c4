"""Tables that change together: Parquet parts named by a list of versions.

A change writes its own rows, and the keys that go, beside what is there; then one small file that names the parts of all
tables is moved into place, and that is the change. So readers see all of it or nothing, a batch of k rows writes k rows, and
what a crash leaves behind is named by no version. Reading puts the parts together: a row counts unless a later part says that
its key is gone. ``compact`` writes a table anew where parts have become many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from folioforge.operators import library
from folioforge.plans.lineage import cut_lineage
from folioforge.plans.sizes import broadcast_if_small


class Conflict(Exception):
    """Another change became this version first."""


@dataclass
class Change:
    """Rows to come, keys (one column) to go from what is there already, and whether all that is there goes."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    anew: bool = False


class Tables:
    """Named tables below a folder, each with a key column; ``split`` names a table's partition columns."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], split: dict[str, Sequence[str]] | None = None):
        self.spark, self.folder, self.keys, self.split = spark, folder.rstrip("/"), keys, split or {}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def version(self) -> int:
        """The number of the last change; 0 before the first."""
        at = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version names: ``{"tables": {name: [part]}, "note": ...}``."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "note": {}}
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """A table as of a version, by default the last; None if it has had no rows. ``where`` picks rows and columns (the key among
        them) of each part's scan, in front of the join with what is gone."""
        parts = self.entry(version)["tables"].get(name, [])
        key = self.keys[name]
        read = lambda p: self.spark.read.schema(StructType.fromJson(p["schema"])).parquet(f"{self.folder}/{p['path']}")  # noqa: E731  a part may have no files
        rows = [(p["at"], read(p)) for p in parts if p["kind"] == "rows"]
        if not rows:
            return None
        gone = [read(p).select(F.col(key).alias("_key"), F.lit(p["at"]).alias("_gone")) for p in parts if p["kind"] == "gone"]
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [(where(df) if where else df).withColumn("_at", F.lit(at)) for at, df in rows])
        if not gone:
            return found.drop("_at")
        last = broadcast_if_small(reduce(DataFrame.union, gone).groupBy("_key").agg(F.max("_gone").alias("_gone")))
        return found.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") < F.col("_gone")), "left_anti").drop("_at")

    def commit(self, changes: dict[str, Change], expected: int | None = None, note: dict | None = None) -> int:
        """Make the changes to all tables one version, and return its number. A key in both ``gone`` and ``rows`` is replaced. Raises
        ``Conflict`` if the tables are no longer at version ``expected``, by default the one found when this began."""
        before = self.version() if expected is None else expected
        entry = self.entry(before)
        tables, at = dict(entry["tables"]), before + 1
        for name, change in changes.items():
            parts = [] if change.anew else list(tables.get(name, []))
            for kind, df in (("gone", change.gone), ("rows", change.rows)):
                if df is None or (kind == "gone" and not parts):
                    continue
                path = f"data/{name}/{at:012d}-{kind}-{uuid.uuid4().hex}"
                df = df.select(self.keys[name]).distinct() if kind == "gone" else df
                out = df.write.partitionBy(*self.split.get(name, ())) if kind == "rows" else df.write
                out.parquet(f"{self.folder}/{path}")
                parts.append({"kind": kind, "path": path, "at": at, "schema": df.schema.jsonValue()})
            tables[name] = parts
        self._publish(at, {"tables": tables, "note": entry["note"] if note is None else note})
        return at

    def _publish(self, version: int, entry: dict) -> None:
        """Move the version's file to its name, which no other may have."""
        place, fresh = self._path(f"versions/{version:012d}.json"), self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        out.write(json.dumps(entry).encode())
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fresh, place, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(fresh, False)
            if self._fs.exists(place):
                raise Conflict(f"version {version} of {self.folder} is there already") from e
            raise

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame | None = None, note: dict | None = None) -> int:
        """Rows replace those of their keys; further keys go."""
        keys = rows.select(self.keys[name])
        return self.commit({name: Change(rows, keys if gone is None else keys.union(gone.select(self.keys[name])))}, note=note)

    def compact(self, *names: str) -> int:
        """The same rows in one part for each table; earlier versions can still be read until their files are cleared."""
        before = self.version()
        return self.commit({n: Change(self.read(n, before), anew=True) for n in names or self.entry(before)["tables"]}, expected=before)


def cascade(tables: Tables, edges: Sequence[tuple[str, str, str, str, str]], root: str, gone: DataFrame, note: dict | None = None) -> int:
    """Delete the keys ``gone`` from ``root`` and what hangs on them, in all tables at once. An edge is (parent, parent column, child,
    foreign key, action), in the order of the graph; the action is ``cascade`` or ``set null``. What is written are keys, and the rows
    that lose a foreign key; the tables stay where they are."""
    at = tables.version()
    now = {n: df for n in {root, *(e[0] for e in edges), *(e[2] for e in edges)} if (df := tables.read(n, at)) is not None}
    if root not in now:
        return at
    lost, changed = {root: now[root].join(gone.select(tables.keys[root]), tables.keys[root], "left_semi")}, {}
    for parent, column, child, foreign, action in edges:
        if parent not in lost or child not in now:
            continue
        keys = lost[parent].select(F.col(column).alias(foreign)).distinct()
        if action == "cascade":
            hit = now[child].join(keys, foreign, "left_semi")
            lost[child] = lost[child].unionByName(hit) if child in lost else hit
        else:
            changed.setdefault(child, []).append((foreign, keys))
    changes = {n: Change(gone=cut_lineage(df.select(tables.keys[n]).distinct())) for n, df in lost.items()}
    for child, nulls in changed.items():
        key, rows = tables.keys[child], now[child]
        for foreign, keys in nulls:
            rows = rows.join(keys.withColumn(f"_no_{foreign}", F.lit(True)), foreign, "left")
        flags = [f"_no_{foreign}" for foreign, _ in nulls]
        rows = rows.where(F.coalesce(*map(F.col, flags)))
        if child in changes:
            rows = library.delete_keys(rows, changes[child].gone, key)
        rows = cut_lineage(rows.withColumns({f: F.when(F.col(f"_no_{f}").isNull(), F.col(f)) for f, _ in nulls}).drop(*flags).select(*now[child].columns))
        own = rows.select(key)
        changes[child] = Change(rows, own.union(changes[child].gone) if child in changes else own)
    return tables.commit(changes, expected=at, note=note)
