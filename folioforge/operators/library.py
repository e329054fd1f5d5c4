"""The library of sources: scans, lookups, tags, scopes, and changes as functions from an old table to a new one.

Plain Parquet has no row-level changes, so every change returns the table's next state; `save_next` swaps it in. Keys of the
side that is looked up are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions import text as tx
from folioforge.plans.lineage import cut_lineage
from folioforge.plans.sizes import broadcast_if_small


def library_scan(sources: DataFrame, cached: DataFrame, key: str, newest: str) -> DataFrame:
    """Long-lived rows, newest first: those that aren't in the per-task cache."""
    return sources.join(cached, key, "left_anti").orderBy(F.desc(newest))


def lookup_in_order(df: DataFrame, ids: Sequence, key: str) -> DataFrame:
    """Rows of ``ids`` in their first given order, with ``position`` from 0; repeated ids count once, unknown ones are dropped."""
    spark = df.sparkSession
    order = {k: i for i, k in reversed(list(enumerate(ids)))}
    wanted = spark.createDataFrame(sorted((i, k) for k, i in order.items()) or [], f"_at int, _key {df.schema[key].dataType.simpleString()}")
    found = df.join(F.broadcast(wanted), F.col(key) == F.col("_key"))  # as long as the caller's list
    rank = F.row_number().over(Window.orderBy("_at")) - 1
    return found.withColumn("position", rank.cast("bigint")).drop("_at", "_key")


def lookup_url_scope(pages: DataFrame, url: str, scope: str | None, url_col: str = "url", scope_col: str = "task_id") -> DataFrame:
    """Rows of a URL in one task's cache, or in the library if ``scope`` is None."""
    return pages.where((F.col(url_col) == url) & F.col(scope_col).eqNullSafe(F.lit(scope)))


def having_all(pairs: DataFrame, entity: str, tag: str, wanted: Sequence) -> DataFrame:
    """Relational division: entities that have every one of ``wanted``, which is taken as a set."""
    asked = list(dict.fromkeys(wanted))
    some = pairs.where(F.col(tag).isin(asked)).groupBy(entity).agg(F.count_distinct(tag).alias("n"))
    return some.where(F.col("n") == len(asked)).select(entity)


def tags_of(bridge: DataFrame, tags: DataFrame, source: str, tag: str, name: str) -> DataFrame:
    """Names of each source's tags, in order."""
    return bridge.join(tags, tag).select(source, name).orderBy(source, name)


def enrich(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with what is known of their parent; those without stay."""
    return children.join(parents, key, "left")


def array_titles(rows: DataFrame, titles: DataFrame, key: str, ids: str, id_col: str, title: str) -> DataFrame:
    """Titles of an array of ids in its order; an id without a title stands for itself."""
    each = rows.select(key, F.posexplode(ids).alias("_at", id_col)).join(titles, id_col, "left")
    named = F.struct("_at", F.coalesce(title, id_col).alias("name"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"]).alias("titles"))


def nested_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Parents with an array of their children's ``fields``, by ``order``."""
    child = F.struct(order, *fields)
    return parents.join(children, key).groupBy(key).agg(F.array_sort(F.collect_list(child)).alias("children"))


def resolve_scope(sources: DataFrame, bridge: DataFrame, scope: dict, key: str = "source_id", tag: str = "tag_id") -> DataFrame:
    """Source ids of a scope: ``{"all": True}``, ``{"sourceIds": [...]}`` as given, or the distinct members of ``{"tagIds": [...]}``."""
    if scope.get("all"):
        return sources.select(key).distinct()
    if "sourceIds" in scope:
        return sources.sparkSession.createDataFrame([(x,) for x in scope["sourceIds"]], f"{key} {sources.schema[key].dataType.simpleString()}")
    return bridge.where(F.col(tag).isin(list(scope.get("tagIds", [])))).select(key).distinct()


def latest_per_key(df: DataFrame, key: str, *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


# --- changes: old table to new table ---


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and the distinct new rows whose keys it lacks."""
    return base.unionByName(new.dropDuplicates(list(keys)).join(base, list(keys), "left_anti"))


def batch_tag(existing: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """Associations that are missing of every given tag with every given source. ``tags`` is a caller's list, as many as its result
    repeats each source."""
    pairs = sources.distinct().crossJoin(broadcast_if_small(tags.distinct()))
    return pairs.join(existing, [*sources.columns, *tags.columns], "left_anti")


def normalised_url(url: Column) -> Column:
    """Trimmed, without slashes at the end."""
    return F.regexp_replace(F.trim(url), "/+$", "")


def create_once(rows: DataFrame, name: Column, order: str) -> DataFrame:
    """Of rows with one normalised name the first stays."""
    return latest_per_key(rows.withColumn("name_key", name), "name_key", F.asc(order))


def delete_keys(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key), key, "left_anti")


def replace_children(base: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced whole."""
    return base.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``delta`` wins over ``base`` by key; within ``delta`` the last by ``order``."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        delta = delta.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", order)
    return base.join(delta, list(keys), "left_anti").unionByName(delta)


def count_new(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys of ``delta`` the base lacks."""
    return delta.select(*keys).distinct().join(base, list(keys), "left_anti").agg(F.count("*").alias("n_new"))


def patch(base: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Partial update of one column: only rows present in ``changes`` (key, value) change, and null is a value."""
    c = changes.select(key, F.col("value").alias("_value"), F.lit(True).alias("_given"))
    return base.join(c, key, "left").withColumn(column, F.when(F.col("_given"), F.col("_value")).otherwise(F.col(column))).drop("_value", "_given")


def untag_titles(sources: DataFrame, key: str, title: str, now: Column) -> DataFrame:
    """``(key, title, updated_at)`` of rows whose title loses tags that were written into it, for :func:`upsert` or :func:`patch_columns`;
    rows that stay as they are don't appear. A title that was nothing but tags becomes empty."""
    bare = sources.select(key, title, tx.without_tags(F.col(title)).alias("_bare"))
    return bare.where(F.col("_bare") != F.col(title)).select(key, F.col("_bare").alias(title), now.alias("updated_at"))


def patch_columns(base: DataFrame, changes: DataFrame, key: str, given: str, order: str | None = None) -> DataFrame:
    """Partial update of several columns: of the rows in ``changes`` those columns change that its array ``given`` names, and null is a
    value; other names in it mean nothing. Of changes with one key the last by ``order`` counts, any one without it; a null key changes
    nothing."""
    last = latest_per_key(changes, key, F.desc(order)) if order else changes.dropDuplicates([key])
    columns = [c for c in base.columns if c != key and c in changes.columns]
    new = last.select(key, F.col(given).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    named = lambda c: F.coalesce(F.array_contains("_given", c), F.lit(False))
    return base.join(new, key, "left").select(*[F.when(named(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def cascade(tables: dict[str, DataFrame], edges: Sequence[tuple[str, str, str, str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete ``gone`` from ``root`` and what hangs on it. An edge is (parent, parent key, child, foreign key, action), in the order of
    the graph; the action is ``cascade`` or ``set null``."""
    lost = {root: tables[root].join(gone.select(key), key, "left_semi")}
    left = dict(tables) | {root: delete_keys(tables[root], gone, key)}
    for parent, parent_key, child, foreign, action in edges:
        if parent not in lost:
            continue
        keys = lost[parent].select(F.col(parent_key).alias(foreign)).distinct()
        if action == "cascade":
            hit = left[child].join(keys, foreign, "left_semi")
            lost[child] = lost[child].unionByName(hit) if child in lost else hit
            left[child] = left[child].join(keys, foreign, "left_anti")
        else:
            flagged = left[child].join(keys.withColumn("_gone", F.lit(True)), foreign, "left")
            left[child] = flagged.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).drop("_gone").select(*left[child].columns)
    return left


def append(base: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """``base`` and the new rows; columns that they lack are null, ``created_at`` and ``updated_at`` are ``now`` where the base has them."""
    stamped = new.withColumns({c: F.current_timestamp() if now is None else now for c in ("created_at", "updated_at") if c in base.columns and c not in new.columns})
    return base.unionByName(stamped.select(*[c for c in stamped.columns if c in base.columns]), allowMissingColumns=True)


def seed_if_untouched(table: DataFrame, presets: DataFrame, preset: str) -> DataFrame:
    """Presets replace a table that is empty or holds presets only; any row of a user's own keeps the table as it is. Which of both is
    decided by one number, joined to either side."""
    own = table.agg(F.count_if(~F.coalesce(F.col(preset), F.lit(False))).alias("_own"))  # one row
    kept = table.crossJoin(F.broadcast(own)).where("_own > 0").drop("_own")
    return kept.unionByName(presets.crossJoin(F.broadcast(own)).where("_own = 0").drop("_own"))


def match_skills(titles: DataFrame, skills: DataFrame, title: str, name: str, tags: str) -> DataFrame:
    """Pairs of a title and a skill whose name, or one of whose tags, the title without white space contains. Both meet by the first two
    characters of a name or tag, which the title must have; what meets is compared. An empty name or tag matches nothing."""
    bare = cut_lineage(titles.withColumns({"_bare": tx.strip_ws(F.col(title)), "_title": F.monotonically_increasing_id()}))
    terms = F.filter(F.array_distinct(F.concat(F.array(name), F.coalesce(F.col(tags), tx.none()))), lambda t: F.coalesce(t, F.lit("")) != "")
    own = cut_lineage(skills.withColumn("_skill", F.monotonically_increasing_id()))
    begins = own.select("_skill", F.explode(terms).alias("_term")).withColumn("_gram", F.left("_term", F.lit(2)))
    grams = F.array_distinct(F.concat(tx.pairs(F.col("_bare")), F.regexp_extract_all("_bare", F.lit("(?s)."), F.lit(0))))
    met = bare.select("_title", "_bare", F.explode(grams).alias("_gram")).join(begins, "_gram").where(F.contains("_bare", F.col("_term")))
    return met.select("_title", "_skill").distinct().join(bare.drop("_bare"), "_title").join(own, "_skill").drop("_title", "_skill")


def valid_ids(rows: DataFrame, valid: DataFrame, key: str, ids: str, id_col: str) -> DataFrame:
    """``(key, ids)``: the ids that exist, each once, in order of first appearance."""
    each = rows.select(key, F.posexplode(ids).alias("_at", id_col)).groupBy(key, id_col).agg(F.min("_at").alias("_at"))
    good = each.join(valid.select(id_col).distinct(), id_col, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", id_col))).alias("_ids"))
    return rows.select(key).join(good, key, "left").select(key, F.coalesce(F.transform("_ids", lambda x: x[id_col]), F.array().cast(rows.schema[ids].dataType)).alias(ids))


def apply_settings(changes: DataFrame, key: str, value: str, order: str, valid: Column) -> DataFrame:
    """``(key, value)`` after all changes: the last valid one of each key; a null value clears the key."""
    last = latest_per_key(changes.where(F.col(value).isNull() | valid), key, F.desc(order))
    return last.where(F.col(value).isNotNull()).select(key, value)


def legacy_files(sources: DataFrame) -> DataFrame:
    """Imported files that lie outside the workspace and still have a place."""
    return sources.where((F.col("kind") == "file") & ~F.coalesce(F.col("workspace"), F.lit(False)) & F.col("file_path").isNotNull())


def _swap_paths(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, fresh, old = (hadoop.Path(path + end) for end in ("", "._next", "._old"))
    return here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), here, fresh, old


def recover(spark, path: str) -> bool:
    """Finish or undo a swap that was interrupted, and say whether there is a table. Between both renames the table lies beside its
    place, under the old name."""
    fs, here, _, old = _swap_paths(spark, path)
    if not fs.exists(here) and fs.exists(old) and not fs.rename(old, here):
        raise OSError(f"cannot restore {path}")
    return fs.exists(here)


def save_next(df: DataFrame, path: str) -> None:
    """Write a table's next state beside it and swap it in by renames of the file system that holds it. A crash leaves the old state or
    the new one, after :func:`recover`."""
    spark = df.sparkSession
    fs, here, fresh, old = _swap_paths(spark, path)
    there = recover(spark, path)
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if there and not fs.rename(here, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, here):
        raise OSError(f"cannot move the next state of {path} in")
    fs.delete(old, True)
