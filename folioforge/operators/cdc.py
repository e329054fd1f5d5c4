"""Change data capture between a library table and a snapshot of its folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Folders and endings that a scan passes over; extensions that can be read.
IGNORED_DIRS = r"\.git|\.idea|\.vscode|\.vs|node_modules|__pycache__|\.DS_Store"
SUPPORTED = ("pdf", "docx", "doc", "wps", "xls", "xlsx", "txt", "md", "png", "jpg", "jpeg", "bmp")


def norm_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def ignored(path: Column) -> Column:
    """Whether a scan passes over the path: an ignored folder anywhere, a hidden or temporary file name."""
    p = F.translate(path, "\\", "/")
    return p.rlike(rf"(^|/)({IGNORED_DIRS})(/|$)") | p.rlike(r"(^|/)(\.|~\$)[^/]*$") | p.rlike(r"(~|\.tmp|\.bak|\.swp)$")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def parser_of(path: Column) -> Column:
    """Which parser reads a file, by extension; null if none does."""
    e = extension(path)
    return (
        F.when(e.isin("txt", "md"), "text").when(e.isin("png", "jpg", "jpeg", "bmp"), "image").when(e.isin("xls", "xlsx"), "sheet")
        .when(e.isin("pdf", "docx", "doc", "wps"), e)
    )


def container_of(head: Column) -> Column:
    """What a document file really is, by its first four bytes."""
    h = F.hex(F.substring(head, 1, 4))
    return F.when(h == "504B0304", "docx").when(h == "D0CF11E0", "ole").otherwise("PARSE_UNSUPPORTED")


def diff(old: DataFrame, new: DataFrame, path: str = "path", content: str = "hash") -> DataFrame:
    """``(path, change, old_hash, new_hash)``: added, changed, removed or same, by normalised path. One full outer join."""
    a = old.select(norm_path(F.col(path)).alias("_p"), F.col(content).alias("old_hash"))
    b = new.select(norm_path(F.col(path)).alias("_p"), F.col(content).alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    )
    return a.join(b, "_p", "full_outer").select(F.col("_p").alias("path"), change.alias("change"), "old_hash", "new_hash")


def screen(known: DataFrame, light: DataFrame, path: str = "path", stamp: Sequence[str] = ("mtime", "size")) -> DataFrame:
    """``(path, state, new_path)``: what a scan that opened no file says of each path, by its ``stamp``: ``removed``, ``same`` where the
    stamp is the known one, else ``open``: new, or touched, so that only its content can tell. One full outer join of short rows."""
    a = known.select(norm_path(F.col(path)).alias("_p"), F.struct(*stamp).alias("_old"))
    b = light.select(norm_path(F.col(path)).alias("_p"), F.col(path).alias("new_path"), F.struct(*stamp).alias("_new"))
    state = F.when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("open")
    return a.join(b, "_p", "full_outer").select(F.col("_p").alias("path"), state.alias("state"), "new_path")


def moves(changes: DataFrame) -> DataFrame:
    """``(hash, old_path, new_path)``: a path that vanished and one that came with the same content, paired in path order."""
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = changes.where("change = 'removed'").select(F.col("old_hash").alias("hash"), F.col("path").alias("old_path"), nth("old_hash").alias("_n"))
    came = changes.where("change = 'added'").select(F.col("new_hash").alias("hash"), F.col("path").alias("new_path"), nth("new_hash").alias("_n"))
    return gone.join(came, ["hash", "_n"]).drop("_n")


def safe_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """``files`` with ``safe_name``: no illegal characters, never empty, and `` (n)`` before the extension from the second of equal names on."""
    bare = F.trim(F.regexp_replace(F.col(name), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    rows = files.withColumn("_safe", F.coalesce(F.nullif(bare, F.lit("")), F.lit("未命名")))
    nth = F.row_number().over(Window.partitionBy(F.lower("_safe")).orderBy(order))
    stem, end = F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("_n", nth).withColumn("safe_name", F.when(F.col("_n") == 1, F.col("_safe")).otherwise(F.concat(stem, F.lit(" ("), (F.col("_n") - 1).cast("string"), F.lit(")"), end))).drop("_safe", "_n")
