"""Files as a source: recursive scan, fingerprints, and text by format.

Spark lists and reads the files; a parser is a small function from bytes to text, and a file that can't be parsed stays as a row
with an error code.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.operators import cdc
from folioforge.plans.lineage import cut_lineage
from folioforge.sources.sheets import cells

Parser = Callable[[bytes], str]


def parse_docx(data: bytes) -> str:
    """Paragraphs of a Word document, one a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def parse_xlsx(data: bytes) -> str:
    """A line for each sheet's name, then one for each cell that shows something."""
    out, now = [], None
    for sheet, row, column, text in cells(data):
        if sheet != now:
            out.append(f"【工作表：{sheet}】")
            now = sheet
        out.append(f"第{row}行第{column}列：{text}")
    return "\n".join(out)


#: Parsers by format; others (pdf, ole, image) are given by the caller.
PARSERS: dict[str, Parser] = {"text": lambda b: b.decode("utf-8", "replace"), "docx": parse_docx, "sheet": parse_xlsx}


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """``(path, mtime, size[, content, hash])`` of the supported files below a folder. Without content the files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(~cdc.ignored(F.col("path")) & cdc.extension(F.col("path")).isin(*cdc.SUPPORTED))
    light = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    return light.withColumn("hash", F.sha2("content", 256)) if content else light


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, mtime, size, content, hash)`` of the files named, and of no others. Paths are names, not patterns."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    files = spark.read.format("binaryFile").load(plain) if plain else spark.createDataFrame([], kinds)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("hash"))


def screened(spark: SparkSession, folder: str, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A folder against its ``known`` files (path, mtime, size, hash), opening only those that are new or whose time or size is another.

    Returns the changes, ``(path, change, new_path)``, where a file that was touched but holds what it held is ``touched``; and the files
    that were opened, as :func:`read_files` gives them. The names of files to open pass through the driver, where Spark's own list of the
    folder lies.
    """
    light = scan(spark, folder, content=False)
    known = light.withColumn("hash", F.lit("")).limit(0) if known is None else known
    states = cut_lineage(cdc.screen(known, light))
    opened = read_files(spark, [r.new_path for r in states.where("state = 'open'").select("new_path").collect()])
    name = lambda df: df.select(cdc.norm_path(F.col("path")).alias("_p"), "hash")
    met = states.join(name(known).withColumnRenamed("hash", "_old"), F.col("path") == F.col("_p"), "left").drop("_p")
    met = met.join(name(opened).withColumnRenamed("hash", "_new"), F.col("path") == F.col("_p"), "left").drop("_p")
    change = F.when(F.col("state") != "open", F.col("state")).when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_new"), "touched").otherwise("changed")
    return met.select("path", change.alias("change"), "new_path"), opened


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``(path, hash, text, error_code)`` of :func:`scan`'s files."""
    known = PARSERS | (parsers or {})
    kind = F.when(cdc.parser_of(F.col("path")).isin("wps", "doc", "docx"), cdc.container_of(F.col("content"))).otherwise(cdc.parser_of(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, digest, k, data in zip(rows["path"], rows["hash"], rows["kind"], rows["content"]):
                text, error = None, None
                if k not in known:
                    error = "PARSE_UNSUPPORTED"
                else:
                    try:
                        text = known[k](bytes(data))
                    except Exception:  # noqa: BLE001  whatever a parser raises is this file's error
                        error = "PARSE_FAILED"
                out.append((path, digest, text, error))
            yield pd.DataFrame(out, columns=["path", "hash", "text", "error_code"])

    return files.withColumn("kind", kind).select("path", "hash", "kind", "content").mapInPandas(run, "path string, hash string, text string, error_code string")
