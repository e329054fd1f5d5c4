"""A corpus from ``documents``: language ID, line dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.llm import bpe, langid, linededup, mixing, simhash
from folioforge.llm.batches import identified, unpacked
from folioforge.plans.lineage import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Documents in no language, those without a letter, go; of the others, ``lang`` is the language found. The network
    learns from the labelled documents outside the held-out fifth; if there are none, nothing is known and all rows stay as they are."""
    model = langid.train(docs.where(~langid.held_out()))
    if model is None:
        return docs
    return unpacked(langid.predicted(docs, model, docs.columns).where(F.col("lang_pred") != langid.UNKNOWN), docs, lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Of lines that repeat or resemble each other one stays; documents stay, with what is left of their text."""
    found = linededup.dedup_lines(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[n_chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Of each group of near-duplicates the document with the smallest id stays, of those with one id or none the
    smallest by hash, and one without an id only if none has one. Rows that are equal in all columns are one document."""
    rows = identified(docs)
    own = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "_row", "_row2").alias("id")
    kept = simhash.near_duplicates(rows.select(own, "row.text"), "id").where("id <=> component_id").select("id._row", "id._row2").distinct()
    return unpacked(rows.join(kept, ["_row", "_row2"]).dropDuplicates(["_row", "_row2"]), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Documents repeat, go, or are cut at the end of a run, as the targets of their sources ask."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return mixing.mixed_texts(docs).select(*[n_chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Tokens of every text that the mix took, and whether they decode to the text again: ``(doc_id, source, lang, n_tokens,
    ids, exact)``, a row for each row. A null text is empty and has no tokens; for it ``exact`` is null. Other columns, the text among
    them, are left out."""
    path, pattern = bpe.public_ranks()
    found = bpe.decode(bpe.encode(docs.select(F.struct("doc_id", "source", "lang", F.sha2("text", 256).alias("sha")).alias("row"), "text"), path, pattern, key="row"), path, pattern, key="row")
    return found.select("row.doc_id", "row.source", "row.lang", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.sha2("raw", 256) == F.col("row.sha")).alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: The network's, the fingerprints' and the tokenizer's results aren't expressible in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them rows are kept as Parquet in the folder of ``spark.checkpoint.dir``. What a stage has
    read is deleted once its own rows are written; the last stage's stay for the caller to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, last = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        last = at
    return docs
