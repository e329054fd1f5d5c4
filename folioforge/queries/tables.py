"""Reading the driver's tables, and literal fixtures as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A table in a SQL text for both engines.
TABLE = re.compile(r"\{(documents|pages|orders|lineitem|events|conversations|nation|region|supplier|customer|part|labels|benchmark|embeddings)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sql_values: str, columns: str) -> DataFrame:
    """Literal rows; the same text serves both engines."""
    return spark.sql(f"SELECT * FROM VALUES {sql_values} AS t({columns})")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that a SQL text makes of the driver's tables, which it names in braces."""
    return spark.sql(TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def duck(sql: str) -> str:
    """The same text with plain table names."""
    return TABLE.sub(r"\1", sql)
