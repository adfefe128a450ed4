"""Relational schemas as tables of columns: from a definitions log, a saved file or a database's catalogs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

SAVED = "tables array<struct<schema: string, name: string, is_view: boolean, columns: array<struct<name: string, sql_type: string, nullable: boolean>>>>"
CATALOG = """(SELECT c.table_schema AS schema, c.table_name AS name, t.table_type = 'VIEW' AS is_view, c.column_name AS column, c.data_type AS sql_type, c.is_nullable = 'YES' AS nullable
FROM information_schema.columns c JOIN information_schema.tables t USING (table_schema, table_name) WHERE c.table_schema NOT IN ('pg_catalog', 'information_schema')) AS q"""


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """(schema, name, is_view, column, sql_type, nullable) of a saved schema; a damaged or missing file is none."""
    if not os.path.exists(path):
        return None
    rows = spark.read.schema(SAVED).json(path, multiLine=True).select(F.explode("tables").alias("t"))
    flat = rows.select("t.schema", "t.name", "t.is_view", F.explode("t.columns").alias("c")).select("schema", "name", "is_view", F.col("c.name").alias("column"), "c.sql_type", "c.nullable")
    return None if flat.isEmpty() else flat


def live(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """The same of a PostgreSQL database, read only and for at most thirty seconds; its driver must be there."""
    own = {"driver": "org.postgresql.Driver", "sessionInitStatement": "SET default_transaction_read_only = on; SET statement_timeout = 30000"} | properties
    return spark.read.jdbc(url, CATALOG, properties=own)


def drift(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, column, problem): what a database lacks, has besides, or has otherwise; bookkeeping tables are ignored."""
    from ..operators import diff

    own = lambda df: df.select("schema", F.col("name").alias("table"), "column", F.struct(C.normalize_sql_type("sql_type").alias("type"), "nullable").alias("type"))
    full = lambda df: df.select(F.col("table"), F.concat_ws(".", "schema", "table", "column").alias("column"), "type")
    return diff.drift(full(own(desired)), full(own(actual)))
