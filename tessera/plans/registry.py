"""Where queries register, and small vocabularies as tables for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function (spark, sf_dir) under its name, with SQL for the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_in_order(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table with the place of each row: its file (`_file`) and its number there (`_row`), the order in which one thread of DuckDB reads it."""
    return read(spark, sf_dir, table).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return str(x)


class Vocabulary:
    """A table that both engines get: frame() for Spark, cte() for DuckDB.

    Some rows are written down; `grown` adds rows that follow the test tables, as a function (spark, sf_dir) and the same in SQL. Without
    sf_dir, or with base, a table is the written rows only.
    """

    def __init__(self, name: str, schema: str, rows: list[tuple], grown: tuple[Callable[[SparkSession, str], DataFrame], str] | None = None) -> None:
        self.name, self.schema, self.rows, self.grown = name, schema, rows, grown

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        base = spark.createDataFrame(self.rows, self.schema)
        if not self.grown or sf_dir is None:
            return base
        return base.unionByName(self.grown[0](spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema]))

    def cte(self, base: bool = False) -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]", "boolean": "BOOLEAN"}
        columns = [c.strip().split(" ", 1) for c in self.schema.split(",")]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        written = f"select {', '.join(f'cast(c{i} as {kinds[k]}) as "{n}"' for i, (n, k) in enumerate(columns))} from (values {rows}) v({', '.join(f'c{i}' for i in range(len(columns)))})"
        more = f" union all select {', '.join(f'cast("{n}" as {kinds[k]}) as "{n}"' for n, k in columns)} from ({self.grown[1]}) more" if self.grown and not base else ""
        return f"{self.name} as ({written}{more})"
