"""Sources and sinks. Schemas are declared, never inferred; every path goes through Spark's readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of the cluster (spark.checkpoint.dir). Only where all runs in one process may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base}/tessera-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df as Parquet in the shared folder, read back: later jobs start from files, so a lost executor costs a re-read."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header row; only the columns that are asked for later are parsed. Empty cells are nulls."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header row; bom marks the file as UTF-8 for spreadsheet programs by a first column name that begins with U+FEFF."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def resolved(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The wanted columns, each from the first of its names that the table has (case and a byte-order mark don't matter); null where none is there."""
    have = {c.lstrip("﻿").lower(): c for c in df.columns}
    return df.select(*[next((df[have[n.lower()]] for n in names if n.lower() in have), F.lit(None).cast("string")).alias(name) for name, names in wanted.items()])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def found_records(docs: DataFrame, document: str, query_keys: list[str], table_keys: list[str], depth: int = 8) -> DataFrame:
    """(query, tables array<string>) of all objects of JSON texts, down to a depth, that have a query-like and a tables-like key (any case) and a query.

    Tables are a list of names, a list of objects with a table, en or name, or one text with commas, bars, semicolons or blanks between them.
    Each level is one explode of the level before; texts that aren't JSON have no records.
    """
    level = docs.select(F.try_parse_json(document).alias("node")).where("node is not null").withColumn("id", F.monotonically_increasing_id())
    wanted, rows = [k.lower() for k in [*query_keys, *table_keys]], []
    for _ in range(depth + 1):
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer())).select("id", F.lower("key").alias("name"), F.col("value").alias("node"))
        rows.append(inner.where(F.col("name").isin(*wanted)))
        level = inner.where(F.schema_of_variant("node").rlike("^(ARRAY|OBJECT)")).select("node", F.monotonically_increasing_id().alias("id"))
    pick = lambda names: F.coalesce(*[F.max(F.when(F.col("name") == n, F.to_json("node"))) for n in names])
    found = [r.groupBy("id").agg(pick(query_keys).alias("query"), pick(table_keys).alias("tables")) for r in rows]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    plain = lambda x: F.get_json_object(F.concat(F.lit('{"x":'), x, F.lit("}")), "$.x")
    names = F.transform(F.from_json("tables", "array<string>"), lambda e: F.when(e.startswith("{"), F.coalesce(*[F.get_json_object(e, f"$.{k}") for k in ("table", "en", "name")])).otherwise(e))
    names = F.when(F.col("tables").startswith("["), names).otherwise(F.split(plain(F.col("tables")), r"[,，|;\s]+"))
    clean = F.filter(F.transform(names, lambda e: F.trim(e)), lambda e: e.isNotNull() & (e != ""))
    return out.where("query is not null and tables is not null").select(F.trim(plain(F.col("query"))).alias("query"), clean.alias("tables")).where("query <> ''")


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, behind what is there."""
    rows.write.mode("append").json(path)


def nested_as_text(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that don't have them."""
    deep = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(deep) else F.col(c) for c, kind in df.dtypes])


def overwrite_keys(new: DataFrame, path: str, key: str) -> None:
    """Replaces only those partitions of the table at path that new has rows of; columns that either lacks are filled with nulls by readers."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def merged_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key new doesn't have, and all new ones; missing columns are nulls."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cache_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of the parts as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def split_by_cache(calls: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answered calls with their value, calls that aren't in the cache yet)."""
    return calls.join(cache, key), calls.join(cache.select(key), key, "left_anti").dropDuplicates([key])
