"""Cutting lineage so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.sources import files


def settled(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the folder that the cluster names in spark.checkpoint.dir and read it back, so later jobs start from files that any executor sees."""
    return files.settled(df)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
