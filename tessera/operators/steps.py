"""Steps that run only if what they read has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.versions import Change, Store


@dataclass(frozen=True)
class Step:
    """inputs are folders or files, or names of earlier steps; work makes the step's table of them, in that order."""

    name: str
    inputs: list[str]
    work: Callable[..., DataFrame]


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, bytes, print): a hash of path, size and modification time of all files under a path. Files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/[._][^/]*(/|$)"))
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("double")).cast("decimal(38,0)")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("print"))


def run_dirty(spark: SparkSession, path: str, steps: list[Step], read: Callable[[str], DataFrame] | None = None) -> list[tuple[str, bool]]:
    """(step, ran) in order. A step runs if it has no table yet or a fingerprint of its inputs differs from the one it last ran with; a step's own
    table counts by the version that wrote it. Table and fingerprint change in one commit of the store at path, so a run that breaks off is taken up where it was."""
    store, read, out = Store(spark, path), read or spark.read.parquet, []
    made = {s.name for s in steps}
    for step in steps:
        base = store.version()
        known = store.manifest(base)

        def now(source: str) -> str:
            if source in made:
                return ",".join(known[source]["commits"])
            return "/".join(map(str, fingerprint(spark, source).first()))

        seen = [(i, source, now(source)) for i, source in enumerate(step.inputs)]
        old = [] if f"{step.name}.inputs" not in known else [tuple(r) for r in store.read(f"{step.name}.inputs", base).orderBy("place").collect()]  # one row an input
        ran = step.name not in known or old != seen
        if ran:
            table = step.work(*[store.read(s, base) if s in made else read(s) for s in step.inputs])
            prints = spark.createDataFrame(seen, "place int, source string, print string")
            store.commit(base, {step.name: Change(table), f"{step.name}.inputs": Change(prints)})
        out.append((step.name, ran))
    return out
