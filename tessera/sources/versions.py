"""Tables in versions: an edit of several tables is put in place whole or not at all, and of two edits of the same version one has to try again.

A store is a folder. `commits/<id>/<table>` holds the rows that a commit wrote and `commits/<id>/<table>.keys` the keys whose earlier rows it replaces;
files are never changed. `versions/<number>.json` names the commits that make up each table; it is a small file that appears under its name in one
step, and only if that name is free.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


#: Folders that the rows of a keyed table are dealt into by a hash of the key, unless a change says otherwise.
PARTS = 32


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class Conflict(Exception):
    """Another commit has the version that this one was to become."""


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: without a key, rows are the whole table from now on; with one, they replace all rows of the keys that `keys` (or rows) have.

    A new keyed table takes its number of folders from `parts`.
    """

    rows: DataFrame
    key: str | None = None
    keys: DataFrame | None = None
    parts: int = PARTS


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last version, 0 before the first commit."""
        folder = self._paths(f"{self.path}/versions")
        if not self._files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        rows = self.spark.read.text(f"{self.path}/versions/{version:08d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0].value)

    def read(self, table: str, version: int | None = None, only: list | None = None) -> DataFrame:
        """The table as of a version, the last one by default. Rows of a key are those of the last commit that replaced it. With `only`, just these keys, from their folders alone."""
        manifest = self.manifest(self.version() if version is None else version)
        if table not in manifest:
            raise ValueError(f"no table {table} in version {version}")
        about = manifest[table]
        schema, key = StructType.fromJson(about["schema"]), about["key"]
        names = schema.names
        out, later = None, None
        for commit in reversed(about["commits"]):
            rows = self.spark.read.schema(StructType([*schema.fields, StructField("__part", IntegerType())]) if key else schema).parquet(f"{self.path}/commits/{commit}/{table}")
            if only is not None:
                same = [(F.col(key).eqNullSafe(F.lit(k)) & (F.col("__part") == part_of(F.lit(k).cast(schema[key].dataType), about["parts"]))) for k in only]
                rows = rows.where(reduce(or_, same, F.lit(False)))
            rows = rows.select(*names)
            if later is not None:
                rows = rows.join(later, rows[key].eqNullSafe(later["_key"]), "left_anti")
            out = rows if out is None else out.unionByName(rows)
            if key:
                kind = schema[key].dataType.simpleString()
                gone = self.spark.read.schema(f"_key {kind}").parquet(f"{self.path}/commits/{commit}/{table}.keys")
                later = gone if later is None else later.unionByName(gone).distinct()
        return out

    def commit(self, base: int, changes: dict[str, Change]) -> int:
        """Puts all changes in place as version base + 1, or raises Conflict and leaves no trace if that version is there. A table keeps its first key and schema until it is replaced whole."""
        name, manifest = uuid.uuid4().hex, self.manifest(base)
        for table, change in changes.items():
            old = manifest.get(table)
            if change.key is not None and old is not None and old["key"] == change.key:
                schema = StructType.fromJson(old["schema"])
                commits, parts = [*old["commits"], name], old["parts"]
            else:
                schema, commits, parts = change.rows.schema, [name], change.parts
            rows = change.rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            where = f"{self.path}/commits/{name}/{table}"
            if change.key is None:
                rows.write.parquet(where)
            else:
                # A file a folder, more where it has very many rows.
                key = F.col(change.key).cast(schema[change.key].dataType)
                rows.withColumn("__part", part_of(key, parts)).hint("rebalance", "__part").write.partitionBy("__part").parquet(where)
                keys = rows if change.keys is None else change.keys
                keys.select(key.alias("_key")).distinct().write.parquet(f"{where}.keys")
            manifest[table] = {"key": change.key, "parts": parts, "schema": schema.jsonValue(), "commits": commits}
        try:
            self._publish(base + 1, json.dumps(manifest), name)
        except Conflict:
            self._files.delete(self._paths(f"{self.path}/commits/{name}"), True)
            raise
        return base + 1

    def edit(self, work: Callable[[Callable[..., DataFrame]], dict[str, Change]], tries: int = 10) -> int:
        """Commits what work makes of the tables as they are; if another edit comes first, work is done again on its outcome. Gives the version."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.commit(base, work(lambda table, only=None: self.read(table, base, only)))  # noqa: B023
            except Conflict:
                continue
        raise Conflict(f"{tries} other edits came first")

    def _publish(self, version: int, text: str, name: str) -> None:
        """The manifest is written beside its place and moved there in one step that fails if something is there: a hard link on local disks, a rename without overwriting on others."""
        final = f"{self.path}/versions/{version:08d}.json"
        draft = self._paths(f"{self.path}/versions/.{name}")
        out = self._files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._files.getUri().getScheme() == "file":
                local = self._files.makeQualified(draft).toUri().getPath()
                os.link(local, self._files.makeQualified(self._paths(final)).toUri().getPath())
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._paths(final).toUri(), self.spark._jsc.hadoopConfiguration())
                no = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, self._paths(final), no)
        except FileExistsError as e:
            raise Conflict(f"version {version} is there") from e
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} is there") from e
            raise
        finally:
            if self._files.exists(draft):
                self._files.delete(draft, False)
