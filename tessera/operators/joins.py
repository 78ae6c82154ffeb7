"""Joins with overlays, bridges and fall-backs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import settled

#: A side of up to so many rows is sent to all tasks.
SMALL = 100_000
#: About so many rows of a class, of either side, meet in one task.
BLOCK = 2_048
#: About so many pairs are put out by a task, if its cells can be dealt out so: writing them takes most of the time.
PAIRS = 2_097_152


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df marked for broadcasting if its rows are counted and few; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def all_pairs(left: DataFrame, right: DataFrame, most: int = SMALL, by: list[str] | None = None) -> DataFrame:
    """Each row of left with each of right, for a right side that is a vocabulary. Left is dealt out before, since it may be few rows that give very many; by its columns `by`, if given, so that
    what groups the pairs by these needs no other exchange. Beyond `most` rows of right both are dealt into blocks."""
    if right.count() <= most:
        return left.repartition(_tasks(left), *(by or [])).join(F.broadcast(right))
    whole = left.sparkSession.createDataFrame([(0, 0)], "_left long, _right long")
    zero = F.lit(0).cast("long")
    return expanded(whole, left.withColumn("_left", zero), right.withColumn("_right", zero))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def classed(rows: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a number `name` in place of the columns by, the distinct values of by with their numbers)."""
    rows = settled(rows)
    classes = settled(rows.select(*by).distinct().withColumn(name, F.monotonically_increasing_id()))
    return rows.join(small(classes), by).drop(*by), classes


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row of left (_left, ...) with each of right (_right, ...) whose classes are a pair: pairs is (_left, _right, ...), each once.

    Members of a class are dealt into blocks of about `block` rows by a hash, on both sides, and each two blocks of a pair of classes meet in a cell. So a task
    holds few rows however large classes are, and their number follows that of the cells and of the pairs.
    """
    many = lambda side, key, at: side.groupBy(key).agg(F.count("*").alias(f"_rows_{at}")).withColumn(f"_blocks_{at}", F.ceil(F.col(f"_rows_{at}") / block).cast("long"))
    cells = settled(pairs.join(many(left, "_left", "l"), "_left").join(many(right, "_right", "r"), "_right").withColumn("_pair", F.monotonically_increasing_id()))
    both = lambda name: F.coalesce(F.sum(F.col(f"{name}_l") * F.col(f"{name}_r")), F.lit(0))
    n, met, rows = cells.agg(F.count("*"), both("_blocks"), both("_rows")).first()
    tasks = min(max(_tasks(left), met // 4, rows // PAIRS), 20_000)
    cells, at = F.broadcast(cells) if n <= SMALL else cells, ["_pair", "_cell_l", "_cell_r"]  # numbers of pairs, since a class that is a literal would leave the keys of the join, and all be dealt out anew
    extra = [c for c in pairs.columns if c not in ("_left", "_right")]

    def dealt(side: DataFrame, key: str, mine: str, other: str, more: list[str]) -> DataFrame:
        own = F.pmod(F.xxhash64(*side.columns), F.col(f"_blocks_{mine}")).alias(f"_cell_{mine}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_blocks_{other}") - 1)).alias(f"_cell_{other}")
        rows = side.join(cells, key).select("_pair", own, every, *more, *[c for c in side.columns if c != key])
        return rows.repartition(tasks, *at)

    a, b = dealt(left, "_left", "l", "r", extra), dealt(right, "_right", "r", "l", [])
    return a.join(b.hint("merge"), at).drop(*at)


def with_usage(catalog: DataFrame, usage: DataFrame, keys: list[str], fan_out: bool = False) -> DataFrame:
    """Usage beside each column of the catalogue. Repeated usage rows are added up first, unless fan_out asks for a row each."""
    if not fan_out:
        usage = usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in usage.columns if c not in keys])
    return catalog.join(usage, keys, "left")


def overlaid(results: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Results with their reviews; reviews of columns without results stay, as rows of their own."""
    return results.join(reviews, keys, "full")


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A dictionary join: one row a key is kept, the least value, and what it lacks gets the default."""
    one = lookup.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def bridged(columns: DataFrame, bridge: DataFrame, slots: DataFrame) -> DataFrame:
    """Each column with every slot of every topic that its table belongs to. Topics without slots vanish, before columns are joined: one may have most of the tables."""
    return columns.join(bridge.join(slots, "vt_id"), "table")


def filled(references: DataFrame, library: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """References with the library's metadata where their own is missing."""
    side = library.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return references.join(side, key, "left").select(key, *[c for c in references.columns if c != key and c not in columns], *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def group_pairs(df: DataFrame, by: list[str], key: str, payload: list[str]) -> DataFrame:
    """All pairs a < b of rows of the same group, each once, with both payloads."""
    a = df.select(*by, F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in payload])
    b = df.select(*by, F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in payload])
    return a.join(b, by).where("a < b")


def sharing_pairs(members: DataFrame, key: str, shared: str) -> DataFrame:
    """(a, b) of the keys that have any member in common, each pair once. Keys with the same members are a class, classes that share one are paired, and their keys then
    meet block by block, so nothing has to be made distinct afterwards."""
    sets = members.groupBy(key).agg(F.array_sort(F.collect_set(shared)).alias("_set")).where(F.size("_set") > 0)
    rows, classes = classed(sets, ["_set"], "_class")
    each = classes.select("_class", F.explode("_set").alias("_one"))
    pairs = each.withColumnRenamed("_class", "_left").join(each.withColumnRenamed("_class", "_right"), "_one").select("_left", "_right").distinct()
    return expanded(pairs, rows.toDF("a", "_left"), rows.toDF("b", "_right")).where("a < b").select("a", "b")
