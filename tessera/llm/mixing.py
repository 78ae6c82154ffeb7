"""Mixing sources to target weights by a time-varying curriculum. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.durable import settled

#: A document is in one of so many slices of its source, by a hash. Prefix sums go slice by slice, so no task gets a whole source.
SLICES = 4096
#: Weight schedules as (time, weight) knots with straight lines between, times from 0 to 1. The means over time are 5, 2 and 1.
SCHEDULES = (((0.0, 7.0), (0.5, 5.0), (1.0, 3.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    """What a schedule adds up to from time 0 to time 1."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the schedule's running integral has reached the given share of its total; solves the quadratic of the right segment."""
    total, done, arms = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.greatest(share * total - done, F.lit(0.0))
        at = (rest / w0 if w0 else F.lit(0.0)) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        arms.append(((done + area) / total, F.least(F.lit(t0) + at, F.lit(t1))))
        done += area
    out = arms[-1][1]
    for end, at in reversed(arms[:-1]):
        out = F.when(share <= end, at).otherwise(out)
    return out


def _timed(knots: tuple[tuple[float, float], ...]) -> Callable[[Column], Column]:
    return lambda share: inverse(share, knots)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, schedules: tuple = SCHEDULES, cap: float = 3.0) -> DataFrame:
    """From (source, source_size): the weight's place in schedules and the target of each source; the targets share the total.

    Sources in code point order, null last, take the schedules in turn. No target is above cap times its source's size: sources are capped in
    order of cap * size / weight, until the level that the rest reach is below the next one's cap. One row a source, so its window is small.
    """
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    rows = sizes.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    rows = rows.withColumn("weight", F.element_at(weights, (F.col("turn") + 1).cast("int"))).withColumn("level", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    left = F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("water", left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("water", F.max("water").over(all_rows))
    # The level rises while the sources before it are rightly capped and falls afterwards, so the highest one holds.
    return rows.select(
        *([x for x in ("name", "source") if x in sizes.columns]), "turn", "source_size", F.when(F.col("level") <= F.col("water"), cap * F.col("source_size")).otherwise(F.col("weight") * F.col("water")).alias("target")
    )


def mix_sources(docs: DataFrame, schedules: tuple = SCHEDULES, cap: float = 3.0, seed: int = 17, slices: int = SLICES, carry: bool = False, ordered: bool = True) -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, taken, positions) of every row of docs, in training order.

    Within its source a document has a place by a seeded hash. The source takes its documents in that order, over and over, until it has its
    target of words; so each document is taken the same number of times or once more, and one may be taken in part. positions has the
    training position (0 to 1) at which each of its copies begins: the time when the source's integrated schedule has asked for the words
    before it. Rows come range-partitioned by first position; those that aren't taken come last.

    carry adds the input row as the struct `row`. Without it, rows with equal id, text and source are one entry with a number until the end.

    Null text or text without words: size 0, taken 0, no position. A null source is a source, and comes last. Null ids and repeated rows are
    rows as any other; equal ones are interchangeable. Columns other than doc_id, text and source are ignored. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.lit(seed), "doc_id", text)
    name = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))  # a key without nulls, so that sums, windows and joins share one shuffle
    rows = docs.select("doc_id", "source", name.alias("name"), key.alias("digest"), F.pmod(key, F.lit(slices)).alias("slice"), word_count(F.col("text")).alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    if carry:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    else:
        rows = settled(rows.groupBy("doc_id", "source", "name", "digest", "slice", "size").agg(F.count("*").alias("times")))
    parts = settled(rows.groupBy("name", "slice").agg(F.sum(F.col("size") * F.col("times")).alias("slice_size"), F.first("source").alias("source")))
    whole = Window.partitionBy("name")
    parts = parts.withColumn("source_size", F.sum("slice_size").over(whole)).withColumn("ahead", F.sum("slice_size").over(whole.orderBy("slice")) - F.col("slice_size"))
    sizes = parts.groupBy("name").agg(F.max("source_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, schedules, cap).select("name", "turn", "target")
    parts = parts.join(targets, "name").select("name", "slice", "source_size", "ahead", "turn", "target")

    within = Window.partitionBy("name", "slice").orderBy("digest", "doc_id", "size")
    whole_size = F.col("size") * F.col("times")
    rows = rows.withColumn("before", F.sum(whole_size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - whole_size)
    rows = rows.join(parts, ["name", "slice"])
    if not carry:
        rows = rows.withColumn("turn_of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("before", F.col("before") + F.col("turn_of") * F.col("size"))
    rows = rows.withColumn("before", F.col("before") + F.col("ahead"))

    want = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    more = F.least(F.greatest(want - passes * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("taken", passes * F.col("size") + more)
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    starts = F.transform(F.slice(F.array(*[F.lit(i) for i in range(int(-(-cap // 1)))]), 1, copies), lambda i: (i * F.col("source_size") + F.col("before")) / F.greatest(want, F.lit(1)))
    placed = starts
    for turn, knots in enumerate(schedules):
        placed = F.when(F.col("turn") == turn, F.transform(starts, _timed(knots))).otherwise(placed)
    out = rows.select("doc_id", "source", "digest", "size", "source_size", "target", "taken", placed.alias("positions"), *(["row"] if carry else []))
    if not ordered:
        return out
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return out.repartitionByRange(first.alias("first"), F.col("digest")).sortWithinPartitions(first, "digest")


def training_rows(docs: DataFrame, schedules: tuple = SCHEDULES, cap: float = 3.0) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them (to the nearest whole number), in order of training position."""
    rows = mix_sources(docs, schedules, cap, carry=True, ordered=False)
    copies = F.when(F.col("taken") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = rows.select(F.explode(F.slice("positions", F.lit(1), copies)).alias("position"), "digest", "row")
    return rows.repartitionByRange("position", "digest").sortWithinPartitions("position", "digest").select("row.*")
