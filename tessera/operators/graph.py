"""Connected components of similarity edges, and what is done with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import settled

#: Edges that a task puts together at once; if no more are left in all, one task ends the work.
TOGETHER = 1_000_000


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of each node that edges lead to a smaller one, b the smallest; for each TOGETHER edges by themselves."""

    def put(wait: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [pa.concat_arrays([w.column(i) for w in wait]) for i in (0, 1)]
        names = pc.unique(pa.concat_arrays(ends))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(e, names).to_numpy(zero_copy_only=False) for e in ends)
        label = np.arange(len(names))
        while len(a):
            # Every label is a root here: roots hang onto smaller neighbours, then trees are made flat.
            a, b = label[a], label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up
        led = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(led)), names.take(pa.array(label[led]))], ["a", "b"])

    wait: list[pa.RecordBatch] = []
    for batch in batches:
        wait.append(batch)
        if sum(w.num_rows for w in wait) >= TOGETHER:
            yield put(wait)
            wait = []
    if wait:
        yield put(wait)


def connected(nodes: DataFrame, edges: DataFrame, closed: bool = False) -> DataFrame:
    """(node, component) with the smallest node that edges (a, b) lead to; nodes without edges are their own. Edges of what isn't a node connect nothing; closed says that there are none.

    Each task first leads the edges it has to the smallest node of each piece, so it helps if edges that hang together lie together. What is left is ended by one task if it is few edges. Else
    labels go along the edges and then jump to the label of their label, so a chain takes rounds by the logarithm of its length. Every round
    is written to the shared folder, which cuts the lineage. Labels are as many as nodes, so they are never broadcast, which would send them to the driver each round.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    edges = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a is not null and b is not null")
    for end in [] if closed else ["a", "b"]:
        edges = edges.join(nodes.select(F.col("node").alias(end)).hint("merge"), end, "left_semi").select("a", "b")
    led = settled(edges.mapInArrow(_leading, f"a {kind}, b {kind}"))
    labels = nodes.select(F.col("node"), F.col("node").alias("component")).distinct()
    if led.count() <= TOGETHER:
        ends = led.repartition(1).mapInArrow(_leading, f"a {kind}, b {kind}")
        return settled(labels.join(ends.hint("merge"), labels.node == ends.a, "left").select("node", F.coalesce("b", "component").alias("component")))
    both = settled(led.select("a", "b").union(led.select("b", "a")).distinct())
    labels = settled(labels)
    while True:
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near.hint("merge"), labels.node == near.a, "left").select("node", F.least("component", "least").alias("component"))
        jump = step.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = settled(step.join(jump.hint("merge"), step.component == jump.up, "left").select("node", F.least("component", "top").alias("component")))
        still = new.join(labels.withColumnRenamed("component", "before").hint("merge"), "node").where("component <> before").isEmpty()
        labels = new
        if still:
            return labels


def triggered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sim, overlap) that any of three rules joins."""
    return pairs.where((F.col("sim") >= 0.80) | (F.col("overlap") >= 0.60) | (0.6 * F.col("sim") + 0.4 * F.col("overlap") >= 0.65))


def near_existing(new: DataFrame, existing: DataFrame, duplicate: float = 0.85, similar: float = 0.65, best: int = 5, listed: int = 3) -> DataFrame:
    """(item, found, reason, similarity, duplicate) for new and existing items (item, name, label, q or s: unit vectors).

    An equal name makes a duplicate, else an equal label, else a cosine of `duplicate` or more; the first one found, by item. If none does, up to
    `listed` of the `best` nearest are listed that are at least `similar`.
    """
    from tessera.operators.ranking import top
    from tessera.operators.retrieval import scored_slots

    def equal(rows: DataFrame, column: str) -> DataFrame:
        side = existing.where(F.col(column) != "").groupBy(column).agg(F.min("item").alias("found"))
        return rows.join(side, column).select("item", "found", F.lit(f"equal {column}").alias("reason"), F.lit(1.0).alias("similarity"), F.lit(True).alias("duplicate"))

    by_name = equal(new, "name")
    rest = new.join(by_name.select("item"), "item", "left_anti")
    by_label = equal(rest, "label")
    rest = rest.join(by_label.select("item"), "item", "left_anti")
    scored = scored_slots(rest.select("item", "q"), existing.select(F.col("item").alias("found"), "s")).select("item", "found", F.round("score", 9).alias("similarity"))
    ranked = top(scored, best, ["item"], [F.col("similarity").desc(), F.col("found")])
    twin = ranked.where((F.col("rank") == 1) & (F.col("similarity") >= duplicate)).select("item", "found", F.lit("near").alias("reason"), "similarity", F.lit(True).alias("duplicate"))
    others = ranked.where((F.col("similarity") >= similar) & (F.col("rank") <= listed)).join(twin.select("item"), "item", "left_anti").select("item", "found", F.lit("similar").alias("reason"), "similarity", F.lit(False).alias("duplicate"))
    return by_name.unionByName(by_label).unionByName(twin).unionByName(others)


def survivors(members: DataFrame, component: str, name: str, support: str, source: str, cohesion: str) -> DataFrame:
    """One member of each component: most support, then clusters before others, then with a cohesion, then the smaller name; the rest become its aliases."""
    order = F.struct((-F.col(support)).alias("s"), (F.col(source) != "cluster").alias("c"), F.col(cohesion).isNull().alias("n"), F.col(name).alias("name"))
    rows = members.groupBy(component).agg(F.min(order).getField("name").alias(name), F.array_sort(F.collect_set(name)).alias("all"), F.sum(support).alias("total"))
    return rows.select(component, name, F.array_except("all", F.array(name)).alias("aliases"), F.col("total"))


def scope(groups: DataFrame, name: str, topic: str) -> DataFrame:
    """base for names in three topics or more, domain in two, else local."""
    n = F.count_distinct(topic)
    return groups.groupBy(name).agg(n.alias("topics"), F.when(n >= 3, "base").when(n == 2, "domain").otherwise("local").alias("scope"))


def rename_plan(clusters: DataFrame, cluster: str, name: str, topic: str, canonical: DataFrame, topics: int = 2, outliers: DataFrame | None = None) -> DataFrame:
    """Renames of the members of clusters that have at least two members over `topics` topics; changed says whether the name differs, excluded_as_outlier
    whether outliers (cluster, name) lists it. Only members that change and aren't excluded are to be renamed."""
    wide = clusters.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(topic).alias("topics")).where((F.col("size") >= 2) & (F.col("topics") >= topics))
    rows = clusters.join(wide.select(cluster), cluster).join(canonical, cluster).withColumn("changed", F.col(name) != F.col("canonical"))
    if outliers is None:
        return rows.withColumn("excluded_as_outlier", F.lit(False))
    return rows.join(outliers.select(cluster, name, F.lit(True).alias("_out")).distinct(), [cluster, name], "left").withColumn("excluded_as_outlier", F.coalesce("_out", F.lit(False))).drop("_out")
