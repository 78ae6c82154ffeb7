"""Clustering of the vectors of a group by rounds of joins over blocks of rows: average link, and density."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import placed, top
from tessera.operators.retrieval import unit
from tessera.sources.files import settled


#: Rows of a block of vectors, and bytes; near rows that are kept of each row; edges of a group that one task merges at a time.
BLOCK, BLOCK_BYTES, NEAR, EDGES = 1024, 4 << 20, 8, 1 << 16


def _side(row: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, cores, components and unit vectors of a block."""
    ids, cores, comps, x = (row[name].values for name in ("ids", "cores", "comps", "x"))
    return ids.to_numpy(), cores.to_numpy(), comps.to_numpy(), x.flatten().to_numpy().reshape(len(ids), -1)


def _compared(pairs: DataFrame, measure: Callable[[tuple, tuple], np.ndarray]) -> DataFrame:
    """(g, id, near, d): for each row of the left block the right one with the least measure, ties by id; rows without any (all infinite) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, left, right in zip(*batch.columns):
                left, right = _side(left), _side(right)
                d = measure(left, right)
                best = d.argmin(axis=1)
                d = d[np.arange(len(d)), best]
                keep = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), g.as_py())), pa.array(left[0][keep]), pa.array(right[0][best][keep]), pa.array(d[keep])], ["g", "id", "near", "d"])

    found = pairs.select("g", "left", "right").mapInArrow(run, "g long, id long, near long, d double")
    return found.groupBy("g", "id").agg(F.min(F.struct("d", "near")).alias("m")).select("g", "id", "m.near", "m.d")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(np.clip(1 - x @ y.T, 0, 2), 12)


def _blocked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, block, side): rows (g, id, core, comp, x) of a group in blocks of about BLOCK rows, dealt by hash."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    packed = rows.join(sizes, "g").groupBy("g", block).agg(F.array_sort(F.collect_list(F.struct("id", "core", "comp", "x"))).alias("r"))
    pick = lambda c: F.transform("r", lambda e: e[c])
    return packed.select("g", "block", F.struct(pick("id").alias("ids"), pick("core").alias("cores"), pick("comp").alias("comps"), pick("x").alias("x")).alias("side"))


def _against(asking: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, p, q, left, right): each block of asking with each block of rows of its group. Left blocks go to the numbers of the right ones, so a group is spread by those."""
    left = _blocked(asking, sizes).join(sizes, "g").select("g", F.col("block").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("q"), F.col("side").alias("left"))
    return left.join(_blocked(rows, sizes).select("g", F.col("block").alias("q"), F.col("side").alias("right")), ["g", "q"])


def _nearest(rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(g, id, near, d, place): the k nearest other rows of each row in its group, ties by id. A task keeps the best of a block over a stripe of other blocks."""

    def best(ids: np.ndarray, found: list[tuple]) -> tuple:
        i, near, d = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((near, d, i))
        i, near, d = i[order], near[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[first], near[first], d[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, g, ids, held = None, None, None, None

        def closed() -> pa.RecordBatch:
            i, near, d = held
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g)), pa.array(ids[i]), pa.array(near), pa.array(d)], ["g", "id", "near", "d"])

        for batch in batches:
            for g_, p, stripe, left, right in zip(*batch.columns):
                new = g_.as_py(), p.as_py(), stripe.as_py()
                if new != at:
                    if at is not None:
                        yield closed()
                    at, g, held = new, new[0], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    (ids, _, _, x) = _side(left)
                others, _, _, y = _side(right)
                d = _distances(x, y)
                d[ids[:, None] == others] = np.inf
                # All that is as near as the k-th, then the first k of them.
                upto = np.partition(d, k - 1, axis=1)[:, k - 1] if len(others) > k else np.full(len(ids), np.inf)
                i, j = np.nonzero(np.isfinite(d) & (d <= upto[:, None]))
                held = best(ids, [held, (i, others[j], d[i, j])])
        if at is not None:
            yield closed()

    keys = ["g", "p", "stripe"]
    pairs = _against(rows, rows, sizes).withColumn("stripe", F.floor(F.col("q") / 64))
    found = pairs.select(*keys, "left", "right").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "g long, id long, near long, d double")
    return top(found, k, ["g", "id"], [F.col("d"), F.col("near")], "place")


def _outside(asking: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, id, near, d): for each asking row the nearest row of another component by mutual reachability, over the whole group."""

    def measure(left: tuple, right: tuple) -> np.ndarray:
        w = np.maximum(np.maximum(left[1][:, None], right[1]), _distances(left[3], right[3]))
        w[left[2][:, None] == right[2]] = np.inf
        return w

    return _compared(_against(asking, rows, sizes), measure)


def _closest(asking: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, id, near, d): for each asking row (g, id, core, comp, x) the nearest other one of its group, block by block; ties by id."""

    def measure(left: tuple, right: tuple) -> np.ndarray:
        d = _distances(left[3], right[3])
        d[left[0][:, None] == right[0]] = np.inf
        return d

    return _compared(_against(asking, rows, sizes), measure)


def _usable(df: DataFrame, group: str, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(groups (_group, g), rows (g, id, _key, x)), settled: rows that have a group, a key and a whole vector, numbered in the order of their keys, with unit vectors."""
    whole = ~F.exists(F.coalesce(F.col(vector), F.array().cast(df.schema[vector].dataType)), lambda x: x.isNull() | F.isnan(x.cast("double")))
    some = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull() & F.col(key).isNotNull() & whole).select(F.col(group).alias("_group"), F.col(key).alias("_key"), unit(F.col(vector)).alias("x"))
    groups = settled(some.select("_group").distinct().withColumn("g", F.monotonically_increasing_id()))
    rows = some.join(groups, "_group").select("g", "_key", "x")
    return groups, settled(rows.repartitionByRange("g", "_key").sortWithinPartitions("g", "_key").withColumn("id", F.monotonically_increasing_id()))


def _sizes(rows: DataFrame) -> DataFrame:
    """(g, n, blocks), settled: rows of each group, and the blocks that they make."""
    wide = rows.select(F.max(F.size("x"))).first()[0] or 1
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * wide)))
    return settled(rows.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", F.ceil(F.col("n") / size).alias("blocks")))


def average_links(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.18) -> DataFrame:
    """(group, key, cluster): average-link clusters by cosine distance inside each group, named by their smallest key.

    Every round all clusters that are each other's nearest, and as near as threshold, merge at once; mean distances make this the same tree as one
    merge at a time. A cluster is kept as the mean of its unit vectors and their number, with its nearest one. A merge brings no cluster nearer to a third one than
    the nearer of its two was, so after the first round only the merged clusters, and those whose nearest was merged, look for their nearest again, block
    by block. Distances count to 12 digits, ties go to the smaller key. A row without group, key or whole vector is its own cluster.
    """
    groups, rows = _usable(df, group, key, vector)
    sizes = _sizes(rows)
    sides = lambda some: some.select("g", "id", F.lit(0.0).alias("core"), F.lit(0).cast("long").alias("comp"), "x")
    state, names = rows.select("g", "id", F.lit(1).cast("long").alias("n"), "x"), rows.select("g", "id", F.col("id").alias("c"), "_key")
    nearest = settled(_closest(sides(state), sides(state), sizes))
    while True:
        close = nearest.where(F.col("d") <= threshold).select("g", "id", "near")
        back = close.select("g", F.col("id").alias("near"), F.col("near").alias("back"))
        mutual = settled(close.join(back, ["g", "near"]).where("back = id and id < near").select("g", F.col("near").alias("id"), F.col("id").alias("into")))
        if mutual.isEmpty():
            break
        names = settled(names.join(mutual.select("g", F.col("id").alias("c"), "into"), ["g", "c"], "left").select("g", "id", F.coalesce("into", "c").alias("c"), "_key"))
        both = mutual.select("g", F.explode(F.array("id", "into")).alias("id"), "into")
        parts = state.join(both, ["g", "id"]).select("g", "into", "n", F.posexplode(F.transform("x", lambda v: v * F.col("n"))).alias("i", "v"))
        sums = parts.groupBy("g", "into", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).groupBy("g", "into").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
        merged = settled(sums.select("g", F.col("into").alias("id"), "n", F.transform("s", lambda e: e.v / F.col("n")).alias("x")))
        touched = both.select("g", "id")
        state = settled(state.join(touched, ["g", "id"], "left_anti").unionByName(merged))
        stale = nearest.join(touched, ["g", "id"], "left_anti").join(touched.withColumnRenamed("id", "near"), ["g", "near"], "left_semi").select("g", "id").unionByName(merged.select("g", "id"))
        stale = settled(stale)
        gone = stale.unionByName(touched).distinct()
        again = _closest(sides(state.join(stale, ["g", "id"], "left_semi")), sides(state), sizes)
        nearest = settled(nearest.join(gone, ["g", "id"], "left_anti").unionByName(again))
    first = names.groupBy("g", "c").agg(F.min("_key").alias("_cluster"))
    found = names.join(first, ["g", "c"]).join(groups, "g").select(F.col("_group").alias(group), F.col("_key").alias(key), "_cluster")
    return df.select(group, key).join(found, [group, key], "left").select(group, key, F.coalesce("_cluster", key).alias("cluster"))


def spanning_tree(rows: DataFrame, least: int) -> DataFrame:
    """(g, lo, hi, w), settled: the edges of the minimum spanning tree of mutual reachability in each group of rows (g, id, x), x unit vectors.

    Rounds of cheapest edges: every component takes its cheapest edge by (w, lo, hi), so the tree is one and the same on every run. An edge
    comes from the near rows that are kept, and where something nearer than it may lie beyond those, from all rows of the group, block by block. Every
    round at least halves the components that can still grow.
    """
    sizes = _sizes(rows)
    plain = rows.select("g", "id", F.lit(0.0).alias("core"), F.lit(0).cast("long").alias("comp"), "x")
    k = max(NEAR, 2 * least)
    near = settled(_nearest(plain, sizes, k))
    at = near.groupBy("g", "id").agg(F.max(F.when(F.col("place") == least - 1, F.col("d"))).alias("core"), F.max("d").alias("far"))
    lone = F.coalesce("core", F.lit(0.0) if least < 2 else F.col("far"), F.lit(0.0))
    # Beyond the kept rows nothing is nearer than `bound`; where all others of the group are kept, there is nothing beyond.
    known = rows.join(at, ["g", "id"], "left").join(sizes.select("g", "n"), "g").select("g", "id", "x", lone.alias("core"), F.when(F.col("n") - 1 > k, F.greatest(lone, "far")).alias("bound"))
    known, labels, edges = settled(known), settled(rows.select("g", "id", F.col("id").alias("comp"))), []
    cores = known.select("g", "id", "core")
    links = near.select("g", "id", "near", "d").join(cores, ["g", "id"]).join(cores.select("g", F.col("id").alias("near"), F.col("core").alias("other")), ["g", "near"])
    links = settled(links.select("g", F.least("id", "near").alias("lo"), F.greatest("id", "near").alias("hi"), F.greatest("d", "core", "other").alias("w")).distinct())
    bounds = settled(known.where("bound is not null").select("g", "id", "bound"))
    comp_of = lambda name: labels.select("g", F.col("id").alias(name), F.col("comp").alias(f"comp_{name}"))
    both = lambda rows_: rows_.join(comp_of("lo"), ["g", "lo"]).join(comp_of("hi"), ["g", "hi"]).where("comp_lo <> comp_hi")
    least_of = F.min(F.struct("w", "lo", "hi", "to")).alias("e")
    ends = lambda rows_: rows_.select("g", F.explode(F.array(F.struct(F.col("comp_lo").alias("comp"), F.col("comp_hi").alias("to")), F.struct(F.col("comp_hi").alias("comp"), F.col("comp_lo").alias("to")))).alias("c"), "w", "lo", "hi").select("g", "c.*", "w", "lo", "hi")
    while True:
        links = settled(both(links))
        cheapest = lambda: ends(links).groupBy("g", "comp").agg(least_of)  # noqa: B023, E731
        open_ = bounds.join(labels, ["g", "id"]).join(cheapest(), ["g", "comp"], "left").where("e is null or bound <= e.w")
        asking = settled(open_.join(known.select("g", "id", "core", "x"), ["g", "id"]).select("g", "id", "core", "comp", "x"))
        if not asking.isEmpty():
            found = settled(_outside(asking, known.join(labels, ["g", "id"]).select("g", "id", "core", "comp", "x"), sizes))
            # What was asked knows its nearest outside now, and later components only lie farther.
            bounds = settled(bounds.join(asking.select("g", "id"), ["g", "id"], "left_anti").unionByName(found.select("g", "id", F.col("d").alias("bound"))))
            more = found.select("g", F.least("id", "near").alias("lo"), F.greatest("id", "near").alias("hi"), F.col("d").alias("w"))
            links = settled(links.select("g", "lo", "hi", "w", "comp_lo", "comp_hi").unionByName(both(more)).distinct())
        picks = settled(cheapest())
        links = links.select("g", "lo", "hi", "w")
        if picks.isEmpty():
            break
        edges.append(picks.select("g", "e.lo", "e.hi", "e.w"))
        # A component follows its pick, four steps at most; of two that picked each other the smaller one stays. Any set's cheapest edge is of the tree, so a part of the way is enough.
        back = picks.select("g", F.col("comp").alias("to"), F.col("e.to").alias("back"))
        up = picks.select("g", "comp", F.col("e.to").alias("to")).join(back, ["g", "to"], "left").select("g", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to"))
        for _ in range(2):
            up = up.join(up.select("g", F.col("comp").alias("to"), F.col("to").alias("next")), ["g", "to"], "left").select("g", "comp", F.coalesce("next", "to").alias("to"))
        labels = settled(labels.join(up, ["g", "comp"], "left").select("g", "id", F.coalesce("to", "comp").alias("comp")))
    out = rows.sparkSession.createDataFrame([], "g long, lo long, hi long, w double")
    for e in edges:
        out = out.unionByName(e)
    return settled(out.groupBy("g", "lo", "hi").agg(F.min("w").alias("w")))


_EVENTS = "kind string, g long, a long, b long, n long, total double, below double, cluster long, members array<long>"


def _merge(least: int) -> Callable[[pa.Table], pa.Table]:
    """Merges a stretch of a group's edges in their order. A component is (size, members while it is below `least`, cluster, total, below).

    A component of `least` rows opens a cluster; each row adds the 1 / w at which it leaves the cluster to `total`. Where two clusters meet both end
    and a new one opens; what each is worth is total less size / w, or what its own children are worth, if that is more.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        g, up, state, first, out = table.column("g")[0].as_py(), {}, {}, {}, []

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for e in table.select(["rank", "w", "lo", "hi"]).to_pylist():
            for side in (e["lo"], e["hi"]):
                if side["comp"] not in state and side["comp"] not in up:
                    first[side["comp"]] = state[side["comp"]] = (side["n"], side["members"], side["cluster"], side["total"], side["below"])
            a, b = find(e["lo"]["comp"]), find(e["hi"]["comp"])
            if a == b:
                continue
            a, b = min(a, b), max(a, b)
            rate, (na, ma, ca, ta, wa), (nb, mb, cb, tb, wb) = 1 / max(e["w"], 1e-12), state.pop(a), state.pop(b)
            up[b], n, cluster = a, na + nb, e["rank"]
            if ca is None and cb is None:
                members = ma + mb
                if n < least:
                    state[a] = (n, members, None, None, None)
                else:
                    out += [("row", g, m, cluster, None, None, None, None, None) for m in members]
                    state[a] = (n, None, cluster, n * rate, None)
            elif ca is None or cb is None:
                members, (cluster, total, below) = (ma, (cb, tb, wb)) if ca is None else (mb, (ca, ta, wa))
                out += [("row", g, m, cluster, None, None, None, None, None) for m in members]
                state[a] = (n, None, cluster, total + len(members) * rate, below)
            else:
                worth = 0.0
                for c, size, total, below in ((ca, na, ta, wa), (cb, nb, tb, wb)):
                    own = max(0.0, total - size * rate)
                    chosen = below is None or own >= below
                    worth += own if chosen else below
                    out.append(("cluster", g, c, cluster, int(chosen), None, None, None, None))
                state[a] = (n, None, cluster, n * rate, worth)
        out += [("moved", g, c, find(c), None, None, None, None, None) for c in first if find(c) != c]
        out += [("state", g, c, None, n, total, below, cluster, members) for c, (n, members, cluster, total, below) in state.items()]
        names = [f.split()[0] for f in _EVENTS.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return work


def condensed_tree(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows (g, id, cluster), clusters (g, cluster, parent, chosen)) of the tree edges (g, lo, hi, w) of each group, from settled tables.

    Edges come in the order (w, lo, hi), EDGES of a group at a time: a task merges those of one group among the components that they touch, whose
    states are a few numbers. What became of a component goes back to its rows by a join. A group's last cluster, the root, is never chosen.
    """
    dealt = placed(edges, ["g"], [F.col("w"), F.col("lo"), F.col("hi")], name="rank").withColumn("turn", F.floor((F.col("rank") - 1) / EDGES))
    dealt = settled(dealt)
    turns = (dealt.agg(F.max("turn")).first()[0] if not dealt.isEmpty() else -1) + 1
    spark = edges.sparkSession
    labels, states = spark.createDataFrame([], "g long, id long, comp long"), spark.createDataFrame([], "g long, comp long, n long, total double, below double, cluster long, members array<long>")
    done = []
    for turn in range(turns):
        some = dealt.where(F.col("turn") == turn)
        for side in ("lo", "hi"):
            own = labels.select("g", F.col("id").alias(side), "comp").join(states, ["g", "comp"])
            got = some.join(own, ["g", side], "left")
            alone = F.struct(F.col(side).alias("comp"), F.lit(1).cast("long").alias("n"), F.array(side).alias("members"), F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("below"))
            some = got.withColumn(f"_{side}", F.when(F.col("comp").isNull(), alone).otherwise(F.struct("comp", "n", "members", "cluster", "total", "below"))).drop("comp", "n", "members", "cluster", "total", "below")
        events = settled(some.select("g", "rank", "w", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).groupBy("g").applyInArrow(_merge(least), _EVENTS))
        done.append(events.where("kind in ('row', 'cluster')"))
        if turn + 1 < turns:
            moved, now = events.where("kind = 'moved'").select("g", F.col("a").alias("comp"), F.col("b").alias("into")), events.where("kind = 'state'").select("g", F.col("a").alias("comp"), "n", "total", "below", "cluster", "members")
            touched = some.select("g", F.explode(F.array("lo", "hi")).alias("id")).distinct().join(labels, ["g", "id"], "left_anti").withColumn("comp", F.col("id"))
            labels = settled(labels.unionByName(touched).join(moved, ["g", "comp"], "left").select("g", "id", F.coalesce("into", "comp").alias("comp")))
            gone = moved.select("g", "comp").unionByName(now.select("g", "comp"))
            states = settled(states.join(gone, ["g", "comp"], "left_anti").unionByName(now))
    events = spark.createDataFrame([], _EVENTS)
    for e in done:
        events = events.unionByName(e)
    members = events.where("kind = 'row'").select("g", F.col("a").alias("id"), F.col("b").alias("cluster"))
    return members, events.where("kind = 'cluster'").select("g", F.col("a").alias("cluster"), F.col("b").alias("parent"), (F.col("n") == 1).alias("chosen"))


def dense(df: DataFrame, group: str, key: str, vector: str, least: int = 3) -> DataFrame:
    """(group, key, cluster): clusters by density on cosine distances inside each group, named by their smallest key; null for noise.

    Core distance: to the (least - 1)-th other row. Single links over max(core, core, distance) give the hierarchy; a split counts where both sides
    have `least` rows; of a cluster and its children those with the larger sum of (1 / d) lifetimes stay. The whole group isn't a cluster.
    Distances count to 12 digits, equal ones go by key. Keys are unique in a group; rows with a null group, key, vector or component are noise. An empty
    table gives no rows. Every step is joins and grouped sums over blocks of rows or stretches of edges, so a group may have any size.
    """
    groups, rows = _usable(df, group, key, vector)
    members, clusters = condensed_tree(spanning_tree(rows.select("g", "id", "x"), least), least)
    # The topmost chosen cluster above each one: paths to the root double each round.
    paths = settled(clusters.select("g", "cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("best")))
    while not paths.where("up is not null").isEmpty():
        above = paths.select("g", F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("best").alias("higher"))
        paths = settled(paths.join(above, ["g", "up"], "left").select("g", "cluster", F.col("next").alias("up"), F.coalesce("higher", "best").alias("best")))
    found = members.join(paths.select("g", "cluster", "best"), ["g", "cluster"]).where("best is not null").select("g", "id", "best")
    named = settled(found.join(rows.select("g", "id", "_key"), ["g", "id"]))
    names = named.groupBy("g", "best").agg(F.min("_key").alias("_cluster"))
    kept = named.join(names, ["g", "best"]).join(groups, "g").select(F.col("_group").alias(group), F.col("_key").alias(key), F.col("_cluster").alias("cluster"))
    return df.select(group, key).join(kept, [group, key], "left")


def cohesion(members: DataFrame, by: list[str], key: str, vector: str) -> DataFrame:
    """Mean cosine of all pairs of each cluster, from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1)). Null for single members."""
    parts = members.select(*by, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    rows = parts.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.max("n").alias("n"))
    return rows.select(*by, "n", F.when(F.col("n") > 1, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))
