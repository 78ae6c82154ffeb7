"""Approximate nearest neighbours by learned partitions: a neighbour graph is cut into balanced parts, and a small classifier routes vectors to parts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.durable import settled
from tessera.llm.textkit import released
from tessera.operators.joins import small

#: A graph and its classifier are fitted on at most so many vectors, the first in a hash order of ids. Every row is indexed.
FIT_VECTORS = 8192
#: Rows that a part should have, and parts of one classifier. Where more parts are needed, each part is cut again by a classifier of its own.
PART_ROWS, PARTS = 4096, 256
NEIGHBOURS = 10
#: Rows of a part are dealt into blocks of about so many, and its queries into batches, so that a hot part is many tasks.
BLOCK, BATCH = 2048, 2048


@dataclass(frozen=True)
class Router:
    """A perceptron with one hidden layer: scores of parts for vectors, and how many parts a query is sent to."""

    first: np.ndarray
    second: np.ndarray
    probes: int
    dim: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.column_stack([x, np.ones(len(x))]) @ self.first, 0)
        return np.column_stack([hidden, np.ones(len(x))]) @ self.second


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS, step: int = 512) -> np.ndarray:
    """The k nearest other rows of each row."""
    k, norms = min(k, len(x) - 1), (x * x).sum(axis=1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), step):
        d = norms - 2 * x[i : i + step] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + step] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row, all of about the same size: halving along the main direction, then swaps between parts that keep more edges inside."""
    part = np.zeros(len(x), np.int64)
    for level in range(int(np.log2(parts))):
        for p in range(1 << level):
            at = np.flatnonzero(part == p)
            centred = x[at] - x[at].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = at[np.argsort(centred @ axis, kind="stable")]
            part[order[len(order) // 2 :]] += 1 << level
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    a, b = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(rounds):
        near = np.bincount(a * parts + part[b], minlength=len(x) * parts).reshape(len(x), parts)
        gain = near - near[np.arange(len(x)), part][:, None]
        moved = np.zeros(len(x), bool)
        for p in range(parts):
            for q in range(p):
                i, j = (np.flatnonzero((part == s) & ~moved & (gain[:, t] > 0)) for s, t in ((p, q), (q, p)))
                n = min(len(i), len(j))
                i, j = i[np.argsort(-gain[i, q], kind="stable")[:n]], j[np.argsort(-gain[j, p], kind="stable")[:n]]
                part[i], part[j] = q, p
                moved[i] = moved[j] = True
        if not moved.any():
            break
    return part


def fit_router(x: np.ndarray, parts: int, reach: float = 0.97, hidden: int = 128, epochs: int = 60, seed: int = 3) -> Router:
    """Fits on sample vectors x. Targets are the parts of a vector's neighbours; probes is the least number of parts that hold `reach` of them."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[graph[:, j]]), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    one = np.column_stack([x, np.ones(len(x))])
    weights = [rng.normal(0, 1 / (scale * np.sqrt(dim)), (dim + 1, hidden)), rng.normal(0, np.sqrt(2 / hidden), (hidden + 1, parts))]
    weights[0][-1] = 0
    held = np.arange(len(x)) % 5 == 0  # probes are chosen on rows that the classifier has not seen
    train = np.flatnonzero(~held) if held.any() and (~held).any() else np.arange(len(x))
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 256):
            at = train[i : i + 256]
            h = np.maximum(one[at] @ weights[0], 0)
            h1 = np.column_stack([h, np.ones(len(at))])
            z = h1 @ weights[1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            grads = [one[at].T @ ((d @ weights[1][:-1].T) * (h > 0)), h1.T @ d]
            t += 1
            for k in range(2):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                weights[k] = weights[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    router = Router(weights[0], weights[1], parts, dim)
    tested = np.flatnonzero(held) if held.any() else train
    rank = np.argsort(np.argsort(-router.scores(x[tested]), axis=1, kind="stable"), axis=1)
    home = router.scores(x).argmax(axis=1)  # rows are indexed where the classifier puts them
    if graph.shape[1]:
        found = np.sort(rank[np.arange(len(tested))[:, None], home[graph[tested]]].ravel())
        probes = int(found[min(len(found) - 1, int(np.ceil(reach * len(found))))]) + 1
    else:
        probes = parts
    return Router(weights[0], weights[1], min(parts, max(2, probes)), dim)


def _usable(rows: DataFrame) -> DataFrame:
    """The distinct (vec_id, embedding) that can be compared."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return settled(rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).distinct())


def _two_to(n: float) -> int:
    """The largest power of two up to n, 1 at least."""
    return 1 << max(0, int(np.log2(max(1.0, n))))


def _routed(shared, probes: int | None, dim: int):  # noqa: ANN001, ANN202
    """(vec_id, embedding, part) by the classifiers in shared, a dict by part: to so many most probable parts, or as many as the classifier says.

    Vectors without a part use the one under None; those in a part use that part's, if it has one, and get finer numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routers = shared.value
        for record in batches:
            for i in range(0, record.num_rows, 4096):
                some = record.slice(i, 4096)
                parts = some.column(2).to_numpy() if some.num_columns > 2 else None
                for part in [None] if parts is None else np.unique(parts).tolist():
                    here = some if part is None else some.filter(pa.array(parts == part))
                    column, base = here.column(1), 0 if part is None else part * PARTS
                    if (r := routers.get(part)) is None:
                        yield pa.RecordBatch.from_arrays([here.column(0), column, pa.array(np.full(len(column), base))], ["vec_id", "embedding", "part"])
                        continue
                    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    best = np.argsort(-r.scores(flat), axis=1, kind="stable")[:, : probes or r.probes]
                    at = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([here.column(0).take(at), column.take(at), pa.array(base + best.ravel().astype(np.int64))], ["vec_id", "embedding", "part"])
        released()

    return work


def _inner_routers(placed: DataFrame, parts: int, fit_vectors: int, part_rows: int, reach: float) -> dict[int, Router]:
    """A classifier for each part with more than twice part_rows rows, fitted in a task of its own on at most fit_vectors of its vectors. At most PARTS small ones reach the driver."""
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * part_rows)
    chosen = placed.join(F.broadcast(sizes), "part").where(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.ceil(F.col("rows") / fit_vectors)) == 0)

    def fit(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")[:fit_vectors]
        x = np.array(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)[order]
        wanted = min(_two_to(table["rows"][0].as_py() / part_rows), parts, _two_to(len(x) // 16))
        return pa.table([table["part"].slice(0, 1), pa.array([pickle.dumps(fit_router(x, wanted, reach))], pa.binary())], names=["part", "router"])

    found = chosen.groupBy("part").applyInArrow(fit, "part long, router binary").collect()
    return {r.part: pickle.loads(r.router) for r in found}


def search(rows: DataFrame, is_query: Column, k: int = 10, fit_vectors: int = FIT_VECTORS, part_rows: int = PART_ROWS, parts: int = PARTS, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k nearest found among all other rows, by Euclidean distance.

    A sample of at most fit_vectors gives a neighbour graph, its balanced parts of about part_rows rows, and a classifier that learns which parts a
    vector's neighbours are in. Every row goes to its most probable part, and each query to the most probable few; there it is compared with
    all rows, in double precision on the original vectors. Where more than `parts` parts are needed, each part is cut once more in the same
    way by a sample of its own, so that the rows of a part, and the work for a query, don't grow with the table up to parts * parts * part_rows
    rows. Ties go to the smaller vec_id.

    Rows without id, null, empty or zero vectors, vectors with null or non-finite components, and those whose dimension isn't the sample's
    commonest take no part. Rows that repeat an id and vector count once, and an id is never its own neighbour. Columns other than vec_id and
    embedding are ignored. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    spark = rows.sparkSession
    queries = _usable(rows.where(is_query))
    rows = _usable(rows)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_vectors).toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    vectors = [np.array(x, float) for x in sample["embedding"].to_pylist()]
    sizes = np.array([len(x) for x in vectors])
    dim = int(np.bincount(sizes).argmax())
    x = np.stack([v for v in vectors if len(v) == dim])
    needed = _two_to(rows.count() / part_rows)
    twice = needed > parts
    reach = 0.985 if twice else 0.97
    router = fit_router(x, min(needed, parts, _two_to(len(x) // 16)), reach)
    element = rows.schema["embedding"].dataType.simpleString()

    right_size = F.size("embedding") == dim
    shape = f"vec_id long, embedding {element}, part long"
    shared = spark.sparkContext.broadcast({None: router})
    placed = rows.where(right_size).mapInArrow(_routed(shared, 1, dim), shape)
    asked = queries.where(right_size).mapInArrow(_routed(shared, None, dim), shape)
    if twice:
        placed = settled(placed)
        inner = spark.sparkContext.broadcast(_inner_routers(placed, parts, fit_vectors, part_rows, reach))
        placed, asked = placed.mapInArrow(_routed(inner, 1, dim), shape), asked.mapInArrow(_routed(inner, None, dim), shape)
    counts = placed.groupBy("part").agg(F.count("*").alias("rows")).join(asked.groupBy("part").agg(F.count("*").alias("asked")), "part", "left").select("part", (F.floor(F.col("rows") / block) + 1).alias("blocks"), (F.floor(F.coalesce("asked", F.lit(0)) / batch) + 1).alias("batches"))
    counts = small(settled(counts))  # a row a part
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n))
    left = placed.join(counts, "part").select("part", mine("blocks").alias("block"), each("batches").alias("batch"), "vec_id", "embedding")
    right = asked.join(counts, "part").select("part", each("blocks").alias("block"), mine("batches").alias("batch"), "vec_id", "embedding")

    def nearest(there: pa.Table, here: pa.Table) -> pa.Table:
        ids, names = there["vec_id"].to_numpy(), here["vec_id"].to_numpy()
        rows_, wanted = (np.array(t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim) if t.num_rows else np.zeros((0, dim)) for t in (there, here))
        out: list[tuple[np.ndarray, ...]] = []
        norms = (rows_ * rows_).sum(axis=1)
        for name, vector in zip(names, wanted):
            others = ids != name
            rough = norms - 2 * (rows_ @ vector)
            rough[~others] = np.inf
            if (n := int(others.sum())) > k:
                edge = np.partition(rough, k - 1)[k - 1]
                others = rough <= edge + 1e-9 * (1 + abs(edge) + vector @ vector)
            at = np.flatnonzero(others)
            if not n:
                continue
            score = np.sqrt(((rows_[at] - vector) ** 2).sum(axis=1))
            at, score = at[order := np.lexsort([ids[at], score])], score[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (ids[at][1:] != ids[at][:-1]) | (score[1:] != score[:-1])
            at, score = at[fresh][:k], score[fresh][:k]
            out.append((np.full(len(at), name), ids[at], score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = "part", "block", "batch"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
