"""Hard-negative mining by bit-sliced integer products: the bit-planes of the components are multiplied most significant first, and each plane narrows
the interval that a pair's product lies in, so that pairs drop out once their interval can't qualify."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import frozen, thawed
from tessera.llm.durable import settled
from tessera.llm.textkit import released

#: Rows of a block of candidates and of a block of anchors, and bytes of components in either. A task holds one of each.
BLOCK, BATCH, BLOCK_BYTES = 4096, 512, 8 << 20
#: Components beyond this, after scaling, take no part: 2**14 products of such fit into 64 bits.
LARGEST = 1 << 24
_NONE = np.iinfo(np.int64).min

Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _kth(values: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row among those marked; the least number where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), _NONE)
    return np.partition(np.where(among, values, _NONE), -k, axis=1)[:, -k]


def first_by_score(k: int) -> Judge:
    """Keeps what can be among the k highest products of an anchor, ties included."""
    return lambda low, high, alive: alive & (high >= _kth(low, alive, k)[:, None])


def first_in_windows(least: np.ndarray, most: np.ndarray, k: int) -> Judge:
    """Keeps what can be among the k highest products of any of an anchor's windows [least, most] (anchors x windows)."""

    def judge(low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        keep = np.zeros_like(alive)
        for a, b in zip(least.T[:, :, None], most.T[:, :, None]):
            sure = alive & (low >= a) & (high <= b)
            keep |= alive & (high >= np.maximum(a, _kth(low, sure, k)[:, None])) & (low <= b)
        return keep

    return judge


def sliced_products(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, product) of the pairs that `judge` keeps to the end, of those alive at first. Both are integer matrices; products are exact.

    A row's components are two's complement: the sign plane counts -2**p, plane p below it 2**p. After plane p the rest of the product lies
    between (2**p - 1) times the sum of the anchor's negative components and the same of its positive ones. Once few rows are left to each anchor, only
    those are multiplied.
    """
    wide = anchors.astype(np.float64)  # products with 0/1 planes stay far below 2**53
    up, down = (np.where(s, anchors, 0).sum(axis=1, dtype=np.int64)[:, None] for s in (anchors > 0, anchors < 0))
    planes = int(max(int(rows.max(initial=0)), ~int(rows.min(initial=0)))).bit_length() + 1
    done, at = np.zeros(alive.shape, np.int64), None
    for p in reversed(range(planes)):
        plane = (rows >> p & 1).astype(np.float64)
        done += (-1 if p == planes - 1 else 1) * _times(wide, plane, at).astype(np.int64) << p
        alive = judge(done + ((1 << p) - 1) * down, done + ((1 << p) - 1) * up, alive)
        most = int(alive.sum(axis=1).max(initial=0))
        if most * 2 <= alive.shape[1]:
            i, j = np.nonzero(alive)
            n = alive.sum(axis=1)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            left, sums, some = np.zeros((len(alive), most), np.int64), np.zeros((len(alive), most), np.int64), np.zeros((len(alive), most), bool)
            left[i, k], sums[i, k], some[i, k] = j if at is None else at[i, j], done[i, j], True
            at, done, alive = left, sums, some
    i, j = np.nonzero(alive)
    return i, j if at is None else at[i, j], done[i, j]


def _times(anchors: np.ndarray, plane: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    if at is None:
        return anchors @ plane.T
    out = np.zeros(at.shape)
    step = max(1, (4 << 20) // max(1, at.shape[1] * plane.shape[1]))
    for i in range(0, len(at), step):
        out[i : i + step] = (plane[at[i : i + step]] @ anchors[i : i + step, :, None])[:, :, 0]
    return out


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, q, tie), settled: each usable row once, its components floor(scale * x), a number of its own and a hash for ties."""
    wide = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.forall("_wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = vectors.where("label is not null and embedding is not null").select("vec_id", "label", wide.alias("_wide")).where(usable)
    rows = rows.select("vec_id", "label", F.transform("_wide", lambda x: F.floor(x).cast("int")).alias("q")).distinct()
    return settled(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "q", F.xxhash64("label", "q").alias("tie")))


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """(block, labels, data), settled: rows by label in blocks of at most `size`, frozen, with the labels that each holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, used, room = TaskContext.get().partitionId() << 32, [], 0, size

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            labels = pa.array([table.column("label").unique().to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([number]), labels, pa.array([frozen(table)], pa.binary())], ["block", "labels", "data"])

        for batch in batches:
            widest = int(np.diff(batch.column(batch.schema.get_field_index("q")).offsets.to_numpy()).max(initial=1))
            room = max(1, min(size, BLOCK_BYTES // (8 * max(1, widest))))
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + max(1, room - used))
                held.append(batch.slice(at, end - at))
                used, at = used + end - at, end
                if used >= room:
                    yield closed()
                    number, held, used = number + 1, [], 0
        if held:
            yield closed()
        released()

    parts = max(1, -(-n // size))
    return settled(rows.repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row").mapInArrow(work, "block long, labels array<long>, data binary"))


def _compared(pairs: DataFrame, work: Callable[[pa.Table, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                yield work(thawed(a.as_buffer()), thawed(b.as_buffer()))
                released()

    return pairs.mapInArrow(run, schema)


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components of both, same row, same label, and the rows' ids with null as the largest."""
    x = _matrix(anchors.column("q"))
    y = _matrix(rows.column("q"), x.shape[1])
    x = np.pad(x, ((0, 0), (0, y.shape[1] - x.shape[1])))
    same = anchors.column("row").to_numpy()[:, None] == rows.column("row").to_numpy()
    alike = anchors.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()
    return x, y, same, alike, rows.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of the anchors, the rows of vectors (vec_id, embedding, label) where the condition `anchors` on vec_id holds.

    Components become floor(scale * x); a row's score is its integer product with the anchor. Higher scores come first, then smaller vec_id (null
    last), then a hash of the row. An anchor's positives are its first `positives` other rows of its label. For each of them come the first `negatives` rows of other labels whose
    score lies between low and high hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label or vector, or a component that is null, not finite or beyond LARGEST after scaling, take no part. Equal rows count
    once; rows that share an id but differ are rows of their own, as candidates and as anchors. A shorter vector counts as ending in zeros. Other columns
    are ignored; an empty table gives no rows. Anchors meet all rows in blocks: for positives only blocks that share a label.
    """
    rows = quantised(vectors, scale)
    chosen = rows.where(F.coalesce(anchors, F.lit(False)))
    candidates, asking = _blocks(rows, BLOCK, rows.count()), _blocks(chosen, BATCH, chosen.count())
    stripes = max(1, candidates.count())

    def near(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        x, y, same, alike, ids = _sides(a, b)
        i, j, score = sliced_products(x, y, alike & ~same, first_by_score(positives))
        tie = b.column("tie").to_numpy()
        order = np.lexsort((tie[j], ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = (v[place < positives] for v in (i, j, score))
        return pa.RecordBatch.from_arrays([a.column("row").take(pa.array(i)).combine_chunks(), b.column("vec_id").take(pa.array(j)).combine_chunks(), pa.array(tie[j]), pa.array(score)], ["row", "id", "tie", "score"])

    met = candidates.select("block", F.explode("labels").alias("label")).join(asking.select(F.col("block").alias("anchor_block"), F.explode("labels").alias("label")), "label").select("block", "anchor_block").distinct()
    met = met.join(asking.select(F.col("block").alias("anchor_block"), F.col("data").alias("asked")), "anchor_block").repartition(stripes, "block").join(candidates.select("block", "data").repartition(stripes, "block").hint("merge"), "block")
    found = _compared(met.select("asked", "data"), near, "row long, id long, tie long, score long")
    best = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")]
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(*best))).where(F.col("place") <= positives)
    window = F.struct("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    placed = settled(found.where(f"score >= 0 and {low} <= {high}").groupBy("row").agg(F.array_sort(F.collect_list(window)).alias("windows")).join(rows, "row"))
    again = _blocks(placed, BATCH, placed.count())

    def hard(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        x, y, _, alike, ids = _sides(a, b)
        windows = a.column("windows").combine_chunks()
        size, score = np.diff(windows.offsets.to_numpy()), windows.flatten().field("positive_score").to_numpy()
        least, most = np.ones((len(x), positives), np.int64), np.zeros((len(x), positives), np.int64)
        inside = np.arange(positives) < size[:, None]
        least[inside], most[inside] = -(-low * score // 100), high * score // 100
        i, j, product = sliced_products(x, y, ~alike, first_in_windows(least, most, negatives))
        tie, out = b.column("tie").to_numpy(), []
        order = np.lexsort((tie[j], ids[j], -product, i))
        i, j, product = i[order], j[order], product[order]
        for w in range(positives):
            fits = np.flatnonzero((product >= least[i, w]) & (product <= most[i, w]))
            place = np.arange(len(fits)) - np.searchsorted(i[fits], i[fits])
            out.append(fits[place < negatives])
        which, at = np.repeat(np.arange(positives), [len(o) for o in out]), np.concatenate(out)
        names = [a.column("row").take(pa.array(i[at])).combine_chunks(), pa.array(which + 1, pa.int32()), b.column("vec_id").take(pa.array(j[at])).combine_chunks(), pa.array(tie[j[at]]), pa.array(product[at])]
        return pa.RecordBatch.from_arrays(names, ["row", "place", "id", "tie", "score"])

    stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    dealt = candidates.select(F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"), "data").repartition(stripes, "stripe")
    asked = again.select(F.col("data").alias("asked"), stripe).repartition(stripes, "stripe").join(dealt.hint("merge"), "stripe")
    mined = _compared(asked.select("asked", "data"), hard, "row long, place int, id long, tie long, score long")
    mined = mined.withColumn("rank", F.row_number().over(Window.partitionBy("row", "place").orderBy(*best))).where(F.col("rank") <= negatives)
    named = placed.select("row", F.col("vec_id").alias("anchor_id"), F.explode("windows").alias("w")).select("row", "anchor_id", "w.*")
    return mined.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
