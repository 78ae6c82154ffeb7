"""All links of a Jaccard similarity join over word shingles, by prefix filters under several global orders of the shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.durable import dropped, settled
from tessera.llm.textkit import U64, buffers, chunks, released, shingles, splitmix, words

ORDERS = 3
#: Shingles that many texts share go last in the orders. Their class is kept for so many slots of the hash: one byte each, so the broadcast is 16 MB.
SLOT_BITS = 24
#: A count is passed on when a shingle is in so many texts of a stretch of STRETCH bytes (lossy counting); this only shapes the orders.
LOSSY, STRETCH = 2, 16 << 20
BLOOM_BYTES = 1 << 25
#: A task compares at most two blocks of about so many sets and bytes of shingles. Buckets beyond one block are first compared block by block, each block with about HEADS heads of its bucket.
BLOCK, BLOCK_BYTES, HEADS = 512, 24 << 20, 24
#: A set's parities take at most so many bytes, and it names at most so many of its buckets, the first ones; both only save work.
PARITY_BYTES, NAMED = 1 << 11, 16
#: Sets that a task of the prefix pass remembers, to give each only once.
REMEMBERED = 1 << 18


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, shingles, offsets, key of each set, bytes) of runs of texts. Equal sets have equal keys."""
    for first, data, offsets in chunks(column):
        hashed, _, _, text = words(data, offsets)
        found, at = shingles(hashed, text, len(offsets) - 1, k)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(splitmix(found ^ U64(0x5851F42D4C957F2D)))])
        keys = splitmix((total[at[1:]] - total[at[:-1]]) ^ (np.diff(at).astype(U64) << U64(40)))
        yield first, found, at, keys.view(np.int64), len(data)


def parities(found: np.ndarray) -> bytes:
    """Of each of 2n to 4n places (within PARITY_BYTES), whether an odd number of the n shingles falls on it."""
    places = min(8 * PARITY_BYTES, 1 << max(6, int(2 * len(found)).bit_length()))
    return np.packbits(np.bincount((found >> U64(9)).astype(np.int64) & (places - 1), minlength=places) & 1).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities for the places of width bytes, as 64-bit words."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return np.ascontiguousarray(bits).view(U64)


def _facts(docs: DataFrame, k: int) -> DataFrame:
    """(kind 0: doc_id, n, key) of every row, key null without shingles; (kind 1: key, n) of shingles that are in n texts of a stretch."""
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "key"]
        held, size, id_type = [], 0, None

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= LOSSY
            n = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, id_type), pa.array(count[some].astype(np.int64)), pa.array(token[some].view(np.int64))], names)

        for batch in batches:
            id_type = batch.column(0).type
            for first, found, at, keys, used in _sets(batch.column(1), k):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0).slice(first, len(n)), pa.array(n), pa.array(keys, mask=n == 0)], names)
                held.append(found)
                size += used
                if size >= STRETCH:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()
        released()

    return docs.mapInArrow(work, f"kind int, doc_id {kind.simpleString()}, n long, key long")


def _classes(facts: DataFrame) -> np.ndarray:
    """For each slot of the shingle hash, the binary logarithm of the largest count of a shingle in it. At most 2**(SLOT_BITS - 3) rows of eight slots reach the driver."""
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS).alias("slot")
    counts = facts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).groupBy(slot).agg(F.floor(F.log2(F.max("n"))).cast("long").alias("class"))
    eight = counts.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.expr("bit_or(shiftleft(class, cast(8 * (slot & 7) as int))) as classes")).toArrow()
    out = np.zeros(1 << (SLOT_BITS - 3), np.int64)
    out[eight["at"].to_numpy()] = eight["classes"].to_numpy()
    return out.view(np.uint8)


def _ranks(found: np.ndarray, order: int, classes: np.ndarray) -> np.ndarray:
    """The place of shingles in a global order: the first ones rarest first, each with its own hash among equals; the last one by hash alone."""
    mixed = splitmix(found + U64(977 * order + 1))
    return mixed if order == ORDERS - 1 else classes[found >> U64(64 - SLOT_BITS)].astype(U64) << U64(58) | mixed >> U64(6)


def _prefix(found: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in an order: so many that two sets of the similarity have one in common."""
    p = len(found) + 1 + -percent * len(found) // 100
    return found[np.argpartition(ranks, p - 1)[:p]] if p < len(found) else found


def _prefixes(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:  # noqa: ANN001
    """(key, n, bits, tokens) of each set that has shingles: its prefix under the first order. A task gives most sets once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, found, at, keys, _ in _sets(batch.column(0), k):
                ranks, rows = _ranks(found, 0, classes.value), []
                for i, key in enumerate(keys.tolist()):
                    if at[i + 1] > at[i] and key not in seen:
                        seen.add(key)
                        rows.append(i)
                tokens = [_prefix(found[at[i] : at[i + 1]], ranks[at[i] : at[i + 1]], percent) for i in rows]
                if rows:
                    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(np.diff(at)[rows]), pa.array([parities(found[at[i] : at[i + 1]]) for i in rows], pa.binary()), lists], ["key", "n", "bits", "tokens"])
                if len(seen) > REMEMBERED:
                    seen.clear()
        released()

    return docs.select("text").mapInArrow(work, "key long, n long, bits binary, tokens array<long>")


def _buckets(prefixes: DataFrame) -> DataFrame:
    """(token, key, n): the sets that share a token, for tokens of at least two sets.

    Of tokens that the very same sets share, the smallest stands for all. A bucket goes if each of its sets has the same largest bucket, another one:
    all its pairs are in that one too.
    """
    rows = prefixes.select(F.explode("tokens").alias("token"), "key", "n")
    shared = settled(rows.groupBy("token").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("token"))
    often = settled(rows.join(shared, "token", "left_semi"))
    met = settled(often.distinct())
    dropped(shared, often)
    marks = met.groupBy("token").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    first = settled(marks.groupBy("sets", "x", "y").agg(F.min("token").alias("token")).select("token", "sets"))
    single = settled(met.join(first, "token"))
    dropped(met, first)
    top = settled(single.groupBy("key").agg(F.max(F.struct("sets", "token")).getField("token").alias("top")))
    within = single.join(top, "key").groupBy("token").agg(F.min("top").alias("x"), F.max("top").alias("y")).where("x = y and x <> token").select("token")
    out = settled(single.join(settled(within), "token", "left_anti").select("token", "key", "n"))
    dropped(single, top)
    return out


class Members:
    """The rows of one task as arrays: which sides of the comparison a row is on (1, 2 or 3 for both), its component, and what it names."""

    def __init__(self, table: pa.Table, bits: list[bytes]) -> None:
        self.token = table["token"][0].as_py()
        self.key, self.component, self.side, self.n = (table[c].to_numpy() for c in ("key", "component", "side", "n"))
        self.other = table["other"].to_numpy(zero_copy_only=False)
        self.names = table["names"]
        self.held: dict[int, frozenset[int]] = {}
        width = np.array([len(b) for b in bits])
        self.bits = {int(w): (at := np.flatnonzero(width == w), np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint8).reshape(-1, w)) for w in np.unique(width)}

    def named(self, i: int) -> frozenset[int]:
        if i not in self.held:
            self.held[i] = frozenset(self.names[i].as_py() or ())
        return self.held[i]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(u, v, upper bound of what they have in common): all pairs of the two sides in different components that have room for the similarity.

        Each place of unequal parity needs a shingle that only one of the two sets has.
        """
        for w, (at, bits) in self.bits.items():
            for w2, (at2, bits2) in self.bits.items():
                least = min(w, w2)
                l, r = at[(self.side[at] & 1) > 0], at2[(self.side[at2] & 2) > 0]
                if not len(l) or not len(r):
                    continue
                x, y = _folded(bits[(self.side[at] & 1) > 0], least), _folded(bits2[(self.side[at2] & 2) > 0], least)
                step = max(1, (4 << 20) // y.size)
                for i in range(0, len(l), step):
                    apart = np.bitwise_count(x[i : i + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                    u, n, m = l[i : i + step], self.n[l[i : i + step]][:, None], self.n[r][None]
                    both = np.minimum((n + m - apart) // 2, np.minimum(n, m))
                    fits = (100 * both >= percent * (n + m - both)) & (self.component[u][:, None] != self.component[r][None]) & (self.key[u][:, None] != self.key[r][None])
                    fits &= ~(self.other[u][:, None] & self.other[r][None]) | (self.key[u][:, None] < self.key[r][None])  # of two that are on both sides once
                    p, q = np.nonzero(fits)
                    yield u[p], r[q], both[p, q]

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that no smaller bucket has too, as far as the two sets name theirs; likeliest first."""
        u, v, both = (np.concatenate(x) for x in zip(*self.pairs(percent), (np.zeros(0, np.int64),) * 3))
        mine = np.fromiter((min(self.named(a) & self.named(b), default=self.token) >= self.token for a, b in zip(u.tolist(), v.tolist())), bool, len(u))
        u, v, both = u[mine], v[mine], both[mine]
        order = np.argsort(-both / np.maximum(1, self.n[u] + self.n[v] - both), kind="stable")
        return u[order], v[order]


def _grouped(rows: DataFrame, keys: list[str], work, shape: str) -> DataFrame:  # noqa: ANN001
    """work on all rows of each combination of keys, one after the other in tasks of many: for very many small groups."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            if held and any(held[-1].column(batch.schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns)):
                yield from work(pa.Table.from_batches(held))
                held = []
            at = 0
            for cut in cuts.tolist():
                yield from work(pa.Table.from_batches([*held, batch.slice(at, cut - at)]))
                held, at = [], cut
            held.append(batch.slice(at))
        if held:
            yield from work(pa.Table.from_batches(held))
        released()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, shape)


TASK = ["token", "block", "opposite"]


def _needed(rows: DataFrame, percent: int) -> DataFrame:
    """Those rows of tasks that are in some candidate pair, without their parities."""
    names = [*TASK, "side", "key", "component", "other", "names"]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows > 1:
            u, v = Members(table, table["bits"].to_pylist()).candidates(percent)
            if len(u):
                yield from table.select(names).take(pa.array(np.unique(np.concatenate([u, v])))).to_batches()

    kept = rows.select(*names, "n", "bits")
    return settled(_grouped(kept, TASK, work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*names).schema)))


def _forest(docs: DataFrame, tasks: DataFrame, k: int, percent: int, classes) -> DataFrame:  # noqa: ANN001
    """(a, b): links that connect what similar pairs within a task connect, at most one less than the task has sets.

    A candidate pair must share a prefix token under every other order too; then the sets themselves are compared. Pairs that others have
    connected already are passed over.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(table["set"])
        sets = [np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), U64) for i in range(table.num_rows)]
        table = table.set_column(table.schema.get_field_index("n"), "n", pa.array([len(s) for s in sets], pa.int64()))
        rows = Members(table, [parities(s) for s in sets])
        root: dict[int, int] = {}
        cut: dict[tuple[int, int], np.ndarray] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        def prefix(i: int, order: int) -> np.ndarray:
            if (i, order) not in cut:
                cut[i, order] = np.sort(_prefix(sets[i], _ranks(sets[i], order, classes.value), percent))
            return cut[i, order]

        def meet(i: int, j: int, order: int) -> bool:
            a, b = prefix(i, order), prefix(j, order)
            return bool((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).any())

        found = []
        for i, j in zip(*(x.tolist() for x in rows.candidates(percent))):
            a, b = top(int(rows.component[i])), top(int(rows.component[j]))
            if a == b or not all(meet(i, j, order) for order in range(1, ORDERS)):
                continue
            x, y = sets[i], sets[j]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[max(a, b)] = min(a, b)
                found.append((int(rows.key[i]), int(rows.key[j])))
        if found:
            least: dict[int, int] = {}
            members = {x for pair in found for x in pair}
            component = dict(zip(rows.key.tolist(), rows.component.tolist()))
            for key in members:
                t = top(component[key])
                least[t] = min(key, least.get(t, key))
            stars = [(least[top(component[key])], key) for key in sorted(members) if least[top(component[key])] != key]
            a, b = zip(*stars)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sets = _wanted(docs, tasks, k)
    shape = tasks.join(sets, "key").select(*TASK, "side", "key", "component", "other", "names", F.lit(0).cast("long").alias("n"), "set")
    out = settled(_grouped(shape, TASK, work, "a long, b long"))
    dropped(sets)
    return out


def _wanted(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(key, set): the shingles of each key that rows name. Only sets that rows name are shuffled: a filter of bounded size tells most of the others."""
    names = settled(rows.select("key").distinct())
    bits = min(BLOOM_BYTES * 8, 1 << max(13, int(32 * max(1, names.count())).bit_length()))
    spots = names.select(F.explode(F.array(F.pmod("key", F.lit(bits)), F.pmod(F.shiftrightunsigned("key", 24), F.lit(bits)))).alias("bit"))
    words_ = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int))) as mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words_["word"].to_numpy()] = words_["mask"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, found, at, keys, _ in _sets(batch.column(0), k):
                one, two = keys % bits, (keys.view(U64) >> U64(24)).astype(np.int64) % bits
                t = shared.value
                hit = ((t[one >> 6] >> (one & 63)) & (t[two >> 6] >> (two & 63)) & 1).astype(bool) & (np.diff(at) > 0)
                some = [i for i in np.flatnonzero(hit).tolist() if not (int(keys[i]) in seen or seen.add(int(keys[i])))]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array([found[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], ["key", "set"])
                if len(seen) > REMEMBERED:
                    seen.clear()
        released()

    return settled(docs.select("text").mapInArrow(emit, "key long, set binary").join(names, "key", "left_semi").dropDuplicates(["key"]))


def _pieces(sets: Column, size: Column) -> Column:
    """How many blocks of BLOCK sets and BLOCK_BYTES a group of sets with so many shingles is dealt into."""
    return F.greatest(F.lit(1), F.ceil(sets / BLOCK), F.ceil(size * 8 / BLOCK_BYTES)).cast("long")


def _hot_tasks(met: DataFrame) -> DataFrame:
    """Tasks that compare the members of buckets beyond one block with those of their own block and a few heads, which all blocks of a bucket share.

    Each set is in one of them only, that of its largest bucket. Heads are the members with the smallest keys, which are hashes.
    """
    sizes = met.groupBy("token").agg(F.count("*").alias("sets"), F.sum("n").alias("size")).withColumn("pieces", _pieces(F.col("sets"), F.col("size"))).where("pieces > 1")
    sized = met.join(settled(sizes), "token")
    top = settled(sized.groupBy("key").agg(F.max(F.struct("sets", "token", "pieces")).alias("t")).select("key", "t.*"))
    head = F.col("key") < F.lit(-(2.0**63)) + F.lit(2.0**64) * HEADS / F.col("sets")
    heads = sized.where(head).select("token", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("block"))
    mine = top.select("token", "key", F.pmod(F.xxhash64("key"), F.col("pieces")).alias("block"))
    tasks = mine.union(heads.select("token", "key", "block")).distinct()
    return settled(tasks.select("token", "block", F.lit(0).cast("long").alias("opposite"), F.lit(3).alias("side"), "key", F.col("key").alias("component"), F.lit(True).alias("other"), F.lit(None).cast("array<long>").alias("names")))


def _tasks(met: DataFrame, labels: DataFrame | None, maps: DataFrame) -> DataFrame:
    """Tasks that compare all pairs of each bucket whose sets are in different components.

    A bucket beyond one block is dealt twice: all its sets into blocks, and those outside its largest component into blocks of their own, the
    opposite side. Each two blocks are a task, so the copies are few as long as most of the bucket is one component.
    """
    rows = met.withColumn("component", F.col("key")) if labels is None else met.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = settled(rows)
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    whole = parts.groupBy("token").agg(F.sum("sets").alias("sets"), F.sum("size").alias("size"), F.max(F.struct("sets", "component", "size")).alias("most")).where("sets > most.sets")
    pieces = _pieces(F.col("sets"), F.col("size")).alias("pieces")
    whole = settled(whole.select("token", pieces, F.when(pieces == 1, F.lit(1)).otherwise(_pieces(F.col("sets") - F.col("most.sets"), F.col("size") - F.col("most.size"))).cast("long").alias("sides"), F.col("most.component").alias("largest")))
    rows = settled(rows.join(whole, "token"))
    names = rows.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("token")), 1, NAMED).alias("names"))
    rows = rows.join(settled(names.join(maps, "key")), "key").withColumn("other", (F.col("pieces") == 1) | (F.col("component") != F.col("largest"))).drop("n")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.select("token", F.pmod(F.xxhash64("key"), F.col("pieces")).alias("block"), each("sides").alias("opposite"), F.when(F.col("pieces") == 1, F.lit(3)).otherwise(F.lit(1)).alias("side"), "key", "component", "other", "names", "size", "bits")
    right = rows.where("pieces > 1 and other").select("token", each("pieces").alias("block"), F.pmod(F.xxhash64(F.lit(1), "key"), F.col("sides")).alias("opposite"), F.lit(2).alias("side"), "key", "component", "other", "names", "size", "bits")
    return left.union(right).withColumnRenamed("size", "n")


def _near_labels(links: DataFrame) -> DataFrame:
    """(key, component): of each linked set the smallest within two links. Equal labels mean one component; the reverse need not hold yet."""
    both = settled(links.union(links.select("b", "a")))
    least = settled(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    far = both.join(least.select(F.col("a").alias("b"), "m"), "b").groupBy(F.col("a").alias("key")).agg(F.min("m").alias("component"))
    return settled(far.select("key", F.least("key", "component").alias("component")))


def link(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: which documents similar ones connect, directly or by way of others.

    A document is its set of distinct k-word shingles (A-Z lower-cased; fewer words: the whole sequence), and two are linked when
    100 * intersection >= percent * union. The result is exact but for collisions of 64-bit hashes.

    Equal sets count as one from the start. Two similar sets share a token of their prefixes under any one order of all tokens. The prefixes
    under one order are exchanged; sets that share a token are a bucket, and buckets of the very same sets are one. In the task of a bucket
    small bitmaps of parities first tell which sets have room for the similarity with another one; only these sets are fetched. There a pair
    must meet under each of the other orders too before it is compared exactly, and links are put out that connect what similar
    pairs connect. Large buckets are dealt into blocks: first each block on its own, then all pairs that are still apart.

    A null or blank text has no shingles, is linked with nothing and is its own component. Repeated rows and ids keep a row each; a null id
    has a row, but names no component unless it is alone. Columns other than doc_id and text are ignored. Empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    facts = settled(_facts(docs, k))
    classes = docs.sparkSession.sparkContext.broadcast(_classes(facts))
    prefixes = settled(_prefixes(docs, k, percent, classes))
    met = _buckets(prefixes)
    maps = settled(prefixes.join(met.select("key").distinct(), "key", "left_semi").select("key", F.col("n").alias("size"), "bits").dropDuplicates(["key"]))
    dropped(prefixes)

    hot, links, labels = _hot_tasks(met), [], None
    if not hot.isEmpty():
        links.append(_forest(docs, hot, k, percent, classes))
        labels = _near_labels(links[0])
    needed = _needed(_tasks(met, labels, maps), percent)
    dropped(met, maps)
    links.append(_forest(docs, needed, k, percent, classes))
    links = links[0] if len(links) == 1 else links[0].union(links[1])
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    sets = facts.where("kind = 0").where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    known = settled(sets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    tops = settled(known.groupBy("component").agg(F.min("least").alias("component_id")))
    named = settled(known.join(tops, "component").select("key", "component_id"))
    return facts.where("kind = 0").join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
