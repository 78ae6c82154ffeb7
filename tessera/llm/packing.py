"""Packing documents into training sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.durable import settled
from tessera.llm.textkit import released
from tessera.operators.joins import small

#: Documents and bytes of a group, on average. A group is packed in one task, so this bounds its memory; the last sequences of a group are what stays unfilled.
GROUP, GROUP_BYTES = 1024, 8 << 20
#: Texts of only these characters split into the same words by both libraries; others go to the slower one, which is the measure.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-ſ‐-‧]*\Z")
_LONG = re.compile(r"[^\s]{400}")


class CapacityTree:
    """A tournament over bins: each inner node has the larger free space of its two halves, so the first bin with room is found from the root."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, whose space it takes."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            node += free[node] < size
        free[node] -= size
        bin_ = node - self.leaves
        while node > 1:
            node >>= 1
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size, none above capacity; equal sizes in their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = CapacityTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i] = tree.place(size)
        offsets[i] = capacity - tree.free[tree.leaves + bins[i]] - size
    return bins, offsets


@lru_cache(2)
def _encoder(path: str):  # noqa: ANN202
    """Token ids of a list of texts. path is a byte-level vocabulary of the tokenizers library; ranks of the same name beside it serve plain texts."""
    from pathlib import Path

    from tokenizers import Tokenizer

    slow, ranks = Tokenizer.from_file(path), Path(path).with_suffix(".tiktoken")
    fast, special = None, [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks.exists():
        import public_tokenizers
        import tiktoken

        pairs = (line.split() for line in ranks.read_bytes().splitlines() if line)
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        plain = [fast is not None and bool(_PLAIN.match(t)) and not _LONG.search(t) and not any(s in t for s in special) for t in texts]
        out = [fast.encode_ordinary(t) if p else None for t, p in zip(texts, plain)]
        rest = [i for i, p in enumerate(plain) if not p]
        for i, got in zip(rest, slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = got.ids
        return out

    return encode


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, group: int = GROUP, seed: int = 23) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    A document is its token ids, then end_id; a null or empty text has end_id alone. Whole stretches of length ids make sequences of their own,
    and the rests of a group's documents are packed by first-fit decreasing, so no rest is cut. Groups go by a seeded hash of id and text;
    their number follows the rows and bytes, and each is packed on its own. Equal rows are packed as separate documents; where there are more of
    them than a group takes, they go round the groups by row number.
    Columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("mixed"))
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-size.rows // group), -(-(size.bytes or 0) // GROUP_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hot, turn = settled(docs.groupBy("mixed").agg(F.count("*").alias("times")).where(F.col("times") > group)), F.lit(0)
    if not hot.isEmpty():
        docs, turn = docs.join(small(hot), "mixed", "left"), F.when(F.col("times").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = docs.select(F.pmod(F.pmod("mixed", F.lit(groups)) + turn, F.lit(groups)).alias("pack"), "doc_id", "text")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        base = table.column("pack")[0].as_py() << 40
        texts, tokens = table.column("text"), []
        for i in range(0, len(texts), 64):
            tokens += [np.array([*x, end_id], "<u4") for x in encode([t or "" for t in texts.slice(i, 64).to_pylist()])]
        sizes = np.array([len(x) for x in tokens], np.int64)
        full, rest = sizes // length, sizes % length
        some = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[some], length)
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(sizes[doc] - start, length)
        partial = size < length
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[partial], offset[partial] = bins, offsets
        packed = bins.max(initial=-1) + 1
        sequence[~partial] = packed + np.arange((~partial).sum())
        ids, flat = table.column("doc_id"), np.cumsum(sizes) - sizes
        stream = np.concatenate(tokens).tobytes()
        for a in range(0, len(doc), 2048):
            at = slice(a, a + 2048)
            held = [stream[4 * x : 4 * (x + n)] for x, n in zip((flat[doc[at]] + start[at]).tolist(), size[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc[at])).combine_chunks(), pa.array(start[at]), pa.array(size[at]), pa.array(held, pa.binary()), pa.array(sizes[doc[at]]), pa.array(base + sequence[at]), pa.array(offset[at])],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    def grouped(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(work(table))
        released()
        return out

    return rows.groupBy("pack").applyInArrow(grouped, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
