"""Token ids as files: canonical length-limited Huffman codes from the ids' counts over all documents, in independent blocks with bit-offset checkpoints.

A folder holds two Parquet tables. `book` has a row for each id that occurs: id, n, bits (its code's length). `blocks` has a row for each block, and
its files go by ascending doc_id: part and first (ids of the part before the block) give its place; doc_ids and sizes its documents; bits
the codes of all its ids, one behind the other, most significant bit first, in bytes; checkpoints the bit at which every STRIDE-th id begins.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.durable import dropped, settled
from tessera.llm.textkit import buffers, released

#: No code is longer than so many bits, so a table of 2**LIMIT entries decodes any of them.
LIMIT = 18
#: Ids between two checkpoints of a block; a block closes at so many ids, and a document isn't cut.
STRIDE, BLOCK_IDS = 256, 1 << 19
#: Words that a task remembers with their ids, and the longest of these in characters.
WORDS, WORD_CHARS = 400_000, 48


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code, 0 where its count is 0: the least total of all prefix codes of at most `limit` bits, by package-merge. Equal counts go by id."""
    some = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(some) > 1 << limit:
        raise ValueError(f"{len(some)} ids don't fit codes of {limit} bits")
    if len(some) < 2:
        out[some] = 1
        return out
    order = some[np.argsort(counts[some], kind="stable")]
    weights = counts[order].astype(np.float64)
    # merged[k] says of each item of level k whether it is an id (in order) or a pair of the level before.
    level, merged = weights, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both, own = np.concatenate([weights, pairs]), np.concatenate([np.ones(len(weights), bool), np.zeros(len(pairs), bool)])
        at = np.argsort(both, kind="stable")
        level = both[at]
        merged.append(own[at])
    bits, taken = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for own in reversed(merged):
        ids = int(own[:taken].sum())
        bits[:ids] += 1
        taken = 2 * (taken - ids)
    out[order] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, equal lengths by id, each the next number."""
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    some = np.flatnonzero(bits)
    lengths, starts = np.unique(bits[some], return_index=False), {}
    for n in lengths.tolist():
        code <<= n - last
        starts[n], last = code, n
        ids = some[bits[some] == n]
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def encode_bits(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids one behind the other, and the bit at which each begins."""
    size = bits[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    words = np.zeros((total + 31) // 32 + 2, np.uint64)
    if len(ids):
        # Each code lies in a window of two 32-bit words; codes that begin in the same word lie together, so a sum joins their bits.
        window = codes[ids] << (64 - size - (start & 31)).astype(np.uint64)
        word = start >> 5
        cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        joined, at = np.add.reduceat(window, cut), word[cut]
        words[at] += joined >> np.uint64(32)
        words[at + 1] += joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], start


def decoding_table(bits: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The id and the code's length for every string of `limit` bits that begins with the code."""
    codes = canonical(bits)
    some = np.flatnonzero(bits)
    some = some[np.lexsort((some, bits[some]))]
    span = np.int64(1) << (limit - bits[some].astype(np.int64))
    ids, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    if len(some):
        filled = int(span.sum())
        assert int(codes[some[-1]] + np.uint64(1)) << (limit - int(bits[some[-1]])) == filled
        ids[:filled], size[:filled] = np.repeat(some, span), np.repeat(bits[some], span)
    return ids, size


def decode_bits(data: bytes, starts: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids from several places at once, sizes[i] of them from bit starts[i] on; all places take a step together."""
    raw = np.frombuffer(data + b"\0" * (12 - len(data) % 4), ">u4").astype(np.uint64)
    pairs = raw[:-1] << np.uint64(32) | raw[1:]
    ids, size = table
    at, out = starts.astype(np.int64), np.zeros((int(sizes.max(initial=0)), len(starts)), np.uint32)
    mask, most = np.uint64((1 << limit) - 1), len(pairs) - 1
    for i in range(len(out)):
        key = pairs[np.minimum(at >> 5, most)] >> (64 - limit - (at & 31)).astype(np.uint64) & mask
        out[i] = ids[key]
        at += size[key]
    return out.T[np.arange(len(out)) < sizes[:, None]]


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others are numbered from 256 on."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in itself else next(rest) for b in range(256)}


#: Words of these characters are the same after composition, and these are their parts once they are in lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


@lru_cache(2)
def _encoder(path: str):  # noqa: ANN202
    """Little-endian ids of a text, by a tokenizers file whose words end at white space, so that each word has the same ids wherever it stands.

    Plain words are cut here and go straight to the file's model; whatever else, such as its special strings, goes through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    slow, known, letters = Tokenizer.from_file(path), {}, _byte_letters()
    kind, code = ("<u2", "H") if slow.get_vocab_size() <= 1 << 16 else ("<u4", "I")
    model, special = slow.model.tokenize, [t.content for t in slow.get_added_tokens_decoder().values()]
    ids_of = (lambda ids: array(code, ids).tobytes()) if sys.byteorder == "little" else (lambda ids: np.array(ids, kind).tobytes())

    def part(word: str) -> bytes:
        ids = known.get(word)
        if ids is None:
            ids = known[word] = ids_of([t.id for t in model(word if word.isascii() else word.encode().decode("latin-1").translate(letters))])
        return ids

    def encode(text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(known) > WORDS:
            known.clear()
        rest, odd, long = [], None, {}
        for w in set(words).difference(known):
            if odd is None:
                odd = any(s in text for s in special)
            if w.isalpha() and w.isascii() and len(w) <= WORD_CHARS:
                known[w] = part(w.lower())
            elif len(w) <= WORD_CHARS and _PLAIN.fullmatch(w) and not (odd and any(s in w for s in special)):
                known[w] = b"".join(map(part, _PARTS.findall(w.lower())))
            else:
                rest.append(w)
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for w, e in zip(some, slow.encode_batch_fast(some, add_special_tokens=False)):
                (known if len(w) <= WORD_CHARS else long)[w] = ids_of(e.ids)
        return b"".join([known[w] if len(w) <= WORD_CHARS else long[w] for w in words] if long else map(known.__getitem__, words))

    return encode, kind


def tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary, n, tie, turn), settled: the ids of each text and the end id, in the narrowest type of the vocabulary; tie and turn order rows of one doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = _encoder(tokenizer)
        end, wide = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                ids = [encode(t.as_py() or "") + end for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // wide for x in ids], pa.int64())], ["doc_id", "ids", "n"])
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids binary, n long")
    return settled(made.withColumns({"tie": F.xxhash64("ids"), "turn": F.monotonically_increasing_id()}))


def id_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all ids; each task adds up its own first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(buffers(batch.column(0))[0].view(kind))
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return rows.select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = LIMIT, block_ids: int = BLOCK_IDS, stride: int = STRIDE) -> None:
    """Token ids of all texts, each with end_id behind it, in ascending doc_id order (nulls first) as the two tables of this module under path.

    Rows of one doc_id go by a hash of their ids; equal rows are documents of their own. A null or empty text has end_id alone; an empty
    table gives a book and blocks without rows. Columns other than doc_id and text are ignored. The book comes to the driver and goes to all tasks: a few
    bytes an id, and a vocabulary bounds the ids. Ids are counted over all documents. Both tables are written by Spark's committed writers, so lost tasks are
    run again and leave nothing behind.
    """
    kind = _encoder(tokenizer)[1]
    rows = tokens(docs, tokenizer, end_id)
    counts = {r.id: r.n for r in id_counts(rows, kind).collect()}
    n = np.zeros(max(counts, default=0) + 1, np.int64)
    n[list(counts)] = list(counts.values())
    bits = code_lengths(n, limit)
    book = rows.sparkSession.createDataFrame([(i, int(n[i]), int(bits[i])) for i in sorted(counts)], "id long, n long, bits int")
    book.coalesce(1).write.parquet(f"{path}/book")
    doc = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, first, held, used = canonical(bits), TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            data, start = encode_bits(ids, bits, codes)
            names, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            of = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([first]), pa.array([len(ids)]), of, pa.array([sizes], pa.list_(pa.int64())), pa.array([start[::stride]], pa.list_(pa.int64())), pa.array([stride]), pa.array([data], pa.binary())],
                ["part", "first", "n_ids", "doc_ids", "sizes", "checkpoints", "stride", "bits"],
            )

        for batch in batches:
            ids, end = buffers(batch.column(1))[0].view(kind), np.cumsum(batch.column(2).to_numpy())
            row = 0
            while row < batch.num_rows:
                before = int(end[row - 1]) if row else 0
                # Up to the document that fills the block.
                upto = min(batch.num_rows, int(np.searchsorted(end, before + block_ids - used)) + 1)
                held.append((batch.column(0).slice(row, upto - row), np.diff(end[row:upto], prepend=before), ids[before : end[upto - 1]]))
                used, row = used + int(end[upto - 1]) - before, upto
                if used >= block_ids:
                    yield closed()
                    first, held, used = first + used, [], 0
        if held:
            yield closed()
        released()

    order = ["doc_id", "tie", "turn"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "n")
    ranged.mapInArrow(work, f"part long, first long, n_ids long, doc_ids array<{doc}>, sizes array<long>, checkpoints array<long>, stride long, bits binary").write.parquet(f"{path}/blocks")
    dropped(rows)


def _book(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/book").select("id", "bits").collect()  # one row an id of the vocabulary
    bits = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        bits[r.id] = r.bits
    return bits


def read_ids(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that write_ids put under path; ids are little-endian unsigned 32-bit, start the ids of all documents before.

    Blocks are decoded independently. With `only`, a condition on doc_id, just the stretches of ids that hold such documents are decoded, from their
    checkpoints on; start stays that in the whole.
    """
    bits = _book(spark, path)
    limit = int(bits.max(initial=1))
    blocks = spark.read.parquet(f"{path}/blocks")
    doc = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # A row a part, and there are no more parts than the writing shuffle had partitions.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    wanted = F.lit(None).cast("array<boolean>") if only is None else F.col("wanted")
    if only is not None:
        each = blocks.select("part", "first", F.posexplode("doc_ids").alias("at", "doc_id")).groupBy("part", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(only, F.lit(False)).alias("w")))), lambda x: x.w).alias("wanted"))
        blocks = blocks.join(each, ["part", "first"]).where(F.exists("wanted", lambda w: w))
    rows = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("first")).alias("base"), "doc_ids", "sizes", "checkpoints", "stride", "bits", wanted.alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(bits, limit)
        for batch in batches:
            for r in range(batch.num_rows):
                base, names, sizes, checks, stride, data, mask = (batch.column(i)[r] for i in range(7))
                sizes, checks, stride = np.array(sizes.as_py(), np.int64), np.array(checks.as_py(), np.int64), stride.as_py()
                end, total = np.cumsum(sizes), int(sizes.sum())
                begin = end - sizes
                take = np.flatnonzero(np.array(mask.as_py())) if mask.is_valid else np.arange(len(sizes))
                used = np.zeros(len(checks) + 1, np.int64)
                np.add.at(used, begin[take] // stride, 1)
                np.add.at(used, (end[take] - 1) // stride + 1, -1)
                lanes = np.flatnonzero(np.cumsum(used[:-1]))
                places = np.minimum(stride, total - lanes * stride)
                ids = decode_bits(data.as_buffer().to_pybytes(), checks[lanes], places, table, limit)
                # Where the ids of a lane lie in what was decoded.
                offset = np.zeros(len(checks), np.int64)
                offset[lanes] = np.cumsum(places) - places - lanes * stride
                at = begin[take] + offset[begin[take] // stride]
                stream = ids.astype("<u4").tobytes()
                for i in range(0, len(take), 512):
                    some = slice(i, i + 512)
                    out = [stream[4 * a : 4 * (a + n)] for a, n in zip(at[some].tolist(), sizes[take[some]].tolist())]
                    yield pa.RecordBatch.from_arrays([names.values.take(pa.array(take[some])), pa.array(base.as_py() + begin[take[some]]), pa.array(sizes[take[some]]), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        released()

    return rows.mapInArrow(work, f"doc_id {doc}, start long, n_tokens long, ids binary")
