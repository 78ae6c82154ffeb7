"""Removing repeated passages: a suffix sort of the places where a repeat can begin, as a distributed merge sort that knows common prefixes.

A repeat of LENGTH bytes is found by an anchor in it: of the GRAM-byte strings that start in the window, the one with the least hash. Equal
windows have equal anchors, so only the suffixes at anchors are sorted, one in about fifteen bytes. As in prefix-doubling string sorts, a
first exchange of hashes tells which anchors occur in more than one document; suffixes at the others need no sorting. The rest are
sorted in their block, exchanged as front-coded runs, and merged by a loser tree that keeps for each run how many bytes its head shares
with the last string put out, and never looks at those bytes again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import textkit
from tessera.llm.blocks import blocks, frozen, thawed
from tessera.llm.durable import settled
from tessera.llm.textkit import BYTE_CODE, U64, as_binary, buffers, released, splitmix

LENGTH, GRAM = 50, 20
#: Bytes of text of a block; its anchors with their surroundings take some fifteen times as much.
SORT_BYTES = 4 << 20
#: A range of hashes, and so a merge task, gets the anchors of about so many bytes of text.
RANGE_BYTES = 6 << 20
_LAST = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): for each window of length bytes inside a text, the first of its grams with the least hash; each place once, in order."""
    n, m, w = len(data), len(data) - gram + 1, length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = textkit._powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=total[1:])
    hashed = splitmix((total[gram:] - total[:m]) * down[:m])
    least, reach = (hashed >> U64(32) << U64(32)) | np.arange(m, dtype=U64), 1
    while reach * 2 <= w:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < w:
        least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
    inside = np.arange(len(least)) + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    chosen = np.zeros(m, bool)
    chosen[(least[inside] & U64(0xFFFFFFFF)).astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, hashed[places]


def _anchored(docs: pa.Table, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, offsets, first row, places, hashes, rows) of runs of texts of a block."""
    for first, data, offsets in textkit.chunks(docs["text"].combine_chunks()):
        places, hashed = anchors(data, offsets, length, gram)
        yield data, offsets, first, places, hashed, np.searchsorted(offsets, places, "right") - 1


def _trimmed(work):  # noqa: ANN001, ANN202
    """A group function whose memory goes back to the system when a group is done."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return work(*tables)
        finally:
            released()

    return (lambda a: run(a)) if work.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


def _ids(docs: pa.Table) -> np.ndarray:
    return docs["doc_id"].combine_chunks().cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _code(hashed: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash and 31 more bits of it in one number."""
    return ((hashed >> U64(32)) % U64(ranges) << U64(31) | (hashed & U64(0x7FFFFFFF))).astype(np.int64)


def _requests(ranges: int, length: int, gram: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = thawed(blob.as_buffer())
                ids, codes, owners = _ids(docs), [], []
                for _, _, first, _, hashed, rows in _anchored(docs, length, gram):
                    code = _code(hashed, ranges)
                    order = np.lexsort([ids[first + rows], code])
                    code, owner = code[order], ids[first + rows][order]
                    keep = np.ones(len(code), bool)
                    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
                    codes.append(code[keep])
                    owners.append(owner[keep])
                if not codes:
                    continue
                code, owner = np.concatenate(codes), np.concatenate(owners)
                order = np.argsort(code, kind="stable")
                code, owner = code[order], owner[order]
                head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
                if not len(head):
                    continue
                several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
                code = code[head]
                value = ((code & 0x7FFFFFFF) << 1 | several).astype(np.uint32)
                range_, at = np.unique(code >> 31, return_index=True)
                at = np.append(at, len(code))
                yield pa.RecordBatch.from_arrays([pa.array(range_.astype(np.int32)), pa.array(np.full(len(range_), block)), as_binary(value, at)], ["range", "block", "values"])
                del docs, codes, owners, code, owner, order, value
                released()

    return work


def _shared(table: pa.Table) -> pa.Table:
    """For each block of a range, the values that other blocks have too or that are in several of its documents."""
    data, offsets = buffers(table["values"])
    values = np.frombuffer(data.tobytes(), np.uint32)
    owner = np.repeat(np.arange(table.num_rows), np.diff(offsets) // 4)
    order = np.argsort(values >> 1, kind="stable")
    plain, several = (values >> 1)[order], (values & 1)[order]
    head = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
    count = np.diff(np.append(head, len(plain)))
    hot = np.repeat((count > 1) | (np.maximum.reduceat(several, head) > 0), count)
    plain, owner = plain[hot], owner[order][hot]
    order = np.lexsort([plain, owner])
    at = np.searchsorted(owner[order], np.arange(table.num_rows + 1))
    return pa.table([table["range"], table["block"], as_binary(plain[order].astype(np.uint32), at)], names=["range", "block", "values"])


def _contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(length bytes from each place on, the length - gram before it, nearest first, how many of either are in the text)."""
    back = length - gram
    ahead = np.minimum(offsets[rows + 1] - places, length)
    behind = np.minimum(places - offsets[rows], back)
    spread = np.arange(length)
    right = data[np.minimum(places[:, None] + spread, len(data) - 1)] * (spread < ahead[:, None])
    spread = np.arange(back)
    left = data[np.maximum(places[:, None] - 1 - spread, 0)] * (spread < behind[:, None])
    return right.astype(np.uint8), left.astype(np.uint8), ahead, behind


def _whole(places: np.ndarray, ahead: np.ndarray, behind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all windows with a place that are in the text."""
    return places - behind, places - (length - ahead) + length


def _run(right: np.ndarray, left: np.ndarray, ahead: np.ndarray, behind: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> bytes:
    """A front-coded run: suffixes in order, each without the bytes that it shares with the one before."""
    length, back = right.shape[1], left.shape[1]
    order = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
    right, left, ahead, behind = right[order], left[order], ahead[order], behind[order]
    same = np.zeros(len(order), np.int64)
    differ = right[1:] != right[:-1]
    same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    same = np.minimum(same, ahead)
    spread = np.arange(length)
    tail = right[(spread >= same[:, None]) & (spread < ahead[:, None])]
    near = left[np.arange(back) < behind[:, None]]
    sums = lambda n: np.concatenate([[0], np.cumsum(n)])
    columns = [pa.array(same.astype(np.uint8)), pa.array(doc[order]), pa.array(row[order].astype(np.int32)), pa.array(place[order].astype(np.int64)), as_binary(tail, sums(ahead - same)), as_binary(near, sums(behind))]
    return frozen(pa.RecordBatch.from_arrays(columns, ["same", "doc", "row", "place", "tail", "left"]))


def _sort_block(ranges: int, length: int, gram: int):  # noqa: ANN202
    def work(there: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["range", "block", "data", "known"]
        if not there.num_rows or not answers.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=names)
        block, docs = there["block"][0].as_py(), thawed(there["docs"][0].as_buffer())
        ids = _ids(docs)
        data, offsets = buffers(answers["values"])
        hot = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
        hot = np.sort(hot | np.repeat(answers["range"].to_numpy().astype(np.int64) << 31, np.diff(offsets) // 4))
        found = []
        for data, offsets, first, places, hashed, rows in _anchored(docs, length, gram):
            code = _code(hashed, ranges)
            at = np.minimum(np.searchsorted(hot, code), max(0, len(hot) - 1))
            some = hot[at] == code if len(hot) else np.zeros(len(code), bool)
            right, left, ahead, behind = _contexts(data, offsets, places[some], rows[some], length, gram)
            found.append((right, left, ahead, behind, first + rows[some], places[some] - offsets[rows[some]], code[some] >> 31))
        right, left, ahead, behind, row, place, range_ = (np.concatenate(x) for x in zip(*found))
        del found, hot
        doc = ids[row]
        # Of equal surroundings in this block only those in the smallest document go on; the others are known to repeat it.
        mixed = np.full(len(row), 7, U64)
        for matrix in (right, left):
            wide = np.zeros((len(row), -(-matrix.shape[1] // 8) * 8), np.uint8)
            wide[:, : matrix.shape[1]] = matrix
            for column in wide.view(U64).T:
                mixed = splitmix(mixed * U64(0x9FB21C651E98DF25) + column)
            del wide
        mixed = splitmix(mixed + (ahead.astype(U64) << U64(8)) + behind.astype(U64))
        order = np.lexsort([doc, mixed])
        head = np.append(True, mixed[order][1:] != mixed[order][:-1]) if len(order) else np.zeros(0, bool)
        x, y = order[np.flatnonzero(~head) - 1], order[~head]  # equal hashes: their bytes decide
        head[~head] = (right[x] != right[y]).any(axis=1) | (left[x] != left[y]).any(axis=1) | (ahead[x] != ahead[y]) | (behind[x] != behind[y])
        least = doc[order][head][np.cumsum(head) - 1] if len(order) else doc
        goes = np.zeros(len(row), bool)
        goes[order] = doc[order] == least
        start, end = _whole(place, ahead, behind, length)
        known = ~goes & (end - start >= length)
        out = [(block % ranges, block, None, _spans(row[known], start[known], end[known]))] if known.any() else []
        at = np.flatnonzero(goes)
        at = at[np.argsort(range_[at], kind="stable")]
        for r, i in zip(*np.unique(range_[at], return_index=True)):
            part = at[i : np.searchsorted(range_[at], r, "right")]
            out.append((int(r), block, _run(right[part], left[part], ahead[part], behind[part], doc[part], row[part], place[part]), None))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    return work


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Row, start and end of spans, those that touch joined, as 64-bit numbers."""
    order = np.lexsort([start, row])
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if len(row):
        big = row * (1 << 42)
        far = np.maximum.accumulate(end + big)
        fresh = np.append(True, start[1:] + big[1:] > far[:-1])
        head = np.flatnonzero(fresh)
        row, start, end = row[head], start[head], (far - big)[np.append(head[1:], len(big)) - 1]
    return np.column_stack([row, start, end]).tobytes()


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, bytes shared with the string before) of all strings of front-coded runs in order; equal ones by run.

    A loser tree. Every string that waits in it knows how many bytes it shares with the last one put out: the one that shares more is the
    smaller, without a look at either; only if they share the same number are they compared, from that byte on.
    """
    leaves = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [tails[0] if tails else None for _, tails in runs] + [None] * (leaves - len(runs))
    shared, at = [0] * leaves, [0] * leaves
    losers = [-1] * leaves

    def winner(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        n, m = shared[a], shared[b]
        if n != m:
            return (a, b) if n > m else (b, a)
        end = min(len(x), len(y))
        while n < end and x[n] == y[n]:
            n += 1
        first = (len(x), a) <= (len(y), b) if n == end and len(x) != len(y) else a < b if n == end else x[n] < y[n]
        if first:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        won, lost = winner(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return won

    top = build(1)
    while (text := heads[top]) is not None:
        yield top, at[top], shared[top]
        same, tails = runs[top]
        at[top] = i = at[top] + 1
        if i < len(tails):
            heads[top], shared[top] = text[: same[i]] + tails[i], same[i]
        else:
            heads[top] = None
        node = (top + leaves) >> 1
        while node:
            top, losers[node] = winner(top, losers[node])
            node >>= 1


def _merge_range(length: int, gram: int):  # noqa: ANN202
    back = length - gram

    def work(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_valid(table["known"])).select(["block", "known"]).rename_columns(["block", "data"])
        table = table.filter(pa.compute.is_valid(table["data"]))
        if not table.num_rows:
            return known
        parts, runs = [thawed(x.as_buffer()).combine_chunks() for x in table["data"]], []
        for part in parts:
            runs.append((part["same"].to_pylist(), part["tail"].to_pylist()))
        total = sum(len(r[0]) for r in runs)
        run, index, same = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for i, (a, b, c) in enumerate(merged(runs)):
            run[i], index[i], same[i] = a, b, c
        del runs
        base = np.concatenate([[0], np.cumsum([p.num_rows for p in parts])])
        whole = pa.concat_tables(parts).combine_chunks()
        at = base[run] + index
        doc, row, place = (whole[c].to_numpy()[at] for c in ("doc", "row", "place"))
        tails, offsets = np.diff(buffers(whole["tail"])[1]), buffers(whole["left"])
        ahead = (tails + whole["same"].to_numpy())[at]
        near, near_at = offsets
        behind = np.diff(near_at)[at]
        near = np.append(near, 0).astype(np.uint8)
        first, last = np.full(total, -1), np.full(total, -1)  # least and largest distance from the start of a repeated window to its anchor
        cuts = np.append(np.flatnonzero(same < gram), total)
        a = 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 65536, "right")) - 1)
            here = slice(cuts[a], cuts[b])
            _compare(here, same, doc, ahead, behind, near, near_at[:-1][at[here]], length, back, first, last)
            a = b
        hit = last >= 0
        block = np.asarray(table["block"].to_numpy())[run]
        out = []
        for name in np.unique(block[hit]):
            some = hit & (block == name)
            out.append((int(name), _spans(row[some], place[some] - last[some], place[some] - first[some] + length)))
        return pa.concat_tables([known, pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])])

    return work


def _compare(here: slice, same: np.ndarray, doc: np.ndarray, ahead: np.ndarray, behind: np.ndarray, near: np.ndarray, near_at: np.ndarray, length: int, back: int, first: np.ndarray, last: np.ndarray) -> None:
    """For suffixes in order, which windows around them also are in a smaller document; sets first and last of those that have any."""
    n = here.stop - here.start
    if n < 2:
        return
    same, doc, ahead, behind = same[here].copy(), doc[here], ahead[here], behind[here]
    same[0] = 0
    spread = np.arange(back)
    left = near[np.minimum(near_at[:, None] + spread, len(near) - 1)] * (spread < behind[:, None])
    by_left = np.argsort(left.view(f"S{back}").ravel(), kind="stable")
    differ = left[by_left[1:]] != left[by_left[:-1]]
    alike = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), back))  # bytes that each shares with the one before, in the order of what is to the left
    beside = np.zeros(n, np.int64)
    for d in range(back + 1):
        beside[by_left] = np.cumsum(alike < d)
        fits = np.flatnonzero((d <= behind) & (length - d <= ahead))
        if len(fits) < 2:
            continue
        key = np.cumsum(same < length - d)[fits] * (n + 1) + beside[fits]  # equal for equal windows only
        order = np.lexsort([doc[fits], key])
        head = np.append(True, key[order][1:] != key[order][:-1])
        least = doc[fits][order][head][np.cumsum(head) - 1]
        hit = fits[order][doc[fits][order] > least]
        last[here.start + hit] = d
        hit = hit[first[here.start + hit] < 0]
        first[here.start + hit] = d


def _cut(length: int):  # noqa: ANN202
    def work(there: pa.Table, spans: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        docs = thawed(there["docs"][0].as_buffer()) if there.num_rows else None
        if docs is None:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), span, pa.binary(), pa.string())], names=names)
        data, offsets = buffers(docs["text"])
        rows = np.frombuffer(b"".join(spans["data"].to_pylist()), np.int64).reshape(-1, 3)
        rows = np.frombuffer(_spans(rows[:, 0], rows[:, 1], rows[:, 2]), np.int64).reshape(-1, 3)
        at = np.searchsorted(rows[:, 0], np.arange(len(offsets))).astype(np.int32)
        kept, hashes = [], []
        for i in range(len(offsets) - 1):
            raw, done, pieces = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
            for _, start, end in rows[at[i] : at[i + 1]].tolist():
                pieces.append(raw[done:start])
                done = end
            kept.append(b"".join([*pieces, raw[done:]]))
            hashes.append(sha256(kept[-1]).hexdigest())
        inner = pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2] - rows[:, 1])], ["start", "length"])
        return pa.table([docs["doc_id"].combine_chunks(), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at), inner).cast(span), pa.array(kept, pa.binary()), pa.array(hashes)], names=names)

    return work


def _spare(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters that it begins or ends within."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _shorten(kinds: pa.Schema):  # noqa: ANN202
    def work(there: pa.Table, spans: pa.Table) -> pa.Table:
        if not there.num_rows:
            return kinds.empty_table()
        docs = thawed(there["docs"][0].as_buffer()).combine_chunks()
        rows = np.frombuffer(b"".join(spans["data"].to_pylist()), np.int64).reshape(-1, 3)
        rows = np.frombuffer(_spans(rows[:, 0], rows[:, 1], rows[:, 2]), np.int64).reshape(-1, 3)
        texts, keep = docs["text"].to_pylist(), np.ones(docs.num_rows, bool)
        changed = np.unique(rows[:, 0]).tolist()
        at = np.searchsorted(rows[:, 0], [*changed, docs.num_rows])
        for k, i in enumerate(changed):
            raw, done, pieces = texts[i].encode(), 0, []
            for _, start, end in rows[at[k] : at[k + 1]].tolist():
                start, end = _spare(raw, start, end)
                pieces.append(raw[done:start])
                done = end
            texts[i] = b"".join([*pieces, raw[done:]]).decode()
            keep[i] = bool(texts[i])
        at = docs.schema.get_field_index("text")
        out = docs.set_column(at, docs.schema.field(at), pa.array(texts, docs.schema.field(at).type))
        if (at := docs.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(docs.schema.field(at).type):
            sizes = docs["n_chars"].to_pylist()
            for i in changed:
                sizes[i] = len(texts[i])
            out = out.set_column(at, docs.schema.field(at), pa.array(sizes, docs.schema.field(at).type))
        return out.filter(pa.array(keep))

    return work


def _repeats(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of docs, spans to remove by block)."""
    rows = blocks(docs, size=SORT_BYTES)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = int(total // RANGE_BYTES) + 1
    asked = rows.select("block", "docs").mapInArrow(_requests(ranges, length, gram), "range int, block long, values binary")
    answers = settled(asked.groupBy("range").applyInArrow(_trimmed(_shared), "range int, block long, values binary"))
    by = rows.select("block", "docs").groupBy("block")
    runs = by.cogroup(answers.groupBy("block")).applyInArrow(_trimmed(_sort_block(ranges, length, gram)), "range int, block long, data binary, known binary")
    return rows.select("block", "docs"), settled(runs.groupBy("range").applyInArrow(_trimmed(_merge_range(length, gram)), "block long, data binary"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, length>>, kept binary, kept_sha256) of every row.

    Removes each byte that lies in a string of `length` bytes which also starts in a document with a smaller doc_id; matches stay within a
    document, overlaps count, and all strings are taken from the input. spans are the maximal removed runs in UTF-8 bytes.

    A null text is empty; texts shorter than length lose nothing. Rows with the same doc_id don't count against each other; a null doc_id is
    after all others, and nothing is removed for its sake. Columns other than doc_id and text are ignored. Empty tables give no rows.
    """
    rows, spans = _repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram)
    cut = "doc_id long, n_bytes long, spans array<struct<start: bigint, length: bigint>>, kept binary, kept_sha256 string"
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_trimmed(_cut(length)), cut)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with all their columns, less the bytes that remove_repeats finds, up to whole characters; n_chars, if any, follows.

    A document of which nothing is left goes; one that was empty or null before stays. doc_id is a whole number.
    """
    rows, spans = _repeats(docs, length, gram)
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_trimmed(_shorten(to_arrow_schema(docs.schema))), docs.schema)
